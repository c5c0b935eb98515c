"""The searchable corpus: chunks of the documents table, the question set, and their candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import lexical_features, normalize_text
from quillstone.operators.chunking import slices
from quillstone.operators.embedding import DIM, embed_features
from quillstone.operators.nearest import knn_topk
from quillstone.plans import duck
from quillstone.sources.tables import table, texts

# A chunk id is the document id and the slice number in one integer.
SLICE_BITS = 20


def chunk_id(doc_id: Column, slice_ix: Column) -> Column:
    """One integer for both; ids and slice numbers that do not fit raise, as they would name another document's text."""
    id_ = doc_id.cast("long")
    fits = (id_ >= -(1 << 63 - SLICE_BITS)) & (id_ < 1 << 63 - SLICE_BITS) & (slice_ix < 1 << SLICE_BITS)
    beyond = F.raise_error(F.concat(F.lit("no room in a chunk number for document "), id_.cast("string"))).cast("long")
    return F.when(fits, F.shiftleft(id_, SLICE_BITS) + slice_ix).otherwise(beyond)


def document_of(chunk: Column) -> Column:
    return F.shiftright(chunk, SLICE_BITS)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, doc_id, kb_id, title, chunk_order, content of every slice of every document; no shuffle."""
    docs = texts(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    cut = docs.withColumn("_s", F.explode(slices(normalize_text("text"))))
    key = chunk_id(F.col("doc_id"), F.col("_s.ix"))
    return cut.select(
        key.alias("chunk_id"),
        "doc_id",
        F.col("source").alias("kb_id"),
        F.col("lang").alias("title"),
        key.alias("chunk_order"),
        F.col("_s.content").alias("content"),
    )


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    embedded = embed_features(chunks, ["chunk_id"], lexical_features("content"))
    return embedded.withColumnRenamed("embedding", "vector")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark passages as questions whose answer is the passage itself."""
    items = table(spark, folder, "benchmark")
    return items.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("answer_source")
    )


def question_vectors(asked: DataFrame) -> DataFrame:
    return embed_features(asked, ["query_id"], lexical_features("query")).withColumnRenamed("embedding", "vector")


def with_chunk_rows(found: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds document_id, document_title, metadata and content to rows with a chunk_id.

    Only the documents that hold a hit are cut again, and of those only the hit slices are kept.
    """
    docs = texts(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    keyed = found.withColumn("doc_id", document_of(F.col("chunk_id")))
    joined = keyed.join(docs, "doc_id")
    place = F.col("chunk_id").bitwiseAND((1 << SLICE_BITS) - 1).cast("int")
    return joined.select(
        *found.columns,
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("document_title"),
        F.to_json(F.struct(F.col("source").alias("kb"))).alias("metadata"),
        F.get(slices(normalize_text("text")), place)["content"].alias("content"),
    )


def candidates(spark: SparkSession, folder: str, k: int = 20) -> DataFrame:
    """The k nearest chunks of every question, with their texts."""
    asked = questions(spark, folder)
    found = knn_topk(chunk_vectors(corpus(spark, folder)), question_vectors(asked), k)
    full = with_chunk_rows(found.withColumnRenamed("rank", "raw_rank"), spark, folder)
    return full.join(asked, "query_id")


DUCK_CORPUS = f"""
    corpus AS (SELECT doc_id * {1 << SLICE_BITS} + slice_ix AS chunk_id, doc_id, source AS kb_id, lang AS title, content
               FROM ({duck.slices('documents', 'doc_id, source, lang', duck.normalize('text'))})),
    questions AS (SELECT item_id AS query_id, text AS query, text AS answer_source FROM benchmark)
"""


def duck_unit(source: str, keep: str, text: str) -> str:
    return f"""
    SELECT {keep}, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS vector
    FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
          FROM (SELECT {keep}, list_transform(range({DIM}), lambda i: len(list_filter(slots, lambda s: s = i))::DOUBLE) AS v
                FROM (SELECT {keep}, list_transform({duck.features(text)},
                             lambda f: ('0x' || substr(md5(f), 1, 8))::BIGINT % {DIM}) AS slots FROM {source})))
    """


def duck_distance(a: str, b: str, rounded: bool = True) -> str:
    raw = f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    return f"round({raw}, 9)" if rounded else raw


DUCK_CANDIDATES = f"""
    {DUCK_CORPUS},
    cvec AS ({duck_unit('corpus', 'chunk_id', 'content')}),
    qvec AS ({duck_unit('questions', 'query_id', 'query')}),
    pairs AS (SELECT query_id, chunk_id, {duck_distance('c.vector', 'q.vector')} AS distance FROM cvec c CROSS JOIN qvec q),
    knn AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + distance) AS score,
                   row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS raw_rank
            FROM pairs QUALIFY raw_rank <= 20),
    candidates AS (SELECT query_id, query, answer_source, chunk_id, distance, score, raw_rank, doc_id AS document_id,
                          title AS document_title, '{{"kb":"' || kb_id || '"}}' AS metadata, content
                   FROM knn JOIN corpus USING (chunk_id) JOIN questions USING (query_id))
"""
