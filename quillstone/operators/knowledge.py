"""The knowledge index: uploads to a chunk-and-vector table by knowledge base, and the search within a base.

The table has one row per chunk: kb_id, chunk_id, doc_id, document_title, metadata, content, content_key, vector; folders
are by kb_id. Chunk ids are texts that hold the document's id and a digest of the chunk, so any document id will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import text_key
from quillstone.operators.chunking import chunk_document, plain_text_chunks, trust_headings
from quillstone.operators.embedding import embed_with_cache
from quillstone.operators.inverted_file import nearest_by_key
from quillstone.operators.retrieval import cross_rerank, retrieval_policy, service_passage
from quillstone.session import BROADCAST_ROWS, broadcast_if_small, materialise
from quillstone.sources.files import chunk_rows, ensure_title, file_type, gate_format

MODEL = "hashed-features"
COLUMNS = ["kb_id", "chunk_id", "doc_id", "document_title", "metadata", "content", "content_key"]


def uploaded_chunks(uploads: DataFrame, trust: Column | None = None, **sizes: int) -> DataFrame:
    """Chunk rows, without vectors, of the uploads that pass the gate and need no converter.

    ``uploads``: doc_id, kb_id, filename, size, text. A title is put in front where a text has no heading. Headings cut
    Markdown files, or what ``trust`` says; other texts are cut as plain text. Rejected and blank uploads, and
    those without a base, have no rows.
    """
    gated = gate_format(uploads.withColumn("filetype", file_type(F.col("filename"))))
    accepted = gated.where("reject_reason IS NULL AND NOT requires_conversion AND kb_id IS NOT NULL")
    flag = F.lit(None).cast("boolean") if trust is None else trust
    titled = accepted.withColumn("text", ensure_title(F.col("text"), F.col("filename"))).withColumn("title", F.col("filename"))
    titled = titled.withColumn("_trusted", trust_headings(flag, F.col("filetype")))
    parts = ["doc_id", "title", "text"]
    headed = chunk_document(titled.where("_trusted").select(parts), **sizes)
    plain = plain_text_chunks(titled.where("NOT _trusted").select(parts), **sizes)
    rows = chunk_rows(headed.unionByName(plain, allowMissingColumns=True), titled)
    return rows.join(titled.select("doc_id", F.col("filename").alias("document_title")), "doc_id").select(
        "kb_id", F.col("id").alias("chunk_id"), "doc_id", "document_title", "metadata", "content",
        text_key(MODEL, F.col("embedding_text")).alias("content_key"), "embedding_text",
    )


def with_vectors(rows: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """Adds the vector of each row's embedding text; equal texts are embedded once."""
    found = embed_with_cache(rows.select(F.col("embedding_text").alias("text")), model=MODEL, embedder=embedder)
    return rows.join(found.select(F.col("key").alias("content_key"), F.col("embedding").alias("vector")), "content_key").select(*COLUMNS, "vector")


def write_index(rows: DataFrame, path: str, embedder: Callable | None = None) -> None:
    with_vectors(rows, embedder).write.mode("overwrite").partitionBy("kb_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("kb_id", F.col("kb_id").cast("string")).select(*COLUMNS, "vector")


def refresh_index(spark: SparkSession, path: str, rows: DataFrame, documents: DataFrame, embedder: Callable | None = None) -> dict[str, int]:
    """Brings the table up to date with all chunks ``rows`` of ``documents`` (doc_id): what is there no more goes.

    A chunk is the same if its base, id and content key are; only others are embedded, and only the folders of bases in
    which a row comes or goes are written. Documents that are not named stay as they are; one without rows is taken out.
    Returns how many rows came and went. The new folders are staged first, so a job that is cut short can be run again.
    """
    same = ["kb_id", "chunk_id", "content_key"]
    old = read_index(spark, path)
    named = documents.select("doc_id").distinct()
    rows = materialise(rows, "upload")
    came = materialise(with_vectors(rows.join(old.select(same), same, "left_anti"), embedder), "came")
    went = materialise(old.join(named, "doc_id", "left_semi").select(same).join(rows.select(same), same, "left_anti"), "went")
    touched = came.select("kb_id").union(went.select("kb_id")).distinct()
    counts = {"came": came.count(), "went": went.count()}
    if not any(counts.values()):
        return counts
    staged = old.join(touched, "kb_id", "left_semi").join(went, same, "left_anti").unionByName(came)
    staged = materialise(staged, "staged")
    emptied = touched.join(staged.select("kb_id").distinct(), "kb_id", "left_anti")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
    if not emptied.isEmpty():  # a base without a row left: an empty folder takes the place of its files
        _empty_folders(spark, path, emptied)
    return counts


def _empty_folders(spark: SparkSession, path: str, bases: DataFrame) -> None:
    """Overwrites the folders of bases that have no row left; they are few rows of one text each."""
    plain = spark.read.parquet(path).drop("kb_id")
    for row in bases.toLocalIterator():
        plain.where("false").write.mode("overwrite").parquet(f"{path}/kb_id={row.kb_id}")


def search_candidates(index: DataFrame, asked: DataFrame, k: int = fixed.RAW_TOP_K, embedder: Callable | None = None) -> DataFrame:
    """The k nearest chunks of each question's own base with their texts: (query_id, kb_id, query) in.

    The vectors of the asked bases alone are read. Texts are read for the hits only: their ids go to the scan where they
    are few enough to be handed to every task, and through a join of ids otherwise.
    """
    bases = [r.kb_id for r in asked.select("kb_id").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(bases) <= BROADCAST_ROWS:
        index = index.where(F.col("kb_id").isin(bases))
    vectors = embed_with_cache(asked.select(F.col("query").alias("text")), model=MODEL, embedder=embedder)
    keyed = asked.withColumn("key", text_key(MODEL, F.col("query"))).join(vectors.withColumnRenamed("embedding", "vector"), "key")
    found = nearest_by_key(index.select("kb_id", "chunk_id", "vector"), keyed.select("kb_id", "query_id", "vector"), "kb_id", k)
    hits = materialise(found.withColumnRenamed("rank", "raw_rank").join(asked, "query_id"), "hits")
    texts = index.select("kb_id", "chunk_id", F.col("doc_id").alias("document_id"), "document_title", "metadata", "content")
    wanted = broadcast_if_small(hits.select("kb_id", "chunk_id").distinct())
    return hits.join(texts.join(wanted, ["kb_id", "chunk_id"], "left_semi"), ["kb_id", "chunk_id"])


def rag_search(index: DataFrame, asked: DataFrame, embedder: Callable | None = None, scorer: Callable | None = None, **policy) -> DataFrame:
    """Questions within their bases: nearest chunks, model score of title, metadata and content, then the policy."""
    candidates = search_candidates(index, asked, embedder=embedder)
    return retrieval_policy(cross_rerank(candidates, scorer=scorer, passage=service_passage()), **policy)
