"""Queries over the knowledge index: uploads to a chunk-and-vector table, and searches within a base."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.operators import knowledge as kn
from quillstone.operators import retrieval as rt
from quillstone.plans import corpus as cp
from quillstone.plans import duck
from quillstone.plans.chunk_plans import duck_sections
from quillstone.plans.inputs import UPLOAD, derived, duck_markdown, duck_select, markdown_text
from quillstone.plans.registry import query
from quillstone.plans.retrieval_plans import _duck_log_odds, duck_policy
from quillstone.session import work_dir
from quillstone.sources.tables import table, texts


def uploads(spark, folder):
    """The documents table as uploads of Markdown text."""
    return derived(texts(spark, folder, "documents"), UPLOAD).withColumn("text", markdown_text(F.col("text")))


def index(spark, folder):
    path = work_dir(spark, "knowledge")
    kn.write_index(kn.uploaded_chunks(uploads(spark, folder)), path)
    return kn.read_index(spark, path)


def asked(spark, folder):
    """The benchmark passages as questions, each to one base: sources in order, dealt out by the question's number."""
    sources = table(spark, folder, "documents").select(F.col("source").alias("kb_id")).where("source IS NOT NULL").distinct()
    placed = sources.withColumn("_i", F.row_number().over(Window.orderBy("kb_id")) - 1)
    items = cp.questions(spark, folder).join(F.broadcast(sources.agg(F.count("*").alias("_n"))))
    return items.join(placed, F.col("query_id") % F.col("_n") == F.col("_i")).select("query_id", "kb_id", "query")


_TITLED = f"""CASE WHEN NOT {duck.has_text('text')} THEN '' WHEN regexp_matches(text, '(?m)^[\\t-\\r\\x1c-\\x20]*#') THEN text
              ELSE '# ' || filename || chr(10) || chr(10) || text END"""
_PATH = "array_to_string(paths, ' > ')"
_EMBEDDING = duck.strip(f"'文档：' || title || chr(10) || '章节：' || {_PATH} || chr(10) || chr(10) || content")
DUCK_INDEX = f"""
    uploads AS (SELECT * REPLACE ({duck_markdown('text')} AS text) FROM ({duck_select(UPLOAD, 'documents')})),
    typed AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1)) ELSE 'unknown' END AS filetype FROM uploads),
    accepted AS (SELECT doc_id, kb_id, filename AS title, filetype, {_TITLED} AS text FROM typed
                 WHERE kb_id IS NOT NULL AND size <> 0 AND size <= {fixed.MAX_FILE_MB} * 1024 * 1024 AND filetype IN {duck.in_list(fixed.DIRECT_FORMATS)}),
    {duck_sections("SELECT doc_id, title, text FROM accepted WHERE filetype IN ('md', 'markdown')")},
    every_section AS (
      SELECT doc_id, title, section_id, section_title, heading_level, paths, content FROM sections
      UNION ALL
      SELECT doc_id, title, 0, title, 1, [title], {duck.strip('text')} FROM accepted WHERE filetype = 'txt' AND {duck.has_text('text')}),
    cut AS ({duck.slices('every_section', 'doc_id, title, section_id, section_title, heading_level, paths', 'content')}),
    numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section_id, slice_ix) - 1)::INTEGER AS chunk_index FROM cut),
    told AS (
      SELECT n.*, kb_id, doc_id || '-chunk-' || lpad(chunk_index::VARCHAR, 4, '0') || '-' || substr(sha1(chunk_index || chr(0) || content), 1, 10) AS chunk_id,
             to_json({{'documentTitle': title, 'sectionTitle': section_title, 'headingPath': paths, 'headingLevel': heading_level::INTEGER, 'sourceFileType': filetype,
                      'originalFileName': title, 'chunkIndex': chunk_index, 'sectionChunkIndex': (slice_ix + 1)::INTEGER, 'charStart': char_start::INTEGER,
                      'charEnd': char_end::INTEGER}})::VARCHAR AS metadata,
             {_EMBEDDING} AS embedding_text
      FROM numbered n JOIN (SELECT doc_id, kb_id, filetype FROM accepted) USING (doc_id)),
    vectors AS ({cp.duck_unit('(SELECT DISTINCT embedding_text FROM told)', 'embedding_text', 'embedding_text')}),
    chunk_table AS (SELECT kb_id, chunk_id, doc_id, title AS document_title, metadata, content, vector FROM told JOIN vectors USING (embedding_text))
"""
_SUM = "round(list_sum(list_transform(list_zip(vector, range(64)), lambda z: z[1] * (z[2] + 1))), 6)"


@query(
    "index_documents",
    f"WITH {DUCK_INDEX} SELECT kb_id, chunk_id, doc_id, document_title, metadata, md5(content) AS content_md5, {_SUM} AS check_sum FROM chunk_table",
)
def index_documents(spark, folder):
    weighed = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return index(spark, folder).select(
        "kb_id", "chunk_id", "doc_id", "document_title", "metadata", F.md5("content").alias("content_md5"), F.round(weighed, 6).alias("check_sum")
    )


@query("sink_chunks", f"WITH {DUCK_INDEX} SELECT kb_id, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(length(content))::BIGINT AS chars FROM chunk_table GROUP BY kb_id")
def sink_chunks(spark, folder):
    """What the written table holds per base after a second upload of a third of the documents, which changes nothing."""
    path = work_dir(spark, "knowledge")
    rows = kn.uploaded_chunks(uploads(spark, folder))
    kn.write_index(rows, path)
    again = F.col("doc_id") % 3 == 0
    kn.refresh_index(spark, path, rows.where(again), uploads(spark, folder).where(again).select("doc_id"))
    stored = kn.read_index(spark, path)
    return stored.groupBy("kb_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("content").cast("long")).alias("chars")
    )


# A passage asks in a base that may not hold it: the default scorer's log odds are below 0 for most texts that it meets.
LEAST = -1.5

DUCK_ASKED = """
    bases AS (SELECT source AS kb_id, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
    asked AS (SELECT item_id AS query_id, kb_id, text AS query FROM benchmark JOIN bases ON item_id % n = i)
"""
DUCK_RAG = f"""
    {DUCK_INDEX}, {DUCK_ASKED},
    qvec AS ({cp.duck_unit('asked', 'query_id, kb_id, query', 'query')}),
    pairs AS (SELECT query_id, kb_id, query, c.* EXCLUDE (kb_id, vector), {cp.duck_distance('c.vector', 'q.vector')} AS distance
              FROM chunk_table c JOIN qvec q USING (kb_id)),
    candidates AS (SELECT *, doc_id AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS raw_rank FROM pairs QUALIFY raw_rank <= 20),
    passages AS (SELECT *, document_title || chr(10) || metadata || chr(10) || content AS passage FROM candidates),
    scored AS (SELECT * EXCLUDE (q, t), {_duck_log_odds('q', 't')} AS rerank_score FROM (SELECT *, {duck.features('query')} AS q, {duck.features('passage')} AS t FROM passages)),
    crossed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, raw_rank)::INTEGER AS rerank FROM scored),
    {duck_policy('crossed', 3, None, LEAST, 3).replace('NULL::BIGINT AS chunk_id', 'NULL::VARCHAR AS chunk_id')}
"""


def searched(spark, folder):
    return kn.rag_search(index(spark, folder), asked(spark, folder), min_rerank_score=LEAST)


@query("rag_search", f"WITH RECURSIVE {DUCK_RAG} SELECT query_id, chunk_id, rerank::INTEGER AS rerank, filter_reason, rank FROM decided")
def rag_search(spark, folder):
    return searched(spark, folder).select("query_id", "chunk_id", "rerank", "filter_reason", "rank")


@query(
    "similarity_search",
    f"WITH RECURSIVE {DUCK_RAG} SELECT query_id, rank, md5(content) AS content_md5 FROM decided JOIN chunk_table USING (chunk_id) WHERE NOT filtered",
)
def similarity_search(spark, folder):
    return rt.similarity_search(searched(spark, folder)).select("query_id", "rank", F.md5("content").alias("content_md5"))
