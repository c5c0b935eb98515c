"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import normalize_text
from quillstone.operators import chunking as ck
from quillstone.plans import duck
from quillstone.plans.inputs import DUCK_MARKDOWN_DOCS, markdown_docs
from quillstone.plans.registry import query
from quillstone.sources.tables import texts


@query(
    "sliding_chunks",
    f"SELECT doc_id, slice_ix, char_start, char_end, md5(content) AS content_md5 FROM ("
    f"{duck.slices('documents', 'doc_id', duck.normalize('text'))})",
)
def sliding_chunks(spark, folder):
    docs = texts(spark, folder, "documents").select("doc_id", "text")
    cut = ck.sliding_chunks(docs, normalize_text("text"))
    return cut.select(
        "doc_id",
        F.col("slice_ix").cast("long").alias("slice_ix"),
        F.col("char_start").cast("long").alias("char_start"),
        F.col("char_end").cast("long").alias("char_end"),
        F.md5("content").alias("content_md5"),
    )


@query(
    "plain_text_chunks",
    f"""
    WITH d AS (SELECT doc_id, coalesce(nullif(lang, 'fr'), '未命名文档') AS title, text FROM documents WHERE {duck.has_text('text')})
    SELECT doc_id || '-chunk-' || lpad(slice_ix::VARCHAR, 4, '0') || '-' || substr(sha1(slice_ix || chr(0) || content), 1, 10) AS chunk_id,
           title AS heading_path, slice_ix::INTEGER AS chunk_index, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end,
           md5({duck.strip("'文档：' || title || chr(10) || '章节：' || title || chr(10) || chr(10) || content")}) AS embedding_md5
    FROM ({duck.slices('d', 'doc_id, title', duck.strip('text'), 400, 60, 30)})
    """,
)
def plain_text_chunks(spark, folder):
    docs = texts(spark, folder, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("title"), "text")
    chunks = ck.plain_text_chunks(docs, max_chars=400, overlap_chars=60, min_chars=30)
    return chunks.select(
        "chunk_id",
        F.array_join("heading_path", " > ").alias("heading_path"),
        "chunk_index",
        "char_start",
        "char_end",
        F.md5("embedding_text").alias("embedding_md5"),
    )


def _duck_levels() -> tuple[str, str]:
    seen = ", ".join(
        f"max(CASE WHEN level = {i} THEN pos END) OVER w AS p{i}, "
        f"last_value(CASE WHEN level = {i} THEN head END IGNORE NULLS) OVER w AS t{i}"
        for i in range(1, 7)
    )
    live = ", ".join(
        f"CASE WHEN p{i} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, i))}) THEN t{i} END"
        for i in range(1, 7)
    )
    return seen, live


SEEN, LIVE = _duck_levels()
HEAD = ck.HEADING

def duck_sections(docs: str) -> str:
    """Sections of (doc_id, title, text); ``paths`` has the heading path as a list."""
    return f"""
    docs AS ({docs}),
    lines AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
    fenced AS (SELECT *, sum(regexp_matches(line, {duck.text(ck.FENCE)})::INT)
                         OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS in_fence FROM lines),
    heads AS (SELECT *, NOT in_fence AND regexp_matches(line, {duck.text(HEAD)}) AS is_head FROM fenced),
    leveled AS (SELECT *, CASE WHEN is_head THEN length(regexp_extract(line, {duck.text(HEAD)}, 1)) END AS level,
                       CASE WHEN is_head THEN {duck.strip(f"regexp_extract(line, {duck.text(HEAD)}, 2)")} END AS head FROM heads),
    seen AS (SELECT *, sum(is_head::INT) OVER w AS section_id, {SEEN} FROM leveled
             WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    pathed AS (SELECT *, array_to_string(paths, ' > ') AS path FROM (
        SELECT *, CASE WHEN is_head THEN list_filter([{LIVE}], lambda x: x IS NOT NULL) END AS paths FROM seen)),
    all_sections AS (SELECT doc_id, any_value(title) AS title, section_id::BIGINT AS section_id,
                 CASE WHEN section_id = 0 THEN any_value(title) ELSE max(head) END AS section_title,
                 CASE WHEN section_id = 0 THEN 1 ELSE max(level) END AS heading_level,
                 CASE WHEN section_id = 0 THEN any_value(title) ELSE max(path) END AS heading_path,
                 CASE WHEN section_id = 0 THEN [any_value(title)] ELSE max(paths) END AS paths,
                 {duck.normalize("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_head), '')")} AS content
                 FROM pathed GROUP BY doc_id, section_id),
    sections AS (SELECT * FROM all_sections WHERE length(content) > 0)
"""


DUCK_SECTIONS = duck_sections(DUCK_MARKDOWN_DOCS)


@query(
    "markdown_sections",
    f"""
    WITH {DUCK_SECTIONS}
    SELECT doc_id, section_id, section_title, heading_level::INTEGER AS heading_level, heading_path, md5(content) AS content_md5 FROM sections
    """,
)
def markdown_sections(spark, folder):
    sections = ck.markdown_sections(markdown_docs(spark, folder))
    return sections.select(
        "doc_id",
        "section_id",
        "section_title",
        "heading_level",
        F.array_join("heading_path", " > ").alias("heading_path"),
        F.md5("content").alias("content_md5"),
    )


@query(
    "heading_path",
    f"WITH {DUCK_SECTIONS} SELECT doc_id, pos::INTEGER AS pos, level::INTEGER AS level, path AS heading_path FROM pathed WHERE is_head",
)
def heading_path(spark, folder):
    lines = ck.headed_lines(markdown_docs(spark, folder)).where("is_head")
    return lines.select("doc_id", "pos", "level", F.array_join("path", " > ").alias("heading_path"))


@query(
    "section_pairs",
    f"WITH {DUCK_SECTIONS} SELECT doc_id, section_id, section_title, md5(content) AS content_md5 FROM all_sections WHERE section_id > 0",
)
def section_pairs(spark, folder):
    pairs = ck.section_pairs(markdown_docs(spark, folder))
    return pairs.select("doc_id", "section_id", "section_title", F.md5("content").alias("content_md5"))


DUCK_CHUNKS = f"""
    {DUCK_SECTIONS},
    cut AS ({duck.slices('sections', 'doc_id, title, section_id, section_title, heading_level, heading_path', 'content', 400, 60, 30)}),
    chunks AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY section_id, slice_ix) - 1)::INTEGER AS chunk_index FROM cut)
"""
SMALL = {"max_chars": 400, "overlap_chars": 60, "min_chars": 30}


@query(
    "chunk_document",
    f"""
    WITH {DUCK_CHUNKS}
    SELECT doc_id || '-chunk-' || lpad(chunk_index::VARCHAR, 4, '0') || '-' || substr(sha1(chunk_index || chr(0) || content), 1, 10) AS chunk_id,
           chunk_index, (slice_ix + 1)::INTEGER AS section_chunk_index, char_start::INTEGER AS char_start, char_end::INTEGER AS char_end,
           heading_path, section_title,
           md5({duck.strip("'文档：' || title || chr(10) || '章节：' || heading_path || chr(10) || chr(10) || content")}) AS embedding_md5
    FROM chunks
    """,
)
def chunk_document(spark, folder):
    chunks = ck.chunk_document(markdown_docs(spark, folder), **SMALL)
    return chunks.select(
        "chunk_id",
        "chunk_index",
        "section_chunk_index",
        "char_start",
        "char_end",
        F.array_join("heading_path", " > ").alias("heading_path"),
        "section_title",
        F.md5("embedding_text").alias("embedding_md5"),
    )


@query(
    "table_preserving_text",
)
def table_preserving_text(spark, folder):
    sections = ck.markdown_sections(markdown_docs(spark, folder))
    return sections.select("doc_id", "section_id", ck.strip_inline_markup("content").alias("content"))


@query(
    "chunk_stats",
    f"""
    WITH {DUCK_CHUNKS}
    SELECT title, count(*) AS chunk_count, min(length(content))::INTEGER AS min_chars, max(length(content))::INTEGER AS max_chars,
           round(avg(length(content)), 6) AS avg_chars, arg_min(heading_path, (doc_id, chunk_index)) AS first_path,
           arg_max(heading_path, (doc_id, chunk_index)) AS last_path
    FROM chunks GROUP BY title
    """,
)
def chunk_stats(spark, folder):
    stats = ck.chunk_stats(ck.chunk_document(markdown_docs(spark, folder), **SMALL), "title")
    return stats.withColumn("avg_chars", F.round("avg_chars", 6))


@query(
    "page_range_chunks",
    f"""
    WITH RECURSIVE pages AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) + 1 AS page FROM documents),
    pars AS (SELECT doc_id, page, {duck.normalize('t')} AS p FROM pages),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS j, count(*) OVER (PARTITION BY doc_id) AS n FROM pars WHERE length(p) > 0),
    gathered AS (
      SELECT DISTINCT doc_id, 0::BIGINT AS j, '' AS buffer, NULL::BIGINT AS start, NULL::BIGINT AS page, NULL::VARCHAR AS done, NULL::BIGINT AS done_start FROM placed
      UNION ALL
      SELECT doc_id, j, CASE WHEN length(b) >= 900 THEN right(b, 120) ELSE b END, CASE WHEN length(b) >= 900 THEN page ELSE s END, page,
             CASE WHEN length(b) >= 900 THEN b END, s
      FROM (SELECT x.doc_id, x.j, x.page, coalesce(g.start, x.page) AS s, {duck.strip("g.buffer || chr(10) || x.p")} AS b
            FROM gathered g JOIN placed x ON x.doc_id = g.doc_id AND x.j = g.j + 1)),
    chunks AS (
      SELECT doc_id, j, 0 AS rest, done_start AS page_start, page AS page_end, done AS content FROM gathered WHERE done IS NOT NULL
      UNION ALL
      SELECT doc_id, j, 1, start, page, {duck.strip('buffer')} FROM gathered JOIN (SELECT DISTINCT doc_id, n FROM placed) USING (doc_id) WHERE j = n AND {duck.has_text('buffer')}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j, rest) AS ordinal FROM chunks)
    SELECT doc_id, 'chunk-' || CASE WHEN ordinal < 10000 THEN lpad(ordinal::VARCHAR, 4, '0') ELSE ordinal::VARCHAR END || '-' ||
           substr(sha1(page_start || ':' || page_end || ':' || content), 1, 12) AS chunk_id,
           ordinal::INTEGER AS ordinal, page_start::INTEGER AS page_start, page_end::INTEGER AS page_end, content
    FROM numbered
    """,
)
def page_range_chunks(spark, folder):
    docs = texts(spark, folder, "documents")
    # every line of a document is one page here
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return ck.page_range_chunks(pages.withColumn("page", F.col("page") + 1))
