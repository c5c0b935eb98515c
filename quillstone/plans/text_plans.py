"""Queries over documents and pages: scans, file gate, text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyarrow import fs
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions import agents, text as tx
from quillstone.operators import overlap
from quillstone.operators.chunking import trust_headings
from quillstone.plans import duck
from quillstone.plans.inputs import DUCK_MARKDOWN_DOCS, UPLOAD, derived, duck_select, markdown_docs
from quillstone.plans.registry import query
from quillstone.session import work_dir
from quillstone.sources import files
from quillstone.sources.tables import chunk_lines, list_table, table, texts

DUCK_UPLOADS = duck_select(UPLOAD, "documents")


@query("scan_table", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def scan_table(spark, folder):
    docs = texts(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))
    return list_table(docs, F.col("n_chars").desc(), F.col("doc_id"))


LINE = (
    "CASE WHEN doc_id % 4 = 0 THEN ' ' WHEN doc_id % 4 = 1 THEN '{\"chunkIndex\": ' || CAST(doc_id AS STRING) || '}' "
    "WHEN doc_id % 4 = 2 THEN '{\"chunkIndex\": ' || CAST(doc_id AS STRING) || ', \"sectionTitle\": \"' || source || "
    "'\", \"content\": \"' || lang || '\"}' ELSE '{\"chunkIndex\": ' || CAST(doc_id AS STRING) || "
    "', \"sectionTitle\": \"\", \"headingPath\": [\"' || source || '\", \"' || lang || '\"], "
    "\"embeddingText\": \"e' || lang || '\"}' END"
)


@query(
    "scan_jsonl",
    f"""
    WITH l AS (SELECT {LINE} AS value, doc_id FROM documents),
    j AS (SELECT json_extract_string(value, '$.sectionTitle') AS st, json_extract_string(value, '$.content') AS c,
                 json_extract_string(value, '$.embeddingText') AS e, json_extract_string(value, '$.headingPath[0]') AS h0,
                 json_extract_string(value, '$.headingPath[1]') AS h1, doc_id FROM l WHERE trim(value) <> '')
    SELECT 'chunk-' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END AS chunk_id,
           CAST(doc_id AS INTEGER) AS chunk_index, coalesce(nullif(st, ''), 'document') AS document_title,
           CASE WHEN h0 IS NULL THEN coalesce(nullif(st, ''), 'document') ELSE h0 || '>' || h1 END AS heading_path,
           coalesce(c, '') AS content, coalesce(nullif(e, ''), c, '') AS embedding_text FROM j
    """,
)
def scan_jsonl(spark, folder):
    lines = texts(spark, folder, "documents").selectExpr(f"{LINE} AS value")
    return chunk_lines(lines).withColumn("heading_path", F.array_join("heading_path", ">"))


@query(
    "gate_format",
    f"""
    WITH u AS ({DUCK_UPLOADS}),
    t AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1))
                         ELSE 'unknown' END AS filetype FROM u)
    SELECT doc_id, kb_id, filename, filetype, size,
           CASE WHEN size = 0 THEN 'empty_file'
                WHEN filetype NOT IN {duck.in_list(fixed.ENABLED_FORMATS)} THEN 'unsupported_type'
                WHEN size > 150 * 1024 * 1024 THEN 'too_large' END AS reject_reason,
           filetype NOT IN {duck.in_list(fixed.DIRECT_FORMATS)} AS requires_conversion FROM t
    """,
)
def gate_format(spark, folder):
    uploads = derived(texts(spark, folder, "documents"), UPLOAD).drop("text")
    return files.gate_format(uploads.withColumn("filetype", files.file_type(F.col("filename"))))


@query(
    "ensure_title",
    f"""
    SELECT doc_id, md5(CASE WHEN NOT {duck.has_text('text')} THEN ''
                 WHEN regexp_matches(text, '(?m)^[\\t-\\r\\x1c-\\x20]*#') THEN text
                 ELSE '# ' || CASE WHEN trim(filename) <> '' THEN filename ELSE '{fixed.UNTITLED_DOCUMENT}' END
                      || chr(10) || chr(10) || text END) AS markdown_md5
    FROM ({DUCK_UPLOADS})
    """,
)
def ensure_title(spark, folder):
    uploads = derived(texts(spark, folder, "documents"), UPLOAD)
    return uploads.select("doc_id", F.md5(files.ensure_title(F.col("text"), F.col("filename"))).alias("markdown_md5"))


@query(
    "conversion_status",
    f"""
    WITH u AS ({DUCK_UPLOADS}),
    t AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1))
                         ELSE 'unknown' END AS filetype,
                 CASE WHEN trim(filename) <> '' THEN filename ELSE 'converted' END AS base FROM u)
    SELECT doc_id, CASE WHEN filetype IN {duck.in_list(fixed.DIRECT_FORMATS)} THEN 'direct' ELSE 'markitdown-cli' END AS tool,
           CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
           CASE WHEN doc_id % 7 = 0 THEN 'no text found' END AS error,
           regexp_replace(CASE WHEN instr(base, '.') > 0 AND length(regexp_extract(base, '^(.*)[.][^.]*$', 1)) > 0
                          THEN regexp_extract(base, '^(.*)[.][^.]*$', 1) ELSE base END,
                          '[\\\\/:*?"<>|]', '_', 'g') || '.converted.md' AS converted_name FROM t
    """,
)
def conversion_status(spark, folder):
    uploads = derived(texts(spark, folder, "documents"), UPLOAD)
    error = F.when(F.col("doc_id") % 7 == 0, "no text found")
    status = files.conversion_status(files.file_type(F.col("filename")), error)
    return uploads.select(
        "doc_id",
        status["tool"].alias("tool"),
        status["status"].alias("status"),
        status["error"].alias("error"),
        files.converted_name(F.col("filename")).alias("converted_name"),
    )


def _document_column(name: str, column: Callable[[Column], Column], sql: str, digest: bool = True) -> None:
    """One text function over every document; ``column`` gets the text column."""
    shown = "md5" if digest else ""

    @query(name, f"SELECT doc_id, {shown}({sql}) AS value FROM documents")
    def run(spark, folder):
        value = column(F.col("text"))
        docs = texts(spark, folder, "documents")
        return docs.select("doc_id", (F.md5(value) if digest else value).alias("value"))


_document_column("normalize_text", lambda t: tx.normalize_text(t), duck.normalize("text"))
_document_column("compact_text", lambda t: tx.compact_text(t), duck.compact("text"))
_document_column("normalize_content", lambda t: tx.normalize_content(t), f"trim({duck.sub('text', chr(92) + 's+', ' ')})")
_document_column("count_cjk", lambda t: tx.count_cjk(F.concat(t, F.lit("知识库 kb"))),
                 "length(" + duck.sub("text || '知识库 kb'", r"[^\x{4e00}-\x{9fff}]") + ")::INTEGER", digest=False)
_document_column("latin_tokens", lambda t: F.array_join(F.array_sort(tx.latin_tokens(t)), " "),
                 f"array_to_string(list_sort(list_distinct({duck.latin('text')})), ' ')")

def _cjk(t):
    return F.concat(F.lit("检索 "), F.col("source"), F.lit(" 质量カナ "), t, F.lit(" 결과"))


DUCK_CJK = "('检索 ' || source || ' 质量カナ ' || text || ' 결과')"
_document_column("cjk_ngrams", lambda t: F.array_join(F.array_sort(tx.cjk_ngrams(_cjk(t))), " "),
                 f"array_to_string(list_sort(list_distinct({duck.ngrams(DUCK_CJK)})), ' ')", digest=False)
_document_column("lexical_features", lambda t: F.array_join(F.array_sort(tx.lexical_features(_cjk(t), "scripts")), " "),
                 f"array_to_string(list_sort({duck.features(DUCK_CJK, duck.SCRIPTS)}), ' ')")
_document_column("searchable_text", lambda t: tx.searchable_text(F.nullif(F.col("lang"), F.lit("fr")), F.col("source"), t),
                 "coalesce(nullif(lang, 'fr'), '') || chr(10) || source || chr(10) || text")
_document_column("embedding_text",
                 lambda t: tx.embedding_text(F.col("lang"), F.array(F.col("source"), F.lit(" "), F.col("lang")), t),
                 duck.strip("'文档：' || lang || chr(10) || '章节：' || source || ' > ' || lang || chr(10) || chr(10) || text"))
_document_column("sha_keys",
                 lambda t: F.concat_ws("|", tx.text_key("m", t), tx.pair_key("m", F.col("lang"), F.col("source"), t),
                             tx.chunk_digest(F.col("doc_id"), t)),
                 "sha256('m' || chr(0) || text) || '|' || sha256('m' || chr(0) || lang || chr(0) || source || chr(0) || text)"
                 " || '|' || substr(sha1(doc_id::VARCHAR || chr(0) || text), 1, 10)", digest=False)
_document_column("contains_sensitive", lambda t: tx.contains_sensitive(t), f"regexp_matches(text, {duck.text(fixed.SENSITIVE_PATTERN)})", digest=False)
_document_column("has_text", lambda t: tx.has_text(F.nullif(F.substring_index(t, "\n", -1), F.lit("."))),
                 duck.has_text("nullif(regexp_extract(text, '([^\n]*)$', 1), '.')"), digest=False)
_document_column("truncate_field", lambda t: F.concat_ws("|", tx.truncate_json(t, 2000), tx.truncate_plain(t, 2000)),
                 "CASE WHEN length(text) > 2000 THEN '{\"content\":' || to_json(substr(text, 1, 2000))::VARCHAR || ',\"originalSize\":'"
                 " || length(text) || ',\"truncated\":true}' ELSE text END || '|' || substr(text, 1, 2000)")


def _dsml(t):
    return F.concat(F.lit(" <｜｜DSML｜｜tool_calls>"), F.col("source"), F.lit("</｜｜DSML｜｜tool_calls>\n"), t,
                    F.lit("<| |DSML| |tool_calls>x\ny</| |DSML| |tool_calls> "))


_document_column("strip_dsml", lambda t: tx.strip_dsml(_dsml(t)), duck.strip("text"))


@query(
    "lexical_score",
    f"SELECT doc_id, lang, round({duck.overlap('q', 'f')}, 6) AS lexical_score FROM (SELECT doc_id, lang, "
    f"{duck.features('text')} AS f, {duck.features(duck.text('The reten lement und 知识 ') + ' || source || lang')} AS q FROM documents)",
)
def lexical_score(spark, folder):
    docs = texts(spark, folder, "documents")
    asked = F.concat(F.lit("The reten lement und 知识 "), F.col("source"), F.col("lang"))
    return docs.select("doc_id", "lang", F.round(tx.lexical_score(asked, F.col("text")), 6).alias("lexical_score"))


@query(
    "remove_code_fences",
    f"SELECT doc_id, md5({duck.sub('text', '(?s)```.*?```|~~~.*?~~~')}) AS value FROM ({DUCK_MARKDOWN_DOCS})",
)
def remove_code_fences(spark, folder):
    return markdown_docs(spark, folder).select("doc_id", F.md5(tx.remove_code_fences("text")).alias("value"))


WEB_TEXT = "url || ' and `' || CAST(page_id AS STRING) || '` then https://www.site.org/' || CAST(page_id AS STRING) || '.,' || html"


@query(
    "strip_url_inline_code",
    "SELECT page_id, md5(" + duck.sub(duck.sub("x", f"https?://[^{tx.WS}]+"), "`([^`]+)`", "\\1") + f") AS value FROM (SELECT page_id, {WEB_TEXT} AS x FROM pages)",
)
def strip_url_inline_code(spark, folder):
    pages = texts(spark, folder, "pages").selectExpr("page_id", f"{WEB_TEXT} AS x")
    return pages.select("page_id", F.md5(tx.strip_url_inline_code("x")).alias("value"))


@query(
    "extract_urls",
    f"""
    SELECT page_id, u AS url, regexp_replace(regexp_extract(u, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www[.]', '') AS domain,
           count(*) AS times
    FROM (SELECT page_id, regexp_replace(unnest(regexp_extract_all(x, {duck.text(fixed.WEB_URL_PATTERN)})), '[.,;:]+$', '') AS u
          FROM (SELECT page_id, {WEB_TEXT} AS x FROM pages)) GROUP BY ALL
    """,
)
def extract_urls(spark, folder):
    pages = texts(spark, folder, "pages").selectExpr("page_id", f"{WEB_TEXT} AS x")
    urls = pages.select("page_id", F.explode(tx.extract_urls("x")).alias("url"))
    return urls.groupBy("page_id", "url", tx.url_domain("url").alias("domain")).agg(F.count("*").alias("times"))


@query(
    "lcs_substring_len",
    f"""
    WITH t AS (SELECT doc_id, {duck.compact('text')} AS c, {duck.compact("substr(text, greatest(1, length(text) // 2), 9 + doc_id % 5)")} AS p FROM documents)
    SELECT doc_id, len(list_filter(range(length(p) - 10), lambda i: contains(c, substr(p, i + 1, 11)))) > 0 AS over_limit FROM t
    """,
)
def lcs_substring_len(spark, folder):
    docs = texts(spark, folder, "documents")
    middle = F.substring(F.col("text"), F.greatest(F.lit(1), F.floor(F.length(F.col("text")) / 2).cast("int")), (F.col("doc_id") % 5 + 9).cast("int"))
    return docs.select("doc_id", tx.shares_long_substring(F.col("text"), middle, 10).alias("over_limit"))


DUCK_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _duck_windows(words: str) -> str:
    return f"list_transform(range(1, len({words}) - {overlap.WINDOW - 2}), lambda x: md5(array_to_string({words}[x:x + {overlap.WINDOW - 1}], ' ')))"


# The longest common run is found here from equal 8-grams that follow each other on one diagonal.
@query(
    "passage_overlaps",
    f"""
    WITH pw AS (SELECT DISTINCT passage_id, unnest({_duck_windows("words")}) AS ws FROM (SELECT item_id AS passage_id, {DUCK_WORDS} AS words FROM benchmark)),
    dw AS (SELECT DISTINCT doc_id, unnest({_duck_windows("words")}) AS ws FROM (SELECT doc_id, {DUCK_WORDS} AS words FROM documents)),
    pairs AS (SELECT passage_id, doc_id, count(*) AS n_windows FROM pw JOIN dw USING (ws) GROUP BY ALL),
    pc AS (SELECT item_id AS passage_id, {duck.compact('text')} AS c FROM benchmark WHERE item_id IN (SELECT passage_id FROM pairs)),
    dc AS (SELECT doc_id, {duck.compact('text')} AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM pairs)),
    pg AS (SELECT passage_id, unnest(list_transform(range(1, length(c) - 6), lambda x: {{'i': x, 'g': substr(c, x, 8)}}), recursive := true) FROM pc),
    dg AS (SELECT doc_id, unnest(list_transform(range(1, length(c) - 6), lambda x: {{'j': x, 'g': substr(c, x, 8)}}), recursive := true) FROM dc),
    met AS (SELECT passage_id, doc_id, j - i AS diagonal, j - row_number() OVER (PARTITION BY passage_id, doc_id, j - i ORDER BY j) AS run
            FROM pairs JOIN pg USING (passage_id) JOIN dg USING (doc_id, g)),
    runs AS (SELECT passage_id, doc_id, count(*) + 7 AS n FROM met GROUP BY passage_id, doc_id, diagonal, run)
    SELECT passage_id, doc_id, any_value(n_windows) AS n_windows, max(n)::INTEGER AS longest FROM runs JOIN pairs USING (passage_id, doc_id) GROUP BY ALL
    """,
)
def passage_overlaps(spark, folder):
    passages = table(spark, folder, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return overlap.passage_overlaps(passages, texts(spark, folder, "documents"))


FENCED = "CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) WHEN 1 THEN '``` ' ELSE '' END || '{\"n\": ' || CAST(n_chars AS STRING) || '}' || CASE doc_id % 3 WHEN 2 THEN '' ELSE chr(10) || '```' END"


@query("strip_json_fence", "SELECT doc_id, '{\"n\": ' || n_chars || '}' AS value, n_chars AS n FROM documents")
def strip_json_fence(spark, folder):
    body = tx.strip_json_fence("x")
    docs = texts(spark, folder, "documents").selectExpr("doc_id", f"{FENCED} AS x")
    return docs.select("doc_id", body.alias("value"), F.from_json(body, "n bigint")["n"].alias("n"))


@query(
    "load_vector_text",
    "SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, "
    "len(embedding) <> 64 AS rejected FROM embeddings",
)
def load_vector_text(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", tx.format_vector("embedding").alias("text"))
    loaded = vectors.select("vec_id", tx.parse_vector_text("text").alias("v"))
    return loaded.select(
        "vec_id",
        F.size("v").alias("dim"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"),
        (F.size("v") != 64).alias("rejected"),
    )


AGENT = [
    "p_partkey AS agent_id",
    "CASE WHEN p_size % 4 = 0 THEN 'glm-4.6' ELSE p_brand END AS model",
    "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / 500.0 - 1.0 END AS temperature",
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice / 1000.0 - 0.5 END AS top_p",
    "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size * 2 - 10 END AS auto_memory_interval",
]


@query(
    "normalise_agents",
    f"""
    SELECT agent_id, model,
      round(CASE WHEN temperature IS NULL THEN NULL ELSE greatest(0.0, least(CASE WHEN model = 'glm-4.6' THEN 1.0 ELSE 2.0 END, temperature)) END, 6) AS temperature,
      round(CASE WHEN top_p IS NULL THEN NULL ELSE greatest(0.0, least(1.0, top_p)) END, 6) AS top_p,
      CASE WHEN auto_memory_interval IS NULL THEN 10 ELSE greatest(3, least(50, auto_memory_interval)) END AS auto_memory_interval
    FROM ({duck_select(AGENT, "part")})
    """,
)
def normalise_agents(spark, folder):
    out = agents.normalise_agents(derived(table(spark, folder, "part"), AGENT))
    return out.withColumn("temperature", F.round("temperature", 6)).withColumn("top_p", F.round("top_p", 6))


@query(
    "trust_headings",
    f"""
    WITH t AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '([^.]*)$', 1))
                         ELSE 'unknown' END AS filetype, CASE doc_id % 11 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM ({DUCK_UPLOADS}))
    SELECT doc_id, coalesce(flag, filetype IN ('md', 'markdown'), false) AS trusted FROM t
    """,
)
def trust_headings_query(spark, folder):
    uploads = derived(texts(spark, folder, "documents"), UPLOAD)
    flag = F.when(F.col("doc_id") % 11 == 0, True).when(F.col("doc_id") % 11 == 1, False)
    return uploads.select("doc_id", trust_headings(flag, files.file_type(F.col("filename"))).alias("trusted"))


@query("html_to_markdown")
def html_to_markdown(spark, folder):
    return files.html_to_markdown(texts(spark, folder, "pages"), "page_id", "html")


# Documents as files of several types, each a few of them empty, badly encoded or too large.
FILE_NAME = "CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.exe' WHEN 3 THEN '.pdf' ELSE '.Markdown' END"
FILE_LIMIT_MB = 0.005


def written_files(spark, folder):
    """Writes one file per document to the shared folder, in folders by their number."""
    target = work_dir(spark, "files")

    def write(batches):
        for batch in batches:
            for doc_id, name, text in zip(batch["doc_id"], batch["name"], batch["text"]):
                system, root = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
                system.create_dir(f"{root}/{doc_id % 16}")
                body = b"" if doc_id % 11 == 0 else (text or "").encode() + (b"\xff" if doc_id % 13 == 0 else b"")
                with system.open_output_stream(f"{root}/{doc_id % 16}/{name}") as out:
                    out.write(body)
            yield batch[["doc_id"]]

    docs = texts(spark, folder, "documents").selectExpr("doc_id", f"{FILE_NAME} AS name", "text")
    docs.mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return target


@query(
    "ingest_files",
    f"""
    WITH f AS (SELECT {FILE_NAME} AS filename, doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(text, '') END AS text FROM documents),
    t AS (SELECT *, lower(regexp_extract(filename, '([^.]*)$', 1)) AS filetype, strlen(text) + CASE WHEN doc_id % 13 = 0 AND doc_id % 11 > 0 THEN 1 ELSE 0 END AS size FROM f),
    e AS (SELECT *, CASE WHEN size = 0 THEN 'empty_file' WHEN filetype NOT IN {duck.in_list(fixed.ENABLED_FORMATS)} THEN 'unsupported_type'
                         WHEN size > {int(FILE_LIMIT_MB * 1024 * 1024)} THEN 'too_large' WHEN filetype NOT IN {duck.in_list(fixed.DIRECT_FORMATS)} THEN 'needs an external converter'
                         WHEN doc_id % 13 = 0 THEN 'not_utf8' END AS error FROM t)
    SELECT filename, filetype, size, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error, CASE WHEN error IS NULL THEN md5(text) END AS markdown_md5 FROM e
    """,
)
def ingest_files(spark, folder):
    found = files.ingest_files(spark, written_files(spark, folder), max_mb=FILE_LIMIT_MB)
    return found.select("filename", "filetype", "size", "status", "error", F.md5("markdown").alias("markdown_md5"))
