"""Reference-shaped tables derived from the given ones.

Derivations are written once, in SQL that Spark and DuckDB both read, so the checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans import duck
from quillstone.sources.tables import table, texts


def derived(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(*columns)


def duck_select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


# documents as uploads: file names of every kind the format gate has to judge.
UPLOAD = [
    "doc_id",
    "source AS kb_id",
    "text",
    "CASE doc_id % 9 WHEN 0 THEN 'Doc: ' || CAST(doc_id AS STRING) || '.MD' "
    "WHEN 1 THEN 'notes/' || CAST(doc_id AS STRING) || '.txt' "
    "WHEN 2 THEN CAST(doc_id AS STRING) || '.v2.Pdf' "
    "WHEN 3 THEN 'file' || CAST(doc_id AS STRING) "
    "WHEN 4 THEN CAST(doc_id AS STRING) || '.exe' "
    "WHEN 5 THEN CAST(doc_id AS STRING) || '.html' "
    "WHEN 6 THEN 'a*' || CAST(doc_id AS STRING) || '?.docx' "
    "WHEN 7 THEN '  ' ELSE CAST(doc_id AS STRING) || '.markdown' END AS filename",
    "CAST(n_chars * (doc_id % 5) * 20000 AS BIGINT) AS size",
]

# documents as Markdown: the first letter of a line turns its first word into a heading or opens a fence.
MARKDOWN_RULES = [
    (r"(^|\n)([A-D]\S*) ", "$1# $2\n"),
    (r"(^|\n)([E-H]\S*) ", "$1## $2 ##\n"),
    (r"(^|\n)([IN]\S*) ", "$1### $2\n"),
    (r"(^|\n)([O-S]\S*) ", "$1##### $2\n"),
    (r"(^|\n)(Wh\S*) ", "$1```\n$2 "),
]


def markdown_text(text: Column) -> Column:
    for pattern, to in MARKDOWN_RULES:
        text = F.regexp_replace(text, pattern, to)
    return text


def duck_markdown(x: str) -> str:
    for pattern, to in MARKDOWN_RULES:
        x = duck.sub(x, pattern, to.replace("$1", "\\1").replace("$2", "\\2"))
    return x


def markdown_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents")
    title = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", title.alias("title"), markdown_text(F.col("text")).alias("text"))


DUCK_MARKDOWN_DOCS = (
    f"SELECT doc_id, 'doc-' || doc_id || '.md' AS title, {duck_markdown('text')} AS text FROM documents"
)


def plain_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents")
    return docs.select("doc_id", F.col("source").alias("kb_id"), F.col("lang").alias("title"), "text")


# conversations as chat messages.
MESSAGE = ["conv_id AS session_id", "turn AS pos", "role", "text AS content"]


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return derived(table(spark, folder, "conversations"), MESSAGE)


DUCK_MESSAGES = duck_select(MESSAGE, "conversations")
