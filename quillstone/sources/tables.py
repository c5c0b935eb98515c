"""Readers of base tables and of line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import has_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Below this many bytes per core a table is too small for its file splits to keep all cores busy.
SMALL_SPLIT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table out to all cores, ahead of costly work on texts.

    A large table has enough splits of its own and is read as it is. The size is the scan's estimate, so nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SMALL_SPLIT else df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts, spread when it is small."""
    return spread(table(spark, folder, name))


def list_table(df: DataFrame, *order: Column) -> DataFrame:
    """Every row, newest (or whatever the order says) first; a range-partitioned sort."""
    return df.orderBy(*order)


CHUNK_LINE = (
    "chunkIndex int, sectionTitle string, headingPath array<string>, content string, embeddingText string"
)


def chunk_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Chunk export lines (one JSON object each, blank lines skipped) with their defaults filled in."""
    row = lines.where(has_text(F.col(value))).withColumn("_row", F.from_json(F.col(value), CHUNK_LINE))
    title = F.when(has_text(F.col("_row.sectionTitle")), F.col("_row.sectionTitle")).otherwise("document")
    content = F.coalesce("_row.content", F.lit(""))
    path = F.col("_row.headingPath")
    passthrough = [c for c in lines.columns if c != value]
    return row.select(
        *passthrough,
        F.format_string("chunk-%04d", F.col("_row.chunkIndex")).alias("chunk_id"),
        F.col("_row.chunkIndex").alias("chunk_index"),
        title.alias("document_title"),
        F.when(F.size(path) > 0, path).otherwise(F.array(title)).alias("heading_path"),
        content.alias("content"),
        F.when(F.length("_row.embeddingText") > 0, F.col("_row.embeddingText"))
        .otherwise(content)
        .alias("embedding_text"),
    )


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    return chunk_lines(spark.read.text(path))


QUESTION_LINE = (
    "id string, question string, answer string, relevant_chunk_id string, answer_source string, "
    "heading_path array<string>, question_type string"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_LINE).json(path)
