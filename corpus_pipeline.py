"""The corpus pipeline: documents with a language, without exact and near copies, mixed by source, packed for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import exact_dedup, language, mixing, near_dedup, packing
from quillstone.llm.common import BATCH_BYTES, materialise
from quillstone.llm.queries import tokenizer_file
from quillstone.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts and texts without letters.

    The rows are computed when the caller writes them, so the bound on their Arrow batches is set for the session and
    stays; results do not depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return language.identified_rows(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so rows may repeat and some documents go."""
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset; a repeated document is packed as often."""
    return packing.best_fit_packing(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

# Language prediction and token ids have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
