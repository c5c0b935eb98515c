"""The registered queries of the corpus operators, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import (
    archives,
    bpe_stream,
    exact_dedup,
    language,
    licences,
    line_join,
    mixing,
    near_dedup,
    outliers,
    packing,
    resident_lloyd,
    threshold_negatives,
    token_records,
)
from quillstone.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


@query("op1_licence_scan", licences.oracle())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_scan(table(spark, folder, "documents"))


@query(
    "op2_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op3_arc_to_warc")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive_pages(table(spark, folder, "pages"))


@query(
    "op4_mix_sources",
    r"""
    WITH d AS (
      SELECT doc_id, source, length(coalesce(text, '')) AS chars,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT + 0.5::DOUBLE)
               / 281474976710656.0::DOUBLE AS u
      FROM documents),
    k AS (SELECT *, -ln(u) / CASE WHEN size > 0 AND chars >= 3 * size AND chars <= 13 * size THEN 1.0::DOUBLE
                                  ELSE 0.25::DOUBLE END AS k FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                      WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
                 2.0::DOUBLE * source_size AS lim FROM s),
    l AS (SELECT *, row_number() OVER o AS place,
                 (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
                  - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY lim / w, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w WINDOW o AS (ORDER BY lim / w, source NULLS LAST)),
    t AS (SELECT source, source_size,
                 least(lim, (SELECT level FROM l WHERE level * w <= lim ORDER BY place LIMIT 1) * w) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                 sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM r
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).drop("copies")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, folder, "documents"), tokenizer_file(), block_chars=1 << 19)


@query("op7_outliers")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality(table(spark, folder, "documents")).drop("distance")


@query("op8_token_records")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_records.token_records(table(spark, folder, "documents"), tokenizer_file())


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return line_join.line_dedup(table(spark, folder, "documents"))


@query("op10_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, folder, "documents"), shingle=3, percent=85)


@query(
    "op11_hard_negatives",
    """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label,
             CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score,
           score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE own <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 3
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold_negatives.hard_negatives(
        rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"))
    )


@query("op12_bpe_stream")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_stream.round_trip(table(spark, folder, "documents"), tokenizer_file())


@query("op13_resident_codes")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return resident_lloyd.vector_codes(table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector"))
