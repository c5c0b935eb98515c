"""Mixing sources to target weights: weighted sampling by exponential keys, prefix-summed to word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
# Key ranges per source whose sizes are summed first; only the range that the budget ends in is sorted.
RANGES = 4096
SHARE = 1.5
MOST_EPOCHS = 2.0
SOURCE_WEIGHTS = (3.0, 1.0, 2.0)


def quality_weight(text: Column, words: Column) -> Column:
    """Weight of a document: 1 where words have 3 to 12 characters on average (a gap included), else a quarter."""
    chars = F.length(text)
    return F.when((chars >= 3 * words) & (chars <= 13 * words) & (words > 0), 1.0).otherwise(0.25)


def sampling_columns(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds size, _id, _key (exponential, divided by the weight; small keys go first) and _range to the documents."""
    text = F.coalesce("text", F.lit(""))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), ident)), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    out = docs.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long"))
    out = out.withColumn("_key", -F.log(uniform) / quality_weight(text, F.col("size")))
    return out.withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")),
            "_range": F.floor((1 - F.exp(-F.col("_key"))) * RANGES),
        }
    )


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): weights 3, 1, 2 by code point order, no target above ``most`` times its source.

    A target above its limit stops there and the excess goes to the others by weight. That ends at one level L with
    target = min(limit, L * weight); L is read off running sums over the sources in order of limit / weight. The
    window holds one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(SOURCE_WEIGHTS)
    weight = F.lit(SOURCE_WEIGHTS[-1])
    for i, w in enumerate(SOURCE_WEIGHTS[:-1]):
        weight = F.when(turn == i, w).otherwise(weight)
    rows = sizes.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * most)
    rising = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    full = F.sum("_limit").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    open_weight = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_place", F.row_number().over(rising)).withColumn(
        "_level", (total - F.coalesce(full, F.lit(0.0))) / open_weight
    )
    fits = F.col("_level") * F.col("_w") <= F.col("_limit")
    level = F.min(F.when(fits, F.struct("_place", "_level"))).over(everything)["_level"]
    return rows.select(
        "source",
        "source_size",
        F.least(F.col("_limit"), F.coalesce(level * F.col("_w"), F.col("_limit"))).alias("target"),
    )


def plan_mix(rows: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: its target, complete epochs, and the key at which the fractional epoch ends.

    ``rows`` has source, size, _id, _key, _range. Sizes are summed per (source, range) before the shuffle, running
    sums go over at most RANGES rows per source, and only the rows of the range that the budget ends in are sorted.
    A document at the end of the budget is taken where at least half of it fits.
    """
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    plan = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("_epochs", epochs.cast("long")).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size")
    )
    running = Window.partitionBy("_s", "_null").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})

    by_source = keyed(plan).drop("source")
    ends = (
        keyed(ranges)
        .withColumn("_cum", F.sum("_sum").over(running))
        .join(by_source.select("_s", "_null", "_rest"), ["_s", "_null"])
        .where("_cum > _rest")
        .groupBy("_s", "_null")
        .agg(F.min(F.struct("_range", (F.col("_rest") - F.col("_cum") + F.col("_sum")).alias("_left"))).alias("_end"))
        .select("_s", "_null", F.col("_end._range").alias("_end"), F.col("_end._left").alias("_left"))
    )
    fine = Window.partitionBy("_s", "_null").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        keyed(rows)
        .join(ends, ["_s", "_null"])
        .where("_range = _end")
        .withColumn("_before", F.sum("size").over(fine) - F.col("size"))
        .where(F.col("_before") + F.col("size") / 2 <= F.col("_left"))
        .groupBy("_s", "_null")
        .agg(F.max(F.struct("_key", "_id")).alias("_edge"))
    )
    return (
        by_source.join(ends.drop("_left"), ["_s", "_null"], "left")
        .join(last, ["_s", "_null"], "left")
        .select("_s", "_null", "source_size", "target", "_epochs", "_end", "_edge")
    )


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken to rows with the sampling columns; a join with one row per source."""
    keyed = rows.withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()})
    inside = (
        F.col("_end").isNull()
        | (F.col("_range") < F.col("_end"))
        | ((F.col("_range") == F.col("_end")) & (F.struct("_key", "_id") <= F.col("_edge")))
    )
    copies = F.col("_epochs") + F.when((F.col("target") > F.col("_epochs") * F.col("source_size")) & inside, 1).otherwise(0)
    return (
        keyed.join(plan, ["_s", "_null"], "left")
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_s", "_null", "_end", "_edge", "_epochs", "_key", "_id", "_range")
    )


def mix_sources(docs: DataFrame, seed: str = "mix", share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per input row: (doc_id, size, source_size, target, taken, copies).

    Size counts words; a null text has none. A null source is a source of its own, last in order. A document of size
    0 takes no words. Rows that repeat a doc_id share its key, so both are in or out at the edge of a budget; null ids
    share one key. The keys are hashes of the id, so reruns agree. Other columns are not looked at; an empty table
    gives an empty result.
    """
    rows = materialise(sampling_columns(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    plan = materialise(plan_mix(rows, share, most), "mix")
    return decide(rows, plan).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix_rows(docs: DataFrame, seed: str = "mix", share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: every document as often as the mix takes it.

    Documents are not shuffled: the key and the range are recomputed from each row and compared with its source's plan.
    """
    names = docs.columns
    inner = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = materialise(sampling_columns(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    plan = materialise(plan_mix(rows, share, most), "mix")
    kept = decide(sampling_columns(inner, seed), plan).where("copies > 0")
    again = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col("_row").getField(c).alias(c) for c in names])
