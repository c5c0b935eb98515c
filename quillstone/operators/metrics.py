"""Retrieval metrics, score distributions, AUC, threshold trade-offs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import compact_text
from quillstone.operators.positions import running
from quillstone.session import materialise


def mark_hits(hits: DataFrame) -> DataFrame:
    """Adds contains_answer to hits that carry ``content`` and ``answer_source``."""
    return hits.withColumn(
        "contains_answer", F.contains(compact_text("content"), compact_text("answer_source"))
    )


def per_question(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """One row per question, those without hits included; filtered hits do not count."""
    shown = hits.where(~F.col("filtered")) if "filtered" in hits.columns else hits
    found = shown.groupBy("query_id").agg(
        F.min(F.when(F.col("contains_answer"), F.col("rank"))).alias("first_relevant"),
        F.min("rank").alias("first_rank"),
        F.count_if("contains_answer").alias("relevant"),
        F.count("*").alias("selected"),
    )
    joined = questions.join(found, "query_id", "left")
    relevant = F.coalesce("relevant", F.lit(0))
    return joined.select(
        *questions.columns,
        F.coalesce((F.col("first_relevant") == F.col("first_rank")).cast("double"), F.lit(0.0)).alias("hit_at_1"),
        (relevant > 0).cast("double").alias("hit_at_k"),
        (relevant / k).alias("precision_at_k"),
        F.coalesce(1.0 / F.col("first_relevant"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("selected", F.lit(0)).alias("selected"),
    )


def _means() -> list[Column]:
    return [
        F.count("*").alias("question_count"),
        F.avg("hit_at_1").alias("hit_rate_at_1"),
        F.avg("hit_at_k").alias("hit_rate_at_k"),
        F.avg("hit_at_k").alias("recall_at_k"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("selected").alias("mean_selected_count"),
    ]


def retrieval_metrics(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    return per_question(questions.select("query_id"), hits, k).agg(*_means())


def metrics_by_type(questions: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The same per question_type, and over all as type null."""
    rows = per_question(questions.select("query_id", "question_type"), hits, k)
    return rows.rollup("question_type").agg(*_means())


def mean_top1_distance(hits: DataFrame) -> DataFrame:
    return hits.where("rank = 1").agg(F.avg("distance").alias("mean_top1_distance"))


def type_distribution(questions: DataFrame) -> DataFrame:
    return questions.groupBy("question_type").agg(F.count("*").alias("questions"))


def labelled_metrics(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Micro-averaged precision and recall over the first k, HitRate@1, and MRR over the full ranking.

    ``ranked``: query_id, chunk_id, rank; ``labels``: query_id, chunk_id of the relevant chunks.
    """
    marked = ranked.join(labels.select("query_id", "chunk_id", F.lit(True).alias("_hit")), ["query_id", "chunk_id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    top = F.col("rank") <= k
    per_query = marked.groupBy("query_id").agg(
        F.count_if(top).alias("retrieved"),
        F.count_if(top & hit).alias("relevant"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    sizes = labels.groupBy("query_id").agg(F.count("*").alias("labelled"))
    rows = per_query.join(sizes, "query_id", "left")
    return rows.agg(
        (F.sum("relevant") / F.sum("retrieved")).alias("precision_at_k"),
        (F.sum("relevant") / F.sum("labelled")).alias("recall_at_k"),
        F.avg(F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0))).alias("hit_rate_at_1"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


METRICS = ["hit_rate_at_1", "recall_at_k", "precision_at_k", "mrr", "mean_selected_count"]


def method_compare(by_method: DataFrame, base: str, other: str, methods: list[str]) -> DataFrame:
    """One row per metric, one column per method, and the signed difference of two methods."""
    long = by_method.unpivot("method", METRICS, "metric", "value")
    wide = long.groupBy("metric").pivot("method", methods).agg(F.first("value"))
    return wide.withColumn("delta", F.col(other) - F.col(base))


def cumulative_counts(scores: DataFrame, keys: list[str], value: str, cells: float = 1000) -> DataFrame:
    """Distinct values with their count ``n`` and the running count ``upto``, per key.

    Equal scores are added up before the shuffle, and the running sum goes through blocks of near values.
    """
    counts = scores.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, keys, [value], F.floor(F.col(value) * cells), sums={"upto": F.col("n")})


def exact_percentiles(
    scores: DataFrame, key: str, value: str, points: list[int], cells: float = 1000
) -> DataFrame:
    """Linear-interpolation percentiles per key as columns p10, p25, ...; no group is held in one task."""
    counted = cumulative_counts(scores, [key], value, cells)
    totals = scores.groupBy(key).agg(F.count(value).alias("_total"))
    ranked = counted.join(totals, key)
    columns = []
    for p in points:
        place = (F.col("_total") - 1) * (p / 100.0)
        low = F.floor(place)
        high = F.least(low + 1, F.col("_total") - 1)
        at_low = (F.col("upto") - F.col("n") <= low) & (low < F.col("upto"))
        at_high = (F.col("upto") - F.col("n") <= high) & (high < F.col("upto"))
        left = F.max(F.when(at_low, F.col(value)))
        right = F.max(F.when(at_high, F.col(value)))
        share = F.max(place - low)
        columns.append((left * (1 - share) + right * share).alias(f"p{p}"))
    return ranked.groupBy(key).agg(*columns)


# Ranges of near values that the count table is cut into, and the accuracy of the sketch that finds their bounds.
RANGES, ACCURACY = 256, 10_000


def count_table(scored: DataFrame, value: str, positive: Column) -> DataFrame:
    """(value, pos, neg, pos_upto, neg_upto) of every distinct score, written once; null scores are left out.

    Equal scores are added up first. Ranks come from running counts within ranges whose bounds a mergeable sketch takes
    from the scores themselves, so ranges are of like size wherever the scores lie; only the sums of the ranges, a
    bounded number, are carried from one to the next.
    """
    yes = F.coalesce(positive, F.lit(False))
    counts = scored.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"))
    counts = materialise(counts, "counts")
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = counts.agg(F.percentile_approx("value", shares, F.lit(ACCURACY)).alias("_bounds"))
    # one row of at most RANGES numbers
    placed = counts.join(F.broadcast(bounds), F.lit(True)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    carried = sums.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_p", "_n")])
    within = Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(carried), "_range").select(
        "value", "pos", "neg",
        (F.col("_p") + F.sum("pos").over(within)).alias("pos_upto"),
        (F.col("_n") + F.sum("neg").over(within)).alias("neg_upto"),
    )


PERCENTS = [10, 25, 50, 75, 90]


def score_distribution(hits: DataFrame, value: str = "rerank_score") -> DataFrame:
    """Count, extremes, percentiles and mean of the scores of relevant and other hits, all from one count table."""
    shown = hits.where(~F.col("filtered")) if "filtered" in hits.columns else hits
    ranked = count_table(shown, value, F.col("contains_answer"))
    classes = {"positive": "pos", "negative": "neg"}
    totals = ranked.agg(*[F.sum(c).alias(f"_{c}_total") for c in classes.values()])
    joined = ranked.join(F.broadcast(totals), F.lit(True))  # one row
    columns = []
    for name, c in classes.items():
        n, upto, total, v = F.col(c), F.col(f"{c}_upto"), F.col(f"_{c}_total"), F.col("value")
        own = F.when(n > 0, v)
        points = []
        for p in PERCENTS:
            place = (total - 1) * (p / 100.0)
            low = F.floor(place)
            high = F.least(low + 1, total - 1)
            left, right = (F.max(F.when((upto - n <= at) & (at < upto), v)) for at in (low, high))
            share = F.max(place - low)
            points.append((left * (1 - share) + right * share).alias(f"p{p}"))
        row = [F.lit(name).alias("class"), F.sum(n).alias("count"), F.min(own).alias("min"), F.max(own).alias("max")]
        mean = F.try_divide(F.sum(n * v), F.sum(n)).alias("mean")
        columns.append(F.struct(*row, mean, *points))
    return joined.agg(F.array(*columns).alias("rows")).select(F.inline("rows")).where("count > 0")


def score_auc(scored: DataFrame, value: str, positive: str) -> DataFrame:
    """Chance that a relevant pair outscores another, ties half; read from the count table."""
    ranked = count_table(scored, value, F.col(positive))
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    return ranked.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"),
    )


def threshold_sweep(hits: DataFrame, questions: DataFrame, thresholds: list[float | None], k: int) -> DataFrame:
    """Effect of a minimum score on raw candidates: (query_id, raw_rank, score_value, contains_answer).

    The thresholds are a short list, so each question is summed up once with one set of counters per threshold.
    """
    def kept(t: float | None) -> Column:
        return F.lit(True) if t is None else F.col("score_value") >= t

    per = hits.groupBy("query_id").agg(
        *[
            F.struct(
                F.count_if(kept(t) & (F.col("raw_rank") <= k)).alias("injected"),
                F.count_if(kept(t) & (F.col("raw_rank") <= k) & F.col("contains_answer")).alias("relevant"),
                F.count_if(kept(t) & F.col("contains_answer")).alias("pos_kept"),
                F.count_if(kept(t) & ~F.col("contains_answer")).alias("neg_kept"),
                F.count_if("contains_answer").alias("pos"),
                F.count_if(~F.col("contains_answer")).alias("neg"),
            ).alias(f"_t{i}")
            for i, t in enumerate(thresholds)
        ]
    )
    rows = questions.select("query_id").join(per, "query_id", "left")
    labelled = F.array(
        *[
            F.struct(F.lit("none" if t is None else str(float(t))).alias("threshold"), F.col(f"_t{i}").alias("c"))
            for i, t in enumerate(thresholds)
        ]
    )
    long = rows.select(F.explode(labelled).alias("x")).select("x.threshold", "x.c.*")
    safe = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return long.groupBy("threshold").agg(
        F.avg((F.coalesce("relevant", F.lit(0)) > 0).cast("double")).alias("recall_at_k"),
        F.avg((F.coalesce("injected", F.lit(0)) > 0).cast("double")).alias("kept_any"),
        F.avg(F.coalesce("injected", F.lit(0))).alias("mean_injected"),
        safe("relevant", "injected").alias("precision"),
        safe("pos_kept", "pos").alias("positive_retention"),
        safe("neg_kept", "neg").alias("negative_retention"),
    )


def labelled_pairs(questions: DataFrame, candidates: DataFrame, expected: int = 20) -> DataFrame:
    """(query_id, chunk_id, positive, score) of scored pairs; every question must have ``expected`` candidates."""
    joined = questions.select("query_id", "relevant_chunk_id").join(candidates, "query_id", "left")
    sizes = joined.groupBy("query_id").agg(F.count("chunk_id").alias("_n"))
    message = F.concat(F.col("query_id").cast("string"), F.lit(" has "), F.col("_n").cast("string"), F.lit(f" candidates; expected {expected}"))
    checked = sizes.withColumn("_ok", F.when(F.col("_n") != expected, F.raise_error(message)).otherwise(True)).where("_ok")
    return joined.join(checked.select("query_id"), "query_id").select(
        "query_id", "chunk_id", (F.col("chunk_id") == F.col("relevant_chunk_id")).alias("positive"), "score"
    )


def score_histogram(scored: DataFrame, value: str, width: float = 0.5) -> DataFrame:
    """Counts per bin from the floor of the minimum to the ceiling of the maximum; empty bins are kept.

    The last bin is closed on the right: values on the top edge fall into the bin below it.
    """
    slot = F.floor(F.col(value) / width)
    counted = scored.groupBy(slot.alias("slot"), (F.col(value) == slot * width).alias("on_edge")).agg(
        F.count("*").alias("n")
    )
    # From here on there is one row per bin, and the window runs over those only.
    everything = Window.partitionBy()
    top = F.max(F.when(F.col("on_edge"), F.col("slot")).otherwise(F.col("slot") + 1)).over(everything)
    low = F.min("slot").over(everything)
    placed = counted.select("n", "slot", "on_edge", low.alias("low"), top.alias("top")).withColumn(
        "bin",
        F.when(F.col("on_edge") & (F.col("slot") == F.col("top")) & (F.col("slot") > F.col("low")), F.col("slot") - 1)
        .otherwise(F.col("slot")),
    )
    span = placed.agg(F.min("low").alias("low"), F.max("top").alias("top"))
    bins = span.select(F.explode(F.sequence("low", F.greatest(F.col("top") - 1, F.col("low")))).alias("bin"))
    return (
        bins.join(placed.groupBy("bin").agg(F.sum("n").alias("n")), "bin", "left")
        .select(
            (F.col("bin") * width).alias("lower"),
            ((F.col("bin") + 1) * width).alias("upper"),
            F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        )
    )


# Cells between two points of the density: weights are split between the two ends of a cell, whose width bounds the error.
CELLS_PER_STEP = 2048


def score_kde(scored: DataFrame, value: str, points: int = 500, width: float = 0.5) -> DataFrame:
    """Gaussian density with Scott's bandwidth on an even grid over the histogram's range.

    Every score is split between the two nearest points of a fine grid, in proportion to how near they are. The grid's
    sums are partial aggregates of bounded number; the kernel is folded in by one convolution, whatever the number of
    scores. Scores of which fewer than two differ have no bandwidth and a null density.
    """
    shape = scored.agg(
        F.count(value).alias("total"),
        (F.pow(F.count(value).cast("double"), F.lit(-0.2)) * F.stddev_samp(value)).alias("h"),
        (F.floor(F.min(value) / width) * width).alias("low"),
        (F.ceil(F.max(value) / width) * width).alias("high"),
    )
    cells = (points - 1) * CELLS_PER_STEP
    # ``shape`` is one row
    place = F.coalesce(F.try_divide((F.col(value) - F.col("low")) * cells, F.col("high") - F.col("low")), F.lit(0.0))
    placed = scored.where(F.col(value).isNotNull()).join(F.broadcast(shape), F.lit(True)).select(place.alias("place"))
    cell = F.least(F.floor("place"), F.lit(cells - 1))
    ends = F.array(F.struct(cell.alias("cell"), (1 - (F.col("place") - cell)).alias("w")), F.struct((cell + 1).alias("cell"), (F.col("place") - cell).alias("w")))
    grid = placed.select(F.inline(ends)).groupBy("cell").agg(F.sum("w").alias("w"))
    one = grid.agg(F.collect_list("cell").alias("cells"), F.collect_list("w").alias("ws")).join(F.broadcast(shape), F.lit(True))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x = np.linspace(row.low, row.high, points) if row.total else np.full(points, np.nan)
                density = np.full(points, np.nan)
                if row.total and row.h and row.high > row.low:
                    weights = np.zeros(cells + 1)
                    weights[np.asarray(row.cells, int)] = row.ws
                    step = (row.high - row.low) / cells
                    reach = min(cells, int(np.ceil(40 * row.h / step)))
                    kernel = np.exp(-0.5 * np.square(np.arange(-reach, reach + 1) * step / row.h))
                    size = len(weights) + len(kernel) - 1
                    both = np.fft.irfft(np.fft.rfft(weights, size) * np.fft.rfft(kernel, size), size)
                    density = both[reach : reach + cells + 1 : CELLS_PER_STEP] / (row.total * row.h * np.sqrt(2 * np.pi))
                yield pd.DataFrame({"i": np.arange(points, dtype=np.int32), "x": x, "density": density})

    found = one.mapInPandas(fold, "i int, x double, density double")
    return found.select("i", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "density")])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
