"""Quality rules: robust multivariate outliers by minimum covariance determinants, per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

GAP = r"[\x20\x09-\x0D]+"
# Share of a group's rows that the estimate rests on, and the factor that makes up for leaving the rest out (4 values).
CORE = 0.5
CONSISTENCY = 2.109
# Steps end when no determinant falls by more than FALL (of its logarithm), at the latest after STEPS.
STEPS = 30
FALL = 1e-9
# Starts per group: centre at this quartile (0 to 2), and whether the spread is that of the quartiles or the floors alone.
# Another start than the first counts where it lowers the logarithm of the determinant by more than MARGIN.
MARGIN = 0.1
STARTS = ((1, True), (1, False), (0, False), (2, False))
SMALLEST_GROUP = 40
# Standard deviations added in square to the four values: most rows of a group have no symbols and no repeats at all, so
# without them the variance is zero and a single symbol would reject a row.
FLOORS = (0.15, 0.45, 0.35, 0.55)
# The 99.9 % quantile of chi-square with four degrees of freedom: what one in a thousand normal rows exceeds.
CUT = 18.467
VALUES = ("x0", "x1", "x2", "x3")
ACCURACY = 10_000


def repeated_words(hashes: Column) -> Column:
    """Number of words in three-word windows that occur twice or more; ``hashes`` has one number per window.

    Windows are sorted with their places; equal neighbours are repeats. Texts without equal windows skip the sort.
    """
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        marked = F.transform(
            s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])
        )
        starts = F.filter(marked, lambda x: x.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    # a one-element array binds the sorted windows once
    counted = F.element_at(F.transform(F.array(paired), again), 1)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(counted)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", GAP), lambda w: w != ""))
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines).withColumn(
        "_windows",
        F.when(
            F.size("_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(rows: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of word length and of symbols, repeated lines and repeats per 100 words."""
    per_word = 100.0 / F.greatest(F.col("n_words"), F.lit(1))
    return rows.withColumns(
        {
            "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x1": F.log1p(F.col("n_symbols") * per_word),
            "x2": F.log1p(F.col("n_dup_lines") * per_word),
            "x3": F.log1p(F.col("n_repeat_words") * per_word),
        }
    )


def factored(rows: DataFrame) -> DataFrame:
    """Adds the Cholesky factor (l_i_j) of the covariance columns c_i_j, with the floors on its diagonal, and the
    logarithm of the determinant (_det)."""
    k = len(VALUES)
    for j in range(k):
        rest = F.col(f"c_{j}_{j}") + FLOORS[j] ** 2
        for m in range(j):
            rest = rest - F.col(f"l_{j}_{m}") * F.col(f"l_{j}_{m}")
        rows = rows.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, k):
            value = F.col(f"c_{i}_{j}")
            for m in range(j):
                value = value - F.col(f"l_{i}_{m}") * F.col(f"l_{j}_{m}")
            rows = rows.withColumn(f"l_{i}_{j}", value / F.col(f"l_{j}_{j}"))
    det = F.lit(0.0)
    for j in range(k):
        det = det + 2 * F.log(f"l_{j}_{j}")
    names = [f"l_{i}_{j}" for i in range(k) for j in range(i + 1)]
    return rows.select("_g", "_s", *[f"m_{i}" for i in range(k)], *names, det.alias("_det"))


def distance(rows: DataFrame, shape: DataFrame, keys: tuple[str, ...] = ("_g",)) -> DataFrame:
    """Adds _d, the squared Mahalanobis distance; null where the group has no estimate."""
    joined = rows.join(shape.drop("_det", *({"_g", "_s"} - set(keys))), list(keys), "left")
    total = F.lit(0.0)
    for i in range(len(VALUES)):
        y = F.col(f"x{i}") - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * F.col(f"_y{j}")
        joined = joined.withColumn(f"_y{i}", y / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return joined.withColumn("_d", total).select(*rows.columns, "_d")


def estimates(rows: DataFrame) -> DataFrame:
    """Means and factored covariances per group (_g): of several starts, the estimate of least determinant,
    where the first start is ahead by MARGIN.

    The starts (_s) are coordinate-wise: quartiles as centres, with quartile ranges or the floors as spread. Each step
    takes the share CORE of a group's rows that is nearest, and computes mean and covariance of those, until the
    determinants stop falling. Steps are aggregates with map-side sums and a join with one row per group and start, so a
    group with a third of all rows is no hot task.
    """
    k = len(VALUES)
    rows = materialise(rows, "vectors")
    quartiles = rows.groupBy("_g").agg(
        *[F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}") for i, x in enumerate(VALUES)]
    )
    starts = F.array(*[F.struct(F.lit(s).alias("_s"), F.lit(at).alias("_at"), F.lit(wide).alias("_wide")) for s, (at, wide) in enumerate(STARTS)])
    first = quartiles.withColumn("_start", F.explode(starts)).select("*", "_start.*")
    first = first.select(
        "_g",
        "_s",
        *[F.get(f"q{i}", F.col("_at")).alias(f"m_{i}") for i in range(k)],
        *[
            (F.when(F.col("_wide"), F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2)).otherwise(0.0) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}")
            for i in range(k)
            for j in range(i + 1)
        ],
    )
    shape = materialise(factored(first), "shape")
    started = rows.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in range(len(STARTS))])))
    for step in range(STEPS):
        far = distance(started, shape, ("_g", "_s"))
        edge = materialise(far.groupBy("_g", "_s").agg(F.percentile_approx("_d", CORE, ACCURACY).alias("_edge")), "edge")
        core = far.join(edge, ["_g", "_s"]).where("_d <= _edge")
        moments = core.groupBy("_g", "_s").agg(
            *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(VALUES)],
            *[
                (F.covar_pop(VALUES[i], VALUES[j]) * CONSISTENCY).alias(f"c_{i}_{j}")
                for i in range(k)
                for j in range(i + 1)
            ],
        )
        last, shape = shape, materialise(factored(moments), "shape")
        # the first shapes are no covariances of a core, so their determinants do not count
        falls = shape.select("_g", "_s", F.col("_det").alias("_new")).join(last, ["_g", "_s"]).where(F.col("_det") - F.col("_new") > FALL)
        if step and falls.isEmpty():
            break
    best = shape.groupBy("_g").agg(F.min(F.struct((F.col("_det") + F.when(F.col("_s") == 0, -MARGIN).otherwise(0.0)).alias("_det"), "_s")).alias("_b")).select("_g", F.col("_b._s").alias("_s"))
    return shape.join(best, ["_g", "_s"], "left_semi").drop("_s")


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per input row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Rows that fail the base rules are rejected and do not enter the estimates. The others are rejected where their
    squared distance from the centre of their language and source exceeds ``cut``. A null language or source is a
    value of its own. Groups with fewer than SMALLEST_GROUP rows are estimated together; where even those are too few,
    their rows are kept. Null and empty texts have no words and fail the base rules. Repeated rows get equal verdicts; an
    empty table gives an empty result; other columns are not looked at.
    """
    stats = materialise(statistics(docs), "statistics")
    rows = vectors(stats).withColumn("base_failed", base_failed())
    rows = rows.withColumn("_own", F.to_json(F.struct("lang", "source")))
    sizes = rows.where("NOT base_failed").groupBy("_own").agg(F.count("*").alias("_n"))
    named = materialise(
        sizes.select("_own", F.when(F.col("_n") >= SMALLEST_GROUP, F.col("_own")).otherwise("").alias("_g"), "_n"), "groups"
    )
    placed = rows.join(named.select("_own", "_g"), "_own", "left")
    enough = named.groupBy("_g").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= SMALLEST_GROUP).select("_g")
    shape = estimates(placed.where("NOT base_failed").select("_g", *VALUES)).join(enough, "_g", "left_semi")
    judged = distance(placed, shape)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("_d", F.lit(0.0)) <= cut)).alias("kept"),
        F.col("_d").alias("distance"),
    )
