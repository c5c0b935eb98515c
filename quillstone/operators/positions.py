"""Running values per key that split a long key into blocks.

A window over a whole session puts all of that session into one task. Here each key is cut into blocks by a column that
follows the order; a summary row per block is carried forward, and the window runs within a block only. The summary
rows go through blocks of blocks in the same way, so that no window is long even for a key with a third of all rows.
Block columns are whole numbers and must not decrease along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def position_block(position: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(position) / size)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds inclusive running sums and the last non-null value so far, per key along the order."""
    sums, lasts = sums or {}, lasts or {}
    df = df.withColumn("_block", block)
    place = F.struct(*order)
    per_block = df.groupBy(*keys, "_block").agg(
        *[F.sum(value).alias(f"_s_{name}") for name, value in sums.items()],
        *[F.max_by(value, F.when(value.isNotNull(), place)).alias(f"_l_{name}") for name, value in lasts.items()],
    )
    carried = _carried(per_block, keys, list(sums), list(lasts))
    within = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = _join_back(df, carried, [*keys, "_block"])
    return joined.select(
        *[c for c in df.columns if c != "_block"],
        *[(F.col(f"_cs_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n) for n, v in sums.items()],
        *[
            F.coalesce(F.last(v, ignorenulls=True).over(within), F.col(f"_cl_{n}")).alias(n)
            for n, v in lasts.items()
        ],
    )


def _join_back(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that treats null keys, and blocks of null orders, as values like others."""
    named = other.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(named, same).drop(*[f"_k_{c}" for c in keys])


def _carried(per_block: DataFrame, keys: list[str], sums: list[str], lasts: list[str]) -> DataFrame:
    """What each block takes over from the blocks before it."""
    blocks = per_block.withColumn("_group", F.floor(F.col("_block") / BLOCK))
    per_group = blocks.groupBy(*keys, "_group").agg(
        *[F.sum(f"_s_{n}").alias(f"_gs_{n}") for n in sums],
        *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col("_block"))).alias(f"_gl_{n}") for n in lasts],
    )
    groups_before = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    from_groups = per_group.select(
        *keys,
        "_group",
        *[F.coalesce(F.sum(f"_gs_{n}").over(groups_before), F.lit(0)).alias(f"_bs_{n}") for n in sums],
        *[F.last(f"_gl_{n}", ignorenulls=True).over(groups_before).alias(f"_bl_{n}") for n in lasts],
    )
    before = (
        Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return _join_back(blocks, from_groups, [*keys, "_group"]).select(
        *keys,
        "_block",
        *[(F.col(f"_bs_{n}") + F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0))).alias(f"_cs_{n}") for n in sums],
        *[
            F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(before), F.col(f"_bl_{n}")).alias(f"_cl_{n}")
            for n in lasts
        ],
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first rows per key; Spark limits each map task to ``count`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= count).drop("_n")
