"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its smallest neighbour to its larger (large) or to its other (small) neighbours.

    ``edges`` is (a, b) with b < a. The minimum is pre-aggregated, so a node with many neighbours is no hot group; the
    join back is a plain equi-join that adaptive execution can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``links`` (a, b).

    Each round writes its edges to the shared folder, so the plan stays short and a lost executor costs one round. The
    rounds end when the edges stay the same; their number grows with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        edges = materialise(_stars(_stars(edges, True), False), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = state
