"""Nearest rows within a key, and the inverted file: vectors by list, queries sent to the lists that they probe.

A key is a knowledge base or a list of the inverted file. Rows and queries of one key meet in cells: a key with many
rows or many queries is cut into blocks, and each cell has one block of either, so a popular key is spread over tasks
and no task holds more than two blocks. Only rows and queries that share a key are ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vector import vector_score
from quillstone.operators.nearest import PLACES, train_lists
from quillstone.session import materialise

BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000
# Query x row distances held at once in a cell.
CELLS = 2_000_000


def whole_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has components, none of them null or not a number: the others have no distance."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return df.where(F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as the rows of a matrix; another length raises."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes}")
    return flat.reshape(len(column), -1)


def cell_best(rows: pa.Table, queries: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows per query; ``rows`` are in id order, and ties go to the first."""
    x, q = matrix(rows.column("vector").combine_chunks()), matrix(queries.column("vector").combine_chunks())
    if x.shape[1] != q.shape[1]:
        raise ValueError(f"queries of {q.shape[1]} components against rows of {x.shape[1]}")
    norms = np.square(x).sum(axis=1)
    found = []
    for at in range(0, len(q), max(1, CELLS // max(1, len(x)))):
        part = q[at : at + max(1, CELLS // max(1, len(x)))]
        squares = norms[None, :] + np.square(part).sum(axis=1)[:, None] - 2.0 * part @ x.T
        limit = np.partition(squares, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
        # the products choose with room for their error, differences decide
        slack = 1e-9 * (1.0 + norms.max(initial=0.0) + np.square(part).sum(axis=1).max(initial=0.0))
        query, row = np.nonzero(squares <= (limit + slack)[:, None])
        exact = np.round(np.sqrt(np.square(x[row] - part[query]).sum(axis=1)), PLACES)
        order = np.lexsort((row, exact, query))
        query, row, exact = query[order], row[order], exact[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        found.append((query[place < k] + at, row[place < k], exact[place < k]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int),) * 2 + (np.empty(0),)


def nearest_by_key(rows: DataFrame, queries: DataFrame, key: str, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, chunk_id, distance, score, rank): the k nearest rows of (key, chunk_id, vector) per query of the same key.

    Queries are (key, query_id, vector); one that stands under several keys gets the k best of all of them. Rows and
    queries with a null key, and those without a whole vector, find and are found by nothing.
    """
    rows = whole_vectors(rows.select(key, "chunk_id", "vector").where(F.col(key).isNotNull()))
    queries = whole_vectors(queries.select(key, "query_id", "vector").where(F.col(key).isNotNull()))
    asked = queries.groupBy(key).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("_q"))
    cells = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_r")).join(asked, key)

    def own(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = rows.join(cells, key).withColumn("_i", own("chunk_id", "_r")).withColumn("_j", every("_q"))
    right = queries.join(cells, key).withColumn("_j", own("query_id", "_q")).withColumn("_i", every("_r"))
    kinds = [f"{n} {t.schema[n].dataType.simpleString()}" for t, n in ((queries, "query_id"), (rows, "chunk_id"))]
    names = ["query_id", "chunk_id", "distance"]

    def cell(some: pa.Table, these: pa.Table) -> pa.Table:
        some = some.take(pc.sort_indices(some, [("chunk_id", "ascending")]))
        if some.num_rows and these.num_rows:
            query, row, distance = cell_best(some, these, k)
        else:
            query, row, distance = np.empty(0, int), np.empty(0, int), np.empty(0)
        ids = these.column("query_id").take(pa.array(query)), some.column("chunk_id").take(pa.array(row))
        return pa.Table.from_arrays([*ids, pa.array(distance, pa.float64())], names=names)

    where = [key, "_i", "_j"]
    found = left.drop("_r", "_q").groupBy(*where).cogroup(right.drop("_r", "_q").groupBy(*where)).applyInArrow(cell, ", ".join([*kinds, "distance double"]))
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "chunk_id", "distance", vector_score(F.col("distance")).alias("score"), "rank")


@dataclass
class InvertedFile:
    """Centres, and the written table (list_id, chunk_id, vector) in folders by list."""

    centres: np.ndarray
    rows: DataFrame


def nearest_lists(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Adds ``list_ids``, the nearest ``probes`` centres of every row's vector, nearest first; narrow."""
    names = df.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = np.square(centres).sum(axis=1) / 2.0
        for batch in batches:
            if batch.num_rows:
                gaps = half[None, :] - matrix(batch.column(at)) @ centres.T
                nearest = np.argsort(gaps, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield batch.append_column("list_ids", pa.array(list(nearest), pa.list_(pa.int32())))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{shape}, list_ids array<int>")


def build_index(chunks: DataFrame, lists: int = 100, path: str | None = None) -> InvertedFile:
    """Trains the centres on all vectors and writes every row into the folder of its list."""
    usable = whole_vectors(chunks.select("chunk_id", "vector"))
    centres = np.asarray(train_lists(usable, lists).clusterCenters(), dtype=np.float64)
    placed = nearest_lists(usable, centres, 1).select(F.col("list_ids")[0].alias("list_id"), "chunk_id", "vector")
    if path is None:
        return InvertedFile(centres, materialise(placed, "lists"))
    placed.write.mode("overwrite").partitionBy("list_id").parquet(path)
    stored = chunks.sparkSession.read.parquet(path).select("list_id", "chunk_id", "vector")
    return InvertedFile(centres, stored)


def search_index(index: InvertedFile, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """Approximate k nearest: a query is compared with the rows of its nearest ``probes`` lists only.

    With as many probes as lists the result is exact.
    """
    sent = nearest_lists(whole_vectors(queries.select("query_id", "vector")), index.centres, probes)
    probed = sent.select(F.explode("list_ids").alias("list_id"), "query_id", "vector")
    return nearest_by_key(index.rows, probed, "list_id", k)
