"""Best k chunks per query: exact vector and lexical scans, and the centres of the clustered search.

Chunks are never paired with queries as rows. Each task streams its chunks in Arrow batches past the query block and
keeps k rows per query, so what is shuffled is tasks x queries x k rows. Up to ``MAX_QUERIES`` queries are broadcast;
beyond that both sides are cut into blocks and shuffled by block pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vector import vector_score

from quillstone.session import fits

MAX_QUERIES = 4096
BLOCK_CHUNKS = 50_000
# Costs in memory at a time, rows whose distances are taken exactly at a time, and rows of a block looked at together.
CELLS = 1_000_000
PAIRS = 1 << 16
BLOCK_ROWS = 8192
# Distances keep this many places, so that equal distances tie on every platform and the chunk id decides.
PLACES = 9

# (chunk batch, bound) -> pieces of (query index, row index, cost) with all rows that may be among the best k. The bound is
# read anew for every piece, so what one piece adds to the best rows leaves rows out of the next.
Scorer = Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


class Best:
    """The k lowest (cost, chunk id) per query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.empty(0, dtype=np.int64)
        self.cost = np.empty(0, dtype=np.float64)
        self.chunk = np.empty(0, dtype=np.int64)
        self.bound = np.full(queries, np.inf)

    def add(self, query: np.ndarray, cost: np.ndarray, chunk: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        cost = np.concatenate([self.cost, cost])
        chunk = np.concatenate([self.chunk, chunk])
        order = np.lexsort((chunk, cost, query))
        query, cost, chunk = query[order], cost[order], chunk[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if query.size else np.empty(0, int)
        sizes = np.diff(np.r_[starts, query.size])
        rank = np.arange(query.size) - np.repeat(starts, sizes)
        keep = rank < self.k
        self.query, self.cost, self.chunk = query[keep], cost[keep], chunk[keep]
        full = rank == self.k - 1
        self.bound[query[full]] = cost[full]


def _within_bound(cost: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, slack: float):
    """(query, row) pairs of a cost matrix (rows x queries) that can still be among the best k."""
    limit = bound
    if cost.shape[0] > k:
        limit = np.minimum(bound, np.partition(cost, k - 1, axis=0)[k - 1])
    row, query = np.nonzero((cost <= limit + slack) & np.isfinite(cost))
    return query, rows[row], row


def _vectors(column: pa.Array) -> np.ndarray:
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def vector_scorer(matrix: np.ndarray, partitions: list | None, k: int) -> Scorer:
    """Exact Euclidean distance: matrix products choose, differences decide.

    ``partitions`` restricts a query to chunks of its knowledge base.
    """
    norms = np.square(matrix).sum(axis=1)

    def score(batch: pa.RecordBatch, bound: np.ndarray):
        vectors = _vectors(batch.column("vector"))
        part = np.asarray(batch.column("part").to_pylist(), dtype=object) if partitions is not None else None
        groups = [(slice(None), np.arange(len(vectors)))]
        if part is not None:
            wanted = pd.Series(np.arange(len(partitions))).groupby(pd.Series(partitions, dtype=object)).indices
            present = pd.Series(np.arange(len(part))).groupby(pd.Series(part)).indices
            groups = [(wanted[p], rows) for p, rows in present.items() if p in wanted]
        slack = 1e-9 * (1.0 + float(norms.max(initial=0.0)))
        for queries, all_rows in groups:
            q = matrix[queries]
            step = max(1, CELLS // max(1, len(q)))
            ids = np.arange(len(matrix))[queries]
            for at in range(0, len(all_rows), step):
                rows = all_rows[at : at + step]
                x = vectors[rows]
                squares = np.square(x).sum(axis=1)[:, None] + norms[queries][None, :] - 2.0 * (x @ q.T)
                with np.errstate(invalid="ignore"):
                    cap = np.square(bound[ids] + 10.0**-PLACES)  # bounds are rounded
                qj, chosen, _ = _within_bound(squares, rows, cap, k, slack)
                # many rows at one distance are many pairs
                for first in range(0, len(qj), PAIRS):
                    query, row = qj[first : first + PAIRS], chosen[first : first + PAIRS]
                    yield ids[query], row, np.round(np.sqrt(np.square(vectors[row] - q[query]).sum(axis=1)), PLACES)

    return score


def lexical_scorer(features: list[list[str]], k: int) -> Scorer:
    """Minus the number of shared features, counted through the queries' posting lists."""
    vocabulary, codes = np.unique(np.concatenate([np.asarray(f, dtype=object) for f in features]).astype(str), return_inverse=True)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    order = np.argsort(codes, kind="stable")
    postings, starts = owner[order], np.searchsorted(codes[order], np.arange(len(vocabulary) + 1))
    words = pa.array(vocabulary.tolist(), type=pa.string())
    width = len(features)

    def score(batch: pa.RecordBatch, bound: np.ndarray):
        column = batch.column("features")
        sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        code = pc.index_in(column.flatten(), value_set=words)
        row = np.repeat(np.arange(len(column)), sizes)
        known = ~np.asarray(code.is_null())
        row, code = row[known], code.drop_null().to_numpy(zero_copy_only=False)
        step = max(1, CELLS // width)
        for at in range(0, len(column), step):
            rows = np.arange(at, min(at + step, len(column)))
            pick = (row >= at) & (row < at + step)
            r, c = row[pick] - at, code[pick]
            times = starts[c + 1] - starts[c]
            place = np.repeat(starts[c] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            cell = np.repeat(r, times) * width + postings[place]
            cost = -np.bincount(cell, minlength=len(rows) * width).reshape(len(rows), width).astype(np.float64)
            cost[cost == 0] = np.inf
            query, chosen, local = _within_bound(cost, rows, bound, k, 0.0)
            yield query, chosen, cost[local, query]

    return score


def _add_batch(best: Best, score: Scorer, batch: pa.RecordBatch) -> None:
    if batch.num_rows:
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        for query, row, cost in score(batch, best.bound):
            best.add(query, cost, ids[row])


def _scan(chunks: DataFrame, rows: pd.DataFrame, id_type: str, make: Callable[[pd.DataFrame], Scorer], k: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score = shared.value["query_id"].tolist(), make(shared.value)
        best = Best(len(ids), k)
        for batch in batches:
            _add_batch(best, score, batch)
        kind = pa.string() if id_type == "string" else pa.int64()
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": pa.array([ids[q] for q in best.query], type=kind),
                "chunk_id": pa.array(best.chunk, type=pa.int64()),
                "cost": pa.array(best.cost, type=pa.float64()),
            }
        )

    return chunks.mapInArrow(run, f"query_id {id_type}, chunk_id bigint, cost double")


def _blocked(chunks: DataFrame, queries: DataFrame, id_type: str, make: Callable[[pd.DataFrame], Scorer], k: int) -> DataFrame:
    """The same for query tables of any size: chunk blocks meet query blocks, both bounded, in one shuffle."""
    cells = max(1, -(-chunks.count() // BLOCK_CHUNKS))
    blocks = max(1, -(-queries.count() // MAX_QUERIES))

    def slot(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count).cast("long"))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = chunks.withColumn("_cell", slot("chunk_id", cells)).withColumn("_block", every(blocks))
    right = queries.withColumn("_block", slot("query_id", blocks)).withColumn("_cell", every(cells))
    kind = pa.string() if id_type == "string" else pa.int64()

    def pair(chunk_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        best, ids = Best(query_rows.num_rows, k), query_rows.column("query_id").to_pylist()
        if chunk_rows.num_rows and query_rows.num_rows:
            score = make(query_rows.to_pandas())
            for batch in chunk_rows.to_batches(max_chunksize=BLOCK_ROWS):
                _add_batch(best, score, batch)
        return pa.Table.from_pydict(
            {
                "query_id": pa.array([ids[q] for q in best.query], type=kind),
                "chunk_id": pa.array(best.chunk, type=pa.int64()),
                "cost": pa.array(best.cost, type=pa.float64()),
            }
        )

    return (
        left.groupBy("_cell", "_block")
        .cogroup(right.groupBy("_cell", "_block"))
        .applyInArrow(pair, f"query_id {id_type}, chunk_id bigint, cost double")
    )


def _topk(chunks: DataFrame, queries: DataFrame, make: Callable[[pd.DataFrame], Scorer], k: int, max_queries: int) -> DataFrame:
    id_type = queries.schema["query_id"].dataType.simpleString()
    if fits(queries, max_queries):
        rows = queries.toPandas()
        if rows.empty:
            return chunks.sparkSession.createDataFrame([], f"query_id {id_type}, chunk_id bigint, cost double, rank int")
        local = _scan(chunks, rows, id_type, make, k)
    else:
        local = _blocked(chunks, queries, id_type, make, k)
    return _ranked(local, k)


def _ranked(local: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("cost", "chunk_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_topk(
    chunks: DataFrame, queries: DataFrame, k: int, within: bool = False, max_queries: int = MAX_QUERIES
) -> DataFrame:
    """k nearest chunks per query by Euclidean distance, ties by chunk id.

    ``chunks``: chunk_id (bigint), vector, and part when ``within``; ``queries``: query_id, vector, part.
    Returns query_id, chunk_id, distance, score, rank. Rows without a vector, or with a null or a NaN in it, have no
    distance: they find and are found by nothing.
    """
    columns = ["vector", "part"] if within else ["vector"]

    def make(rows: pd.DataFrame) -> Scorer:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vector"]])
        return vector_scorer(matrix, rows["part"].tolist() if within else None, k)

    def usable(df: DataFrame) -> DataFrame:
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
        return df.where(F.coalesce((F.size("vector") > 0) & ~bad, F.lit(False)))

    found = _topk(
        usable(chunks.select("chunk_id", *columns)), usable(queries.select("query_id", *columns)), make, k, max_queries
    )
    return found.select(
        "query_id",
        "chunk_id",
        F.col("cost").alias("distance"),
        vector_score(F.col("cost")).alias("score"),
        "rank",
    )


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int, max_queries: int = MAX_QUERIES) -> DataFrame:
    """k chunks per query with the highest lexical score, ties by chunk id; chunks that share nothing are left out."""
    sized = queries.where(F.size("features") > 0).select("query_id", "features")

    def make(rows: pd.DataFrame) -> Scorer:
        return lexical_scorer([list(f) for f in rows["features"]], k)

    found = _topk(chunks.select("chunk_id", "features"), sized, make, k, max_queries)
    sizes = queries.select("query_id", F.size("features").alias("_size"))
    return found.join(sizes, "query_id").select(
        "query_id", "chunk_id", (-F.col("cost") / F.col("_size")).alias("lexical_score"), "rank"
    )


def train_lists(chunks: DataFrame, lists: int = 100, seed: int = 42):
    """Cluster centres for the clustered search, trained on all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = chunks.count()
    points = chunks.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=min(lists, max(2, total)), seed=seed, maxIter=10).fit(points)
