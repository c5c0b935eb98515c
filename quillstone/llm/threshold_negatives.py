"""Hard-negative mining by Fagin's threshold algorithm.

Candidates lie in blocks. Every dimension of a block has its rows sorted by that component, and an anchor reads the
lists from the end that its own component's sign makes large. Rows come up in rounds of growing depth; a row that came
up in any list is scored exactly, in whole numbers. The components at the current depth, weighted by the anchor, bound
the score of every row that has not come up: once that threshold is strictly below each window's kth score (or below
the window itself), the rest of the block cannot matter.

Two passes run over the pairs of candidate blocks and anchor groups: the first finds each anchor's positives, whose
scores give the windows of the second. A task keeps k rows per window for one group of anchors and streams candidate
blocks past it, so what is merged afterwards is tasks x anchors x k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, text_batches, tidy
from quillstone.llm.vectors import exact_type, largest, narrowed, scaled

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
# Rows of a candidate block, anchors that a task holds, and rows of the first round of sorted access.
BLOCK_ROWS, ANCHOR_ROWS, FIRST_DEPTH = 8192, 1 << 16, 64
# Cells of (anchor group, candidate group) per core, so that tasks are even.
CELLS_PER_CORE = 4
# Anchors scored at once, and the share of a block from which scoring all of it is less work than picking rows.
AT_ONCE, DENSE = 256, 0.125
NONE = -(1 << 62)

PACKED = "number long, n int, ids binary, labels binary, numbers binary, kind string"


def packed(rows: DataFrame, block_rows: int, scale: int) -> DataFrame:
    """Rows (vec_id, label, vector) that take part, in blocks of at most ``block_rows``; one task's rows stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            whole, numbers = scaled(batch.column(2), scale)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[whole]
            labels = batch.column(1).to_numpy(zero_copy_only=False)[whole]
            at = 0
            while at < len(ids):
                take = min(len(ids) - at, block_rows - sum(len(h[0]) for h in held))
                held.append((ids[at : at + take], labels[at : at + take], numbers[at : at + take]))
                at += take
                if sum(len(h[0]) for h in held) == block_rows:
                    yield block(number, held)
                    number, held = number + 1, []
        if held:
            yield block(number, held)

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, numbers = (np.concatenate(column) for column in zip(*held))
        small = narrowed(numbers)
        row = [[number], [len(ids)], [ids.astype("<i8").tobytes()], [labels.astype("<i8").tobytes()], [small.tobytes()], [small.dtype.str]]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=[f.split()[0] for f in PACKED.split(", ")])

    chosen = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
    return chosen.mapInArrow(tidy(run), PACKED)


def unpacked(n: int, ids: bytes, labels: bytes, numbers: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(numbers, kind).reshape(n, -1)


class Lists:
    """The sorted lists of one block: per round and dimension, the rows that came up from either end, as bits."""

    def __init__(self, numbers: np.ndarray, first: int = FIRST_DEPTH) -> None:
        n, width = numbers.shape
        self.numbers = numbers
        order = np.argsort(numbers, axis=0, kind="stable")
        ranks = np.empty((n, width), np.int32)
        np.put_along_axis(ranks, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        ordered = np.take_along_axis(numbers, order, axis=0)
        self.depths = [min(n, first << i) for i in range(max(1, (-(-n // first) - 1).bit_length() + 1))]
        # the last component read from the upper and the lower end, per round
        self.upper = np.stack([ordered[n - t] for t in self.depths])
        self.lower = np.stack([ordered[t - 1] for t in self.depths])
        self.ranks, self.bits = ranks, {}

    def seen(self, round_: int) -> np.ndarray:
        """(2 x dimensions, bytes): rows among the first of the lists read downwards, then upwards."""
        if round_ not in self.bits:
            n, t = len(self.numbers), self.depths[round_]
            ends = np.concatenate([(self.ranks >= n - t).T, (self.ranks < t).T])
            self.bits = {round_: np.packbits(ends, axis=1)}
        return self.bits[round_]

    def thresholds(self, anchors: np.ndarray, round_: int) -> np.ndarray:
        """Highest score that a row can have which has not come up by this round, per anchor."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.upper[round_].astype(anchors.dtype) + down @ self.lower[round_].astype(anchors.dtype)


def threshold_scan(lists: Lists, anchors: np.ndarray, stops, found) -> int:
    """Runs the threshold algorithm for all anchors over one block; returns how many rows were scored.

    ``stops(anchors, thresholds)`` says which anchors are done, ``found(anchor, rows, scores)`` takes what came up.
    """
    n, width = lists.numbers.shape
    kind = exact_type(width * largest(lists.numbers) * largest(anchors))
    block, signed = lists.numbers.astype(kind), anchors.astype(kind)
    active, before = np.arange(len(anchors)), np.zeros((len(anchors), -(-n // 8)), np.uint8)
    scored = 0
    for round_ in range(len(lists.depths)):
        bits = lists.seen(round_)
        for at in range(0, len(active), AT_ONCE):
            part = active[at : at + AT_ONCE]
            dense = signed[part] @ block.T if lists.depths[round_] > DENSE * n else None
            for i, anchor in enumerate(part.tolist()):
                used = np.flatnonzero(anchors[anchor])
                up = np.bitwise_or.reduce(bits[used + width * (anchors[anchor, used] < 0)], axis=0)
                rows = np.flatnonzero(np.unpackbits(up & ~before[anchor], count=n))
                before[anchor] = up
                if len(rows):
                    scored += len(rows)
                    found(anchor, rows, (dense[i, rows] if dense is not None else block[rows] @ signed[anchor]).astype(np.int64))
        if round_ + 1 < len(lists.depths):
            active = active[~stops(active, lists.thresholds(signed[active], round_))]
            if not len(active):
                break
    # an anchor without a component other than 0 reads no list: every row has score 0
    for anchor in np.flatnonzero(~anchors.any(axis=1)).tolist():
        found(anchor, np.arange(n), np.zeros(n, np.int64))
    return scored


class Best:
    """The k highest scores per window, ties by smaller id."""

    def __init__(self, windows: int, k: int) -> None:
        self.k = k
        self.score = np.full((windows, k), NONE, np.int64)
        self.id = np.full((windows, k), np.iinfo(np.int64).max, np.int64)

    def add(self, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.score[window, -1]
        if keep.any():
            scores, ids = scores[keep], ids[keep]
            if len(scores) > 4 * self.k:
                least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                scores, ids = scores[scores >= least], ids[scores >= least]
            scores, ids = np.concatenate([self.score[window], scores]), np.concatenate([self.id[window], ids])
            order = np.lexsort((ids, -scores))[: self.k]
            self.score[window], self.id[window] = scores[order], ids[order]


class Anchors:
    """A task's group of anchors and what it has found for them."""

    def __init__(self, rows: list[tuple], k: int) -> None:
        parts = [unpacked(*r[1:6]) for r in rows]
        self.number = np.array([r[0] for r in rows], np.int64)
        self.id, self.label = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.numbers = np.concatenate([p[2].astype(np.int64) for p in parts])
        self.scores = [r[6] or [] for r in rows]
        width = max(1, max(map(len, self.scores), default=1))
        self.best = Best(len(rows) * width, k)
        self.width = width

    def positives(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> None:
        """Rows of the anchor's label, the anchor's own id left out; the lists hold that label alone."""
        for label in np.intersect1d(labels, self.label).tolist():
            rows, own = np.flatnonzero(labels == label), np.flatnonzero(self.label == label)

            def found(anchor: int, chosen: np.ndarray, scores: np.ndarray) -> None:
                other = ids[rows[chosen]] != self.id[own[anchor]]
                self.best.add(own[anchor], scores[other], ids[rows[chosen[other]]])

            threshold_scan(
                Lists(numbers[rows]), self.numbers[own], lambda active, bound: bound < self.best.score[own[active], -1], found
            )

    def windows(self, low: int, high: int) -> None:
        """Windows of negative scores, one per positive; those that hold no score are closed from the start."""
        self.low = np.full((len(self.id), self.width), np.iinfo(np.int64).max, np.int64)
        self.high = np.full((len(self.id), self.width), NONE, np.int64)
        for i, scores in enumerate(self.scores):
            for j, score in enumerate(scores):
                if -(-low * score // 100) <= high * score // 100:
                    self.low[i, j], self.high[i, j] = -(-low * score // 100), high * score // 100

    def negatives(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> None:
        open_ = np.flatnonzero((self.low <= self.high).any(axis=1))
        if not len(open_):
            return

        def found(anchor: int, rows: np.ndarray, scores: np.ndarray) -> None:
            a = open_[anchor]
            fit = (scores >= self.low[a].min()) & (scores <= self.high[a].max()) & (labels[rows] != self.label[a])
            scores, rows = scores[fit], rows[fit]
            for j in range(self.width):
                inside = (scores >= self.low[a, j]) & (scores <= self.high[a, j])
                if inside.any():
                    self.best.add(a * self.width + j, scores[inside], ids[rows[inside]])

        def stops(active: np.ndarray, bound: np.ndarray) -> np.ndarray:
            kth = self.best.score[:, -1].reshape(-1, self.width)[open_[active]]
            return (bound[:, None] < np.maximum(kth, self.low[open_[active]])).all(axis=1)

        threshold_scan(Lists(numbers), self.numbers[open_], stops, found)

    def table(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.best.score > NONE)
        arrays = [self.number[row // self.width], self.id[row // self.width], row % self.width, self.best.id[row, place], self.best.score[row, place]]
        return pa.RecordBatch.from_arrays(
            [pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["number", "anchor_id", "slot", "found_id", "score"],
        )


FOUND = "number long, anchor_id long, slot int, found_id long, score long"


def best_pairs(candidates: DataFrame, anchors: DataFrame, k: int, window: tuple[int, int] | None = None, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """The k best rows per anchor (``window`` None: same label) or per window (other labels), with their rank.

    ``anchors`` are blocks of one row with ``scores``, the positives' scores. Both sides are written tables. Anchor
    groups and candidate groups are bounded by what a task may hold; every pair of them is one cell of work.
    """
    spark = candidates.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchor_groups = max(1, -(-anchors.count() // anchor_rows))
    groups = max(1, min(candidates.count(), -(-CELLS_PER_CORE * cores // anchor_groups)))

    def group(count: int):
        return F.pmod(F.xxhash64("number"), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    none = F.lit(None).cast("array<long>")
    left = anchors.select("*", group(anchor_groups).alias("a"), every(groups).alias("g"), F.lit(0).alias("side"))
    right = candidates.withColumn("scores", none).select("*", F.lit(1).alias("side"), group(groups).alias("g"))
    right = right.withColumn("a", every(anchor_groups))
    columns = ["a", "g", "side", "number", "n", "ids", "labels", "numbers", "kind", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, held = None, [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                if row[:2] != cell:
                    if held is not None:
                        yield held.table()
                    cell, waiting, held = row[:2], [], None
                if row[2] == 0:
                    waiting.append(row[3:])
                elif waiting or held is not None:
                    if held is None:
                        held, waiting = Anchors(waiting, k), []
                        if window:
                            held.windows(*window)
                    (held.negatives if window else held.positives)(*unpacked(*row[4:9]))
        if held is not None:
            yield held.table()

    both = left.select(columns).unionByName(right.select(columns))
    cells = both.repartition(anchor_groups * groups, "a", "g").sortWithinPartitions("a", "g", "side", "number")
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "found_id")
    return cells.mapInArrow(tidy(run), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """Hard negatives per anchor and positive, from rows (vec_id, label, vector, anchor).

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Positives of a row with
    ``anchor`` true are its best ``positives`` rows of the same label and another vec_id; negatives are the best
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's. Scores are
    inner products of floor(scale * x).

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part. Rows that
    repeat a vec_id are rows of their own, also as anchors, but never each other's positive. Labels are whole numbers.
    Vectors of several lengths and scores beyond 64 bits raise. Other columns are not looked at; an empty table and a
    table without anchors give an empty result.
    """
    with text_batches(rows.sparkSession):
        candidates = materialise(packed(rows, block_rows, scale), "candidates")
        own = materialise(packed(rows.where("anchor"), 1, scale), "anchors").withColumn("scores", F.lit(None).cast("array<long>"))
        best = materialise(best_pairs(candidates, own, positives, None, anchor_rows), "positives")
    best = best.select("number", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("slot"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"])
    scores = best.groupBy("number").agg(in_order.alias("scores"))
    with text_batches(rows.sparkSession):
        found = materialise(best_pairs(candidates, own.drop("scores").join(scores, "number"), negatives, (low, high), anchor_rows), "negatives")
    return found.join(best.drop("anchor_id"), ["number", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
