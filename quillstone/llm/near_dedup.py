"""MinHash near-duplicates with min-max signatures.

Each permutation of the shingle hashes gives two signature values, its smallest and its largest, so half as many
permutations are evaluated. Rows with equal bands meet in a bucket; links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import (
    drop_rows,
    folded,
    folded_digest,
    id_key,
    in_blocks,
    keep_rows,
    materialise,
    mix,
    one_of_ties,
    shingle_sets,
    split_rows,
    text_batches,
    tidy,
)
from quillstone.llm.components import components

SHINGLE = 5
PERCENT = 80
# 40 permutations make 80 values in bands of BAND_ROWS or fewer: as many as keep the probability that a pair at the
# threshold misses all bands under MISS. At 0.85 16 bands of 5 miss with 0.00008, at 0.8 20 bands of 4 with 0.00003.
PERMUTATIONS = 40
BAND_ROWS = 5
MISS = 0.0001
# Rows of a bucket that are compared in one task come in blocks of this many; two blocks meet at a time.
BLOCK = 1024
COLUMNS = 1 << 13

_factors = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_salts = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))


def min_max(shingles: np.ndarray) -> np.ndarray:
    """All minima, then all maxima, of the shingles under each permutation x -> x * odd + salt."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        moved = _factors[:, None] * shingles[None, at : at + (1 << 14)] + _salts[:, None]
        low, high = np.minimum(low, moved.min(axis=1)), np.maximum(high, moved.max(axis=1))
    return np.concatenate([low, high])


def band_rows(percent: int) -> int:
    """Values per band for a threshold."""
    for size in range(BAND_ROWS, 1, -1):
        if (1 - (percent / 100) ** size) ** (2 * PERMUTATIONS // size) <= MISS:
            return size
    return 1


def band_keys(signatures: np.ndarray, size: int = BAND_ROWS) -> np.ndarray:
    """One key per band of ``size`` values and row: the values, folded into 64 bits together with the band's number."""
    whole = signatures.shape[1] // size * size
    grouped = signatures[:, :whole].reshape(len(signatures), -1, size)
    keys = np.broadcast_to(mix(np.arange(grouped.shape[1], dtype=np.uint64) + np.uint64(17)), grouped.shape[:2]).copy()
    for i in range(size):
        keys = mix(keys ^ grouped[:, :, i])
    return keys


def profiles(docs: DataFrame, shingle: int, size: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): set_a and set_b are two sums over the set and so stand for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_blocks(batch, "text"):
                sets = shingle_sets(folded(part.column(1)), shingle)
                signatures = np.stack([min_max(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(list(band_keys(signatures, size).view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    shape = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), shape)


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the sorted 64-bit hashes of a document's distinct shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_blocks(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(folded(part.column(1)), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles binary")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Square matrix: which sets have 100 * intersection >= percent * union, from exact intersection sizes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = np.array([[sizes[0], 0], [0, sizes[1]]], np.int64)
        if 100 * sizes.min() >= percent * sizes.max():
            common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        shared = np.bincount(at) > 1
        column = np.cumsum(shared) - 1
        kept = shared[at]
        owner, at = owner[kept], column[at[kept]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        exact = np.zeros((n, n), np.float64)
        for a in range(0, int(shared.sum()), COLUMNS):
            lo, hi = np.searchsorted(at, [a, a + COLUMNS])
            bag = np.zeros((n, COLUMNS), np.float32)
            bag[owner[lo:hi], at[lo:hi] - a] = 1
            exact += bag @ bag.T  # at most COLUMNS per step, so float32 is exact
        common = exact.astype(np.int64)
        common[np.arange(n), np.arange(n)] = sizes
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def local_roots(near: np.ndarray) -> np.ndarray:
    """Smallest reachable row number for every row of a link matrix."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def bucket_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold in each group of rows (_band, _key, _i, _j, rep, shingles): enough to connect what is linked.

    Rows of a group arrive one after another; a group has at most two blocks. Only confirmed links are followed and a
    row is linked to the first row it reaches, so pairs are not written out.
    """

    def close(ids: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        order = np.argsort(ids, kind="stable")
        number = np.array(ids, np.int64)[order]
        roots = local_roots(linked([np.frombuffer(sets[i], np.uint64) for i in order], percent))
        return [(int(number[i]), int(number[r])) for i, r in enumerate(roots) if r != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for key, rep, data in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if key != group:
                    out += close(ids, sets)
                    group, ids, sets = key, [], []
                ids.append(rep)
                sets.append(data)
            yield table_of(out)
        yield table_of(close(ids, sets))

    def table_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["_band", "_key", "_i", "_j"]
    ordered = rows.select(*keys, "rep", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(tidy(run), "a long, b long")


def candidate_groups(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_band, _key, _i, _j, rep): the rows to compare, from (rep, bands).

    Buckets with the same members are compared once: members are told apart by two xor sums that need no collecting.
    A bucket of more than ``block`` members is cut into blocks by a hash, and each pair of blocks is a group, so every
    pair of members meets and no group grows beyond two blocks.
    """
    banded = reps.select("rep", F.posexplode("bands").alias("_band", "_key"))
    buckets = (
        banded.groupBy("_band", "_key")
        .agg(
            F.count("*").alias("_n"),
            F.bit_xor(F.xxhash64("rep")).alias("_x"),
            F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("_y"),
            F.min("rep").alias("_low"),
        )
        .where("_n > 1")
        .groupBy("_n", "_x", "_y", "_low")
        .agg(F.min(F.struct("_band", "_key")).alias("_b"))
        .select(F.col("_b._band").alias("_band"), F.col("_b._key").alias("_key"), "_n")
    )
    blocks = F.ceil(F.col("_n") / block).cast("int")
    members = banded.join(buckets, ["_band", "_key"]).withColumn("_blocks", blocks)
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_blocks")).cast("int")
    others = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_own"))
    )
    met = members.withColumn("_own", own).withColumn("_other", F.explode(others))
    return met.select(
        "_band", "_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "rep"
    )


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Words are what stands between ASCII white space, with A-Z folded. A document's set has its distinct ``shingle``-word
    runs, the whole sequence where it has fewer words. Documents with equal sets are one node; nodes are linked when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable. Null and empty texts, and
    texts of white space only, have no shingles and stay alone, as do rows with a null id (component_id null, kept).
    Rows that repeat a doc_id are one node of the graph. Only doc_id and text are looked at; an empty table gives an
    empty result.
    """
    with text_batches(docs.sparkSession):
        seen = materialise(profiles(docs, shingle, band_rows(percent)), "profiles")
    some = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = materialise(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "sets")
    banded = some.select(F.col("doc_id").alias("rep"), "set_a", "set_b", "bands").join(reps, ["rep", "set_a", "set_b"], "left_semi")
    groups = materialise(candidate_groups(banded, block), "buckets")
    wanted = groups.select(F.col("rep").alias("doc_id")).distinct()
    texts = keep_rows(docs.select(F.col("doc_id").cast("long"), "text"), wanted)
    sets = sets_of(texts, shingle).withColumnRenamed("doc_id", "rep")
    with text_batches(docs.sparkSession):
        links = materialise(bucket_links(groups.join(sets, "rep"), percent).distinct(), "links")
    found = components(links)
    named = reps.join(found, reps.rep == found.node, "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("_component")
    )
    return (
        seen.drop("bands")
        .join(named, ["set_a", "set_b"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def told_apart(docs: DataFrame) -> DataFrame:
    """Adds ``__row``, a number per distinct row: doc_id where it is the row's own, else a number above all ids.

    Rows without an id and rows that share one are numbered by id and folded text, and those that agree in both are one
    row. Only they are shuffled; the numbers are written, so that they do not change when they are read again.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1 OR doc_id IS NULL")
    shared = materialise(ids.select(id_key().alias("__id")), "shared-ids")
    told = docs.withColumn("__id", id_key())
    own, doubt = split_rows(told, shared, "__id")
    joined = doubt.join(shared.withColumn("__shared", F.lit(True)), "__id", "left").withColumn("__sha", folded_digest())
    own = own.unionByName(joined.where("__shared IS NULL").drop("__shared", "__sha"))
    once = one_of_ties(joined.where("__shared").drop("__shared"), "__id", "__sha")
    above = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0).cast("long"))).first()[0]
    numbered = once.select(docs.columns).withColumn("__row", F.monotonically_increasing_id() + F.lit(above + 1))
    return own.select(*docs.columns, F.col("doc_id").cast("long").alias("__row")).unionByName(materialise(numbered, "told-apart"))


def drop_near(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of the one document per component that stays.

    The smallest doc_id stays. Rows that have no id, or share theirs with other texts, are documents of their own that
    come after all others; of rows that agree in id and text one stays.
    """
    rows = told_apart(docs)
    plain = rows.select(F.col("__row").alias("doc_id"), "text")
    gone = near_dedup(plain, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__row"))
    return drop_rows(rows, gone, "__row").select(docs.columns)
