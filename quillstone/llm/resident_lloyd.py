"""Vector code compression: product codes from Lloyd rounds whose members stay with the owner of their entry.

A vector is cut into equal parts. Each part is a member of one entry of its position's codebook, and lives in the
partition that owns (position, entry, salt); the salt deals the members of a popular entry out to many owners. A round
sums the resident members, replaces the entries, and assigns every member anew where it is: those that keep their entry
stay, and only those that change it go through the next shuffle. DataFrames cannot join what stays in a partition of
Python results with what arrives there, so the rounds are pair RDDs under one partitioner, whose union needs no shuffle.

What the rounds hold comes again from the input and the shuffles of at most ``rounds`` rounds when an executor is lost.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, mix, tidy
from quillstone.llm.vectors import exact_type, largest, narrowed, scaled
from quillstone.session import fits

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Members of one entry that share an owner, if the entry had them all; also the rows of a block that is moved.
OWNER_ROWS, BLOCK_ROWS = 4096, 1 << 14
# Members per partition of the rounds, beyond what the session's shuffle partitions give.
PARTITION_MEMBERS = 1 << 21

# (position, entry, salt, numbers) of some members.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def nearest(numbers: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry per row, ties to the lower index; exact."""
    bound = largest(numbers) + largest(book)
    kind = exact_type(4 * numbers.shape[1] * bound * bound)
    x, b = numbers.astype(kind), book.astype(kind)
    cost = (b * b).sum(axis=1)[None, :] - 2 * (x @ b.T)
    entry = cost.argmin(axis=1)
    found = cost[np.arange(len(x)), entry] + (x * x).sum(axis=1)
    return entry, found.astype(np.int64)


def assign(position: np.ndarray, numbers: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.empty(len(position), np.uint16)
    for p in range(len(books)):
        rows = np.flatnonzero(position == p)
        if len(rows):
            out[rows] = nearest(numbers[rows], books[p])[0]
    return out


def owner(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each (position, entry, salt)."""
    key = position.astype(np.uint64) << np.uint64(48) | entry.astype(np.uint64) << np.uint64(32) | salt.astype(np.uint64)
    return (mix(key + np.uint64(1)) % np.uint64(partitions)).astype(np.int64)


def here(partition: int) -> int:
    """Partitioner of the rounds: keys are partition numbers already."""
    return partition


def dealt(block: Block, partitions: int) -> Iterator[tuple[int, Block]]:
    """The block's members, cut by the partition that owns them."""
    target = owner(*block[:3], partitions)
    order = np.argsort(target, kind="stable")
    edges = np.flatnonzero(np.diff(target[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(target[rows[0]]), tuple(column[rows] for column in block)


def first_books(vectors: DataFrame, entries: int, parts: int, scale: int) -> np.ndarray | None:
    """The parts of the ``entries`` smallest ids in ascending order; None without rows.

    Null ids come last; rows that share an id are ordered by their numbers. Every batch hands on its ``entries`` first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = scaled(batch.column(1), scale)
            ids = batch.column(0).take(pa.array(rows))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            named = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((*numbers.T[::-1], named, missing))[:entries]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(order)), pa.array(list(numbers[order]), pa.list_(pa.int64()))], names=["vec_id", "numbers"]
            )

    found = vectors.select("vec_id", "vector").mapInArrow(tidy(run), "vec_id long, numbers array<long>")
    first = found.orderBy(F.asc_nulls_last("vec_id"), "numbers").limit(entries).collect()
    if not first:
        return None
    numbers = np.array([r["numbers"] for r in first], np.int64)
    if numbers.shape[1] % parts:
        raise ValueError(f"vectors of {numbers.shape[1]} components cannot be cut into {parts} equal parts")
    return np.stack(np.split(numbers, parts, axis=1))


def members(vectors: DataFrame, books: np.ndarray, scale: int, salts: int, partitions: int) -> RDD:
    """(partition, block) of all parts, assigned to ``books``; keys are the partitions that own them."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for batch in batches:
            rows, numbers = scaled(batch.column(0), scale)
            for at in range(0, len(rows), BLOCK_ROWS):
                cut = narrowed(numbers[at : at + BLOCK_ROWS])
                position = np.repeat(np.arange(parts, dtype=np.uint8), len(cut))
                pieces = np.concatenate(np.split(cut, parts, axis=1))
                salt = (mix(seen + np.arange(len(cut), dtype=np.uint64)) % np.uint64(salts)).astype(np.uint32)
                seen += np.uint64(len(cut))
                block = position, assign(position, pieces, books), np.tile(salt, parts), pieces
                targets, blocks = zip(*dealt(block, partitions))
                packed = [pickle.dumps(b, protocol=5) for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int64()), pa.array(packed, pa.binary())], names=["owner", "block"])

    rows = vectors.select("vector").mapInArrow(tidy(run), "owner long, block binary").rdd
    return rows.map(lambda row: (row[0], pickle.loads(row[1])))


def moved_out(records: Iterator[tuple[int, Block]], books, partitions: int) -> Iterator[tuple[bool, int, Block]]:
    """(moves, partition, block): members that keep their entry under the new books, and those that go elsewhere."""
    for at, (position, entry, salt, numbers) in records:
        now = assign(position, numbers, books.value)
        stay = now == entry
        if stay.any():
            yield False, at, (position[stay], entry[stay], salt[stay], numbers[stay])
        go = ~stay
        if go.any():
            for target, block in dealt((position[go], now[go], salt[go], numbers[go]), partitions):
                yield True, target, block


def chosen(records: Iterator[tuple[bool, int, Block]], moves: bool) -> Iterator[tuple[int, Block]]:
    return ((at, block) for moved, at, block in records if moved == moves)


def sums(records: Iterator[tuple[int, Block]], shape: tuple[int, int, int]) -> Iterator[tuple[int, tuple[np.ndarray, int]]]:
    """Sum and count of the resident members of every entry that has any here; one table of the codebook's size."""
    parts, entries, width = shape
    count = np.zeros(parts * entries, np.int64)
    total = np.zeros((parts * entries, width), np.int64)
    large: dict[int, list] = {}  # sums of components for which 64 bits could be too few
    for _, (position, entry, _, numbers) in records:
        key = position.astype(np.int64) * entries + entry
        count += np.bincount(key, minlength=parts * entries)
        if largest(numbers) < 1 << 31:
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            total[key[order][starts]] += np.add.reduceat(numbers[order].astype(np.int64), starts, axis=0)
        else:
            for k, row in zip(key.tolist(), numbers.tolist()):
                large[k] = [a + b for a, b in zip(large.get(k, [0] * width), row)]
    for k in np.flatnonzero(count).tolist():
        yield k, (total[k].astype(object) + np.array(large[k], object) if k in large else total[k], int(count[k]))


def added(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    return a[0] + b[0], a[1] + b[1]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (part, entry, component) after ``rounds`` rounds over all rows of (vec_id, vector); None without rows.

    Only codebooks come to the driver: their size is parts x entries x components, whatever the number of rows.
    """
    spark = vectors.sparkSession
    books = first_books(vectors, entries, parts, scale)
    if books is None or not rounds:
        return books
    rows = vectors.count()
    salts = -(-rows // OWNER_ROWS)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * parts // PARTITION_MEMBERS))
    resident = members(vectors, books, scale, salts, partitions).partitionBy(partitions, here)
    partitions, before, kept = resident.getNumPartitions(), None, None
    for number in range(rounds):
        if number:
            split = partial(moved_out, books=spark.sparkContext.broadcast(books), partitions=partitions)
            before, kept = kept, resident.mapPartitions(split, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            stay = kept.mapPartitions(partial(chosen, moves=False), preservesPartitioning=True)
            arrive = kept.mapPartitions(partial(chosen, moves=True)).partitionBy(partitions, here)
            resident = stay.union(arrive)
        found = resident.mapPartitions(partial(sums, shape=books.shape)).reduceByKey(added).collect()
        books = books.copy()
        for key, (total, count) in found:
            books[divmod(key, books.shape[1])] = [int(t) // count for t in total]
        if before is not None:
            before.unpersist()
    if kept is not None:
        kept.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Adds (code, error) to the rows that take part: two hex digits per part, and the summed squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    at = vectors.columns.index("vector")
    others = [c for c in vectors.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = scaled(batch.column(at), scale)
            codes, error = np.empty((len(rows), len(shared.value)), np.uint8), np.zeros(len(rows), np.int64)
            for p, cut in enumerate(np.split(numbers, len(shared.value), axis=1) if len(rows) else []):
                codes[:, p], distance = nearest(cut, shared.value[p])
                error += distance
            left = batch.take(pa.array(rows))
            columns = [left.column(i) for i in range(left.num_columns) if i != at]
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, text, pa.array(error)], names=[*others, "code", "error"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "vector")
    return vectors.mapInArrow(tidy(run), f"{shape}, code string, error long")


def restore(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Adds ``vector``, the entries that a code names, scaled back to the middle of their steps."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    at = codes.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column(at).to_pylist())), np.uint8).reshape(-1, len(shared.value))
            found = np.concatenate([book[index[:, p]] for p, book in enumerate(shared.value)], axis=1)
            yield batch.append_column("vector", pa.array(list((found + 0.5) / scale), pa.list_(pa.float64())))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(tidy(run), f"{shape}, vector array<double>")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept row of (vec_id, vector, label): (vec_id, code, error, label_error, codebooks_sha256).

    Rows whose vector is null, empty or holds a null or non-finite component are dropped. Rows that repeat a vec_id are
    rows of their own, a null vec_id comes after all others in the first codebooks, null labels are one label. With
    fewer rows than ``entries`` the codebooks have as many entries as rows. Vectors of several lengths, and lengths that
    ``parts`` does not divide, raise. Other columns are not looked at; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "vector")
    shape = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], shape)
    codes = materialise(encode(rows, books, scale), "vector-codes")
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    per_label = per_label.withColumnRenamed("label", "_label")
    if fits(per_label):
        per_label = F.broadcast(per_label)
    found = codes.join(per_label, codes.label.eqNullSafe(per_label["_label"]), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
