"""Helpers shared by the corpus operators: written tables, bounded bit filters, word and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import materialise, work_dir  # noqa: F401

# Words of a bit filter: its size is fixed, whatever it is built from (2^18 rows of two longs).
FILTER_WORDS = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
WHITE_BYTE = re.compile(rb"[\x20\x09-\x0d]")
SLICE = 1 << 19
BATCH_BYTES = 8 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def bit_filter(values: DataFrame, key: Column) -> DataFrame:
    """(__word, __bits): a bit set of fixed size over hashes of ``key``, at most FILTER_WORDS rows however many values."""
    place = F.xxhash64(key)
    word = place.bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = F.shiftrightunsigned(place, 58)
    return values.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("__bits"))


def flag_by_filter(df: DataFrame, key: Column, bits: DataFrame, name: str = "__maybe") -> DataFrame:
    """Adds ``name``: false where ``key`` is surely not among the filter's values. The filter's size bounds the broadcast."""
    place = F.xxhash64(key)
    word = place.bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = F.shiftrightunsigned(place, 58)
    there = F.call_function("shiftright", F.col("__bits"), bit.cast("int")).bitwiseAND(F.lit(1))
    return (
        df.withColumn("__word", word)
        .join(F.broadcast(bits), "__word", "left")
        .withColumn(name, F.coalesce(there == 1, F.lit(False)))
        .drop("__word", "__bits")
    )


def split_rows(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows surely outside ``ids``, and rows that may be in it; only the latter need a join."""
    flagged = flag_by_filter(df, F.col(key), bit_filter(ids, F.col(key)))
    return flagged.where(~F.col("__maybe")).drop("__maybe"), flagged.where("__maybe").drop("__maybe")


def keep_rows(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in ``ids`` (one column); only rows that pass the bit filter are shuffled."""
    return split_rows(df, ids, key)[1].join(ids, key, "left_semi")


def drop_rows(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in ``ids``; rows outside the bit filter stay where they are. Null keys stay."""
    out, doubt = split_rows(df, ids, key)
    return out.unionByName(doubt.join(ids, key, "left_anti"))


def folded_digest(text: str = "text") -> Column:
    """SHA-256 of a text's UTF-8 bytes with A-Z in lower case; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase).cast("binary"), 256)


def id_key(key: str = "doc_id") -> Column:
    """A plain join key for an id that may be null."""
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def one_of_ties(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, the least by all columns; summed before the shuffle, so a row repeated any number of times is fine."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*")


def drop_by_text(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, text_sha256, kept) keep, told apart by id and folded text.

    A null id is an id like others. Of rows that share id and text one stays. Rows whose id is in no decision against
    it and in no such tie stay where they are, only the others are shuffled.
    """
    gone = decisions.where("NOT kept").select("doc_id", "text_sha256").withColumn("__gone", F.lit(True))
    ties = decisions.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("__n")).where("__n > 1")
    acted = gone.distinct().unionByName(ties.select("doc_id", "text_sha256", F.lit(False).alias("__gone")))
    acted = materialise(acted.select(id_key().alias("__id"), F.col("text_sha256").alias("__sha"), "__gone"), "acted")
    told = docs.withColumn("__id", id_key())
    out, doubt = split_rows(told, acted.select("__id"), "__id")
    found = doubt.withColumn("__sha", folded_digest()).join(acted, ["__id", "__sha"], "left")
    tied = one_of_ties(found.where("__gone = false").drop("__gone"), "__id", "__sha")
    left = found.where("__gone IS NULL").select(docs.columns)
    return out.select(docs.columns).unionByName(left).unionByName(tied.select(docs.columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(n + n // 4 + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def _slice_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.zeros(len(buffer) + 2, np.int8)
    solid[1:-1] = ~WHITE[buffer]
    turn = np.diff(solid)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buffer))[: len(buffer)], out=sums[1:])
    raw = (sums[end] - sums[start]) * powers(INVERSE, len(buffer) + 1)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte offsets of the white-space separated words, in slices of bounded size."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            found = WHITE_BYTE.search(data, end)
            end = found.end() if found else len(data)
        h, s = _slice_words(np.frombuffer(data, np.uint8, min(end, len(data)) - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles; fewer words than ``size`` make one shingle."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    hashes, start = word_hashes(b"\n".join(texts))
    cut = np.searchsorted(start, first)
    factors = [mix(np.uint64([7919 * (i + 1)]))[0] | np.uint64(1) for i in range(size)]
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for i, factor in enumerate(factors):
        rolled += hashes[i : n - size + 1 + i] * factor if n >= size else rolled
    rolled = mix(rolled)
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        words = b - a
        if words >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif words:
            short = hashes[a:b] * np.array(factors[:words], np.uint64)
            out.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(words)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def folded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every text with A-Z in lower case; null counts as empty."""
    return [b.lower() if b else b"" for b in column.cast(pa.large_binary()).to_pylist()]


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 1000):
    """While a table is written inside, Arrow batches have at most ``rows`` rows and about BATCH_BYTES: whole texts are
    wide, and a batch is held by the executor and by its worker. The session's settings are put back afterwards."""
    limits = {"maxRecordsPerBatch": rows, "maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(f"spark.sql.execution.arrow.{key}") for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def tidy(run):
    """``run`` over Arrow batches, after which the worker hands freed memory back: it stays alive between tasks, and what
    it holds on to counts against its executor."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def in_blocks(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Slices of a batch with a bounded volume of text; a longer text comes alone."""
    at, volume = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i > at and volume + size > most:
            yield batch.slice(at, i - at)
            at, volume = i, 0
        volume += size
    if at < batch.num_rows:
        yield batch.slice(at)
