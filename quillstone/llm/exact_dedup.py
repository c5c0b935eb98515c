"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import bit_filter, drop_by_text, flag_by_filter, folded, in_blocks, materialise, text_batches, tidy

# Fingerprints that a merged block holds on average; it bounds what one merge task reads for a block.
BLOCK_FINGERPRINTS = 1 << 17
MOST_BLOCK_BITS = 24


def pack_filter(prints: np.ndarray, counts: np.ndarray, remainder_bits: int) -> bytes:
    """A counting quotient filter over sorted distinct fingerprints.

    Layout: number of slots, number of runs, lengths of the runs, their quotients (as gaps), the remainders in run
    order, a bit per slot that says whether a counter follows, and the counters above one.
    """
    quotients = prints >> np.uint64(remainder_bits)
    remainders = prints & np.uint64((1 << remainder_bits) - 1)
    run, length = np.unique(quotients, return_counts=True)
    several = counts > 1
    width = "<u4" if remainder_bits <= 32 else "<u8"
    return b"".join(
        [
            np.array([len(prints), len(run)], "<u8").tobytes(),
            length.astype("<u4").tobytes(),
            np.diff(run, prepend=np.uint64(0)).astype("<u8").tobytes(),
            remainders.astype(width).tobytes(),
            np.packbits(several).tobytes(),
            counts[several].astype("<u8").tobytes(),
        ]
    )


def unpack_filter(data: bytes, remainder_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in ascending order and their counts: the filter keeps every bit of both."""
    slots, runs = (int(x) for x in np.frombuffer(data, "<u8", 2))
    at = 16
    length = np.frombuffer(data, "<u4", runs, at)
    at += 4 * runs
    quotients = np.cumsum(np.frombuffer(data, "<u8", runs, at), dtype=np.uint64)
    at += 8 * runs
    wide = 4 if remainder_bits <= 32 else 8
    remainders = np.frombuffer(data, f"<u{wide}", slots, at).astype(np.uint64)
    at += wide * slots
    several = np.unpackbits(np.frombuffer(data, np.uint8, (slots + 7) // 8, at), count=slots).astype(bool)
    at += (slots + 7) // 8
    counts = np.ones(slots, np.uint64)
    counts[several] = np.frombuffer(data, "<u8", int(several.sum()), at)
    return (np.repeat(quotients, length) << np.uint64(remainder_bits)) | remainders, counts


def merge_filters(filters: list[bytes], remainder_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One filter from many: sorted remainders are interleaved and equal ones add their counters; nothing is lost."""
    parts = [unpack_filter(x, remainder_bits) for x in filters]
    prints = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.empty(0, int)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def fingerprints(docs: DataFrame, bits: int = 64, with_text: bool = False) -> DataFrame:
    """(doc_id, fp, text_sha256[, norm]) of every row; texts are folded A-Z only and null counts as empty."""
    shape = "doc_id long, fp long, text_sha256 string" + (", norm string" if with_text else "")
    names = ["doc_id", "fp", "text_sha256"] + ["norm"] * with_text
    drop = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_blocks(whole, "text")):
            texts = folded(batch.column(1))
            prints = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64) >> drop
            out = [
                batch.column(0),
                pa.array(prints.view(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ]
            if with_text:
                out.append(pa.array([t.decode() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), shape)


def repeated_fingerprints(prints: DataFrame, rows: int, bits: int = 64) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once.

    Every partition builds one filter and cuts it by leading quotient bits into blocks; a block's filters meet in one
    task, which holds BLOCK_FINGERPRINTS of them on average. A fingerprint travels once per partition, with its count.
    """
    block_bits = min(MOST_BLOCK_BITS, bits - 1, max(0, math.ceil(math.log2(max(1, rows) / BLOCK_FINGERPRINTS))))
    remainder_bits = min(32, (bits - block_bits) // 2)
    top = np.uint64(bits - block_bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not sum(map(len, seen)):
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        blocks = values >> top if block_bits else np.zeros(len(values), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist() + [len(values)]
        for i in range(0, len(at) - 1, 1024):
            spans = list(zip(at[i : i + 1024], at[i + 1 : i + 1025]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(blocks[a]) for a, _ in spans], pa.int32()),
                    pa.array([pack_filter(values[a:b], counts[a:b], remainder_bits) for a, b in spans], pa.binary()),
                ],
                names=["block", "filter"],
            )

    def merge(group: pa.Table) -> pa.Table:
        values, counts = merge_filters(group.column("filter").to_pylist(), remainder_bits)
        several = counts > 1
        return pa.table({"fp": pa.array(values[several].view(np.int64)), "n": pa.array(counts[several].astype(np.int64))})

    filters = prints.select("fp").mapInArrow(tidy(build), "block int, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after folding A-Z; null counts as empty, so null and empty texts form one
    group. Of equal texts the largest doc_id stays; rows that repeat that doc_id stay with it. A null doc_id loses
    against any number and stays only in a group without numbers. Other columns of the input are not looked at, and an
    empty table gives an empty result. ``bits`` is the length of the fingerprint; a short one only sends more texts to
    the byte verification.
    """
    with text_batches(docs.sparkSession):
        prints = materialise(fingerprints(docs, bits), "fingerprints")
    again = repeated_fingerprints(prints, prints.count(), bits)
    # The bit filter has a fixed size, so it may be broadcast; what it lets through is compared byte by byte.
    routed = flag_by_filter(fingerprints(docs, bits, with_text=True), F.col("fp"), bit_filter(again, F.col("fp")))
    groups = (
        routed.where("__maybe")
        .groupBy("fp", "norm")
        .agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keep"))
        .where("_n > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "_n", "_keep")
    )
    with text_batches(docs.sparkSession):
        groups = materialise(groups, "copies")
    keep = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("doc_id"))
    return (
        prints.join(groups, "text_sha256", "left")
        .select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps, one of each group; only rows in doubt are shuffled.

    Decisions go by id and text, so rows that share an id with other texts, or have none, fare as their own text does.
    """
    return drop_by_text(docs, exact_dedup(docs, bits))
