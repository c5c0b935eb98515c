"""Token files: length-delimited binary records with masked checksums, and a separate offset index.

A record is: length (u64), masked checksum of the length (u32), data, masked checksum of the data (u32); all little
endian. Data is doc_id (i64), a flag whether it is null (u8), bytes per id (u8: 2 where the vocabulary fits, else 4)
and the ids. Checksums are CRC-32, rotated by 15 bits and shifted by a constant, so that data that holds checksums
does not check itself. The index holds the offset of every record (u64) and the end of the file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.byte_pieces import encoder
from quillstone.llm.common import in_blocks, materialise, text_batches, tidy, work_dir

SHARD_BYTES = 64 << 20
END_ID = 0
MASK = 0xA282EAD8
HEAD = "<QI"
INFO = "<qBB"
HEAD_BYTES, INFO_BYTES = struct.calcsize(HEAD), struct.calcsize(INFO)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join([length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))])


def read_frame(stream) -> bytes | None:
    """The next record's data, None at the end; a record that is cut short or fails a checksum raises."""
    head = stream.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES:
        raise ValueError("record header cut short")
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("record length fails its checksum")
    data = stream.read(length)
    tail = stream.read(4)
    if len(data) < length or len(tail) < 4:
        raise ValueError("record cut short")
    if masked(data) != struct.unpack("<I", tail)[0]:
        raise ValueError("record data fails its checksum")
    return data


def pack_ids(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
    return struct.pack(INFO, doc_id or 0, doc_id is None, 2 if narrow else 4) + body


def unpack_ids(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from(INFO, data)
    return None if null else doc_id, np.frombuffer(data, f"<u{width}", offset=INFO_BYTES).astype("<u4")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Shard:
    """One file of records and its index, written side by side."""

    def __init__(self, folder: str) -> None:
        system, root = opened(folder)
        system.create_dir(root)
        name = uuid.uuid4().hex
        self.path, self.index = f"{folder}/{name}.rec", f"{folder}/{name}.idx"
        self.out = system.open_output_stream(f"{root}/{name}.rec")
        self.index_out = system.open_output_stream(f"{root}/{name}.idx")
        self.size = self.records = self.tokens = 0

    def add(self, data: bytes, tokens: int) -> None:
        self.index_out.write(struct.pack("<Q", self.size))
        record = frame(data)
        self.out.write(record)
        self.size += len(record)
        self.records += 1
        self.tokens += tokens

    def close(self) -> None:
        self.index_out.write(struct.pack("<Q", self.size))
        self.out.close()
        self.index_out.close()


MANIFEST = "part int, shard int, path string, index_path string, records long, tokens long"


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order and returns the manifest, one row per file.

    A task names its files anew at each attempt; only files of attempts that succeeded are in the manifest, so a lost
    executor leaves unused files and nothing else. Null ids come first, equal ids in any order.
    """
    folder = folder or work_dir(docs.sparkSession, "token-records")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares or [0.5], 100 * parts)).first()[0]
    bounds = np.array(found or [], np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        narrow, end = enc.vocabulary <= 1 << 16, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for block in in_blocks(batch, "text"):
                ids = enc.encode([t or "" for t in block.column(1).to_pylist()])
                data = [pack_ids(doc_id, i + end, narrow) for doc_id, i in zip(block.column(0).to_pylist(), ids)]
                tokens = pa.array([len(i) // 4 + 1 for i in ids], pa.int64())
                known = block.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                part = pa.array(np.minimum(np.searchsorted(bounds, known), parts - 1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([block.column(0), part, tokens, pa.array(data, pa.binary())], names=["doc_id", "part", "tokens", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[Shard] = []
        for batch in batches:
            for tokens, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not shards or shards[-1].size >= shard_bytes:
                    if shards:
                        shards[-1].close()
                    shards.append(Shard(folder))
                shards[-1].add(data, tokens)
        if shards:
            shards[-1].close()
            part = TaskContext.get().partitionId()
            rows = [[part] * len(shards), range(len(shards))] + [[getattr(s, k) for s in shards] for k in ("path", "index", "records", "tokens")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(r), t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "shard", "path", "index_path", "records", "tokens"],
            )

    # texts are encoded where they lie, and their ids, about half the size, are shuffled by ranges of doc_id
    with text_batches(docs.sparkSession):
        ids = rows.mapInArrow(tidy(encoded), "doc_id long, part int, tokens long, data binary")
        ordered = ids.repartitionById(parts, "part").sortWithinPartitions("doc_id").select("tokens", "data")
        return materialise(ordered.mapInArrow(tidy(run), MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in all files before; the window holds one row per file."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record: (doc_id, start, n_tokens, ids_crc32), files read front to back and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = opened(path)
                with system.open_input_stream(name, buffer_size=1 << 20) as stream:
                    rows: list[tuple] = []
                    while (data := read_frame(stream)) is not None:
                        doc_id, ids = unpack_ids(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield table_of(rows)
                            rows = []
                    if rows:
                        yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    files = placed(manifest).select("path", "base")
    # one file is one unit of work; they are dealt out to all cores
    spread = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism) * 4)
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """(place, doc_id, ids) of all records in a random order fixed by ``seed``, fetched by the offset index.

    Index entries are ordered by a hash, and every task fetches its range of them; file data is not shuffled.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = opened(index)
                with system.open_input_stream(name) as stream:
                    at = np.frombuffer(stream.read(), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * (len(at) - 1), pa.string()), pa.array(at[:-1])], names=["path", "at"]
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, object] = {}
        for batch in batches:
            places, paths, offsets = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for path, offset in zip(paths, offsets):
                if path not in handles:
                    if len(handles) >= 64:
                        handles.pop(next(iter(handles))).close()
                    system, name = opened(path)
                    handles[path] = system.open_input_file(name)
                handles[path].seek(offset)
                out.append(unpack_ids(read_frame(handles[path])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(places, pa.int64()),
                    pa.array([d for d, _ in out], pa.int64()),
                    pa.array([i.astype(np.int64) for _, i in out], pa.list_(pa.int64())),
                ],
                names=["place", "doc_id", "ids"],
            )

    rows = manifest.select("path", "index_path").mapInArrow(tidy(entries), "path string, at long")
    placed_rows = rows.withColumn("place", F.xxhash64("path", "at", F.lit(seed)))
    return (
        placed_rows.repartitionByRange("place")
        .sortWithinPartitions("place")
        .select("place", "path", "at")
        .mapInArrow(tidy(fetch), "place long, doc_id long, ids array<long>")
    )


def token_records(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes and reads back: one row per input row, (doc_id, start, n_tokens, ids_crc32).

    A null text counts as empty and has the end id alone. Files hold whole documents, so a very long text makes a long
    file. Rows that repeat a doc_id are records of their own. Columns besides doc_id and text are not looked at; an
    empty table writes no file and gives an empty result.
    """
    return read_records(write_records(docs, tokenizer, folder, shard_bytes))
