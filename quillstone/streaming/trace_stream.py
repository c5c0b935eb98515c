"""Trace lines as a stream: numbered as they lie in their files, each event accepted once, run summaries kept up to date.

The state holds, trace by trace within buckets of traces, the event ids and numbers that were accepted, so no stored event
is read again and a conflict is found however long ago the other event came. An id belongs to one run: the batch form also looks across
traces, the stream does not. State and output of a micro-batch are fixed by its files, so a repeated batch overwrites
itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillstone.operators.trace import TERMINAL, merge_aggregates, parse_trace, summarise, trace_aggregates
from quillstone.streaming.state import rocksdb

# Where a line lies: time and path of its file, begin of the split, place in the split. In this order lines arrive.
PLACE = ["file_time", "file_path", "split_start", "line_no"]


def stream_trace_source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(value, file_time, file_path, split_start, line_no) of the lines of files that appear below ``path``.

    A split is read front to back by one task, which numbers its lines.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    placed = lines.select(
        "value",
        F.unix_micros("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("line_no", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    return placed.mapInArrow(number, "value string, file_time long, file_path string, split_start long, line_no long")


# Accepted events of a trace that its state holds as one value; more of them go to maps, which are asked key by key.
RECENT = 512
# Traces are dealt out to this many keys of the state, so that a call handles the events of many short traces. The number
# is part of the state's form.
BUCKETS = 1024


@dataclass
class _Run:
    """What the state holds of a trace, with the events of a batch that were accepted added."""

    ids: dict[str, None] = field(default_factory=dict)
    numbers: dict[int, None] = field(default_factory=dict)
    spilled: bool = False
    last_ms: int | None = None
    ended: bool = False
    kept: list[int] = field(default_factory=list)


class _Accepted(StatefulProcessor):
    """Accepts the events of a bucket of traces in their order of arrival, each id and each number of a trace once.

    Every call on the state is a round trip. A short trace takes two for all of its events in a batch; of a long one the
    value stays short, and the maps are asked for the events that it does not refuse.
    """

    def __init__(self, columns: list[str], recent: int = RECENT):
        self.columns, self.limit = columns, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = "event_ids array<string>, numbers array<int>, spilled boolean, last_ms bigint, ended boolean"
        self.recent = handle.getMapState("recent", "trace_id string", value)
        self.ids = handle.getMapState("event_ids", "trace_id string, event_id string", "place int")
        self.numbers = handle.getMapState("numbers", "trace_id string, sequence_no int", "place int")

    def held(self, trace: str) -> _Run:
        found = self.recent.getValue((trace,))
        if found is None:
            return _Run()
        ids, numbers, spilled, last, ended = found
        return _Run(dict.fromkeys(ids), dict.fromkeys(int(n) for n in numbers), spilled, last, ended)

    def hold(self, trace: str, run: _Run) -> None:
        if len(run.ids) > self.limit:
            for event_id, number in zip(run.ids, run.numbers):
                self.ids.updateValue((trace, event_id), (0,))
                self.numbers.updateValue((trace, number), (0,))
            run.ids, run.numbers, run.spilled = {}, {}, True
        self.recent.updateValue((trace,), (list(run.ids), list(run.numbers), run.spilled, run.last_ms, run.ended))

    def accepted(self, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, dict[str, _Run]]:
        """The rows in their order of arrival, and the traces of which some were accepted; they are not held yet."""
        batch = pd.concat(list(rows), ignore_index=True).sort_values(PLACE, ignore_index=True)
        runs: dict[str, _Run] = {}
        for i, (trace, event_id, number) in enumerate(zip(*(batch[c].tolist() for c in ("trace_id", "event_id", "sequence_no")))):
            run, number = runs.get(trace), int(number)
            if run is None:
                run = runs[trace] = self.held(trace)
            if event_id in run.ids or number in run.numbers:
                continue
            if run.spilled and (self.ids.containsKey((trace, event_id)) or self.numbers.containsKey((trace, number))):
                continue
            run.ids[event_id] = run.numbers[number] = None
            run.kept.append(i)
        return batch, {trace: run for trace, run in runs.items() if run.kept}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, runs = self.accepted(rows)
        for trace, run in runs.items():
            self.hold(trace, run)
        if runs:
            yield batch[self.columns].iloc[sorted(i for run in runs.values() for i in run.kept)]

    def close(self) -> None:
        pass


def by_bucket(events: DataFrame) -> GroupedData:
    return events.withColumn("_bucket", F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


def accepted_events(events: DataFrame, recent: int = RECENT) -> DataFrame:
    """Parsed events, placed in their files, that are the first of their trace with their id and with their number."""
    rocksdb(events.sparkSession)
    return by_bucket(events).transformWithStateInPandas(
        statefulProcessor=_Accepted(events.columns, recent), outputStructType=events.schema, outputMode="Append", timeMode="None"
    )


def run_trace_stream(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Appends accepted events and partial summaries per micro-batch below ``folder``.

    ``events`` are parsed lines of :func:`stream_trace_source`. An event's ``arrival`` is the number of its batch, then
    its place. A restart goes on from the checkpoint and leaves every event counted once.
    """
    order = F.struct(F.col("batch_no"), *PLACE).alias("arrival")
    columns = [c for c in events.columns if c not in PLACE]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("batch_no", F.lit(batch_id).cast("long")).select(*columns, order)
        target = f"{folder}/events/batch_id={batch_id}"
        placed.write.mode("overwrite").parquet(target)
        added = spark.read.schema(placed.schema).parquet(target)
        parts = added.groupBy("trace_id").agg(*trace_aggregates())
        parts.write.mode("overwrite").parquet(f"{folder}/parts/batch_id={batch_id}")

    writer = accepted_events(events).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def dedup_stream(lines: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Parsed events, each event id and each (trace, number) once within the watermark, with state that is given up.

    Events later than the watermark are dropped here; :func:`accepted_events` keeps what it accepted for good.
    """
    events = parse_trace(lines).withWatermark("occurred_at", lateness)
    once = events.dropDuplicatesWithinWatermark(["event_id"])
    return once.dropDuplicatesWithinWatermark(["trace_id", "sequence_no"])


# Open runs of a bucket that were last heard of within the same span of event time share a timer.
SPAN_MS = 86_400_000


class _Stale(_Accepted):
    """Closes a run that has no end once event time has passed its last event by the patience of the watermark.

    ``due`` lists the open runs of a span with the times of their last events; its timer stands at the earliest of them. A
    run heard of again stays in the list of its former time, where it no longer counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.due = handle.getMapState("due", "span bigint", "times array<bigint>, trace_ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, runs = self.accepted(rows)
        # rounded up: a run is not stale before the watermark is past its last event
        times = (-(-batch["occurred_at"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000)).tolist()
        ends = batch["event_type"].isin(TERMINAL).tolist()
        spans: dict[int, list[tuple[int, str]]] = {}
        for trace, run in runs.items():
            before = run.last_ms
            last = max(times[i] for i in run.kept)
            run.last_ms = last if before is None else max(last, before)
            run.ended = run.ended or any(ends[i] for i in run.kept)
            if not run.ended and run.last_ms != before:
                spans.setdefault(run.last_ms // SPAN_MS, []).append((run.last_ms, trace))
            self.hold(trace, run)
        for span, added in spans.items():
            self.await_(span, self.awaited(span), added)
        yield from ()

    def awaited(self, span: int) -> list[tuple[int, str]]:
        found = self.due.getValue((span,))
        return list(zip(*found)) if found else []

    def await_(self, span: int, old: list[tuple[int, str]], added: list[tuple[int, str]]) -> None:
        """Lists ``old`` and ``added`` runs, where ``old`` ones have their timer."""
        times, traces = zip(*old, *added)
        self.due.updateValue((span,), (list(times), list(traces)))
        first = min(at for at, _ in added)
        if not old or first < min(at for at, _ in old):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        past = max(expired, timerValues.getCurrentWatermarkInMs() - 1)
        span, rows = expired // SPAN_MS, []
        listed = self.awaited(span)
        for last, trace in (x for x in listed if x[0] <= past):
            run = self.held(trace)
            if run.last_ms == last and not run.ended:
                run.ended = True
                self.hold(trace, run)
                rows.append({"trace_id": trace, "status": "FAILED", "finish_reason": "INTERNAL_ERROR", "trace_incomplete": True, "last_event_ms": last})
        left = [x for x in listed if x[0] > past]
        if left and len(left) < len(listed):
            self.await_(span, [], left)
        elif listed and not left:
            self.due.removeKey((span,))
        if rows:
            yield pd.DataFrame(rows)


def stale_run_stream(events: DataFrame, patience: str) -> DataFrame:
    """Runs without an end of which nothing was heard for ``patience`` of event time, each once, as failed.

    ``events`` are parsed lines of :func:`stream_trace_source`. The timers are in the state, so they go on after a
    restart. Events that come later than ``patience`` behind the latest one are dropped, as their run may be closed.
    """
    rocksdb(events.sparkSession)
    wanted = ["event_id", "trace_id", "sequence_no", "event_type", "occurred_at", *PLACE]
    return by_bucket(events.select(wanted).withWatermark("occurred_at", patience)).transformWithStateInPandas(
        statefulProcessor=_Stale(wanted),
        outputStructType="trace_id string, status string, finish_reason string, trace_incomplete boolean, last_event_ms long",
        outputMode="Append",
        timeMode="EventTime",
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events").drop("batch_id")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/parts")
    return summarise(parts.groupBy("trace_id").agg(*merge_aggregates()))


def compact_parts(spark: SparkSession, folder: str, target: str) -> None:
    """Writes the merged parts of all batches as one table, for readers that come often."""
    parts = spark.read.parquet(f"{folder}/parts").groupBy("trace_id").agg(*merge_aggregates())
    parts.write.mode("overwrite").parquet(target)
