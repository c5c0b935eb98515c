"""Queries over agent-run traces, derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import trace as tr
from quillstone.operators.positions import running
from quillstone.plans.inputs import derived, duck_select
from quillstone.plans.registry import query
from quillstone.session import materialise, work_dir
from quillstone.sources.tables import table
from quillstone.streaming import memory_trigger, trace_stream

# Each user and week is a run; events are its steps in order.
RUN = [
    "event_id AS eid",
    "ts",
    "user_id",
    "CAST(user_id AS STRING) || '-w' || CAST(CAST(floor(day(ts) / 7.0) AS INT) AS STRING) AS trace_id",
    "event_type",
    "CAST(substring(props, 7, length(props) - 7) AS INT) AS k",
    "value",
]
KIND = (
    "CASE WHEN seq = 1 THEN 'RUN_STARTED' WHEN k % 10 = 0 THEN 'RUN_COMPLETED' WHEN k % 10 = 1 THEN 'RUN_FAILED' "
    "WHEN event_type = 'view' THEN 'MODEL_CALL_STARTED' WHEN event_type = 'click' THEN 'MODEL_CALL_COMPLETED' "
    "WHEN event_type = 'error' THEN 'TOOL_CALL_FAILED' WHEN event_type = 'purchase' THEN 'STEP_COMPLETED' ELSE 'TOOL_CALL_COMPLETED' END"
)
STATUS = "CASE WHEN kind LIKE '%STARTED' THEN 'STARTED' WHEN kind LIKE '%FAILED' THEN 'FAILED' ELSE 'COMPLETED' END"
LINE = (
    "CASE WHEN eid % 47 = 0 THEN '{\"broken' ELSE '{\"schemaVersion\":\"' || CASE WHEN eid % 41 = 0 THEN '2.0' ELSE '1.0' END || '\",\"category\":\"' || "
    "CASE WHEN eid % 43 = 0 THEN 'other' ELSE 'agent_trace' END || '\",\"timestamp\":\"' || iso || '\",\"eventId\":\"' || event_key || '\",\"traceId\":\"' || trace_id || "
    "'\",\"sequenceNo\":' || CAST(seq AS STRING) || ',\"stepNo\":' || CAST(floor(seq / 3.0) AS INT) || ',\"eventType\":\"' || kind || '\",\"eventName\":\"n' || CAST(k % 5 AS STRING) || "
    "'\",\"status\":\"' || status || '\",\"agentId\":\"agent-' || CAST(user_id % 9 AS STRING) || '\",\"sessionId\":\"s' || CAST(user_id AS STRING) || '\"' || "
    "CASE WHEN status = 'STARTED' THEN '' ELSE ',\"durationMs\":' || CAST(eid % 5000 AS STRING) END || "
    "CASE WHEN kind = 'RUN_STARTED' THEN ',\"payload\":{\"model\":\"m' || CAST(k % 3 AS STRING) || '\"}' WHEN kind LIKE 'RUN%' THEN ',\"payload\":{\"finishReason\":\"r' || CAST(k AS STRING) || "
    "'\",\"assistantMessageId\":\"a' || CAST(eid AS STRING) || '\"}' ELSE ',\"payload\":{\"k\":' || CAST(k AS STRING) || '}' END || "
    "CASE WHEN status = 'FAILED' THEN ',\"error\":{\"type\":\"E\",\"message\":\"went wrong at ' || CAST(k AS STRING) || '\"}' ELSE '' END || "
    "',\"metadata\":{\"userMessageId\":\"u' || CAST(user_id AS STRING) || '\"},\"arrival\":' || CAST(arrival AS STRING) || '}' END"
).replace("CAST(floor(seq / 3.0) AS INT) ||", "CAST(CAST(floor(seq / 3.0) AS INT) AS STRING) ||")
# Deliveries: one in 17 is lost, one in 5 comes twice, one in 29 comes again under another event id. One id per run comes
# with several numbers, some taken and some lost ones: it is accepted with the first of them that is free.
COPIES = [
    ("eid % 17 > 0", "'e' || CAST(eid AS STRING)", "eid"),
    ("eid % 5 = 0", "'e' || CAST(eid AS STRING)", "eid + 100000000"),
    ("eid % 29 = 0", "'x' || CAST(eid AS STRING)", "eid + 200000000"),
    ("eid % 7 = 0", "'y' || trace_id", "eid + 300000000"),
    ("eid % 17 = 0", "'y' || trace_id", "eid + 400000000"),
]


def runs(spark, folder):
    base = derived(table(spark, folder, "events"), RUN)
    block = F.floor(F.col("eid") / 4096)
    return running(base, ["trace_id"], ["eid"], block, sums={"seq": F.lit(1)}).withColumn("kind", F.expr(KIND)).withColumn("status", F.expr(STATUS))


def trace_lines(spark, folder):
    base = runs(spark, folder).withColumn("iso", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    copies = F.array(
        *[
            F.when(F.expr(cond), F.struct(F.expr(key).alias("event_key"), F.expr(arrival).alias("arrival")))
            for cond, key, arrival in COPIES
        ]
    )
    sent = base.withColumn("_c", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select("*", "_c.*")
    return sent.selectExpr(f"{LINE} AS value", "arrival")


DUCK_SEQUENCE = f"""
    base AS ({duck_select(RUN, 'events')}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY eid) AS seq FROM base),
    kinds AS (SELECT *, {KIND} AS kind FROM numbered),
    runs AS (SELECT *, {STATUS} AS status FROM kinds)
"""
DUCK_LINES = f"""
    {DUCK_SEQUENCE},
    sent AS ({' UNION ALL '.join(f"SELECT *, {key} AS event_key, {arrival} AS arrival FROM runs WHERE {cond}" for cond, key, arrival in COPIES)}),
    lines AS (SELECT {LINE} AS value, arrival FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM sent)),
    valid AS (SELECT * FROM lines WHERE json_valid(value)),
    parsed AS (SELECT arrival, json_extract_string(value, '$.eventId') AS event_id, json_extract_string(value, '$.traceId') AS trace_id,
        json_extract(value, '$.sequenceNo')::INTEGER AS sequence_no, json_extract(value, '$.stepNo')::INTEGER AS step_no,
        json_extract_string(value, '$.eventType') AS event_type, json_extract_string(value, '$.eventName') AS event_name, json_extract_string(value, '$.status') AS status,
        json_extract_string(value, '$.agentId') AS agent_id, json_extract_string(value, '$.sessionId') AS session_id,
        replace(replace(json_extract_string(value, '$.timestamp'), 'T', ' '), 'Z', '')::TIMESTAMP AS occurred_at, json_extract(value, '$.durationMs')::BIGINT AS duration_ms,
        json_extract_string(value, '$.payload.k') AS k, json_extract_string(value, '$.payload.model') AS model, json_extract_string(value, '$.payload.finishReason') AS reason,
        json_extract_string(value, '$.payload.assistantMessageId') AS answer, json_extract_string(value, '$.error.message') AS message,
        json_extract_string(value, '$.metadata.userMessageId') AS asked
        FROM valid WHERE json_extract_string(value, '$.schemaVersion') = '1.0' AND json_extract_string(value, '$.category') = 'agent_trace')
"""
# Row by row within each run, whose ids no other run has: refused where an accepted row has the id or the number.
DUCK_EVENTS = f"""
    {DUCK_LINES},
    ranked AS (SELECT trace_id, arrival, event_id, sequence_no, row_number() OVER (PARTITION BY trace_id ORDER BY arrival) AS r FROM parsed),
    inserted AS (
      SELECT DISTINCT trace_id, 0 AS r, []::VARCHAR[] AS ids, []::INTEGER[] AS numbers, NULL::BIGINT AS arrival FROM parsed
      UNION ALL
      SELECT trace_id, r, CASE WHEN free THEN list_append(ids, event_id) ELSE ids END, CASE WHEN free THEN list_append(numbers, sequence_no) ELSE numbers END,
             CASE WHEN free THEN arrival END
      FROM (SELECT n.*, i.ids, i.numbers, NOT list_contains(i.ids, n.event_id) AND NOT list_contains(i.numbers, n.sequence_no) AS free
            FROM inserted i JOIN ranked n ON n.trace_id = i.trace_id AND n.r = i.r + 1)),
    deduped AS (SELECT * FROM parsed WHERE arrival IN (SELECT arrival FROM inserted WHERE arrival IS NOT NULL))
"""


def events(spark, folder):
    return tr.dedup_trace(tr.parse_trace(trace_lines(spark, folder)))


def _ms(name: str):
    return F.unix_millis(name).alias(name.replace("_at", "_ms"))


@query(
    "parse_trace",
    f"""
    WITH {DUCK_LINES}
    SELECT arrival, event_id, trace_id, sequence_no, step_no, event_type, status, epoch_us(occurred_at) // 1000 AS occurred_ms, duration_ms, k, message FROM parsed
    """,
)
def parse_trace(spark, folder):
    parsed = tr.parse_trace(trace_lines(spark, folder))
    return parsed.select(
        "arrival", "event_id", "trace_id", "sequence_no", "step_no", "event_type", "status", _ms("occurred_at"), "duration_ms",
        F.get_json_object("payload", "$.k").alias("k"), F.get_json_object("error", "$.message").alias("message"),
    )


@query(
    "rejected_lines",
    f"""
    WITH {DUCK_LINES}
    SELECT value, CASE WHEN NOT json_valid(value) THEN 'malformed' WHEN json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.schemaVersion') <> '1.0' THEN 'schema_version' ELSE 'category' END AS reject_reason
    FROM lines WHERE arrival NOT IN (SELECT arrival FROM parsed)
    """,
)
def rejected_lines(spark, folder):
    return tr.rejected_lines(trace_lines(spark, folder))


@query(
    "build_events",
    f"""
    WITH {DUCK_SEQUENCE}
    SELECT eid, trace_id, seq AS sequence_no, CASE WHEN status <> 'STARTED' THEN epoch_us(ts) // 1000 END AS completed_ms,
           CASE WHEN status <> 'STARTED' AND eid % 3 > 0 THEN greatest(0, epoch_us(ts) // 1000 - epoch_us(ts - to_milliseconds(eid % 7000 - 100)) // 1000) END AS duration_ms,
           CASE WHEN status = 'FAILED' THEN '{{"type":"E","message":"m' || k || '"}}' END AS error
    FROM runs
    """,
)
def build_events(spark, folder):
    calls = runs(spark, folder).drop("seq")
    begun = F.expr("timestampadd(MILLISECOND, -(eid % 7000 - 100), ts)")
    failed = F.col("status") == "FAILED"
    calls = calls.select(
        "eid", "trace_id", "status",
        F.col("ts").alias("occurred_at"),
        F.when(F.col("eid") % 3 > 0, begun).alias("started_at"),
        F.when(failed, "E").alias("error_type"),
        F.when(failed, F.concat(F.lit("m"), F.col("k").cast("string"))).alias("error_message"),
    )
    built = tr.build_events(calls, ["eid"], F.floor(F.col("eid") / 4096))
    ended = F.unix_millis(F.col("completed_at").cast("timestamp")).alias("completed_ms")
    return built.select("eid", "trace_id", "sequence_no", ended, "duration_ms", "error")


@query("dedup_trace", f"WITH RECURSIVE {DUCK_EVENTS} SELECT event_id, trace_id, sequence_no, arrival FROM deduped")
def dedup_trace(spark, folder):
    return events(spark, folder).select("event_id", "trace_id", "sequence_no", "arrival")


DUCK_RUNS = f"""
    {DUCK_EVENTS},
    summaries AS (SELECT trace_id, arg_min(agent_id, arrival) AS agent_id, arg_min(session_id, arrival) AS session_id, arg_min(asked, arrival) AS user_message_id,
        arg_max(answer, arrival) FILTER (WHERE event_type LIKE 'RUN_%ED' AND event_type <> 'RUN_STARTED') AS assistant_message_id,
        coalesce(arg_max(CASE WHEN event_type = 'RUN_COMPLETED' THEN 'COMPLETED' ELSE 'FAILED' END, arrival) FILTER (WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED')), 'RUNNING') AS status,
        arg_max(reason, arrival) FILTER (WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) AS finish_reason,
        arg_max(model, arrival) FILTER (WHERE event_type = 'RUN_STARTED') AS model_name,
        coalesce(max(step_no) FILTER (WHERE event_type = 'STEP_COMPLETED'), 0) AS total_steps,
        count(*) FILTER (WHERE event_type IN ('MODEL_CALL_COMPLETED', 'MODEL_CALL_FAILED')) AS total_model_calls,
        count(*) FILTER (WHERE event_type IN ('TOOL_CALL_COMPLETED', 'TOOL_CALL_FAILED')) AS total_tool_calls,
        min(sequence_no) AS first_sequence_no, max(sequence_no) AS last_sequence_no, count(*) AS received_event_count,
        count(*) <> max(sequence_no) - min(sequence_no) + 1 AS trace_incomplete,
        epoch_us(coalesce(arg_max(occurred_at, arrival) FILTER (WHERE event_type = 'RUN_STARTED'), arg_min(occurred_at, arrival))) // 1000 AS started_ms,
        epoch_us(arg_max(occurred_at, arrival) FILTER (WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED'))) // 1000 AS completed_ms,
        arg_max(duration_ms, arrival) FILTER (WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) AS duration_ms,
        arg_max(coalesce(message, '-'), arrival) FILTER (WHERE event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) AS error_message,
        epoch_us(max(occurred_at)) // 1000 AS last_event_ms
        FROM deduped GROUP BY trace_id)
"""
SUMMARY = "SELECT * REPLACE (nullif(error_message, '-') AS error_message) FROM summaries"


def _summary_columns(df):
    return df.select(
        *[c for c in df.columns if not c.endswith("_at")], _ms("started_at"), _ms("completed_at"), _ms("last_event_at")
    )


@query("trace_projection", f"WITH RECURSIVE {DUCK_RUNS} {SUMMARY}")
def trace_projection(spark, folder):
    return _summary_columns(tr.trace_projection(events(spark, folder)))


@query(
    "trace_completeness",
    f"""
    WITH RECURSIVE {DUCK_EVENTS},
    r AS (SELECT trace_id, count(*) AS n, min(sequence_no) AS lo, max(sequence_no) AS hi, bool_or(event_type IN ('RUN_COMPLETED', 'RUN_FAILED')) AS ended, list(sequence_no) AS s FROM deduped GROUP BY 1),
    g AS (SELECT trace_id, lag(sequence_no) OVER (PARTITION BY trace_id ORDER BY sequence_no) + 1 AS a, sequence_no - 1 AS b FROM deduped),
    m AS (SELECT trace_id, string_agg(a || '-' || b, ' ' ORDER BY a) AS missing FROM g WHERE a <= b GROUP BY 1)
    SELECT trace_id, n <> hi - lo + 1 AS trace_incomplete, lo <> 1 AS head_missing, NOT ended AS tail_missing, hi - lo + 1 - n AS missing_count,
           list_min(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(s, x)))::BIGINT AS first_missing, coalesce(missing, '') AS missing FROM r LEFT JOIN m USING (trace_id)
    """,
)
def trace_completeness(spark, folder):
    told = F.transform("missing", lambda r: F.concat_ws("-", r["missing_from"].cast("string"), r["missing_to"].cast("string")))
    return tr.trace_completeness(events(spark, folder)).withColumn("missing", F.array_join(told, " "))


@query(
    "trace_timeline",
    f"WITH RECURSIVE {DUCK_RUNS} SELECT e.trace_id, e.sequence_no, e.event_id, s.status AS run_status, e.k FROM deduped e JOIN summaries s USING (trace_id)",
)
def trace_timeline(spark, folder):
    rows = events(spark, folder)
    line = tr.trace_timeline(tr.trace_projection(rows), rows)
    return line.select("trace_id", "sequence_no", "event_id", "run_status", F.get_json_object("payload", "$.k").alias("k"))


def _instant(text: str):
    return F.lit(f"{text}Z").cast("timestamp")


@query(
    "stale_runs",
    f"""
    WITH RECURSIVE {DUCK_RUNS}, t AS (SELECT *, status = 'RUNNING' AND last_event_ms < epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000 AS stale FROM summaries)
    SELECT trace_id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, CASE WHEN stale THEN 'INTERNAL_ERROR' ELSE finish_reason END AS finish_reason, stale OR trace_incomplete AS trace_incomplete FROM t
    """,
)
def stale_runs(spark, folder):
    closed = tr.stale_runs(tr.trace_projection(events(spark, folder)), _instant("2024-01-20 00:00:00"))
    return closed.select("trace_id", "status", "finish_reason", "trace_incomplete")


@query(
    "trace_retention",
    f"""
    WITH RECURSIVE {DUCK_RUNS} SELECT trace_id, sequence_no FROM deduped WHERE trace_id NOT IN
    (SELECT trace_id FROM summaries WHERE coalesce(completed_ms, last_event_ms) < epoch_us(TIMESTAMP '2024-01-15 00:00:00') // 1000)
    """,
)
def trace_retention(spark, folder):
    rows = events(spark, folder)
    _, kept = tr.trace_retention(tr.trace_projection(rows), rows, _instant("2024-01-15 00:00:00"))
    return kept.select("trace_id", "sequence_no")


@query(
    "tool_model_stats",
    f"""
    WITH RECURSIVE {DUCK_EVENTS}, d AS (SELECT *, regexp_extract(event_type, '^[A-Z]+') || ':' || event_name AS name FROM deduped WHERE regexp_matches(event_type, '^(MODEL|TOOL)_CALL_(COMPLETED|FAILED)$'))
    SELECT name, count(*) AS calls, count(*) FILTER (WHERE event_type LIKE '%FAILED') AS failures, round(avg(duration_ms), 6) AS mean_ms,
           round(quantile_cont(duration_ms::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(duration_ms::DOUBLE, 0.9), 6) AS p90,
           round(count(*) FILTER (WHERE event_type LIKE '%FAILED') / count(*), 6) AS failure_rate FROM d GROUP BY 1
    """,
)
def tool_model_stats(spark, folder):
    stats = tr.tool_model_stats(events(spark, folder))
    return stats.withColumns({n: F.round(n, 6) for n in ("mean_ms", "p50", "p90", "failure_rate")})


@query(
    "trace_search",
    f"""
    WITH RECURSIVE {DUCK_RUNS} SELECT trace_id, started_ms FROM summaries WHERE agent_id = 'agent-3' AND status = 'FAILED'
      AND started_ms >= epoch_us(TIMESTAMP '2024-01-05 00:00:00') // 1000 AND started_ms < epoch_us(TIMESTAMP '2024-01-25 00:00:00') // 1000
    """,
)
def trace_search(spark, folder):
    runs_ = tr.trace_projection(events(spark, folder))
    found = tr.trace_search(runs_, agent_id="agent-3", status="FAILED", since=_instant("2024-01-05 00:00:00"), until=_instant("2024-01-25 00:00:00"))
    return found.select("trace_id", _ms("started_at"))


def told_lines(spark, folder, **columns):
    """The lines without their arrival in ``value``, and beside them ``arrival``, ``run`` and what ``columns`` read from a
    line. Written once, so that files of several conditions do not compute them again."""
    lines = trace_lines(spark, folder).withColumn("value", F.regexp_replace("value", r',"arrival":\d+\}$', "}"))
    run = F.coalesce(F.get_json_object("value", "$.traceId"), "value")
    return materialise(lines.withColumns({"run": run, **{name: F.expr(x) for name, x in columns.items()}}), "lines")


def line_files(lines, batches, source=None, files=None):
    """Writes told lines in files that are newer from one condition to the next, at most ``files`` of each where given.

    The lines of a run lie in one file per condition, in the order in which they came.
    """
    source = source or work_dir(lines.sparkSession, "trace-lines")
    for condition in batches:
        told = lines.where(condition).repartition(*([files] if files else []), "run").sortWithinPartitions("run", "arrival")
        told.select("value").write.mode("append").text(source)
    return source


@query("stream_trace_source", f"WITH RECURSIVE {DUCK_RUNS} {SUMMARY}")
def stream_trace_source(spark, folder):
    """The same summaries from a stream over files of lines in several micro-batches, begun anew in the middle.

    The lines have no arrival: their files and places give it. Repeats and conflicts come last, weeks after the events.
    """
    early, late = ["arrival < 5000", "arrival >= 5000 AND arrival < 100000000"], ["arrival >= 100000000 AND arrival < 300000000", "arrival >= 300000000"]
    lines = told_lines(spark, folder)
    source, target = line_files(lines, early), work_dir(spark, "trace-stream")

    def run():
        parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, source, files_per_trigger=3))
        trace_stream.run_trace_stream(parsed, target).awaitTermination()

    run()
    line_files(lines, late, source)
    run()
    return _summary_columns(trace_stream.read_summaries(spark, target))


PATIENCE_DAYS = 9
# Files of lines in a micro-batch.
FILES = 3


@query(
    "stale_run_stream",
    f"""
    WITH RECURSIVE {DUCK_RUNS}
    SELECT trace_id, 'FAILED' AS status, 'INTERNAL_ERROR' AS finish_reason, true AS trace_incomplete, last_event_ms FROM summaries
    WHERE status = 'RUNNING' AND last_event_ms <= (SELECT max(last_event_ms) FROM summaries) - {PATIENCE_DAYS} * 86400000
    """,
)
def stale_run_stream(spark, folder):
    """The runs that the batch form fails, from timers in the state; the lines come by event time, some days at a time.

    The days of a condition have no more files than a micro-batch takes. Spread over several, the first of them would move
    the watermark past runs whose lines of the same days are still to come.
    """
    day = "coalesce(cast(substring(get_json_object(value, '$.timestamp'), 9, 2) AS INT), 1)"
    lines = told_lines(spark, folder, day=day)
    source = line_files(lines, [f"day BETWEEN {first} AND {first + 7}" for first in (1, 9, 17, 25)], files=FILES)
    target = work_dir(spark, "stale-runs")
    parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, source, files_per_trigger=FILES))
    failed = trace_stream.stale_run_stream(parsed, f"{PATIENCE_DAYS} days")
    writer = failed.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(failed.schema).parquet(f"{target}/out")


# Users as sessions of nine agents: intervals that are missing, too short, too long and their own; one agent is off.
AGENT_SETTINGS = [
    "user_id % 9 AS agent_id",
    "user_id % 9 <> 4 AS auto_memory_enabled",
    "CASE user_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 90 ELSE user_id % 9 + 1 END AS auto_memory_interval",
]


@query(
    "memory_trigger_stream",
    f"""
    WITH a AS (SELECT DISTINCT {', '.join(AGENT_SETTINGS)} FROM events),
    n AS (SELECT user_id, user_id % 9 AS agent_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
    d AS (SELECT *, CASE WHEN auto_memory_interval IS NULL THEN 10 ELSE greatest(3, least(50, auto_memory_interval)) END AS i FROM n JOIN a USING (agent_id) WHERE auto_memory_enabled),
    t AS (SELECT agent_id, user_id, i, unnest(range(n // i)) AS batch_no FROM d)
    SELECT agent_id::VARCHAR AS agent_id, user_id::VARCHAR AS session_id, batch_no, (batch_no + 1) * i AS processed FROM t
    """,
)
def memory_trigger_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    log = rows.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant").alias("role"))
    users = table(spark, folder, "events")
    sessions = users.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 9).alias("agent_id")).distinct()
    target = work_dir(spark, "memory-trigger")
    due = memory_trigger.memory_trigger_stream(log, sessions, users.selectExpr(*AGENT_SETTINGS).distinct())
    writer = due.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(due.schema).parquet(f"{target}/out")
