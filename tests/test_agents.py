"""Histories, memories, traces and the SQL guard on literal rows."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import extract_urls, parse_vector_text, truncate_json, url_domain
from quillstone.operators import conversation as cv
from quillstone.operators import guard
from quillstone.operators import memory as mm
from quillstone.operators import trace as tr
from quillstone.plans import trace_plans
from quillstone.streaming import memory_trigger, trace_stream

MESSAGE = "session_id int, pos bigint, role string, content string, call_ids array<string>, tool_id string"


def test_history_repair(spark):
    dsml = "<｜｜DSML｜｜tool_calls>x</｜｜DSML｜｜tool_calls>"
    rows = [
        (1, 0, "system", "s1", None, None),
        (1, 1, "user", "ask", None, None),
        (1, 2, "assistant", dsml, ["a", "b"], None),
        (1, 3, "tool", "ra", None, "a"),
        (1, 4, "tool", "ra again", None, "a"),
        (1, 5, "tool", "rc", None, "c"),
        (1, 6, "user", "more", None, None),
        (1, 7, "tool", "rb", None, "b"),
        (1, 8, "assistant", dsml, [], None),
        (1, 9, "system", "s2", None, None),
        (1, 10, "user", "", None, None),
    ]
    out = cv.repair_history(spark.createDataFrame(rows, MESSAGE)).orderBy("place").collect()
    assert [(r.pos, r.content) for r in out] == [(9, "s2"), (0, "s1"), (1, "ask"), (2, ""), (3, "ra"), (6, "more")]


def test_memory_batches(spark):
    roles = ["user", "assistant"] * 5 + ["user", "user"]
    rows = [(1, i, r, f" m{i} ", None, None) for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, MESSAGE)
    out = cv.memory_batches(df, 3).orderBy("batch_no").collect()
    assert [(r.batch_no, r.user_messages, r.ready) for r in out] == [(0, 3, True), (1, 3, False), (2, 1, False)]
    text = cv.render_conversation(cv.batch_turns(df, 3).where("batch_no = 0"), "session_id").first().conversation
    assert text.split("\n")[:2] == ["[1] user: m0", "[2] assistant: m1"] and text.endswith("[6] assistant: m5")


def test_recovered_calls_keep_the_last_value(spark):
    def mark(name, body):
        return f"<｜｜DSML｜｜{name}>{body}</｜｜DSML｜｜{name.split(' ')[0]}>"

    block = mark("tool_calls", mark('invoke name="f"', mark('parameter name="p"', "one") + mark('parameter name="p"', ' t"wo\n')))
    df = spark.createDataFrame([(1, 0, "assistant", "hi " + block, None, None), (1, 1, "assistant", block, ["x"], None)], MESSAGE)
    (row,) = cv.recover_tool_calls(df).collect()
    assert (row.name, json.loads(row.arguments)) == ("f", {"p": 't"wo'})


def test_links(spark):
    df = spark.createDataFrame([("see https://www.a.org/x?y=1), http://b.net/z.; https://www.a.org/x?y=1",)], "t string")
    urls = df.select(extract_urls("t").alias("u")).first().u
    assert urls == ["https://www.a.org/x?y=1", "http://b.net/z", "https://www.a.org/x?y=1"]
    assert df.select(url_domain(F.lit(urls[0])).alias("d")).first().d == "a.org"


def operation(**fields):
    return {"action": "create", "memoryTarget": "user", "memoryScope": "core", "memoryType": "fact", "title": "t", "content": "c", **fields}


def operations(spark, *batches):
    rows = [(i, "agent-1", f"message-{i}", text if isinstance(text, str) else json.dumps({"operations": text, "x": 1})) for i, text in enumerate(batches)]
    df = spark.createDataFrame(rows, "batch_id bigint, agent_id string, source_message_id string, response string")
    return mm.validate_operations(mm.parse_operations(df, "batch_id", "agent_id", "source_message_id"), "batch_id")


MEMORY = "id string, agent_id string, memory_scope string, memory_type string, title string, content string, source_message_id string, enabled boolean"


def apply(spark, valid, memories, target):
    ops = valid.where("accepted").withColumn("seq", F.col("batch_id") * 10 + F.col("position"))
    return {r.id: r for r in mm.apply_operations(ops, spark.createDataFrame(memories, MEMORY), target).collect()}


def test_operations_are_judged_in_order(spark):
    fenced = "```json\n" + json.dumps({"operations": [operation(action=" CREATE ")]}) + "\n```"
    many = [operation(action="ignore", title=None)] * 3 + [operation(title="password"), operation(), operation(), operation()]
    out = operations(spark, fenced, "{broken", many, "  ", [operation(action="update"), operation(memoryTarget="agent", memoryScope="x")]).orderBy("batch_id", "position").collect()
    got = [(r.batch_id, r.reject_reason, r.accepted) for r in out]
    assert got == [
        (0, None, True),
        (1, "not_json", False),
        *[(2, None, True)] * 3,
        (2, "sensitive", False),
        *[(2, None, True)] * 2,
        (2, None, False),
        (4, "missing_id", False),
        (4, "unknown_scope", False),
    ]


def test_creates_go_to_their_own_tables(spark):
    valid = operations(spark, [operation(title="n"), operation(memoryTarget="agent", title="m")])
    user = apply(spark, valid, [("u0", None, None, "fact", "x", "y", None, True)], "user")
    agent = apply(spark, valid, [("a0", "agent-1", "core", "fact", "x", "y", None, True)], "agent")
    assert user.keys() == {"u0", "new-0"} and user["new-0"].source_message_id == "message-0"
    assert agent.keys() == {"a0", "new-1"} and agent["new-1"].agent_id == "agent-1"


def test_duplicates_and_updates(spark):
    base = [("user-memory-1", None, None, "fact", "t", "c", None, False), ("other", None, None, "fact", "o", "o", None, True)]
    valid = operations(
        spark,
        [operation(), operation(action="update", existingMemoryId="user-memory-1", title="用户姓名", content="用户叫司马懿。"), operation(), operation()],
        [operation(title="用户姓名", content="用户叫司马懿。"), operation(action="update", existingMemoryId="foreign", title="z")],
    )
    out = apply(spark, valid, base, "user")
    # The first create repeats a stored memory; after the update the same text is free again, once.
    assert out.keys() == {"user-memory-1", "other", "new-2"}
    assert (out["user-memory-1"].title, out["user-memory-1"].content, out["user-memory-1"].enabled) == ("用户姓名", "用户叫司马懿。", True)
    assert out["other"].title == "o"


def test_operations_agree_with_a_loop(spark):
    rng = random.Random(11)
    base = [(f"m{i}", None, None, "fact", f"t{i % 2}", f"c{i % 3}", None, True) for i in range(3)]
    batches = [
        [operation(action=rng.choice(["create", "create", "update"]), existingMemoryId=rng.choice(["m0", "m1", "m2", "zz"]), title=f"t{rng.randint(0, 3)}", content=f"c{rng.randint(0, 3)}") for _ in range(5)]
        for _ in range(12)
    ]
    table = {r[0]: (r[4], r[5]) for r in base}
    for b, batch in enumerate(batches):
        for p, op in enumerate(batch):
            text = (op["title"], op["content"])
            if op["action"] == "update":
                if op["existingMemoryId"] in table:
                    table[op["existingMemoryId"]] = text
            elif text not in table.values():
                table[f"new-{b * 10 + p}"] = text
    out = apply(spark, operations(spark, *batches), base, "user")
    assert {k: (r.title, r.content) for k, r in out.items()} == table


def test_applied_operations_keep_all_columns(spark):
    schema = MEMORY + ", priority int, embedding array<float>, created_at bigint, updated_at bigint, last_used_at bigint, note string"
    rows = [
        ("a", "agent-1", "core", "fact", "t", "c", None, False, 7, None, 1, 2, 3, "x"),
        ("b", "agent-1", "retrieved", "fact", "t", "d", "old", True, 4, [9.0], 1, 2, 3, "y"),
    ]
    valid = operations(
        spark,
        [
            operation(memoryTarget="agent", action="update", existingMemoryId="a", memoryScope="retrieved", title="n"),
            operation(memoryTarget="agent", title="t"),
            operation(memoryTarget="agent", memoryScope="retrieved", title="new"),
        ],
    )
    ops = valid.where("accepted").withColumn("seq", F.col("batch_id") * 10 + F.col("position")).withColumn("at", F.col("seq") + 100)
    out = {r.id: r for r in mm.apply_operations(ops, spark.createDataFrame(rows, schema), "agent").collect()}
    assert out.keys() == {"a", "b", "new-1", "new-2"}
    a, b, core, new = (out[k] for k in ("a", "b", "new-1", "new-2"))
    assert (a.title, a.enabled, a.priority, a.created_at, a.updated_at, a.last_used_at, a.note) == ("n", True, 7, 1, 100, 3, "x")
    assert a.embedding and new.embedding and core.embedding is None and b.embedding == [9.0] and b.updated_at == 2
    assert (new.priority, new.created_at, new.updated_at, new.last_used_at, new.note) == (0, 102, 102, None, None)


def test_a_hot_memory_and_a_hot_content_run_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mm, "SEQ_BLOCK", 3)
    rng = random.Random(3)
    base = [(f"m{i}", None, None, "fact", "t", f"c{i}", None, True) for i in range(2)]
    batches = [[operation(action=rng.choice(["create", "update"]), existingMemoryId="m0", content=f"c{rng.randint(0, 2)}")] for _ in range(40)]
    held = {r[0]: r[5] for r in base}
    for b, (op,) in enumerate(batches):
        if op["action"] == "update":
            held["m0"] = op["content"]
        elif op["content"] not in held.values():
            held[f"new-{b * 10}"] = op["content"]
    out = apply(spark, operations(spark, *batches), base, "user")
    assert {k: r.content for k, r in out.items()} == held


def test_progress_names_the_last_message(spark):
    state = spark.createDataFrame(
        [("a", "s1", 3, 9, "m9", 90), ("a", "s3", 3, 1, "m1", 10)],
        "agent_id string, session_id string, processed bigint, last_pos bigint, last_message_id string, last_message_at bigint",
    )
    done = spark.createDataFrame(
        [("a", "s1", 15, "m15", 150), ("a", "s1", 21, None, 210), ("a", "s2", 5, "m5", 50)],
        "agent_id string, session_id string, last_user_pos bigint, last_message_id string, last_message_at bigint",
    )
    out = {r.session_id: (r.processed, r.last_pos, r.last_message_id, r.last_message_at) for r in mm.job_progress(state, done, 3).collect()}
    assert out == {"s1": (9, 21, None, 210), "s2": (3, 5, "m5", 50), "s3": (3, 1, "m1", 10)}


def test_progress_and_use(spark):
    state = spark.createDataFrame([("a", "s1", 3, 9)], "agent_id string, session_id string, processed bigint, last_pos bigint")
    done = spark.createDataFrame([("a", "s1", 15), ("a", "s1", 21), ("a", "s2", 5)], "agent_id string, session_id string, last_user_pos bigint")
    out = {r.session_id: (r.processed, r.last_pos) for r in mm.job_progress(state, done, 3).collect()}
    assert out == {"s1": (9, 21), "s2": (3, 5)}


def event(trace, seq, kind, **extra):
    state = {"STARTED": "STARTED", "FAILED": "FAILED"}.get(kind.rsplit("_", 1)[1], "COMPLETED")
    body = {"schemaVersion": "1.0", "category": "agent_trace", "timestamp": f"2024-01-01T00:00:{seq:02d}Z", "eventId": f"{trace}-{seq}", "traceId": trace, "sequenceNo": seq, "eventType": kind, "status": state}
    return body | extra


RUN = ["RUN_STARTED", "CONTEXT_BUILT", "STEP_STARTED", "MODEL_CALL_STARTED", "MODEL_CALL_COMPLETED", "TOOL_CALL_STARTED", "TOOL_CALL_FAILED", "STEP_COMPLETED", "RUN_FAILED"]


def run_events(trace, without=()):
    out = []
    for i, kind in enumerate(RUN, start=1):
        extra = {"payload": {"model": "m"}} if i == 1 else {}
        if kind == "STEP_COMPLETED":
            extra = {"stepNo": 1}
        if kind == "RUN_FAILED":
            extra = {"payload": {"finishReason": "error"}, "error": {"type": "E", "message": "boom"}, "durationMs": 8000}
        if i not in without:
            out.append(event(trace, i, kind, **extra))
    return out


def lines(spark, events):
    rows = [(e if isinstance(e, str) else json.dumps(e), i) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "value string, arrival bigint")


def summaries(spark, events):
    return {r.trace_id: r for r in tr.trace_projection(tr.dedup_trace(tr.parse_trace(lines(spark, events)))).collect()}


def test_run_summaries(spark):
    rng = random.Random(4)
    twice = run_events("dup") * 2
    rng.shuffle(twice)
    bad = ["{nope", event("bad", 1, "RUN_STARTED", schemaVersion="2.0"), event("bad", 2, "RUN_STARTED", category="x")]
    out = summaries(spark, run_events("run") + run_events("gap", without=[5]) + run_events("head", without=[1]) + twice + bad)
    run = out["run"]
    assert (run.status, run.total_model_calls, run.total_tool_calls, run.total_steps, run.trace_incomplete) == ("FAILED", 1, 1, 1, False)
    assert (run.finish_reason, run.error_message, run.duration_ms, run.model_name) == ("error", "boom", 8000, "m")
    assert out["gap"].trace_incomplete and out["gap"].total_model_calls == 0 and not out["head"].trace_incomplete
    assert "bad" not in out and {k: v for k, v in out["dup"].asDict().items() if k != "trace_id"} == {k: v for k, v in run.asDict().items() if k != "trace_id"}


def test_gaps(spark):
    rows = run_events("gap", without=[5, 6]) + run_events("head", without=[1]) + run_events("tail", without=[9])
    out = {r.trace_id: r for r in tr.trace_completeness(tr.parse_trace(lines(spark, rows))).collect()}
    assert (out["gap"].missing_count, out["gap"].first_missing, out["gap"].head_missing) == (2, 5, False)
    assert out["head"].head_missing and not out["head"].trace_incomplete and out["tail"].tail_missing


def test_completeness_names_every_missing_range(spark):
    """All ranges come out, not their count and first number alone; a null trace is one like others."""
    numbers = {"t": [2, 3, 7, 8, 12, 20_000], "whole": [1, 2, 3], None: [1, 5]}
    rows = [(t, n, "RUN_STARTED") for t, ns in numbers.items() for n in ns]
    got = {r.trace_id: r for r in tr.trace_completeness(spark.createDataFrame(rows, "trace_id string, sequence_no int, event_type string")).collect()}
    assert {t: [tuple(x) for x in r.missing] for t, r in got.items()} == {"t": [(4, 6), (9, 11), (13, 19_999)], "whole": [], None: [(2, 4)]}
    assert {t: (r.missing_count, r.first_missing) for t, r in got.items()} == {"t": (19_993, 4), "whole": (0, None), None: (3, 2)}


def test_strict_dedup_agrees_with_inserts(spark):
    rng = random.Random(9)
    rows = [(f"e{rng.randint(0, 25)}", f"t{rng.randint(0, 3)}", rng.randint(1, 8), i) for i in range(120)]
    ids, numbers, want = set(), set(), set()
    for e, t, n, i in rows:
        if e not in ids and (t, n) not in numbers:
            ids.add(e), numbers.add((t, n)), want.add(i)
    df = spark.createDataFrame(rows, "event_id string, trace_id string, sequence_no int, arrival bigint")
    assert {r.arrival for r in tr.dedup_trace(df).collect()} == want


def told(rows, path):
    """Lines as an appender writes them, without an arrival; a later file is newer by a second."""
    path.write_text("\n".join(json.dumps({k: v for k, v in e.items() if k != "arrival"}) for e in rows) + "\n{bad", encoding="utf-8")
    stamp = 1_700_000_000 + len(list(path.parent.iterdir()))
    os.utime(path, (stamp, stamp))


def test_stream_equals_batch(spark, tmp_path):
    """Shuffled and repeated lines in files that come one after another; every call goes on from the checkpoint."""
    rng = random.Random(6)
    rows = [e for t in range(6) for e in run_events(f"t{t}", without=[t + 1])]
    source = tmp_path / "in"
    source.mkdir()
    sent = []
    for part in range(4):
        picked = rng.sample(rows, 25) + (rows if part == 1 else [])
        # an id of this run with another number, and a number with another id
        picked += [e | {"sequenceNo": 100 + part} for e in rng.sample(rows, 3)] + [e | {"eventId": f"z{part}{i}"} for i, e in enumerate(rng.sample(rows, 3))]
        rng.shuffle(picked)
        told(picked, source / f"{part}.json")
        sent += [e | {"arrival": len(sent) + i} for i, e in enumerate(picked)]
        parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, str(source)))
        trace_stream.run_trace_stream(parsed, str(tmp_path / "out")).awaitTermination()
    stream = {r.trace_id: r for r in trace_stream.read_summaries(spark, str(tmp_path / "out")).collect()}
    assert stream == summaries(spark, sent)
    stored = trace_stream.read_events(spark, str(tmp_path / "out"))
    kept = tr.dedup_trace(tr.parse_trace(lines(spark, sent)))
    assert {(r.event_id, r.trace_id, r.sequence_no) for r in stored.collect()} == {(r.event_id, r.trace_id, r.sequence_no) for r in kept.collect()}


def test_conflicts_weeks_apart_and_the_last_end(spark, tmp_path):
    """A second end weeks after the first: its own number is accepted and wins, a taken number or id is refused."""
    source = tmp_path / "in"
    source.mkdir()
    run = run_events("t")
    end = run[-1]
    told(run, source / "0.json")
    for name, change in enumerate([{"eventId": "other"}, {"sequenceNo": 77}, {"eventId": "again", "sequenceNo": 78, "payload": {"finishReason": "late"}}], 1):
        told([end | {"timestamp": f"2024-0{2 + name}-09T00:00:00Z"} | change], source / f"{name}.json")
        parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, str(source)))
        trace_stream.run_trace_stream(parsed, str(tmp_path / "out")).awaitTermination()
    row = trace_stream.read_summaries(spark, str(tmp_path / "out")).first()
    assert (row.received_event_count, row.last_sequence_no, row.finish_reason) == (len(run) + 1, 78, "late")


def test_stale_runs_as_a_stream(spark, tmp_path):
    """Three batches: one run ends, one goes silent, one is heard of to the last; a restart keeps the timers."""
    source = tmp_path / "in"
    source.mkdir()
    done, silent, busy = run_events("done"), run_events("silent", without=[9])[:-1], run_events("busy")[:-1]
    batches = [done[:4] + silent[:4] + busy[:4], done[4:] + silent[4:], [e | {"timestamp": "2024-02-20T00:00:00Z"} for e in busy[4:]]]
    sent = []
    for i, rows in enumerate(batches):
        told(rows, source / f"{i}.json")
        sent += rows
        failed = trace_stream.stale_run_stream(tr.parse_trace(trace_stream.stream_trace_source(spark, str(source))), "10 days")
        writer = failed.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(failed.schema).parquet(str(tmp_path / "o")).collect()
    df = tr.trace_projection(tr.dedup_trace(tr.parse_trace(lines(spark, [e | {"arrival": i} for i, e in enumerate(sent)]))))
    closed = tr.stale_runs(df, F.lit("2024-02-10T00:00:00Z").cast("timestamp")).where("finish_reason = 'INTERNAL_ERROR'").collect()
    assert [(r.trace_id, r.status, r.finish_reason) for r in rows] == [(r.trace_id, r.status, r.finish_reason) for r in closed] == [("silent", "FAILED", "INTERNAL_ERROR")]


def test_missing_arrival_falls_back_to_the_number(spark):
    run = run_events("t")
    ends = [run[-1] | {"sequenceNo": n, "eventId": f"end{n}", "payload": {"finishReason": f"r{n}"}} for n in (60, 50)]
    sent = lines(spark, run[:-1] + ends).withColumn("arrival", F.lit(None).cast("long"))
    row = tr.trace_projection(tr.dedup_trace(tr.parse_trace(sent))).first()
    assert row.finish_reason == "r60"


def test_watermarked_dedup(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(e | {"arrival": i}) for i, e in enumerate(run_events("t") * 2)), encoding="utf-8")
    once = trace_stream.dedup_stream(trace_stream.stream_trace_source(spark, str(source)))
    writer = once.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == len(RUN)


def test_memory_trigger_follows_each_agent(spark, tmp_path):
    """Own, missing and clamped intervals, an agent that is off, counts that go on over batches, an interval that changes."""
    schema = "session_id string, role string"
    sessions = spark.createDataFrame([("s", "a"), ("r", "b"), ("q", "c"), ("off", "d"), ("lost", "none")], "session_id string, agent_id string")
    out = tmp_path / "o"
    for part, users in enumerate([2, 2, 5, 6]):
        rows = [("s", "user")] * users + [("s", "assistant")] * 3 + [("r", "user")] * 4 + [("q", "user")] * 20 + [("off", "user")] * 9 + [("lost", "user"), (None, "user")]
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        agents = [("a", True, 3 if part < 3 else 5), ("b", True, None), ("c", True, 400), ("d", False, 3)]
        log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        due = memory_trigger.memory_trigger_stream(log, sessions, spark.createDataFrame(agents, "agent_id string, auto_memory_enabled boolean, auto_memory_interval int"))
        writer = due.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(due.schema).parquet(str(out)).collect()
    # s: 2, 4, 9 messages by threes, then 15 by fives from 9 on; r: 16 by tens; q: 80 by fifties
    want = [("a", "s", 0, 3), ("a", "s", 1, 6), ("a", "s", 2, 9), ("a", "s", 3, 14), ("b", "r", 0, 10), ("c", "q", 0, 50)]
    assert sorted(map(tuple, found)) == want


def test_stale_and_unknown_traces(spark):
    df = tr.trace_projection(tr.parse_trace(lines(spark, run_events("open", without=[9]))))
    closed = tr.stale_runs(df, F.lit("2024-01-02T00:00:00Z").cast("timestamp")).first()
    assert (closed.status, closed.finish_reason, closed.trace_incomplete) == ("FAILED", "INTERNAL_ERROR", True)
    assert tr.require_trace(df, "open").count() == 1
    with pytest.raises(Exception, match="unknown trace"):
        tr.require_trace(df, "nope").collect()


def test_truncation(spark):
    text = json.dumps({"a": "x" * 3000})
    row = spark.createDataFrame([(text,)], "t string").select(truncate_json("t", 10).alias("c"), truncate_json("t").alias("w")).first()
    cut = json.loads(row.c)
    assert cut == {"content": text[:1000], "originalSize": len(text), "truncated": True} and row.w == text


def test_guard(spark):
    reasons = fixed.SQL_REASONS
    cases = {
        "DELETE FROM agent;": reasons["not_select"],
        "SELECT pg_read_file('/etc/passwd')": reasons["dangerous"],
        "  ": reasons["empty"],
        "SELECT 1 -- x": reasons["comment"],
        "SELECT 1; SELECT 2": reasons["multiple"],
        "WITH a AS (SELECT 1) SELECT * FROM a": reasons["not_select"],
        "SELECT 'update'": reasons["mutating"],
        "SELECT updated_at FROM t;": None,
        "select * from information_schema.tables": reasons["dangerous"],
        "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`": reasons["dangerous"],
        "SELECT * FROM org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2.`/etc/hostname`": reasons["dangerous"],
        "SELECT t.`a b`, u.`c.d` FROM t JOIN u": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "sql string")
    got = {r.sql: r.r for r in df.select("sql", guard.sql_reject_reason("sql").alias("r")).collect()}
    assert got == cases
    with pytest.raises(guard.SqlRejected):
        guard.guarded_sql(spark, "DROP TABLE t")
    # paths that the pattern lets through are no relations either
    for reader in ("org.apache.spark.sql.execution.datasources.text.TextFileFormat", "`text`"):
        with pytest.raises((guard.SqlRejected, AnalysisException)):
            guard.guarded_sql(spark, f"SELECT * FROM {reader}.`README.md`")
    assert spark.conf.get(guard.FILES) == "true"


def test_guarded_run(spark):
    columns, rows, note = guard.run_sql(spark, "SELECT id, repeat('x', 2500) AS long, CAST(NULL AS INT) AS n, array(1, 2) AS a FROM range(150);")
    assert columns == ["id", "long", "n", "a"] and len(rows) == 100 and note
    assert rows[0][1] == "x" * 2000 + fixed.SQL_CELL_MARK and rows[0][2:] == ("NULL", "[1,2]")
    slow = "SELECT count(*) FROM range(100000000000) WHERE sqrt(id) = cos(id)"
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        guard.run_sql(spark, slow, timeout_seconds=1)


def test_vector_text(spark):
    df = spark.createDataFrame([("[1.5,-2,3e-2]",), ("[]",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(parse_vector_text("t").alias("v")).collect()]
    assert got[0] == [1.5, -2.0, pytest.approx(0.03)] and got[1:] == [[], [], None]


def test_trace_lines_are_parsed_once(spark):
    """The filter on the reason of a refusal does not take the parser into its conditions."""
    lines = spark.createDataFrame([("{}", 1), (None, 2), ("{broken", 3)], "value string, arrival long")
    plan = tr.parse_trace(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, plan
    assert sorted((r.value, r.reject_reason) for r in tr.rejected_lines(lines.where("arrival <> 2")).collect()) == [("{broken", "malformed"), ("{}", "schema_version")]
    assert [r.reject_reason for r in tr.rejected_lines(lines.where("arrival = 2")).collect()] == ["malformed"]


def test_long_traces_go_on_in_maps(spark, tmp_path):
    """With room for three accepted events in the value, the others are in the maps: conflicts with both are found."""
    source = tmp_path / "in"
    source.mkdir()
    run, sent = run_events("t"), []
    parts = [run[:2], [*run[1:3], run[0] | {"sequenceNo": 90}], [*run[2:7], run[1] | {"eventId": "z"}], [*run, run[4] | {"sequenceNo": 91}, run[5] | {"eventId": "y"}]]
    for part, rows in enumerate(parts):
        told(rows, source / f"{part}.json")
        sent += [e | {"arrival": len(sent) + i} for i, e in enumerate(rows)]
        parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, str(source)))
        writer = trace_stream.accepted_events(parsed, recent=3).writeStream.format("parquet").option("path", str(tmp_path / "o"))
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    kept = tr.dedup_trace(tr.parse_trace(lines(spark, sent)))
    key = lambda df: sorted((r.event_id, r.sequence_no) for r in df.select("event_id", "sequence_no").collect())
    assert key(spark.read.parquet(str(tmp_path / "o"))) == key(kept) and len(key(kept)) == len(run)


def test_traces_of_one_bucket_do_not_meet(spark, tmp_path, monkeypatch):
    """One key of the state for all traces: ids and numbers that another trace has are free, in the value and in the maps."""
    monkeypatch.setattr(trace_stream, "BUCKETS", 1)
    source = tmp_path / "in"
    source.mkdir()
    rows = [e | {"eventId": f"e{e['sequenceNo']}"} for t in ("a", "b", "c") for e in run_events(t)]
    for part, sent in enumerate([rows[:2] + rows[9:14], rows[::-1], rows]):
        told(sent, source / f"{part}.json")
        parsed = tr.parse_trace(trace_stream.stream_trace_source(spark, str(source)))
        writer = trace_stream.accepted_events(parsed, recent=3).writeStream.format("parquet").option("path", str(tmp_path / "o"))
        query = writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = [(r.trace_id, r.sequence_no) for r in spark.read.parquet(str(tmp_path / "o")).collect()]
    assert sorted(kept) == sorted((e["traceId"], e["sequenceNo"]) for e in rows)


def test_silent_runs_of_one_bucket_and_day_are_closed_in_their_turn(spark, tmp_path, monkeypatch):
    """Runs that share a timer: one is closed, one later of the same day waits, one is heard again, one ends."""
    monkeypatch.setattr(trace_stream, "BUCKETS", 1)
    source = tmp_path / "in"
    source.mkdir()
    at = lambda trace, number, time, kind="STEP_STARTED": event(trace, number, kind, timestamp=f"2024-01-{time}:00:00Z")
    batches = [
        [at("early", 1, "01T01"), at("late", 1, "01T20"), at("back", 1, "01T02"), at("over", 1, "01T03"), at("over", 2, "01T04", "RUN_FAILED")],
        [at("busy", 1, "11T10"), at("back", 2, "08T02"), at("late", 2, "01T19")],
        [at("busy", 2, "11T11")],
        [at("busy", 3, "12T11")],
        [at("busy", 4, "12T12")],
    ]
    closed = []
    for i, rows in enumerate(batches):
        told(rows, source / f"{i}.json")
        failed = trace_stream.stale_run_stream(tr.parse_trace(trace_stream.stream_trace_source(spark, str(source))), "10 days")
        writer = failed.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start().awaitTermination()
        closed.append(sorted((r.trace_id, r.last_event_ms) for r in spark.read.schema(failed.schema).parquet(str(tmp_path / "o")).collect()))
    one, two = ("early", 1_704_070_800_000), ("late", 1_704_139_200_000)
    assert closed == [[], [one], [one], [one, two], [one, two]]


def test_days_of_the_stale_runs_fit_a_micro_batch(spark, tmp_path):
    """A condition has no more files than a micro-batch takes, however many lines; each run lies in one, in its order."""
    rows = [(f"{i % 500}:{i}", i, str(i % 500)) for i in range(40_000)]
    lines_ = spark.createDataFrame(rows, "value string, arrival long, run string")
    wide = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        trace_plans.line_files(lines_, ["arrival < 30000", "arrival >= 30000"], str(tmp_path / "in"), files=trace_plans.FILES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = list((tmp_path / "in").glob("part-*"))
    assert len(parts) == 2 * trace_plans.FILES
    told_ = [[tuple(map(int, x.split(":"))) for x in p.read_text().split()] for p in parts]
    assert sorted(n for part in told_ for _, n in part) == list(range(40_000)) and all(part == sorted(part) or len({r for r, _ in part}) == len([1 for a, b in zip(part, part[1:]) if a[0] != b[0]]) + 1 for part in told_)
