"""Chat histories: windows of messages, repair, memory batches, sessions and table maintenance.

Message tables have session_id, pos (the order within a session, at least 0), role and content. Sessions may be of any
length, so positions and carried values go through ``positions.running``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import extract_urls, has_text, strip, strip_dsml, url_domain
from quillstone.operators.positions import first_per_key, position_block, running

DELETED_AGENT = "已删除的智能体"


def session_history(messages: DataFrame) -> DataFrame:
    return messages.orderBy("session_id", "pos")


def recent_messages(messages: DataFrame, message_length: int) -> DataFrame:
    """The last max(2, n) messages of every session, oldest first."""
    last = first_per_key(messages, ["session_id"], [F.col("pos").desc()], max(2, message_length))
    return last.orderBy("session_id", "pos")


def repair_history(messages: DataFrame) -> DataFrame:
    """The messages a model may be given, with ``place`` as their new order.

    Needs call_ids array<string> (of assistant rows) and tool_id (of tool rows). Blank system and user rows go, an
    assistant row needs text or calls, and a tool row must answer a call of the latest kept row, once per call. System
    rows come first, the latest one foremost.
    """
    text = F.when(F.col("role") == "assistant", strip_dsml("content")).otherwise(F.col("content"))
    calls = F.coalesce("call_ids", F.array().cast("array<string>"))
    speaks = F.when(F.col("role") == "assistant", has_text(text) | (F.size(calls) > 0)).otherwise(
        F.coalesce(F.length("content") > 0, F.lit(False))
    )
    opened = F.when(F.col("role") == "assistant", calls).otherwise(F.array().cast("array<string>"))
    turn = F.when((F.col("role") != "tool") & speaks, F.struct(F.col("pos").alias("at"), opened.alias("ids")))
    carried = running(messages, ["session_id"], ["pos"], position_block("pos"), lasts={"_open": turn})
    kept = carried.where((F.col("role") != "tool") & speaks)
    answers = carried.where(
        (F.col("role") == "tool") & F.coalesce(F.array_contains(F.col("_open.ids"), F.col("tool_id")), F.lit(False))
    ).withColumn("_at", F.col("_open.at"))
    first = first_per_key(answers, ["session_id", "_at", "tool_id"], [F.col("pos")]).drop("_at")
    place = F.when(F.col("role") == "system", -F.col("pos") - 1).otherwise(F.col("pos"))
    return kept.unionByName(first).drop("_open").withColumn("content", text).withColumn("place", place)


def latest_user_text(messages: DataFrame) -> DataFrame:
    asked = messages.where((F.col("role") == "user") & has_text("content"))
    return asked.groupBy("session_id").agg(F.max_by("content", "pos").alias("latest_user_text"))


def count_user_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_messages"))


def _numbered_turns(messages: DataFrame) -> DataFrame:
    """User and assistant rows with ``user_no``, the number of the latest user message so far."""
    is_user = (F.col("role") == "user").cast("long")
    turns = messages.where(F.col("role").isin("user", "assistant"))
    return running(turns, ["session_id"], ["pos"], position_block("pos"), sums={"user_no": is_user})


def unprocessed_batch(messages: DataFrame, state: DataFrame, interval: int) -> DataFrame:
    """User messages processed+1 .. processed+interval of each session; ``state`` has session_id, processed."""
    users = _numbered_turns(messages).where("role = 'user'")
    done = F.coalesce("processed", F.lit(0))
    joined = users.join(state.select("session_id", "processed"), "session_id", "left")
    return joined.where((F.col("user_no") > done) & (F.col("user_no") <= done + interval)).drop("processed")


def messages_after(messages: DataFrame, starts: DataFrame, interval: int) -> DataFrame:
    """User and assistant messages from a start position on, 4 x interval + 20 per session at most."""
    turns = messages.where(F.col("role").isin("user", "assistant")).join(starts, "session_id")
    return first_per_key(turns.where("pos >= start_pos"), ["session_id"], [F.col("pos")], 4 * interval + 20).drop("start_pos")


def batch_turns(messages: DataFrame, interval: int, state: DataFrame | None = None) -> DataFrame:
    """Turns after the processed ones with ``batch_no``: each batch has ``interval`` user messages and their replies."""
    turns = _numbered_turns(messages)
    if state is None:
        turns = turns.withColumn("_done", F.lit(0))
    else:
        turns = turns.join(state.select("session_id", F.col("processed").alias("_done")), "session_id", "left")
    done = F.coalesce("_done", F.lit(0))
    return (
        turns.where(F.col("user_no") > done)
        .withColumn("batch_no", F.floor((F.col("user_no") - done - 1) / interval))
        .withColumn("closing", F.col("user_no") == done + (F.col("batch_no") + 1) * interval)
        .drop("_done")
    )


def memory_batches(messages: DataFrame, interval: int, state: DataFrame | None = None) -> DataFrame:
    """One row per batch; ready when it has all its user messages and a reply after the last one."""
    is_user = F.col("role") == "user"
    return (
        batch_turns(messages, interval, state)
        .groupBy("session_id", "batch_no")
        .agg(
            F.count_if(is_user).alias("user_messages"),
            F.count_if(~is_user).alias("replies"),
            F.min("pos").alias("first_pos"),
            F.max(F.when(is_user, F.col("pos"))).alias("last_user_pos"),
            F.coalesce(F.bool_or(F.col("closing") & ~is_user), F.lit(False)).alias("ready"),
        )
    )


def render_conversation(turns: DataFrame, *keys: str) -> DataFrame:
    """``[i] role: text`` lines per key, blanks skipped; a key is one batch of turns."""
    said = F.struct("pos", F.concat(F.col("role"), F.lit(": "), strip("content")).alias("line"))
    grouped = turns.where(has_text("content")).groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("_lines"))
    lines = F.transform("_lines", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["line"]))
    return grouped.select(*keys, F.array_join(lines, "\n").alias("conversation"))


def session_list(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.coalesce("pinned", F.lit(False)).desc(), F.col("updated_at").desc(), "session_id")


def session_groups(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """Unpinned sessions with their group label and the group's latest update, by which the groups are ordered."""
    unpinned = sessions.where(~F.coalesce("pinned", F.lit(False)))
    named = unpinned.join(agents.select("agent_id", F.col("name").alias("_name")), "agent_id", "left")
    key = F.coalesce(F.col("agent_id").cast("string"), F.lit("deleted"))
    labelled = named.withColumn("group_key", key).withColumn("label", F.coalesce("_name", F.lit(DELETED_AGENT))).drop("_name")
    latest = labelled.groupBy("group_key").agg(F.max("updated_at").alias("group_updated_at"))
    return labelled.join(latest, "group_key").orderBy(
        F.col("group_updated_at").desc(), "group_key", F.col("updated_at").desc(), "session_id"
    )


def pinned_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.coalesce("pinned", F.lit(False))).orderBy(F.col("updated_at").desc(), "session_id")


def touch_sessions(sessions: DataFrame, messages: DataFrame, time: str = "created_at") -> DataFrame:
    latest = messages.groupBy("session_id").agg(F.max(time).alias("_latest"))
    joined = sessions.join(latest, "session_id", "left")
    return joined.withColumn("updated_at", F.greatest("updated_at", "_latest")).drop("_latest")


def append_content(messages: DataFrame, deltas: DataFrame) -> DataFrame:
    """Streams of text deltas (message_id, seq, delta) added to the messages' content in order."""
    part = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    joined = deltas.groupBy("message_id").agg(F.array_join(F.transform(part, lambda x: x["delta"]), "").alias("_added"))
    content = F.concat(F.coalesce("content", F.lit("")), F.coalesce("_added", F.lit("")))
    changed = F.when(F.col("_added").isNotNull(), content).otherwise(F.col("content"))
    return messages.join(joined, "message_id", "left").withColumn("content", changed).drop("_added")


def web_citations(replies: DataFrame) -> DataFrame:
    """The first 12 distinct links per run from replies of search tools: (run_id, pos, tool_name, content) in."""
    name = F.lower(F.coalesce("tool_name", F.lit("")))
    search = replies.where((F.contains(name, F.lit("search")) | F.contains(name, F.lit("brave"))) & has_text("content"))
    links = search.select("run_id", "pos", F.posexplode(extract_urls("content")).alias("link", "url"))
    links = links.withColumn("domain", url_domain("url")).where(has_text("domain"))
    first = links.groupBy("run_id", "url", "domain").agg(F.min(F.struct("pos", "link")).alias("seen"))
    head, tail = fixed.FAVICON_URL.split("{domain}")
    return first_per_key(first, ["run_id"], [F.col("seen"), F.col("url")], fixed.MAX_CITATIONS).select(
        "run_id",
        "url",
        F.col("domain").alias("title"),
        "domain",
        F.concat(F.lit(head), F.col("domain"), F.lit(tail)).alias("favicon_url"),
    )


def tool_call_filter(calls: DataFrame, tools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executable calls of (run_id, position, name), and per run whether all its calls are."""
    known = tools.select(F.col("name")).distinct().withColumn("_known", F.lit(True))
    marked = calls.join(known, "name", "left")
    usable = F.coalesce("_known", F.lit(False)) & (F.col("name") != fixed.TERMINATE_TOOL)
    executable = marked.where(usable).drop("_known")
    runs = marked.groupBy("run_id").agg(F.bool_and(usable).alias("proceed"), F.count_if(usable).alias("executable"))
    return executable, runs


def _groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def recover_tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call that an assistant wrote as markup, from rows that carry no structured calls.

    A parameter given twice keeps its last value.
    """
    written = messages.where(
        (F.col("role") == "assistant")
        & (F.size(F.coalesce("call_ids", F.array().cast("array<string>"))) == 0)
        & F.rlike("content", F.lit(fixed.DSML_TOOL_CALLS_PATTERN))
    )
    blocks = F.array_join(_groups(F.col("content"), fixed.DSML_TOOL_CALLS_PATTERN, 0), "\n")
    calls = written.withColumn("_blocks", blocks).select(
        "session_id",
        "pos",
        F.posexplode(
            F.arrays_zip(
                _groups(F.col("_blocks"), fixed.DSML_INVOKE_PATTERN, 1).alias("name"),
                _groups(F.col("_blocks"), fixed.DSML_INVOKE_PATTERN, 2).alias("body"),
            )
        ).alias("position", "_call"),
    )
    names = _groups(F.col("_call.body"), fixed.DSML_PARAMETER_PATTERN, 1)
    values = F.transform(_groups(F.col("_call.body"), fixed.DSML_PARAMETER_PATTERN, 2), strip)
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    calls = calls.withColumn("_pairs", pairs).withColumn("_names", F.transform("_pairs", lambda p: p["name"]))
    last = F.filter(
        "_pairs",
        lambda p, i: ~F.array_contains(F.slice("_names", i + 2, F.greatest(F.size("_names") - i - 1, F.lit(0))), p["name"]),
    )
    arguments = F.when(F.size(last) == 0, "{}").otherwise(F.to_json(F.map_from_entries(last)))
    return calls.select(
        "session_id", "pos", "position", F.col("_call.name").alias("name"), arguments.alias("arguments")
    )


def delete_cascade(
    ids: DataFrame, sessions: DataFrame, messages: DataFrame, memories: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions without the given ids, messages without theirs, and memories with lost source messages set to null."""
    gone = ids.select("session_id").distinct()
    left_sessions = sessions.join(gone, "session_id", "left_anti")
    left_messages = messages.join(gone, "session_id", "left_anti")
    lost = messages.join(gone, "session_id", "left_semi").select(F.col("message_id").alias("source_message_id"), F.lit(True).alias("_lost"))
    kept = memories.join(lost, "source_message_id", "left")
    source = F.when(F.col("_lost").isNull(), F.col("source_message_id"))
    return left_sessions, left_messages, kept.withColumn("source_message_id", source).drop("_lost")


def partial_update(rows: DataFrame, patch: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Non-null patch values overwrite, and updated_at is set on patched rows."""
    changes = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_patched"))
    joined = rows.join(changes, key, "left")
    updated = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}
    updated["updated_at"] = F.when(F.col("_patched"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(updated).select(*rows.columns)
