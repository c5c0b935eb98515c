"""Long-term memory: selection, defaults, model-proposed operations, job progress, prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import contains_sensitive, has_text, strip, strip_json_fence, text_key
from quillstone.operators.embedding import embed_with_cache
from quillstone.operators.nearest import knn_topk
from quillstone.operators.positions import first_per_key, running
from quillstone.session import materialise


def memory_list(memories: DataFrame) -> DataFrame:
    return memories.orderBy("memory_scope", F.col("priority").desc(), F.col("updated_at").desc(), "id")


def _newest() -> list[Column]:
    return [F.col("priority").desc(), F.col("updated_at").desc(), F.col("id")]


def core_topk(memories: DataFrame, k: int = fixed.CORE_MEMORIES) -> DataFrame:
    core = memories.where(F.col("enabled") & (F.col("memory_scope") == "core"))
    return first_per_key(core, ["agent_id"], _newest(), k)


def user_topk(memories: DataFrame, k: int = fixed.USER_MEMORIES) -> DataFrame:
    return memories.where(F.col("user_id").isNull() & F.col("enabled")).orderBy(*_newest()).limit(k)


def retrieved_knn(memories: DataFrame, queries: DataFrame, k: int = fixed.RETRIEVED_MEMORIES) -> DataFrame:
    """Nearest enabled retrieved memories of each query's agent; blank queries find nothing.

    ``memories``: id (bigint), agent_id, memory_scope, enabled, embedding; ``queries``: query_id, agent_id, query, vector.
    """
    usable = memories.where(
        F.col("enabled") & (F.col("memory_scope") == "retrieved") & F.col("embedding").isNotNull()
    ).select(F.col("id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("agent_id").alias("part"))
    asked = queries.where(has_text("query")).select("query_id", "vector", F.col("agent_id").alias("part"))
    return knn_topk(usable, asked, k, within=True).withColumnRenamed("chunk_id", "id")


def mark_used(memories: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """Sets last_used_at of the returned memories; updated_at stays."""
    hit = used.select("id").distinct().withColumn("_used", F.lit(True))
    joined = memories.join(hit, "id", "left")
    return joined.withColumn("last_used_at", F.when(F.col("_used"), now).otherwise(F.col("last_used_at"))).drop("_used")


def _default(name: str, value: str) -> Column:
    return F.when(has_text(name), strip(name)).otherwise(value)


def memory_defaults(requests: DataFrame) -> DataFrame:
    """Agent memories with defaults filled in and a reject_reason."""
    filled = requests.withColumns(
        {
            "memory_scope": _default("memory_scope", "core"),
            "memory_type": _default("memory_type", "fact"),
            "priority": F.coalesce("priority", F.lit(0)),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "title": strip("title"),
            "content": strip("content"),
        }
    )
    reason = (
        F.when(~has_text("title"), "blank_title")
        .when(~has_text("content"), "blank_content")
        .when(~F.col("memory_scope").isin(fixed.MEMORY_SCOPES), "unknown_scope")
    )
    return filled.withColumn("reject_reason", reason)


def user_memory_defaults(requests: DataFrame) -> DataFrame:
    """User memories: type preference, confidence 1 within [0, 1]."""
    filled = requests.withColumns(
        {
            "memory_type": _default("memory_type", "preference"),
            "priority": F.coalesce("priority", F.lit(0)),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "confidence": F.coalesce("confidence", F.lit(1)).cast("decimal(4,3)"),
            "title": strip("title"),
            "content": strip("content"),
        }
    )
    reason = (
        F.when(~has_text("title"), "blank_title")
        .when(~has_text("content"), "blank_content")
        .when(~F.col("confidence").between(0, 1), "confidence_out_of_range")
    )
    return filled.withColumn("reject_reason", reason)


def memory_embedding(memories: DataFrame, cache: DataFrame | None = None, model: str = "hashed-features") -> DataFrame:
    """Embeds title and content of retrieved memories; core memories have no vector."""
    text = F.concat_ws("\n", "title", "content")
    wanted = memories.where("memory_scope = 'retrieved'").select(text.alias("text"))
    vectors = embed_with_cache(wanted, cache, model)
    key = F.when(F.col("memory_scope") == "retrieved", text_key(model, text))
    return memories.withColumn("key", key).join(vectors, "key", "left").drop("key")


OPERATION_FIELDS = [
    "action", "memoryTarget", "existingMemoryId", "memoryScope", "memoryType", "title", "content", "reason",
]
RESPONSE = "operations array<struct<" + ",".join(f"{f}:string" for f in OPERATION_FIELDS) + ">>, _bad string"
LOWERED = {"action", "memoryTarget", "memoryScope", "memoryType"}


def parse_operations(responses: DataFrame, *keys: str) -> DataFrame:
    """Operations of model responses, one row each with ``position``; a response that is not JSON is one error row."""
    body = strip_json_fence("response")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = responses.withColumn("_r", F.from_json(body, RESPONSE, options))
    bad = has_text("response") & (F.col("_r").isNull() | F.col("_r._bad").isNotNull())
    rows = parsed.select(*keys, bad.alias("parse_error"), F.posexplode_outer(F.when(~bad, F.col("_r.operations"))).alias("position", "_o"))
    rows = rows.where(F.col("parse_error") | F.col("_o").isNotNull())

    def field(name: str) -> Column:
        value = strip(F.col(f"_o.{name}"))
        return (F.lower(value) if name in LOWERED else value).alias(_snake(name))

    return rows.select(*keys, "parse_error", "position", *[field(n) for n in OPERATION_FIELDS])


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def validate_operations(operations: DataFrame, *batch: str) -> DataFrame:
    """Adds reject_reason, and ``accepted`` for the first five valid operations per batch ("ignore" counts as valid)."""

    def among(name: str, values: list[str]) -> Column:
        return F.coalesce(F.col(name).isin(values), F.lit(False))

    target, action = F.col("memory_target"), F.col("action")
    reason = (
        F.when(F.col("parse_error"), "not_json")
        .when(~among("action", fixed.MEMORY_ACTIONS), "unknown_action")
        .when(action == "ignore", F.lit(None))
        .when(~among("memory_target", fixed.MEMORY_TARGETS), "unknown_target")
        .when((target == "agent") & ~among("memory_scope", fixed.MEMORY_SCOPES), "unknown_scope")
        .when((action == "update") & ~has_text("existing_memory_id"), "missing_id")
        .when(~among("memory_type", fixed.MEMORY_TYPES), "unknown_type")
        .when(~has_text("title") | ~has_text("content"), "blank_text")
        .when(contains_sensitive("title") | contains_sensitive("content"), "sensitive")
    )
    marked = operations.withColumn("reject_reason", reason)
    # A batch is one model response, so this window is as long as one answer.
    valid = F.col("reject_reason").isNull()
    order = Window.partitionBy(*batch).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(valid.cast("int")).over(order)
    return marked.withColumn("accepted", valid & (number <= fixed.MAX_OPERATIONS))


# Operations of one memory, or of one content, that a window takes at most.
SEQ_BLOCK = 4096


def apply_operations(
    operations: DataFrame, memories: DataFrame, target: str, cache: DataFrame | None = None, model: str = "hashed-features"
) -> DataFrame:
    """The memory table of one target after accepted operations, taken in ``seq`` order.

    ``operations``: seq (unique, not negative), agent_id, source_message_id, the operation fields, and ``at``, the moment
    of the operation, where memories carry times. ``memories``: id, agent_id, memory_scope, memory_type, title, content,
    source_message_id, enabled; all further columns are kept (user memories have a null agent_id and scope).

    An update sets the texts, enables the memory, moves ``updated_at``, makes ``confidence`` one and renews
    ``embedding``; other columns stay. A create is skipped when an equal memory exists at that moment: an earlier create,
    or a table row in the version that the updates before it left. New rows get the id ``new-<seq>``, priority 0,
    confidence 1 and both times; what else the table has is null in them.

    Every version of a memory opens its content and closes the one before it, which an as-of pass over the memory's
    updates finds. A create is free where no version of its content is open. Both passes run in blocks, so neither a
    memory with many updates nor a content that many propose comes into one task.
    """
    mine = operations.where((F.col("memory_target") == target) & (F.col("action") != "ignore"))
    if target == "user":
        mine = mine.withColumn("agent_id", F.lit(None).cast("string")).withColumn("memory_scope", F.lit(None).cast("string"))
    if "at" not in mine.columns:
        mine = mine.withColumn("at", F.lit(None).cast("long"))
    owner = ["agent_id"] if target == "agent" else []
    key = (["agent_id", "memory_scope"] if target == "agent" else []) + ["title", "content"]
    fields = ["memory_scope", "memory_type", "title", "content"]
    wanted = ["action", "existing_memory_id", "agent_id", "source_message_id", "at", *fields]
    mine = materialise(mine.select(F.col("seq").cast("long"), *wanted), "operations")

    named = mine.where("action = 'update'").withColumn("id", F.col("existing_memory_id"))
    changes = named.join(memories.select("id", *owner), ["id", *owner], "left_semi")
    changes = materialise(changes.select("id", "seq", "agent_id", "at", *fields), "changes")
    creates = mine.where("action = 'create'").select("seq", "agent_id", "source_message_id", "at", *fields)

    content = F.struct(*key)
    first = F.lit(-1).cast("long").alias("seq")
    originals = memories.select("id", first, content.alias("content_key"))
    versions = changes.select("id", "seq", content.alias("content_key"))
    changed = originals.join(changes.select("id").distinct(), "id", "left_semi")
    asked = changes.select("id", "seq", F.lit(None).cast(changed.schema["content_key"].dataType).alias("content_key"))
    steps = asked.withColumn("kind", F.lit(0)).unionByName(versions.unionByName(changed).withColumn("kind", F.lit(1)))
    block = F.floor(F.col("seq") / SEQ_BLOCK)
    closed = running(steps, ["id"], ["seq", "kind"], block, lasts={"before": F.col("content_key")}).where("kind = 0")

    def moves(rows: DataFrame, name: str, opened: int) -> DataFrame:
        return rows.select(f"{name}.*", "seq", F.lit(opened).alias("opened"), F.lit(False).alias("is_create"))

    proposed = creates.select(*key, "seq", F.lit(0).alias("opened"), F.lit(True).alias("is_create"))
    moved = moves(originals, "content_key", 1).unionByName(moves(versions, "content_key", 1)).unionByName(moves(closed, "before", -1))
    events = moved.join(creates.select(*key).distinct(), key, "left_semi").unionByName(proposed)
    counted = running(events, key, ["seq", "opened"], block, sums={"open_now": F.col("opened")})
    firsts = counted.where("is_create AND open_now = 0").groupBy(*key).agg(F.min("seq").alias("seq")).select("seq")
    added = creates.join(firsts, "seq", "left_semi").withColumn("id", F.concat(F.lit("new-"), F.col("seq").cast("string")))
    added = materialise(added, "added")

    last = changes.groupBy("id").agg(F.max_by(F.struct("at", *fields), "seq").alias("_v"))
    renewed = {f: F.col(f"_v.{f}") for f in fields} | {"enabled": F.lit(True)}
    given = {f: F.col(f) for f in ["id", "agent_id", "source_message_id", *fields]} | {"enabled": F.lit(True)}
    for name, update, create in [
        ("updated_at", F.col("_v.at"), F.col("at")),
        ("created_at", None, F.col("at")),
        ("priority", None, F.lit(0)),
        ("confidence", F.lit(1), F.lit(1)),
    ]:
        if name in memories.columns:
            renewed |= {name: update} if update is not None else {}
            given[name] = create
    types = {f.name: f.dataType for f in memories.schema}
    touched = F.col("_v").isNotNull()
    kept = memories.join(last, "id", "left").select(
        *[F.when(touched, renewed[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in renewed else F.col(c) for c in memories.columns]
    )
    fresh = added.select(*[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in memories.columns])
    out = kept.unionByName(fresh)
    if "embedding" not in memories.columns:
        return out
    texts = last.select("id", "_v.memory_scope", "_v.title", "_v.content").unionByName(fresh.select("id", "memory_scope", "title", "content"))
    vectors = memory_embedding(texts, cache, model).select("id", F.struct("embedding").alias("_new"))
    value = F.when(F.col("_new").isNotNull(), F.col("_new.embedding").cast(types["embedding"])).otherwise(F.col("embedding"))
    return out.join(vectors, "id", "left").withColumn("embedding", value).select(memories.columns)


def job_progress(state: DataFrame, finished: DataFrame, interval: int) -> DataFrame:
    """State rows are created where absent; each finished batch adds ``interval`` and moves the last position.

    ``state``: agent_id, session_id, processed, last_pos; ``finished``: agent_id, session_id, last_user_pos per batch.
    Where both have last_message_id or last_message_at, these follow the last message, also to null.
    """
    about = [c for c in ("last_message_id", "last_message_at") if c in state.columns and c in finished.columns]
    newest = [F.max_by(F.struct(*about), "last_user_pos").alias("_message")] if about else []
    done = finished.groupBy("agent_id", "session_id").agg(
        (F.count("*") * interval).alias("_more"), F.max("last_user_pos").alias("_last"), *newest
    )
    joined = state.join(done, ["agent_id", "session_id"], "full")
    return joined.select(
        *[F.when(F.col("_more").isNotNull(), F.col(f"_message.{c}")).otherwise(F.col(c)).alias(c) for c in about],
        "agent_id",
        "session_id",
        (F.coalesce("processed", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("processed"),
        F.coalesce("_last", "last_pos").alias("last_pos"),
    )


def memory_prompt(agents: DataFrame, user: DataFrame, core: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The prompt of each agent from its chosen memories; sections without items are left out.

    ``user`` has the chosen user memories, ``core`` and ``retrieved`` the chosen ones per agent, each with ``place``.
    """

    def items(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
        line = F.concat(F.lit("- ["), _default("memory_type", kind), F.lit("] "), F.col("title"), F.lit("："), F.col("content"))
        lines = F.array_sort(F.collect_list(F.struct(F.col("place"), line.alias("line"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("_items"))

    def section(name: str, head: str) -> Column:
        body = F.concat(F.lit("\n" + head), F.col(name), F.lit("\n"))
        return F.when(F.length(name) > 0, body).otherwise("")

    shared = items(user, "preference", []).withColumnRenamed("_items", "_user")
    core_items = items(core, "fact", ["agent_id"]).withColumnRenamed("_items", "_core")
    found = items(retrieved, "fact", ["agent_id"]).withColumnRenamed("_items", "_found")
    # ``shared`` is one row of ten items at most.
    joined = (
        agents.select("agent_id")
        .join(core_items, "agent_id", "left")
        .join(found, "agent_id", "left")
        .join(F.broadcast(shared), F.lit(True), "left")
    )
    text = F.concat(
        section("_user", fixed.MEMORY_PROMPT_USER),
        section("_core", fixed.MEMORY_PROMPT_CORE),
        section("_found", fixed.MEMORY_PROMPT_RETRIEVED),
    )
    return joined.select("agent_id", text.alias("prompt"))
