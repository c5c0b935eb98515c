"""Queries over long-term memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import lexical_features
from quillstone.operators import memory as mm
from quillstone.operators.embedding import embed_features
from quillstone.plans import corpus as cp
from quillstone.plans import duck
from quillstone.plans.conversation_plans import DUCK_BATCHES, DUCK_LOG, INTERVAL, job_state, tool_log
from quillstone.plans.inputs import derived, duck_select
from quillstone.plans.registry import query
from quillstone.sources.tables import table, texts
from quillstone.operators import conversation as cv

# Conversation turns as memories: every turn is one memory of an agent.
MEMORY = [
    "conv_id * 1000 + turn AS id",
    "conv_id % 12 AS agent_id",
    "CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id END AS user_id",
    "CASE WHEN (conv_id + turn) % 2 = 0 THEN 'core' ELSE 'retrieved' END AS memory_scope",
    "CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'fact' ELSE 'task' END AS memory_type",
    "role || ' ' || CAST(turn AS STRING) AS title",
    "text AS content",
    "CAST(length(text) % 4 AS INT) AS priority",
    "length(text) % 5 > 0 AS enabled",
    "conv_id * 7 % 101 AS updated_at",
    "CAST(NULL AS BIGINT) AS last_used_at",
]
DUCK_MEMORIES = f"memories AS ({duck_select(MEMORY, 'conversations')})"


def memories(spark, folder):
    return derived(table(spark, folder, "conversations"), MEMORY)


@query("memory_list", f"WITH {DUCK_MEMORIES} SELECT id, memory_scope, priority, updated_at FROM memories")
def memory_list(spark, folder):
    return mm.memory_list(memories(spark, folder)).select("id", "memory_scope", "priority", "updated_at")


@query(
    "core_topk",
    f"WITH {DUCK_MEMORIES} SELECT agent_id, id, title FROM memories WHERE enabled AND memory_scope = 'core' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY priority DESC, updated_at DESC, id) <= 10",
)
def core_topk(spark, folder):
    return mm.core_topk(memories(spark, folder)).select("agent_id", "id", "title")


@query(
    "user_topk",
    f"WITH {DUCK_MEMORIES} SELECT id, title, priority FROM memories WHERE user_id IS NULL AND enabled ORDER BY priority DESC, updated_at DESC, id LIMIT 10",
)
def user_topk(spark, folder):
    return mm.user_topk(memories(spark, folder)).select("id", "title", "priority")


def _latest_questions(spark, folder):
    """The latest user text of every session asks that session's agent."""
    said = table(spark, folder, "conversations").selectExpr("conv_id AS session_id", "turn AS pos", "role", "text AS content")
    asked = cv.latest_user_text(said)
    return asked.select(
        F.col("session_id").alias("query_id"), (F.col("session_id") % 12).alias("agent_id"), F.col("latest_user_text").alias("query")
    )


DUCK_FOUND = f"""
    {DUCK_MEMORIES},
    asked AS (SELECT conv_id AS query_id, conv_id % 12 AS agent_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' AND {duck.has_text('text')} GROUP BY 1, 2),
    usable AS (SELECT id, agent_id, content FROM memories WHERE enabled AND memory_scope = 'retrieved'),
    mv AS ({cp.duck_unit('usable', 'id, agent_id', 'content')}),
    av AS ({cp.duck_unit('asked', 'query_id, agent_id', 'query')}),
    found AS (SELECT query_id, id, {cp.duck_distance('mv.vector', 'av.vector')} AS distance,
                     row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM av JOIN mv USING (agent_id) QUALIFY rank <= 5)
"""


def retrieved(spark, folder):
    rows = memories(spark, folder)
    vectors = embed_features(rows, ["id", "agent_id", "memory_scope", "enabled"], lexical_features("content"))
    asked = _latest_questions(spark, folder)
    asked_vectors = embed_features(asked, ["query_id", "agent_id", "query"], lexical_features("query"))
    return mm.retrieved_knn(vectors, asked_vectors.withColumnRenamed("embedding", "vector"))


@query("retrieved_knn", f"WITH {DUCK_FOUND} SELECT query_id, id, rank, round(distance, 6) AS distance FROM found")
def retrieved_knn(spark, folder):
    return retrieved(spark, folder).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query(
    "mark_used",
    f"WITH {DUCK_FOUND} SELECT id, updated_at, CASE WHEN id IN (SELECT id FROM found) THEN 500 END::BIGINT AS last_used_at FROM memories",
)
def mark_used(spark, folder):
    out = mm.mark_used(memories(spark, folder), retrieved(spark, folder), F.lit(500).cast("long"))
    return out.select("id", "updated_at", "last_used_at")


REQUEST = [
    "l_orderkey * 10 + l_linenumber AS id",
    "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN ' core ' WHEN 2 THEN 'retrieved' ELSE 'other' END AS memory_scope",
    "CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE ' task' END AS memory_type",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linenumber END AS priority",
    "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag = 'A' END AS enabled",
    "CASE WHEN l_orderkey % 7 = 0 THEN '  ' ELSE ' ' || l_returnflag || ' ' END AS title",
    "CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE ' line ' || CAST(l_linenumber AS STRING) END AS content",
    "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount * 12 END AS confidence",
]


@query(
    "memory_defaults",
    f"""
    WITH r AS ({duck_select(REQUEST, 'lineitem')}),
    f AS (SELECT id, coalesce(nullif(trim(memory_scope), ''), 'core') AS memory_scope, coalesce(nullif(trim(memory_type), ''), 'fact') AS memory_type,
                 coalesce(priority, 0) AS priority, coalesce(enabled, true) AS enabled, trim(title) AS title, trim(content) AS content FROM r)
    SELECT *, CASE WHEN title = '' THEN 'blank_title' WHEN content = '' THEN 'blank_content' WHEN memory_scope NOT IN ('core', 'retrieved') THEN 'unknown_scope' END AS reject_reason FROM f
    """,
)
def memory_defaults(spark, folder):
    return mm.memory_defaults(derived(table(spark, folder, "lineitem"), REQUEST).drop("confidence"))


@query(
    "user_memory_defaults",
    f"""
    WITH r AS ({duck_select(REQUEST, 'lineitem')}),
    f AS (SELECT id, coalesce(nullif(trim(memory_type), ''), 'preference') AS memory_type, coalesce(round(confidence, 3), 1.0) AS confidence, trim(title) AS title, trim(content) AS content FROM r)
    SELECT id, memory_type, confidence::DOUBLE AS confidence, CASE WHEN title = '' THEN 'blank_title' WHEN content = '' THEN 'blank_content'
           WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END AS reject_reason FROM f
    """,
)
def user_memory_defaults(spark, folder):
    filled = mm.user_memory_defaults(derived(table(spark, folder, "lineitem"), REQUEST))
    return filled.select("id", "memory_type", F.col("confidence").cast("double").alias("confidence"), "reject_reason")


@query(
    "memory_embedding",
    f"""
    WITH {DUCK_MEMORIES}, t AS (SELECT id, title || chr(10) || content AS body FROM memories WHERE memory_scope = 'retrieved'),
    v AS ({cp.duck_unit('t', 'id', 'body')})
    SELECT m.id, round(list_sum(list_transform(list_zip(vector, range(64)), lambda z: z[1] * (z[2] + 1))), 6) AS check_sum FROM memories m LEFT JOIN v USING (id)
    """,
)
def memory_embedding(spark, folder):
    out = mm.memory_embedding(memories(spark, folder))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", F.round(weighted, 6).alias("check_sum"))


# Orders as model responses: seven operations each with every kind of fault, some fenced, some broken.
def _operation(i: int) -> str:
    pick = lambda values, by: "CASE " + " ".join(f"WHEN ({by}) % {len(values)} = {n} THEN '{v}'" for n, v in enumerate(values)) + " END"
    parts = {
        "action": pick(["create", " Create ", "update", "ignore", "drop", "create"], f"o_orderkey + {i}"),
        "memoryTarget": pick(["user", "agent", "AGENT", "user", "team"], f"o_custkey + {i}"),
        "memoryScope": pick(["core", "retrieved", "none"], f"o_orderkey + 2 * {i}"),
        "memoryType": pick(["fact", "Task", "preference", "mood"], f"o_custkey + 3 * {i}"),
        "title": pick(["name", "name", "city", " ", "my password"], f"o_orderkey + o_custkey + {i}"),
        "content": f"'v' || CAST((o_orderkey + {i}) % 23 AS STRING)",
        "existingMemoryId": pick(["m1", "m2", "m3", "zz", " "], f"o_orderkey + {i}"),
    }
    body = " || ',' || ".join(f"'\"{k}\": \"' || {v} || '\"'" for k, v in parts.items())
    return "'{' || " + body + " || ', \"extra\": 1}'"


RESPONSE = [
    "o_orderkey AS batch_id",
    "CAST(o_custkey % 20 AS STRING) AS agent_id",
    "'msg-' || CAST(o_orderkey AS STRING) AS source_message_id",
    "CASE WHEN o_orderkey % 10 = 0 THEN ' ' WHEN o_orderkey % 10 = 1 THEN '{\"operations\": [{\"action\"' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '```json' || chr(10) ELSE '' END || "
    "'{\"operations\": [' || " + " || ',' || ".join(_operation(i) for i in range(7)) + " || ']}' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '```' ELSE '' END END AS response",
]


def _duck_operations() -> str:
    def field(name: str, low: bool) -> str:
        value = duck.strip(f"json_extract_string(o, '$.{name}')")
        return (f"lower({value})" if low else value) + f" AS {mm._snake(name)}"

    fields = ", ".join(field(n, n in mm.LOWERED) for n in mm.OPERATION_FIELDS)
    body = duck.strip(duck.sub(duck.sub(duck.strip("response"), r"^```(?:json)?\s*"), r"\s*```$"))
    return f"""
    responses AS ({duck_select(RESPONSE, 'orders')}),
    bodies AS (SELECT *, {body} AS body FROM responses WHERE trim(response) <> ''),
    rows_out AS (SELECT batch_id, agent_id, source_message_id, false AS parse_error, i::INTEGER AS position, json_extract(body, '$.operations[' || i || ']') AS o
                 FROM bodies, range(7) r(i) WHERE json_valid(body)
                 UNION ALL SELECT batch_id, agent_id, source_message_id, true, NULL, NULL FROM bodies WHERE NOT json_valid(body)),
    operations AS (SELECT batch_id, agent_id, source_message_id, parse_error, position, {fields} FROM rows_out)
    """


DUCK_OPERATIONS = _duck_operations()
SENSITIVE = duck.text(fixed.SENSITIVE_PATTERN)
DUCK_VALID = f"""
    {DUCK_OPERATIONS},
    judged AS (SELECT *, CASE WHEN parse_error THEN 'not_json' WHEN coalesce(action NOT IN {duck.in_list(fixed.MEMORY_ACTIONS)}, true) THEN 'unknown_action'
        WHEN action = 'ignore' THEN NULL WHEN coalesce(memory_target NOT IN ('agent', 'user'), true) THEN 'unknown_target'
        WHEN memory_target = 'agent' AND coalesce(memory_scope NOT IN ('core', 'retrieved'), true) THEN 'unknown_scope'
        WHEN action = 'update' AND coalesce(existing_memory_id, '') = '' THEN 'missing_id'
        WHEN coalesce(memory_type NOT IN {duck.in_list(fixed.MEMORY_TYPES)}, true) THEN 'unknown_type'
        WHEN coalesce(title, '') = '' OR coalesce(content, '') = '' THEN 'blank_text'
        WHEN regexp_matches(title, {SENSITIVE}) OR regexp_matches(content, {SENSITIVE}) THEN 'sensitive' END AS reject_reason FROM operations),
    validated AS (SELECT *, reject_reason IS NULL AND sum((reject_reason IS NULL)::INT) OVER (PARTITION BY batch_id ORDER BY position ROWS UNBOUNDED PRECEDING) <= 5 AS accepted FROM judged)
"""


def responses(spark, folder):
    return derived(texts(spark, folder, "orders"), RESPONSE)


def operations(spark, folder):
    return mm.parse_operations(responses(spark, folder), "batch_id", "agent_id", "source_message_id")


def accepted_operations(spark, folder):
    marked = mm.validate_operations(operations(spark, folder), "batch_id")
    return marked.where("accepted").withColumn("seq", F.col("batch_id") * 10 + F.col("position"))


@query("parse_operations", f"WITH {DUCK_OPERATIONS} SELECT * EXCLUDE (reason) FROM operations")
def parse_operations(spark, folder):
    return operations(spark, folder).drop("reason")


@query("validate_operations", f"WITH {DUCK_VALID} SELECT batch_id, position, reject_reason, accepted FROM validated")
def validate_operations(spark, folder):
    return mm.validate_operations(operations(spark, folder), "batch_id").select("batch_id", "position", "reject_reason", "accepted")




def existing(spark, folder, target):
    """One existing memory per market segment and agent; ids as the operations name them."""
    agents = table(spark, folder, "customer").select((F.col("c_custkey") % 3 + 1).alias("n")).distinct()
    rows = agents.select(
        F.concat(F.lit("m"), F.col("n").cast("string")).alias("id"),
        (F.col("n") * 2).cast("string").alias("agent_id") if target == "agent" else F.lit(None).cast("string").alias("agent_id"),
        F.lit("core" if target == "agent" else None).cast("string").alias("memory_scope"),
        F.lit("fact").alias("memory_type"),
        F.lit("name").alias("title"),
        F.concat(F.lit("v"), F.col("n").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("source_message_id"),
        (F.col("n") > 1).alias("enabled"),
    )
    return rows


def _duck_apply(target: str) -> str:
    agent = target == "agent"
    owner = "AND m.agent_id = o.agent_id" if agent else ""
    key = "agent_id, memory_scope, title, content" if agent else "title, content"
    same = " AND ".join(f"f.{k} = v.{k}" for k in key.split(", "))
    scope = "memory_scope" if agent else "NULL::VARCHAR AS memory_scope"
    owner_col = "agent_id" if agent else "NULL::VARCHAR AS agent_id"
    return f"""
    ops AS (SELECT batch_id * 10 + position AS seq, action, existing_memory_id, {owner_col}, source_message_id, {scope}, memory_type, title, content
            FROM validated WHERE accepted AND action <> 'ignore' AND memory_target = '{target}'),
    known AS (SELECT DISTINCT 'm' || (c_custkey % 3 + 1) AS id, {"((c_custkey % 3 + 1) * 2)::VARCHAR" if agent else "NULL::VARCHAR"} AS agent_id,
                     {"'core'" if agent else "NULL::VARCHAR"} AS memory_scope, 'fact' AS memory_type, 'name' AS title, 'v' || (c_custkey % 3 + 1) AS content,
                     NULL::VARCHAR AS source_message_id, c_custkey % 3 + 1 > 1 AS enabled FROM customer),
    versions AS (SELECT id, -1 AS seq, agent_id, memory_scope, memory_type, title, content FROM known
      UNION ALL SELECT m.id, o.seq, o.agent_id, o.memory_scope, o.memory_type, o.title, o.content FROM ops o JOIN known m ON m.id = o.existing_memory_id {owner} WHERE o.action = 'update'),
    spans AS (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS until FROM versions),
    free AS (SELECT * FROM ops f WHERE action = 'create' AND NOT EXISTS (SELECT 1 FROM spans v WHERE {same} AND f.seq > v.seq AND f.seq < coalesce(v.until, {2**62}))),
    added AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq) = 1)
    SELECT k.id, k.agent_id, s.memory_scope, s.memory_type, s.title, s.content, k.source_message_id, k.enabled OR s.seq >= 0 AS enabled
    FROM known k JOIN spans s ON s.id = k.id AND s.until IS NULL
    UNION ALL SELECT 'new-' || seq, agent_id, memory_scope, memory_type, title, content, source_message_id, true FROM added
    """


@query("apply_operations", f"WITH {DUCK_VALID}, {_duck_apply('agent')}")
def apply_operations(spark, folder):
    return mm.apply_operations(accepted_operations(spark, folder), existing(spark, folder, "agent"), "agent")


@query("apply_user_operations", f"WITH {DUCK_VALID}, {_duck_apply('user')}")
def apply_user_operations(spark, folder):
    return mm.apply_operations(accepted_operations(spark, folder), existing(spark, folder, "user"), "user")


# One memory for each customer, with all columns; updates name memories of their agent, and some of another.
STORED = [
    "'m' || CAST(c_custkey AS STRING) AS id",
    "CAST(c_custkey % 20 AS STRING) AS agent_id",
    "CASE WHEN c_custkey % 3 = 0 THEN 'retrieved' ELSE 'core' END AS memory_scope",
    "'fact' AS memory_type",
    "CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'city' END AS title",
    "'v' || CAST(c_custkey % 23 AS STRING) AS content",
    "CAST(NULL AS STRING) AS source_message_id",
    "c_custkey % 4 > 0 AS enabled",
    "CAST(c_custkey % 5 AS INT) AS priority",
    "CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence",
    "CAST(-c_custkey AS BIGINT) AS created_at",
    "CAST(-c_custkey AS BIGINT) AS updated_at",
    "CAST(c_nationkey AS BIGINT) AS last_used_at",
]
TOUCHED = "'m' || CAST(CAST(agent_id AS INT) + 20 * (batch_id % 75) + CASE WHEN batch_id % 5 = 0 THEN 1 ELSE 0 END AS STRING)"


def stored(spark, folder, target):
    rows = derived(table(spark, folder, "customer"), STORED)
    if target == "user":
        none = F.lit(None).cast("string")
        return rows.drop("priority").withColumns({"agent_id": none, "memory_scope": none})
    return mm.memory_embedding(rows.drop("confidence"))


def _duck_stored(target: str) -> str:
    agent = target == "agent"
    key = "agent_id, memory_scope, title, content" if agent else "title, content"
    same = " AND ".join(f"f.{k} = v.{k}" for k in key.split(", "))
    whose = "agent_id, memory_scope" if agent else "NULL::VARCHAR AS agent_id, NULL::VARCHAR AS memory_scope"
    new, check = ("0", "round(list_sum(list_transform(list_zip(vector, range(64)), lambda z: z[1] * (z[2] + 1))), 6)") if agent else ("1", "")
    mixed = "priority" if agent else "confidence"
    changed = "k.priority" if agent else "CASE WHEN s.seq >= 0 THEN 1.0::DOUBLE ELSE k.confidence END"
    vectors = f""",
    vectors AS ({cp.duck_unit("(SELECT id, title || chr(10) || content AS body FROM result WHERE memory_scope = 'retrieved')", "id", "body")})
    SELECT r.*, {check} AS vector_sum FROM result r LEFT JOIN vectors USING (id)""" if agent else " SELECT * FROM result"
    return f"""
    ops AS (SELECT batch_id * 10 + position AS seq, action, {TOUCHED} AS existing_memory_id, agent_id AS op_agent, {whose}, source_message_id, memory_type, title, content
            FROM validated WHERE accepted AND action <> 'ignore' AND memory_target = '{target}'),
    base AS ({duck_select(STORED, 'customer')}),
    known AS (SELECT * REPLACE ({"agent_id AS agent_id" if agent else "NULL::VARCHAR AS agent_id, NULL::VARCHAR AS memory_scope"}) FROM base),
    versions AS (SELECT id, -1 AS seq, agent_id, memory_scope, memory_type, title, content FROM known
      UNION ALL SELECT m.id, o.seq, o.agent_id, o.memory_scope, o.memory_type, o.title, o.content FROM ops o JOIN known m ON m.id = o.existing_memory_id {"AND m.agent_id = o.agent_id" if agent else ""} WHERE o.action = 'update'),
    spans AS (SELECT *, lead(seq) OVER (PARTITION BY id ORDER BY seq) AS until FROM versions),
    free AS (SELECT * FROM ops f WHERE action = 'create' AND NOT EXISTS (SELECT 1 FROM spans v WHERE {same} AND f.seq > v.seq AND f.seq < coalesce(v.until, {2**62}))),
    added AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq) = 1),
    result AS (
      SELECT k.id, k.agent_id, s.memory_scope, s.memory_type, s.title, s.content, k.source_message_id, k.enabled OR s.seq >= 0 AS enabled, {changed} AS {mixed},
             k.created_at, CASE WHEN s.seq >= 0 THEN s.seq ELSE k.updated_at END AS updated_at, k.last_used_at
      FROM known k JOIN spans s ON s.id = k.id AND s.until IS NULL
      UNION ALL SELECT 'new-' || seq, agent_id, memory_scope, memory_type, title, content, source_message_id, true, {new}, seq, seq, NULL FROM added){vectors}
    """


def _applied(spark, folder, target):
    ops = accepted_operations(spark, folder).withColumns({"existing_memory_id": F.expr(TOUCHED), "at": F.col("seq")})
    return mm.apply_operations(ops, stored(spark, folder, target), target)


@query("apply_operations_all_columns", f"WITH {DUCK_VALID}, {_duck_stored('agent')}")
def apply_operations_all_columns(spark, folder):
    out = _applied(spark, folder, "agent")
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("vector_sum", F.round(weighted, 6)).drop("embedding")


@query("apply_user_operations_all_columns", f"WITH {DUCK_VALID}, {_duck_stored('user')}")
def apply_user_operations_all_columns(spark, folder):
    return _applied(spark, folder, "user")


@query(
    "job_progress",
    f"""
    WITH {DUCK_LOG}, {DUCK_BATCHES},
    done AS (SELECT session_id, count(*) * 3 AS more, max(last_user_pos) AS last FROM batches WHERE ready GROUP BY 1)
    SELECT session_id % 6 AS agent_id, session_id, coalesce(processed, 0) + coalesce(more, 0) AS processed, coalesce(last, CASE WHEN processed IS NOT NULL THEN 0 END) AS last_pos
    FROM state FULL JOIN done USING (session_id)
    """,
)
def job_progress(spark, folder):
    state = job_state(spark, folder)
    ready = cv.memory_batches(tool_log(spark, folder), INTERVAL, state).where("ready")
    agent = (F.col("session_id") % 6).alias("agent_id")
    return mm.job_progress(
        state.select(agent, "session_id", "processed", F.lit(0).cast("long").alias("last_pos")),
        ready.select(agent, "session_id", "last_user_pos"),
        INTERVAL,
    )


def _duck_prompt() -> str:
    def items(rows: str, kind: str) -> str:
        return f"string_agg('- [' || coalesce(memory_type, '{kind}') || '] ' || title || '：' || content, chr(10) ORDER BY place)"

    def section(name: str, head: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '' ELSE {duck.text(chr(10) + head)} || {name} || chr(10) END"

    ranked = "row_number() OVER (PARTITION BY {by} ORDER BY priority DESC, updated_at DESC, id) AS place"
    return f"""
    c AS (SELECT *, {ranked.format(by='agent_id')} FROM memories WHERE enabled AND memory_scope = 'core' QUALIFY place <= 10),
    u AS (SELECT *, row_number() OVER (ORDER BY priority DESC, updated_at DESC, id) AS place FROM memories WHERE user_id IS NULL AND enabled QUALIFY place <= 10),
    best AS (SELECT agent_id, max(query_id) AS query_id FROM asked GROUP BY 1),
    r AS (SELECT m.*, rank AS place FROM best JOIN found USING (query_id) JOIN memories m ON m.id = found.id),
    ci AS (SELECT agent_id, {items('c', 'fact')} AS ci FROM c GROUP BY 1), ri AS (SELECT agent_id, {items('r', 'fact')} AS ri FROM r GROUP BY 1),
    ui AS (SELECT {items('u', 'preference')} AS ui FROM u)
    SELECT agent_id, md5({section('ui', fixed.MEMORY_PROMPT_USER)} || {section('ci', fixed.MEMORY_PROMPT_CORE)} || {section('ri', fixed.MEMORY_PROMPT_RETRIEVED)}) AS prompt_md5
    FROM (SELECT DISTINCT agent_id FROM memories) LEFT JOIN ci USING (agent_id) LEFT JOIN ri USING (agent_id), ui
    """


@query("memory_prompt", f"WITH {DUCK_FOUND}, {_duck_prompt()}")
def memory_prompt(spark, folder):
    from pyspark.sql import Window

    rows = memories(spark, folder)
    newest = [F.col("priority").desc(), F.col("updated_at").desc(), F.col("id")]
    core = mm.core_topk(rows).withColumn("place", F.row_number().over(Window.partitionBy("agent_id").orderBy(*newest)))
    # Ten rows at most.
    user = mm.user_topk(rows).withColumn("place", F.row_number().over(Window.orderBy(*newest)))
    latest = _latest_questions(spark, folder).groupBy("agent_id").agg(F.max("query_id").alias("query_id"))
    found = retrieved(spark, folder).join(latest, "query_id").select("id", F.col("rank").alias("place"))
    near = rows.join(found, "id")
    prompts = mm.memory_prompt(rows.select("agent_id").distinct(), user, core, near)
    return prompts.select("agent_id", F.md5("prompt").alias("prompt_md5"))
