"""Queries over chat messages and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.operators import conversation as cv
from quillstone.plans import duck
from quillstone.plans.inputs import DUCK_MESSAGES, derived, duck_select, messages
from quillstone.plans.registry import query
from quillstone.plans.text_plans import WEB_TEXT
from quillstone.sources.tables import table

INTERVAL = 3  # the smallest allowed one; the sessions of the test tables are short

# Events as an agent's message log with tool calls: each user is a session.
LOG = [
    "user_id AS session_id",
    "event_id AS pos",
    "CASE WHEN event_type = 'view' THEN 'user' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'system' "
    "WHEN event_type IN ('click', 'signup') THEN 'assistant' ELSE 'tool' END AS role",
    "CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 9 = 1 THEN '  ' ELSE props END AS content",
    "CASE WHEN event_type NOT IN ('click', 'signup') OR event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'c0,c1' ELSE 'c1,c2' END AS calls",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'c' || CAST(event_id % 3 AS STRING) END AS tool_id",
]


def tool_log(spark, folder):
    log = derived(table(spark, folder, "events"), LOG)
    ids = F.when(F.length("calls") > 0, F.split("calls", ",")).otherwise(F.array().cast("array<string>"))
    return log.withColumn("call_ids", ids).drop("calls")


def _shown(df):
    return df.select("session_id", "pos", "role", F.md5("content").alias("content_md5"))


@query("session_history", f"SELECT session_id, pos, role, md5(content) AS content_md5 FROM ({DUCK_MESSAGES})")
def session_history(spark, folder):
    return _shown(cv.session_history(messages(spark, folder)))


@query(
    "recent_messages",
    f"SELECT session_id, pos, role, md5(content) AS content_md5 FROM ({DUCK_MESSAGES}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) <= 3",
)
def recent_messages(spark, folder):
    return _shown(cv.recent_messages(messages(spark, folder), 3))


@query(
    "repair_history",
    f"""
    WITH m AS ({duck_select(LOG, 'events')}),
    k AS (SELECT *, role <> 'tool' AND CASE WHEN role = 'assistant' THEN trim(content) <> '' OR (calls <> '' AND role = 'assistant') ELSE length(content) > 0 END AS speaks FROM m),
    o AS (SELECT *, last_value(CASE WHEN speaks THEN pos END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS at FROM k),
    t AS (SELECT o.*, row_number() OVER (PARTITION BY o.session_id, o.at, o.tool_id ORDER BY o.pos) AS n
          FROM o JOIN m a ON a.session_id = o.session_id AND a.pos = o.at
          WHERE o.role = 'tool' AND a.role = 'assistant' AND list_contains(string_split(a.calls, ','), o.tool_id)),
    r AS (SELECT session_id, pos, role, content FROM o WHERE speaks UNION ALL SELECT session_id, pos, role, content FROM t WHERE n = 1)
    SELECT session_id, pos, role, CASE WHEN role = 'assistant' AND trim(content) <> '' THEN trim(content) ELSE content END AS content,
           CASE WHEN role = 'system' THEN -pos - 1 ELSE pos END AS place FROM r
    """,
)
def repair_history(spark, folder):
    return cv.repair_history(tool_log(spark, folder)).select("session_id", "pos", "role", "content", "place")


@query(
    "latest_user_text",
    f"SELECT session_id, arg_max(content, pos) AS latest_user_text FROM ({DUCK_MESSAGES}) WHERE role = 'user' AND {duck.has_text('content')} GROUP BY 1",
)
def latest_user_text(spark, folder):
    return cv.latest_user_text(messages(spark, folder))


@query(
    "count_user_messages",
    f"SELECT session_id, count(*) FILTER (WHERE role = 'user') AS user_messages FROM ({DUCK_MESSAGES}) GROUP BY 1",
)
def count_user_messages(spark, folder):
    return cv.count_user_messages(messages(spark, folder))


DUCK_TURNS = """
    turns AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS user_no
              FROM (SELECT * FROM log WHERE role IN ('user', 'assistant')))
"""
DUCK_LOG = f"log AS ({duck_select(LOG, 'events')})"
DUCK_STATE = "state AS (SELECT DISTINCT user_id AS session_id, user_id % 4 AS processed FROM events WHERE user_id % 3 > 0)"


def job_state(spark, folder):
    events = table(spark, folder, "events").where("user_id % 3 > 0")
    return events.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 4).alias("processed")).distinct()


@query(
    "unprocessed_batch",
    f"""
    WITH {DUCK_LOG}, {DUCK_TURNS}, {DUCK_STATE}
    SELECT session_id, pos, user_no FROM turns LEFT JOIN state USING (session_id)
    WHERE role = 'user' AND user_no > coalesce(processed, 0) AND user_no <= coalesce(processed, 0) + 3
    """,
)
def unprocessed_batch(spark, folder):
    return cv.unprocessed_batch(tool_log(spark, folder), job_state(spark, folder), INTERVAL).select("session_id", "pos", "user_no")


@query(
    "messages_after",
    f"""
    WITH {DUCK_LOG}, s AS (SELECT session_id, min(pos) AS start_pos FROM log WHERE role = 'user' AND pos % 5 = 0 GROUP BY 1)
    SELECT session_id, pos, role FROM log JOIN s USING (session_id) WHERE role IN ('user', 'assistant') AND pos >= start_pos
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) <= 32
    """,
)
def messages_after(spark, folder):
    log = tool_log(spark, folder)
    starts = log.where("role = 'user' AND pos % 5 = 0").groupBy("session_id").agg(F.min("pos").alias("start_pos"))
    return cv.messages_after(log, starts, INTERVAL).select("session_id", "pos", "role")


DUCK_BATCHES = f"""
    {DUCK_TURNS}, {DUCK_STATE},
    cut AS (SELECT t.*, coalesce(processed, 0) AS done, (user_no - coalesce(processed, 0) - 1) // 3 AS batch_no
            FROM turns t LEFT JOIN state USING (session_id) WHERE user_no > coalesce(processed, 0)),
    batches AS (SELECT session_id, batch_no, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role <> 'user') AS replies,
                min(pos) AS first_pos, max(pos) FILTER (WHERE role = 'user') AS last_user_pos,
                coalesce(bool_or(role <> 'user' AND user_no = done + (batch_no + 1) * 3), false) AS ready FROM cut GROUP BY 1, 2)
"""


@query("memory_batches", f"WITH {DUCK_LOG}, {DUCK_BATCHES} SELECT * FROM batches")
def memory_batches(spark, folder):
    return cv.memory_batches(tool_log(spark, folder), INTERVAL, job_state(spark, folder))


@query(
    "render_conversation",
    f"""
    WITH log AS ({DUCK_MESSAGES}), state AS (SELECT NULL::BIGINT AS session_id, 0 AS processed WHERE false),
    {DUCK_BATCHES.replace(DUCK_STATE + ',', '')},
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id, batch_no ORDER BY pos) AS i FROM cut WHERE {duck.has_text('content')})
    SELECT session_id, batch_no, string_agg('[' || i || '] ' || role || ': ' || {duck.strip('content')}, chr(10) ORDER BY i) AS conversation FROM n GROUP BY 1, 2
    """,
)
def render_conversation(spark, folder):
    turns = cv.batch_turns(messages(spark, folder), INTERVAL)
    return cv.render_conversation(turns, "session_id", "batch_no")


SESSION = [
    "conv_id AS session_id",
    "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE conv_id % 10 END AS agent_id",
    "CASE WHEN conv_id % 6 = 0 THEN true WHEN conv_id % 6 < 3 THEN false END AS pinned",
    "conv_id % 37 AS updated_at",
]
DUCK_SESSIONS = f"sessions AS (SELECT DISTINCT {', '.join(SESSION)} FROM conversations)"


def sessions(spark, folder):
    return derived(table(spark, folder, "conversations"), SESSION).distinct()


def named_agents(spark, folder):
    nations = table(spark, folder, "nation")
    return nations.where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("agent_id"), F.col("n_name").alias("name"))


@query("session_list", f"WITH {DUCK_SESSIONS} SELECT session_id, coalesce(pinned, false) AS pinned, updated_at FROM sessions")
def session_list(spark, folder):
    listed = cv.session_list(sessions(spark, folder))
    return listed.select("session_id", F.coalesce("pinned", F.lit(False)).alias("pinned"), "updated_at")


@query(
    "session_groups",
    f"""
    WITH {DUCK_SESSIONS},
    u AS (SELECT session_id, coalesce(agent_id::VARCHAR, 'deleted') AS group_key, coalesce(n_name, '{cv.DELETED_AGENT}') AS label, updated_at
          FROM sessions LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 8) ON n_nationkey = agent_id WHERE NOT coalesce(pinned, false))
    SELECT *, max(updated_at) OVER (PARTITION BY group_key) AS group_updated_at FROM u
    """,
)
def session_groups(spark, folder):
    groups = cv.session_groups(sessions(spark, folder), named_agents(spark, folder))
    return groups.select("session_id", "group_key", "label", "updated_at", "group_updated_at")


@query(
    "touch_sessions",
    f"""
    WITH {DUCK_SESSIONS}, m AS (SELECT conv_id AS session_id, max(turn * 10) AS latest FROM conversations WHERE conv_id % 4 > 0 GROUP BY 1)
    SELECT session_id, greatest(updated_at, coalesce(latest, updated_at)) AS updated_at FROM sessions LEFT JOIN m USING (session_id)
    """,
)
def touch_sessions(spark, folder):
    said = messages(spark, folder).where("session_id % 4 > 0").withColumn("created_at", F.col("pos") * 10)
    return cv.touch_sessions(sessions(spark, folder), said).select("session_id", "updated_at")


@query(
    "append_content",
    """
    WITH d AS (SELECT conv_id AS message_id, string_agg(text, '' ORDER BY turn) AS added FROM conversations WHERE role = 'assistant' GROUP BY 1),
    m AS (SELECT DISTINCT conv_id AS message_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'start ' END AS content FROM conversations)
    SELECT message_id, md5(CASE WHEN added IS NULL THEN content ELSE coalesce(content, '') || added END) AS content_md5 FROM m LEFT JOIN d USING (message_id)
    """,
)
def append_content(spark, folder):
    rows = table(spark, folder, "conversations")
    deltas = rows.where("role = 'assistant'").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"))
    base = rows.select(F.col("conv_id").alias("message_id"), F.when(F.col("conv_id") % 3 > 0, "start ").alias("content")).distinct()
    return cv.append_content(base, deltas).select("message_id", F.md5("content").alias("content_md5"))


REPLY = [
    "page_id % 40 AS run_id",
    "page_id AS pos",
    "CASE page_id % 4 WHEN 0 THEN 'WebSearch' WHEN 1 THEN 'brave_tool' WHEN 2 THEN 'calculator' END AS tool_name",
    f"{WEB_TEXT} || ' https://docs.' || CAST(page_id % 5 AS STRING) || '.net/a; http:///x' AS content",
]


@query(
    "web_citations",
    f"""
    WITH r AS ({duck_select(REPLY, 'pages')}),
    s AS (SELECT run_id, pos, regexp_extract_all(content, {duck.text(fixed.WEB_URL_PATTERN)}) AS l FROM r WHERE contains(lower(tool_name), 'search') OR contains(lower(tool_name), 'brave')),
    u AS (SELECT run_id, pos, i, regexp_replace(x, '[.,;:]+$', '') AS url FROM (SELECT run_id, pos, unnest(l) AS x, unnest(range(len(l))) AS i FROM s)),
    d AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www[.]', '') AS domain FROM u),
    f AS (SELECT run_id, url, domain, min((pos, i)) AS seen FROM d WHERE domain <> '' GROUP BY 1, 2, 3)
    SELECT run_id, url, domain, 'https://www.google.com/s2/favicons?domain=' || domain || '&sz=64' AS favicon_url FROM f
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seen, url) <= 12
    """,
)
def web_citations(spark, folder):
    replies = derived(table(spark, folder, "pages"), REPLY)
    return cv.web_citations(replies).select("run_id", "url", "domain", "favicon_url")


CALL = ["o_custkey AS run_id", "o_orderkey AS position",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'terminate' ELSE o_orderpriority END AS name"]


@query(
    "tool_call_filter",
    f"""
    WITH c AS ({duck_select(CALL, 'orders')}), k AS (SELECT *, name IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS ok FROM c)
    SELECT run_id, bool_and(ok) AS proceed, count(*) FILTER (WHERE ok) AS executable FROM k GROUP BY 1
    """,
)
def tool_call_filter(spark, folder):
    orders = table(spark, folder, "orders")
    tools = orders.where("o_orderpriority < '4'").select(F.col("o_orderpriority").alias("name"))
    _, runs = cv.tool_call_filter(derived(orders, CALL), tools)
    return runs


def _markup(name: str, body: str) -> str:
    return f"'<｜｜DSML｜｜{name}>' || {body} || '</｜｜DSML｜｜{name.split(' ')[0]}>'"


def _written_calls() -> str:
    first = _markup('parameter name="q"', "role") + " || " + _markup('parameter name="n"', "CAST(turn AS STRING)") + " || " + _markup('parameter name="q"', "' last '")
    second = "CAST(turn AS STRING)"
    return "text || " + _markup("tool_calls", _markup('invoke name="search"', first) + " || " + _markup('invoke name="stop"', second))


@query(
    "recover_tool_calls",
    """
    SELECT conv_id AS session_id, turn AS pos, p::INTEGER AS position, CASE p WHEN 0 THEN 'search' ELSE 'stop' END AS name,
           CASE p WHEN 0 THEN '{"n":"' || turn || '","q":"last"}' ELSE '{}' END AS arguments
    FROM conversations, range(2) r(p) WHERE role = 'assistant'
    """,
)
def recover_tool_calls(spark, folder):
    log = table(spark, folder, "conversations").selectExpr(
        "conv_id AS session_id", "turn AS pos", "role", f"{_written_calls()} AS content", "CAST(NULL AS array<string>) AS call_ids"
    )
    return cv.recover_tool_calls(log)


@query(
    "delete_cascade",
    """
    SELECT conv_id AS session_id, conv_id * 100 + turn AS id, CASE WHEN conv_id % 5 > 0 THEN conv_id * 100 + turn END AS source_message_id FROM conversations
    """,
)
def delete_cascade(spark, folder):
    said = messages(spark, folder).withColumn("message_id", F.col("session_id") * 100 + F.col("pos"))
    memories = said.select("session_id", F.col("message_id").alias("id"), F.col("message_id").alias("source_message_id"))
    ids = sessions(spark, folder).where("session_id % 5 = 0").select("session_id")
    _, _, kept = cv.delete_cascade(ids, sessions(spark, folder), said, memories)
    return kept.select("session_id", "id", "source_message_id")


@query(
    "partial_update",
    """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'moved' ELSE c_mktsegment END AS segment,
           CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END::DOUBLE AS balance, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE 1 END AS updated_at FROM customer
    """,
)
def partial_update(spark, folder):
    customer = table(spark, folder, "customer")
    rows = customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("updated_at"))
    patch = customer.where("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "moved").alias("segment"), F.lit(-1.0).alias("balance")
    )
    return cv.partial_update(rows, patch, "id", ["segment", "balance"], F.lit(99))
