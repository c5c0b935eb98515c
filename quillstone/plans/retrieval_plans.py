"""Queries for embedding, search, reranking, policy and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.vector import l2_distance, l2_distance_arrow, mean_vector, vector_score
from quillstone.operators import embedding as em
from quillstone.operators import inverted_file as iv
from quillstone.operators import metrics as mt
from quillstone.operators import nearest as nn
from quillstone.operators import retrieval as rt
from quillstone.plans import corpus as cp
from quillstone.plans import duck
from quillstone.plans.registry import query
from quillstone.sources.tables import table, texts

DUCK_MEANS = """
    means AS (SELECT label AS query_id, list(m ORDER BY i) AS vector FROM (
                SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)
"""


def base_vectors(spark, folder):
    """Chunk vectors (label = knowledge base) and one query per base, the mean of its vectors."""
    rows = table(spark, folder, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("part"))
    means = rows.groupBy(F.col("label").cast("long").alias("query_id")).agg(mean_vector(F.col("embedding"), 64).alias("vector"))
    return chunks, means.withColumn("part", F.col("query_id"))


DUCK_GAP = cp.duck_distance("list_transform(e.embedding, lambda x: x::DOUBLE)", "m.vector")
DUCK_RAW_GAP = cp.duck_distance("list_transform(e.embedding, lambda x: x::DOUBLE)", "m.vector", rounded=False)


@query(
    "l2_distance",
    f"WITH {DUCK_MEANS} SELECT vec_id, round({DUCK_RAW_GAP}, 6) AS distance FROM embeddings e JOIN means m ON m.query_id = e.label",
)
def l2(spark, folder):
    chunks, queries = base_vectors(spark, folder)
    joined = chunks.join(queries.withColumnRenamed("vector", "centre"), "part")
    return joined.select(F.col("chunk_id").alias("vec_id"), F.round(l2_distance(F.col("vector"), F.col("centre")), 6).alias("distance"))


@query(
    "vector_score",
    f"WITH {DUCK_MEANS} SELECT vec_id, round(1 / (1 + {DUCK_RAW_GAP}), 6) AS score FROM embeddings e JOIN means m ON m.query_id = e.label",
)
def vector_score_query(spark, folder):
    chunks, queries = base_vectors(spark, folder)
    joined = chunks.join(queries.withColumnRenamed("vector", "centre"), "part")
    gap = l2_distance_arrow(F.col("vector"), F.col("centre"))
    return joined.select(F.col("chunk_id").alias("vec_id"), F.round(vector_score(gap), 6).alias("score"))


def _duck_knn(k: int, within: bool) -> str:
    join = "JOIN means m ON m.query_id = e.label" if within else "CROSS JOIN means m"
    return f"""
    {DUCK_MEANS},
    gaps AS (SELECT query_id::BIGINT AS query_id, vec_id AS chunk_id, {DUCK_GAP} AS distance FROM embeddings e {join}),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INTEGER AS rank
             FROM gaps QUALIFY rank <= {k})
    """


@query(
    "knn_topk",
    f"""
    WITH {_duck_knn(20, True)}
    SELECT query_id, chunk_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, rank, source AS title
    FROM best LEFT JOIN documents ON doc_id = chunk_id
    """,
)
def knn_topk(spark, folder):
    chunks, queries = base_vectors(spark, folder)
    found = nn.knn_topk(chunks, queries, fixed.RAW_TOP_K, within=True)
    titles = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"))
    return found.join(titles, "chunk_id", "left").select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank", "title"
    )


@query(
    "retrieve_vector",
    f"WITH {_duck_knn(3, False)} SELECT query_id, chunk_id, rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS rerank_score FROM best",
)
def retrieve_vector(spark, folder):
    chunks, queries = base_vectors(spark, folder)
    found = nn.knn_topk(chunks, queries, fixed.FINAL_TOP_K)
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("rerank_score"))


@query(
    "mean_top1_distance",
    f"WITH {_duck_knn(1, False)} SELECT round(avg(distance), 6) AS mean_top1_distance FROM best",
)
def mean_top1_distance(spark, folder):
    chunks, queries = base_vectors(spark, folder)
    out = mt.mean_top1_distance(nn.knn_topk(chunks, queries, 1))
    return out.select(F.round("mean_top1_distance", 6).alias("mean_top1_distance"))


LISTS = 16


@query(
    "ann_ivf",
    f"WITH {_duck_knn(3, False)} SELECT query_id, chunk_id, rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM best",
)
def ann_ivf(spark, folder):
    """All lists are probed, so that the result can be checked; fewer probes are measured by recall in the tests."""
    chunks, queries = base_vectors(spark, folder)
    found = iv.search_index(iv.build_index(chunks, LISTS), queries, fixed.FINAL_TOP_K, probes=LISTS)
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(
    "embed_with_cache",
    f"""
    WITH t AS (SELECT DISTINCT content FROM (SELECT text AS content FROM documents)),
    v AS ({cp.duck_unit('t', 'content', 'content')})
    SELECT sha256('hashed-features' || chr(0) || content) AS key,
           round(list_sum(list_transform(list_zip(vector, range(64)), lambda z: z[1] * (z[2] + 1))), 6) AS check_sum FROM v
    """,
)
def embed_with_cache(spark, folder):
    wanted = texts(spark, folder, "documents").select("text")
    # One language is embedded beforehand and stands for the cache of an earlier run.
    earlier = texts(spark, folder, "documents").where("lang = 'de'").select("text")
    out = em.embed_with_cache(wanted, em.embed_with_cache(earlier))
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("key", F.round(weighted, 6).alias("check_sum"))


def _duck_log_odds(q: str, t: str) -> str:
    return f"ln((len(list_intersect({q}, {t})) + 0.5) / (len({q}) - len(list_intersect({q}, {t})) + 0.5))"


DUCK_CROSS = f"""
    {cp.DUCK_CANDIDATES},
    qf AS (SELECT query_id, {duck.features('query')} AS q FROM questions),
    scored AS (SELECT c.*, {_duck_log_odds('q', 't')} AS rerank_score
               FROM (SELECT *, {duck.features('content')} AS t FROM candidates) c JOIN qf USING (query_id)),
    crossed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, raw_rank)::INTEGER AS rerank FROM scored)
"""


@query(
    "score_pairs_with_cache",
    f"""
    WITH {DUCK_CROSS}
    SELECT DISTINCT sha256('lexical-overlap' || chr(0) || query || chr(0) || chunk_id || chr(0) || content) AS key,
           round(rerank_score, 6) AS pair_score FROM crossed
    """,
)
def score_pairs_with_cache(spark, folder):
    rows = cp.candidates(spark, folder)
    pairs = rows.select("query", F.col("chunk_id").cast("string").alias("chunk_id"), "content")
    return em.score_pairs_with_cache(pairs).select("key", F.round("pair_score", 6).alias("pair_score"))


@query(
    "align_scores",
    """
    SELECT conv_id AS query_id, turn AS position, CASE WHEN turn = 0 OR length(text) % 3 > 0 THEN length(text)::DOUBLE ELSE -1e9 END AS score
    FROM conversations
    """,
)
def align_scores(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text")
    answered = turns.where((F.col("position") == 0) | (F.length("text") % 3 > 0))
    results = answered.select("query_id", F.col("position").alias("index"), F.length("text").cast("double").alias("score"))
    out = em.align_scores(turns.drop("text"), results)
    # The SQL check cannot hold minus infinity in a rounded column.
    return out.withColumn("score", F.when(F.col("score") == float("-inf"), -1e9).otherwise(F.col("score")))


DUCK_HYBRID = f"""
    {cp.DUCK_CANDIDATES},
    hf AS (SELECT query_id, {duck.features('query', duck.SCRIPTS)} AS q FROM questions),
    lexed AS (SELECT c.*, {duck.overlap('q', 't')} AS lexical_score
              FROM (SELECT *, {duck.features("document_title || chr(10) || metadata || chr(10) || content", duck.SCRIPTS)} AS t FROM candidates) c
              JOIN hf USING (query_id)),
    weighed AS (SELECT *, 0.7::DOUBLE * score + 0.3::DOUBLE * lexical_score AS rerank_score FROM lexed),
    hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, raw_rank)::INTEGER AS rerank FROM weighed)
"""


@query(
    "hybrid_rerank",
    f"WITH {DUCK_HYBRID} SELECT query_id, chunk_id, raw_rank::INTEGER AS raw_rank, rerank, round(lexical_score, 6) AS lexical_score, round(rerank_score, 6) AS rerank_score FROM hybrid",
)
def hybrid_rerank(spark, folder):
    ranked = rt.hybrid_rerank(cp.candidates(spark, folder))
    return ranked.select(
        "query_id", "chunk_id", "raw_rank", "rerank",
        F.round("lexical_score", 6).alias("lexical_score"), F.round("rerank_score", 6).alias("rerank_score"),
    )


@query(
    "cross_rerank",
    f"WITH {DUCK_CROSS} SELECT query_id, chunk_id, raw_rank::INTEGER AS raw_rank, rerank, round(rerank_score, 6) AS rerank_score FROM crossed",
)
def cross_rerank(spark, folder):
    ranked = rt.cross_rerank(cp.candidates(spark, folder))
    return ranked.select("query_id", "chunk_id", "raw_rank", "rerank", F.round("rerank_score", 6).alias("rerank_score"))


def duck_policy(ranked: str, top_k: int, max_distance: float | None, min_rerank: float | None, cap: int) -> str:
    far = "false" if max_distance is None else f"r.distance > {max_distance}"
    below = "false" if min_rerank is None else f"coalesce(r.rerank_score < {min_rerank}, true)"
    reason = f"""CASE WHEN NOT {duck.has_text('r.content')} THEN 'empty_content'
         WHEN {below} THEN 'rerank_score_lt_min' WHEN {far} THEN 'distance_gt_max'
         WHEN list_contains(f.bodies, r.body) THEN 'duplicate_content'
         WHEN len(list_filter(f.docs, lambda d: d = r.document_id)) >= {cap} THEN 'too_many_chunks_from_same_document'
         WHEN len(f.bodies) >= {top_k} THEN 'exceeds_final_top_k' END"""
    body = "trim(" + duck.sub("content", r"[ \t\n\x0B\f\r]+", " ") + ")"
    return f"""
    rows_in AS (SELECT query_id, rerank, chunk_id, document_id, distance, rerank_score, content, {body} AS body FROM {ranked}),
    fold AS (SELECT DISTINCT query_id, 0 AS rerank, NULL::BIGINT AS chunk_id, []::VARCHAR[] AS bodies, []::BIGINT[] AS docs, NULL::VARCHAR AS reason FROM rows_in
      UNION ALL
      SELECT query_id, rerank, chunk_id, CASE WHEN reason IS NULL THEN list_append(bodies, body) ELSE bodies END,
             CASE WHEN reason IS NULL THEN list_append(docs, document_id) ELSE docs END, reason
      FROM (SELECT r.query_id, r.rerank, r.chunk_id, f.bodies, f.docs, r.body, r.document_id, {reason} AS reason
            FROM fold f JOIN rows_in r ON r.query_id = f.query_id AND r.rerank = f.rerank + 1)),
    decided AS (SELECT query_id, rerank, chunk_id, reason IS NOT NULL AS filtered, reason AS filter_reason,
                       CASE WHEN reason IS NULL THEN len(bodies)::INTEGER END AS rank FROM fold WHERE rerank > 0)
    """


POLICY = {"final_top_k": 3, "max_distance": 0.95, "min_rerank_score": 0.5, "max_chunks_per_document": 1}


POLICY_SHOWN = {n: POLICY[n] for n in ("final_top_k", "max_distance", "min_rerank_score")}


def hybrid_decided(spark, folder):
    return rt.retrieval_policy(rt.hybrid_rerank(cp.candidates(spark, folder)), **POLICY)


DUCK_DECIDED = f"{DUCK_HYBRID}, {duck_policy('hybrid', 3, 0.95, 0.5, 1)}"


@query(
    "retrieval_policy",
    f"WITH RECURSIVE {DUCK_DECIDED} SELECT query_id, rerank::INTEGER AS rerank, chunk_id, filtered, filter_reason, rank FROM decided",
)
def retrieval_policy(spark, folder):
    return hybrid_decided(spark, folder).select("query_id", "rerank", "chunk_id", "filtered", "filter_reason", "rank")


@query(
    "policy_simple",
    f"""
    WITH {DUCK_HYBRID}
    SELECT query_id, chunk_id, rerank > 2 AS filtered, CASE WHEN rerank > 2 THEN 'too_many_chunks_from_same_document' END AS filter_reason,
           CASE WHEN rerank <= 2 THEN rerank END AS rank FROM hybrid
    """,
)
def policy_simple(spark, folder):
    ranked = rt.hybrid_rerank(cp.candidates(spark, folder))
    return rt.policy_simple(ranked, 3, 2).select("query_id", "chunk_id", "filtered", "filter_reason", "rank")


@query(
    "selected_results",
    f"WITH RECURSIVE {DUCK_DECIDED} SELECT query_id, chunk_id, rank FROM decided WHERE NOT filtered AND rank <= 2",
)
def selected_results(spark, folder):
    return rt.selected_results(hybrid_decided(spark, folder), 2).select("query_id", "chunk_id", "rank")


@query(
    "retrieval_log",
    f"""
    WITH RECURSIVE {DUCK_DECIDED}
    SELECT query_id, md5(query) AS query_md5, 20 AS raw_top_k, 3 AS final_top_k, 0.95::DOUBLE AS max_distance, 0.5::DOUBLE AS min_rerank_score,
           'lexical-overlap' AS rerank_model, d.rerank::INTEGER AS rerank, chunk_id, document_id, round(distance, 6) AS distance, round(score, 6) AS score,
           round(lexical_score, 6) AS lexical_score, round(rerank_score, 6) AS rerank_score, filtered, filter_reason
    FROM decided d JOIN (SELECT * EXCLUDE (rerank, raw_rank) FROM hybrid) USING (query_id, chunk_id)
    """,
)
def retrieval_log(spark, folder):
    log = rt.retrieval_log(hybrid_decided(spark, folder), **POLICY_SHOWN)
    scores = {n: F.round(n, 6) for n in ("distance", "score", "lexical_score", "rerank_score")}
    return log.withColumns(scores).withColumn("query_md5", F.md5("query")).drop("query")


@query(
    "retrieval_outcomes",
    f"""
    WITH RECURSIVE {DUCK_DECIDED}
    SELECT coalesce(filter_reason, 'selected') AS outcome, count(*) AS candidates, count(DISTINCT query_id) AS queries,
           round(min(rerank_score), 6) AS min_rerank_score, round(max(rerank_score), 6) AS max_rerank_score
    FROM decided JOIN (SELECT query_id, chunk_id, rerank_score FROM hybrid) USING (query_id, chunk_id) GROUP BY 1
    """,
)
def retrieval_outcomes(spark, folder):
    counts = rt.outcome_counts(rt.retrieval_log(hybrid_decided(spark, folder)))
    return counts.withColumn("min_rerank_score", F.round("min_rerank_score", 6)).withColumn("max_rerank_score", F.round("max_rerank_score", 6))


def _duck_render() -> str:
    none_head, none_tail = fixed.NO_EVIDENCE_TEXT.split("%s")
    some_head, some_tail = fixed.CONTEXT_HEAD.split("%s")
    nl = "\n"
    t = duck.text
    block = duck.strip(
        f"'[' || rank || '] 文档：' || document_title || {t(nl + 'documentId：')} || document_id || {t(nl + 'chunkId：')} || chunk_id || "
        f"{t(nl + 'distance：')} || printf('%.4f', distance) || {t(nl + 'score：')} || printf('%.4f', score) || "
        f"{t(nl + 'rerankScore：')} || printf('%.4f', rerank_score) || {t(nl + '内容：' + nl)} || content"
    )
    return f"""
    blocks AS (SELECT query_id, string_agg({block}, chr(10) || chr(10) ORDER BY rank) AS body
               FROM decided JOIN (SELECT query_id, chunk_id, document_id, document_title, distance, score, rerank_score, content FROM hybrid)
               USING (query_id, chunk_id) WHERE NOT filtered GROUP BY query_id),
    contexts AS (SELECT q.query_id, CASE WHEN body IS NULL THEN {t(none_head)} || query || {t(none_tail)}
                 ELSE {t(some_head)} || query || {t(some_tail)} || body || {t(fixed.CONTEXT_RULES)} END AS context
                 FROM questions q LEFT JOIN blocks USING (query_id))
    """


@query(
    "render_context",
    f"WITH RECURSIVE {DUCK_DECIDED}, {_duck_render()} SELECT query_id, md5(context) AS context_md5, length(context)::INTEGER AS size FROM contexts",
)
def render_context(spark, folder):
    contexts = rt.render_context(hybrid_decided(spark, folder), cp.questions(spark, folder))
    return contexts.select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("size"))


@query(
    "parse_context",
    f"""
    WITH RECURSIVE {DUCK_DECIDED}
    SELECT query_id, rank, chunk_id::VARCHAR AS chunk_id, printf('%.4f', distance)::DOUBLE AS distance, md5({duck.strip('content')}) AS content_md5
    FROM decided JOIN (SELECT query_id, chunk_id, distance, content FROM hybrid) USING (query_id, chunk_id) WHERE NOT filtered
    """,
)
def parse_context(spark, folder):
    contexts = rt.render_context(hybrid_decided(spark, folder), cp.questions(spark, folder))
    return rt.parse_context(contexts).select("query_id", "rank", "chunk_id", "distance", F.md5("content").alias("content_md5"))


# Orders as search requests: the customer is the agent, and an agent may use the bases of two order priorities.
KB = "CASE WHEN {k} % 10 = 0 THEN ' ' WHEN {k} % 10 = 1 THEN 'kb-' || CAST({k} AS STRING) ELSE '11111111-2222-3333-4444-00000000000' || CAST({k} % 5 AS STRING) END"
REQUEST = ["o_orderkey AS request_id", "o_custkey % 100 AS agent_id", KB.format(k="o_orderkey") + " AS kb_id",
           "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS query"]


@query(
    "scope_filter",
    f"""
    WITH r AS (SELECT {', '.join(REQUEST)} FROM orders),
    g AS (SELECT DISTINCT o_custkey % 100 AS agent_id, '11111111-2222-3333-4444-00000000000' || (o_custkey % 100 % 5) AS kb_id FROM orders)
    SELECT request_id, CASE WHEN trim(r.kb_id) = '' THEN 'blank_kb_id' WHEN r.kb_id LIKE 'kb-%' THEN 'not_a_uuid'
             WHEN g.kb_id IS NULL THEN 'not_allowed' WHEN trim(query) = '' THEN 'blank_query' END AS reject_reason
    FROM r LEFT JOIN g ON g.agent_id = r.agent_id AND g.kb_id = r.kb_id
    """,
)
def scope_filter(spark, folder):
    orders = table(spark, folder, "orders")
    agent = F.col("o_custkey") % 100
    base = F.concat(F.lit("11111111-2222-3333-4444-00000000000"), (agent % 5).cast("string"))
    agents = orders.select(agent.alias("agent_id"), F.array(base).alias("allowed_kbs")).distinct()
    return rt.scope_filter(orders.selectExpr(*REQUEST), agents).select("request_id", "reject_reason")
