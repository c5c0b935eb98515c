"""From candidates to context: reranking, the retrieval policy, rendering, access scope.

Candidate tables hold one row per (query, chunk): query_id, query, raw_rank, chunk_id, document_id, document_title,
content, metadata, distance, score. A query has at most raw-top-k of them, so per-query windows and folds are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import (
    has_text,
    lexical_score,
    normalize_content,
    pair_key,
    searchable_text,
    strip,
)
from quillstone.operators.embedding import score_pairs_with_cache


def _by_rank(rank: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(rank.desc_nulls_last(), F.col("raw_rank"))


def hybrid_rerank(
    candidates: DataFrame,
    vector_weight: float = fixed.VECTOR_WEIGHT,
    lexical_weight: float = fixed.LEXICAL_WEIGHT,
    text: Column | None = None,
    form: str = "scripts",
) -> DataFrame:
    """Adds lexical_score, rerank_score and the stable ``rerank`` order; a blank query keeps the raw order."""
    text = searchable_text(F.col("document_title"), F.col("metadata"), F.col("content")) if text is None else text
    asked = has_text("query")
    lexical = F.when(asked, lexical_score(F.col("query"), text, form))
    scored = candidates.withColumn("lexical_score", lexical)
    combined = vector_weight * F.coalesce("score", F.lit(0.0)) + lexical_weight * F.col("lexical_score")
    scored = scored.withColumn("rerank_score", combined)
    return scored.withColumn("rerank", F.row_number().over(_by_rank(F.col("rerank_score"))))


def service_passage() -> Column:
    """What the search service gives its reranker: title, metadata and content, one below the other."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("document_title", "metadata", "content")])


def cross_rerank(
    candidates: DataFrame, cache: DataFrame | None = None, model: str = "lexical-overlap", scorer=None, passage: Column | None = None
) -> DataFrame:
    """Orders by model score of ``passage`` (the content if none is given), missing scores last; the lexical score stays null."""
    told = candidates.withColumn("_passage", F.col("content") if passage is None else passage)
    pairs = told.where(has_text("query")).select("query", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("_passage").alias("content"))
    scores = score_pairs_with_cache(pairs, cache, model, scorer)
    key = pair_key(model, F.col("query"), F.col("chunk_id").cast("string"), F.col("_passage"))
    joined = told.withColumn("key", key).join(scores, "key", "left").drop("key", "_passage")
    joined = joined.withColumn("lexical_score", F.lit(None).cast("double")).withColumnRenamed("pair_score", "rerank_score")
    order = F.coalesce("rerank_score", F.lit(float("-inf")))
    return joined.withColumn("rerank", F.row_number().over(_by_rank(order)))


def vector_rank(candidates: DataFrame) -> DataFrame:
    """Keeps the order of the distance; the vector score stands in as rerank score."""
    return (
        candidates.withColumn("lexical_score", F.lit(None).cast("double"))
        .withColumn("rerank_score", F.col("score"))
        .withColumn("rerank", F.col("raw_rank"))
    )


def retrieval_policy(
    ranked: DataFrame,
    final_top_k: int = fixed.FINAL_TOP_K,
    max_distance: float | None = None,
    min_rerank_score: float | None = fixed.MIN_RERANK_SCORE,
    max_chunks_per_document: int = fixed.MAX_CHUNKS_PER_DOCUMENT,
) -> DataFrame:
    """Adds filtered, filter_reason and rank to every candidate.

    Whether a row is accepted depends on the rows accepted before it, so each query's candidates (raw-top-k at most)
    are folded in rank order inside one expression.
    """
    below = F.lit(False)
    if min_rerank_score is not None:
        below = F.coalesce(F.col("rerank_score") < min_rerank_score, F.lit(True))
    far = F.lit(False)
    if max_distance is not None:
        far = F.coalesce(F.col("distance") > max_distance, F.lit(False))
    own_reason = (
        F.when(~has_text("content"), "empty_content")
        .when(below, "rerank_score_lt_min")
        .when(far, "distance_gt_max")
    )
    marked = ranked.select(
        "*", own_reason.alias("_reason"), normalize_content("content").alias("_body")
    )
    kept = [c for c in ranked.columns if c not in ("query_id", "rerank")]
    row = F.struct("rerank", "_reason", "_body", *kept)
    grouped = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    document = ranked.schema["document_id"].dataType.simpleString()
    start = F.struct(
        F.array().cast("array<string>").alias("bodies"),
        F.array().cast(f"array<{document}>").alias("documents"),
        F.array().cast("array<string>").alias("reasons"),
        F.array().cast("array<int>").alias("ranks"),
    )

    def step(state: Column, r: Column) -> Column:
        same_document = F.size(F.filter(state["documents"], lambda d: d == r["document_id"]))
        reason = F.coalesce(
            r["_reason"],
            F.when(F.array_contains(state["bodies"], r["_body"]), "duplicate_content"),
            F.when(
                r["document_id"].isNotNull() & (same_document >= max_chunks_per_document),
                "too_many_chunks_from_same_document",
            ),
            F.when(F.size(state["bodies"]) >= final_top_k, "exceeds_final_top_k"),
        )
        accepted = reason.isNull()
        none = F.lit(None).cast("int")
        return F.struct(
            F.when(accepted, F.array_append(state["bodies"], r["_body"])).otherwise(state["bodies"]).alias("bodies"),
            F.when(accepted & r["document_id"].isNotNull(), F.array_append(state["documents"], r["document_id"]))
            .otherwise(state["documents"])
            .alias("documents"),
            F.array_append(state["reasons"], reason).alias("reasons"),
            F.array_append(state["ranks"], F.when(accepted, F.size(state["bodies"]) + 1).otherwise(none)).alias("ranks"),
        )

    folded = grouped.withColumn("_state", F.aggregate("_rows", start, step))
    zipped = F.arrays_zip("_rows", F.col("_state.reasons").alias("reasons"), F.col("_state.ranks").alias("ranks"))
    out = folded.select("query_id", F.explode(zipped).alias("_z"))
    return out.select(
        "query_id",
        F.col("_z._rows.rerank").alias("rerank"),
        *[F.col(f"_z._rows.{c}").alias(c) for c in kept],
        F.col("_z.reasons").isNotNull().alias("filtered"),
        F.col("_z.reasons").alias("filter_reason"),
        F.col("_z.ranks").alias("rank"),
    )


def policy_simple(ranked: DataFrame, final_top_k: int, max_chunks_per_document: int) -> DataFrame:
    """Evaluation form over a single document: first the cap, then top-k."""
    limit = min(final_top_k, max_chunks_per_document)
    kept = F.col("rerank") <= limit
    reason = "too_many_chunks_from_same_document" if max_chunks_per_document <= final_top_k else "exceeds_final_top_k"
    return ranked.select(
        "*",
        (~kept).alias("filtered"),
        F.when(~kept, reason).alias("filter_reason"),
        F.when(kept, F.col("rerank")).alias("rank"),
    )


def selected_results(decided: DataFrame, final_top_k: int = fixed.FINAL_TOP_K) -> DataFrame:
    kept = decided.where(~F.col("filtered"))
    order = Window.partitionBy("query_id").orderBy("rerank")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= final_top_k).drop("_n")


def similarity_search(decided: DataFrame, final_top_k: int = fixed.FINAL_TOP_K) -> DataFrame:
    return selected_results(decided, final_top_k).select("query_id", "rank", "content")


def retrieval_log(decided: DataFrame, raw_top_k: int = fixed.RAW_TOP_K, model: str = "lexical-overlap", **policy) -> DataFrame:
    """One row per candidate with its scores, its outcome and the settings of the search; ``policy`` as it was applied."""
    settings = {
        "raw_top_k": (raw_top_k, "int"),
        "final_top_k": (policy.get("final_top_k", fixed.FINAL_TOP_K), "int"),
        "max_distance": (policy.get("max_distance"), "double"),
        "min_rerank_score": (policy.get("min_rerank_score", fixed.MIN_RERANK_SCORE), "double"),
        "rerank_model": (model, "string"),
    }
    base = ["kb_id"] if "kb_id" in decided.columns else []
    return decided.select(
        "query_id", *base, "query",
        *[F.lit(value).cast(kind).alias(name) for name, (value, kind) in settings.items()],
        "rerank", "chunk_id", "document_id", "distance", "score", "lexical_score", "rerank_score", "filtered", "filter_reason",
    )


def outcome_counts(log: DataFrame) -> DataFrame:
    """Candidates per outcome, with the score range of each."""
    return log.groupBy(F.coalesce("filter_reason", F.lit("selected")).alias("outcome")).agg(
        F.count("*").alias("candidates"),
        F.countDistinct("query_id").alias("queries"),
        F.min("rerank_score").alias("min_rerank_score"),
        F.max("rerank_score").alias("max_rerank_score"),
    )


def _four_places(value: str) -> Column:
    return F.when(F.col(value).isNull(), "unknown").otherwise(F.format_string("%.4f", F.col(value)))


def render_context(decided: DataFrame, queries: DataFrame, final_top_k: int = fixed.FINAL_TOP_K) -> DataFrame:
    """One text per (query_id, query) of ``queries``; the no-evidence text where nothing was selected."""
    title = F.when(has_text("document_title"), F.col("document_title")).otherwise(fixed.UNKNOWN_DOCUMENT)
    chunk = F.when(has_text(F.col("chunk_id").cast("string")), F.col("chunk_id").cast("string")).otherwise("unknown")
    block = strip(
        F.concat(
            F.lit("["), F.col("rank").cast("string"), F.lit("] 文档："), title,
            F.lit("\ndocumentId："), F.coalesce(F.col("document_id").cast("string"), F.lit("null")),
            F.lit("\nchunkId："), chunk,
            F.lit("\ndistance："), _four_places("distance"),
            F.lit("\nscore："), _four_places("score"),
            F.lit("\nrerankScore："), _four_places("rerank_score"),
            F.lit("\n内容：\n"), F.coalesce("content", F.lit("null")),
        )
    )
    blocks = (
        selected_results(decided, final_top_k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block")))).alias("_blocks"))
    )
    joined = queries.select("query_id", "query").join(blocks, "query_id", "left")
    none_head, none_tail = fixed.NO_EVIDENCE_TEXT.split("%s")
    some_head, some_tail = fixed.CONTEXT_HEAD.split("%s")
    body = F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n\n")
    text = F.when(
        F.col("_blocks").isNull(), F.concat(F.lit(none_head), F.col("query"), F.lit(none_tail))
    ).otherwise(
        F.concat(F.lit(some_head), F.col("query"), F.lit(some_tail), body, F.lit(fixed.CONTEXT_RULES))
    )
    return joined.select("query_id", text.alias("context"))


CONTEXT_BLOCK = (
    r"(?s)\[(\d+)\] 文档：([^\n]*)\ndocumentId：([^\n]*)\nchunkId：([^\n]*)\ndistance：([^\n]*)\nscore：([^\n]*)"
    r"\nrerankScore：([^\n]*)\n内容：\n(.*?)(?=\n\n\[\d+\] 文档：|\n\n使用规则：|\z)"
)


def parse_context(contexts: DataFrame, text: str = "context") -> DataFrame:
    """Hit rows from rendered contexts; the inverse of ``render_context``."""
    names = ["rank", "document_title", "document_id", "chunk_id", "distance", "score", "rerank_score", "content"]
    groups = [F.regexp_extract_all(text, F.lit(CONTEXT_BLOCK), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    rows = contexts.select("query_id", F.explode(F.arrays_zip(*groups)).alias("_r"))

    def number(name: str) -> Column:
        return F.col(f"_r.{name}").try_cast("double").alias(name)

    return rows.select(
        "query_id",
        F.col("_r.rank").cast("int").alias("rank"),
        *[F.col(f"_r.{n}").alias(n) for n in ("document_title", "document_id", "chunk_id")],
        *[number(n) for n in ("distance", "score", "rerank_score")],
        F.col("_r.content").alias("content"),
    )


UUID = r"\A[0-9a-fA-F]{1,8}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,4}-[0-9a-fA-F]{1,12}\z"


def scope_filter(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds reject_reason to (agent_id, kb_id, query) requests; null means that the request may run.

    ``agents`` has (agent_id, allowed_kbs array<string>).
    """
    grants = agents.select("agent_id", F.explode("allowed_kbs").alias("kb_id")).distinct().withColumn("_ok", F.lit(True))
    joined = requests.join(grants, ["agent_id", "kb_id"], "left")
    reason = (
        F.when(~has_text("kb_id"), "blank_kb_id")
        .when(~F.rlike("kb_id", F.lit(UUID)), "not_a_uuid")
        .when(F.col("_ok").isNull(), "not_allowed")
        .when(~has_text("query"), "blank_query")
    )
    return joined.withColumn("reject_reason", reason).drop("_ok")
