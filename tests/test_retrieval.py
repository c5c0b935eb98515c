"""Reranking, policy, context and access scope on literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import lcs_substring_len, lexical_score, shares_long_substring
from quillstone.operators import metrics as mt
from quillstone.operators import retrieval as rt
from quillstone.operators.embedding import align_scores, embed_with_cache
from quillstone.operators.overlap import passage_overlaps

CANDIDATE = (
    "query_id string, query string, raw_rank int, chunk_id string, document_id string, document_title string, "
    "content string, metadata string, distance double, score double"
)


def ranked(spark, rows):
    schema = "query_id string, rerank int, chunk_id string, document_id string, content string, distance double, rerank_score double"
    return spark.createDataFrame([("q", i + 1, *r) for i, r in enumerate(rows)], schema)


def decided(df):
    rows = {r.chunk_id: r for r in df.collect()}
    return {k: (r.rank if not r.filtered else r.filter_reason) for k, r in rows.items()}


def test_policy_reasons(spark):
    """One row per rule, three places, one chunk per document; blanks and case of the content do not count."""
    rows = [
        ("void", "m1", " \n ", 0.01, 9.0),
        ("kiln", "m2", "fire the kiln slowly", 0.31, 4.0),
        ("kiln-again", "m2", "cool it overnight", 0.32, 4.0),
        ("far", "m3", "unrelated harbour news", 0.71, 4.0),
        ("weak", "m4", "glaze recipes", 0.33, 2.4),
        ("copy", "m5", "fire  the\nkiln slowly", 0.34, 4.0),
        ("wheel", "m6", "centre the clay", 0.70, 2.5),
        ("slip", "m7", "thin the slip", 0.36, 4.0),
        ("late", "m8", "trim the foot", 0.37, 4.0),
    ]
    assert decided(rt.retrieval_policy(ranked(spark, rows), 3, 0.7, 2.5, 1)) == {
        "void": "empty_content",
        "kiln": 1,
        "kiln-again": "too_many_chunks_from_same_document",
        "far": "distance_gt_max",
        "weak": "rerank_score_lt_min",
        "copy": "duplicate_content",
        "wheel": 2,
        "slip": 3,
        "late": "exceeds_final_top_k",
    }


def test_policy_rejected_rows_do_not_mark_content(spark):
    rows = [("a", "d1", "X", 0.1, 2.0), ("b", "d1", "Y", 0.1, 2.0), ("c", "d2", "Y", 0.1, 2.0)]
    out = decided(rt.retrieval_policy(ranked(spark, rows), 3, None, 1.0, 1))
    assert out == {"a": 1, "b": "too_many_chunks_from_same_document", "c": 2}


def test_policy_null_scores_and_documents(spark):
    rows = [("a", None, "x", None, None), ("b", None, "y", None, 1.0), ("c", None, "z", None, 1.0)]
    assert decided(rt.retrieval_policy(ranked(spark, rows), 3, 0.5, 1.0, 1)) == {"a": "rerank_score_lt_min", "b": 1, "c": 2}
    assert decided(rt.retrieval_policy(ranked(spark, rows), 3, 0.5, None, 1)) == {"a": 1, "b": 2, "c": 3}


def test_hybrid_rerank_prefers_lexical(spark):
    rows = [
        ("q", "tide tables for 北港", 1, "c1", "d", "boats", "how to varnish an oar", None, 0.2, 0.8),
        ("q", "tide tables for 北港", 2, "c2", "d", "boats", "the 北港 office prints tide tables", None, 0.6, 0.6),
        ("blank", " ", 1, "c3", "d", "t", "x", None, 0.1, 0.2),
        ("blank", " ", 2, "c4", "d", "t", "y", None, 0.1, 0.9),
    ]
    out = {r.chunk_id: r for r in rt.hybrid_rerank(spark.createDataFrame(rows, CANDIDATE), 0.2, 0.8).collect()}
    assert (out["c2"].rerank, out["c1"].rerank) == (1, 2)
    assert out["c2"].lexical_score > out["c1"].lexical_score and out["c2"].rerank_score > out["c1"].rerank_score
    assert (out["c3"].rerank, out["c4"].rerank) == (1, 2)


def test_cjk_lexical_score(spark):
    row = spark.range(1).select(
        lexical_score(F.lit("知识库召回质量"), F.lit("RAG 知识库召回质量需要记录 distance 和来源文档"), "scripts").alias("s"),
        lexical_score(F.lit(" "), F.lit("x1 y2")).alias("none"),
    )
    assert row.first() == (1.0, 0.0)


def test_offline_sets(spark):
    # Two relevant of five; the vector order puts one of them second.
    ranked_rows = [(q, f"c{r}", r) for q in range(5) for r in range(1, 6)]
    df = spark.createDataFrame(ranked_rows, "query_id int, chunk_id string, rank int")
    vector = spark.createDataFrame([(q, c) for q in range(5) for c in ("c2", "c4")], "query_id int, chunk_id string")
    hybrid = spark.createDataFrame([(q, c) for q in range(5) for c in ("c1", "c2")], "query_id int, chunk_id string")
    a, b = mt.labelled_metrics(df, vector, 3).first(), mt.labelled_metrics(df, hybrid, 3).first()
    assert (round(a.precision_at_k, 6), a.recall_at_k, a.hit_rate_at_1, a.mrr) == (0.333333, 0.5, 0.0, 0.5)
    assert (round(b.precision_at_k, 6), b.recall_at_k, b.hit_rate_at_1, b.mrr) == (0.666667, 1.0, 1.0, 1.0)


def test_align_scores(spark):
    cands = spark.createDataFrame([("q", 0), ("q", 1)], "query_id string, position int")
    dense = spark.createDataFrame([("q", [0.12, 0.93])], "query_id string, scores array<double>")
    assert {r.position: r.score for r in align_scores(cands, dense).collect()} == {0: 0.12, 1: 0.93}
    part = spark.createDataFrame([("q", 1, 0.5)], "query_id string, index int, score double")
    assert {r.position: r.score for r in align_scores(cands, part).collect()} == {0: float("-inf"), 1: 0.5}
    none = spark.createDataFrame([("z", 1, 0.5)], "query_id string, index int, score double")
    with pytest.raises(Exception, match="no candidate was scored"):
        align_scores(cands, none).collect()


def test_render_and_parse(spark):
    schema = (
        "query_id string, rerank int, chunk_id string, document_id string, document_title string, content string, "
        "distance double, score double, rerank_score double, filtered boolean, rank int"
    )
    rows = [
        ("q1", 1, "chunk-1", "doc-1", "rag.md", "two\nlines", 0.41234, None, 0.812, False, 1),
        ("q1", 2, "chunk-2", "doc-1", " ", "more", 0.5, 0.6, 0.7, False, 2),
        ("q2", 1, "chunk-3", "doc-1", "rag.md", "x", 0.9, 0.1, 0.1, True, None),
    ]
    queries = spark.createDataFrame([("q1", "what?"), ("q2", "who?")], "query_id string, query string")
    texts = rt.render_context(spark.createDataFrame(rows, schema), queries)
    out = {r.query_id: r.context for r in texts.collect()}
    for piece in ("[1] 文档：rag.md", "chunkId：chunk-1", "distance：0.4123", "score：unknown", "rerankScore：0.8120", "请使用片段编号", "[2] 文档：未知文档"):
        assert piece in out["q1"]
    assert "知识库中没有找到与当前问题足够相关的内容" in out["q2"]
    back = sorted(rt.parse_context(texts).collect(), key=lambda r: r.rank)
    assert [(r.rank, r.chunk_id, r.distance, r.score, r.content) for r in back] == [
        (1, "chunk-1", 0.4123, None, "two\nlines"),
        (2, "chunk-2", 0.5, 0.6, "more"),
    ]


def test_scope(spark):
    ok, other = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    requests = spark.createDataFrame(
        [("a", ok, "x"), ("a", other, "x"), ("a", "nope", "x"), ("a", " ", "x"), ("a", ok, " "), ("b", ok, "x")],
        "agent_id string, kb_id string, query string",
    )
    agents = spark.createDataFrame([("a", [ok]), ("b", [])], "agent_id string, allowed_kbs array<string>")
    out = [(r.agent_id, r.kb_id, r.query, r.reject_reason) for r in rt.scope_filter(requests, agents).collect()]
    assert set(out) == {
        ("a", ok, "x", None),
        ("a", other, "x", "not_allowed"),
        ("a", "nope", "x", "not_a_uuid"),
        ("a", " ", "x", "blank_kb_id"),
        ("a", ok, " ", "blank_query"),
        ("b", ok, "x", "not_allowed"),
    }


def test_long_substring_agrees_with_exact_length(spark):
    pairs = [("abcdefghijk", "xxabcdefghijkyy"), ("abcdefghij", "abcdefghij"), ("a b c d e f g h i j k l", "abcdefghijkl"), ("", "abc"), ("知识库召回质量需要记录来源", "召回质量需要记录来源文档")]
    df = spark.createDataFrame(pairs, "l string, r string").select(
        shares_long_substring("l", "r", 10).alias("over"), lcs_substring_len("l", "r").alias("n")
    )
    assert [(r.over, r.n) for r in df.collect()] == [(True, 11), (False, 10), (True, 12), (False, 0), (False, 10)]


def test_embedding_cache_computes_only_missing(spark):
    texts = spark.createDataFrame([("one two",), ("one two",), ("three four",)], "text string")
    cache = embed_with_cache(spark.createDataFrame([("one two",)], "text string"))
    marked = cache.withColumn("embedding", F.array(F.lit(9.0)))
    out = embed_with_cache(texts, marked).collect()
    assert sorted(len(r.embedding) for r in out) == [1, 64]


def test_longest_common_run_agrees_with_a_table(spark):
    rng = random.Random(5)
    words = ["a", "bb", "ab", "ba", "Ω", "😀"]

    def plain(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    pairs = [("", "x"), (None, "x"), (" ", "\u3000"), ("ab" * 700, "ba" * 600)]
    pairs += [(" ".join(rng.choices(words, k=rng.randint(1, 30))), " ".join(rng.choices(words, k=rng.randint(1, 60)))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.n for r in df.select("i", lcs_substring_len("a", "b").alias("n")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == plain("".join((a or "").split()), "".join((b or "").split())), (a, b)


def test_passages_meet_documents(spark):
    run = "one two three four five six seven eight"
    passages = spark.createDataFrame([(1, f"x {run} nine"), (2, "too few words"), (3, None), (4, "")], "passage_id long, text string")
    docs = spark.createDataFrame(
        [(10, f"z {run} nine {run}"), (11, run), (12, run[4:]), (13, None), (14, ""), (15, "w " * 5000 + run)], "doc_id long, text string"
    )
    out = {(r.passage_id, r.doc_id): (r.n_windows, r.longest) for r in passage_overlaps(passages, docs).collect()}
    n = len(run.replace(" ", ""))
    assert out == {(1, 10): (2, n + 4), (1, 11): (1, n), (1, 15): (1, n)}
    assert passage_overlaps(passages.limit(0), docs).count() == 0
