"""Top-k scans, the clustered search, running values and metrics against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.functions.vector import l2_distance, l2_distance_arrow
from quillstone.operators import inverted_file as iv
from quillstone.operators import metrics as mt
from quillstone.operators import nearest as nn
from quillstone.operators import positions
from quillstone.operators.positions import running


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 8))
    data[::3] = data[0]  # a third of all rows are copies of one
    part = rng.integers(0, 4, size=900)
    chunks = pd.DataFrame({"chunk_id": np.arange(900), "vector": list(data), "part": part})
    asked = rng.normal(size=(25, 8))
    asked[0] = data[0]
    queries = pd.DataFrame({"query_id": np.arange(25), "vector": list(asked), "part": rng.integers(0, 4, size=25)})
    schema = "vector array<double>, part bigint"
    return (
        data, part, asked, queries["part"].to_numpy(),
        spark.createDataFrame(chunks, f"chunk_id bigint, {schema}").repartition(5),
        spark.createDataFrame(queries, f"query_id bigint, {schema}"),
    )


def brute(data, part, asked, asked_part, k, within):
    out = {}
    for q in range(len(asked)):
        gaps = np.round(np.sqrt(((data - asked[q]) ** 2).sum(axis=1)), 9)
        ids = np.flatnonzero(part == asked_part[q]) if within else np.arange(len(data))
        out[q] = sorted((gaps[i], i) for i in ids)[:k]
    return out


def found(df):
    out: dict[int, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.chunk_id))
    return out


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("max_queries", [4096, 7])
def test_knn_is_exact_on_both_ways(vectors, within, max_queries, monkeypatch):
    data, part, asked, asked_part, chunks, queries = vectors
    monkeypatch.setattr(nn, "BLOCK_CHUNKS", 200)
    monkeypatch.setattr(nn, "MAX_QUERIES", 7)
    got = found(nn.knn_topk(chunks, queries, 10, within=within, max_queries=max_queries))
    want = brute(data, part, asked, asked_part, 10, within)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]])


@pytest.mark.parametrize("max_queries", [4096, 3])
def test_lexical_topk_is_exact_on_both_ways(spark, max_queries, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_CHUNKS", 60)
    monkeypatch.setattr(nn, "MAX_QUERIES", 3)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    chunks = [(i, rng.sample(words, rng.randint(0, 12))) for i in range(300)]
    queries = [(f"q{i}", rng.sample(words + ["unseen"], rng.randint(1, 8))) for i in range(10)] + [("none", [])]
    got: dict[str, list] = {}
    out = nn.lexical_topk(
        spark.createDataFrame(chunks, "chunk_id bigint, features array<string>").repartition(4),
        spark.createDataFrame(queries, "query_id string, features array<string>"),
        5,
        max_queries,
    )
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.lexical_score, 9)))
    for q, features in queries:
        scored = sorted((-len(set(features) & set(f)), i) for i, f in chunks if set(features) & set(f))[:5]
        assert got.get(q, []) == [(i, round(-c / len(features), 9)) for c, i in scored]


def test_inverted_file_with_all_lists_is_exact(vectors, monkeypatch, tmp_path):
    data, part, asked, asked_part, chunks, queries = vectors
    index = iv.build_index(chunks, 6, str(tmp_path / "lists"))
    assert index.rows.count() == len(data) and index.rows.select("list_id").distinct().count() <= 6
    monkeypatch.setattr(iv, "CELLS", 500)
    exact = brute(data, part, asked, asked_part, 5, False)
    full = found(iv.search_index(index, queries, 5, probes=6))
    assert all([i for _, i in full[q]] == [i for _, i in exact[q]] for q in exact)


def test_inverted_file_recall_and_plan(spark):
    """Rows around centres, as texts of a few topics have them; every 20th row asks."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 3
    data = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    chunks = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:05d}" for i in range(4000)], "vector": list(data)}), "chunk_id string, vector array<double>")
    queries = chunks.where("cast(substring(chunk_id, 2) as int) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    search = iv.search_index(iv.build_index(chunks, 32), queries, 10, probes=4)
    got = found(search)
    hits = 0
    for i in range(0, 4000, 20):
        gaps = np.round(np.sqrt(((data - data[i]) ** 2).sum(axis=1)), 9)
        best = {f"c{j:05d}" for j in np.lexsort((np.arange(4000), gaps))[:10]}
        hits += len(best & {c for _, c in got[f"c{i:05d}"]})
    assert hits / (10 * 200) >= 0.9
    plan = search._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_by_key_in_blocks(vectors):
    """Blocks of a few rows and queries, keys that only one side has, and vectors that take no part."""
    data, part, asked, asked_part, chunks, queries = vectors
    broken = chunks.sparkSession.createDataFrame(
        [(9001, None, 1), (9002, [1.0, None] + [0.0] * 6, 1), (9003, [float("nan")] * 8, 1), (9004, [], 1), (9005, [0.0] * 8, None), (9006, [0.0] * 8, 77)],
        "chunk_id bigint, vector array<double>, part bigint",
    )
    rows = chunks.unionByName(broken)
    got = found(iv.nearest_by_key(rows, queries, "part", 7, block_rows=50, block_queries=3))
    want = brute(data, part, asked, asked_part, 7, True)
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}
    assert iv.nearest_by_key(rows.where("false"), queries, "part", 7).count() == 0
    assert found(nn.knn_topk(rows, queries, 7, within=True)).keys() == got.keys()


def test_distance_forms_agree(spark):
    df = spark.createDataFrame([([0.1, 2.0, -3.5], [1.0, 0.5, 2.25]), ([1.0], [1.0])], "a array<float>, b array<float>")
    rows = df.select(l2_distance(F.col("a"), F.col("b")).alias("x")).collect()
    first = df.limit(1).select(l2_distance_arrow("a", "b").alias("x")).first().x
    assert rows[0].x == pytest.approx(first) and rows[1].x == 0.0


def test_running_values_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 3)  # blocks of blocks as well
    rng = random.Random(2)
    rows = [(s, p, rng.random() < 0.3, rng.choice([None, None, p])) for s in range(3) for p in range(200 if s == 0 else 20)]
    df = spark.createDataFrame(rows, "s int, p int, flag boolean, v int").repartition(7)
    out = running(df, ["s"], ["p"], F.floor(F.col("p") / 16), sums={"n": F.col("flag").cast("int")}, lasts={"l": F.col("v")})
    got = {(r.s, r.p): (r.n, r.l) for r in out.collect()}
    for s in range(3):
        n, last = 0, None
        for _, p, flag, v in [r for r in rows if r[0] == s]:
            n, last = n + flag, v if v is not None else last
            assert got[(s, p)] == (n, last)


def test_percentiles_auc_and_density(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(size=400), 2)
    hit = rng.random(400) < 0.3
    df = spark.createDataFrame(
        pd.DataFrame({"query_id": 0, "rerank_score": values, "contains_answer": hit}),
        "query_id int, rerank_score double, contains_answer boolean",
    )
    out = {r["class"]: r for r in mt.score_distribution(df).collect()}
    for name, sample in (("positive", values[hit]), ("negative", values[~hit])):
        assert out[name]["count"] == len(sample) and out[name]["mean"] == pytest.approx(sample.mean())
        for p in mt.PERCENTS:
            assert out[name][f"p{p}"] == pytest.approx(np.percentile(sample, p))
    pairs = values[hit][:, None] - values[~hit][None, :]
    auc = mt.score_auc(df, "rerank_score", "contains_answer").first().auc
    assert auc == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
    bins = mt.score_histogram(df, "rerank_score").orderBy("lower").collect()
    edges = np.arange(np.floor(values.min() / 0.5) * 0.5, np.ceil(values.max() / 0.5) * 0.5 + 0.5, 0.5)
    assert [b["count"] for b in bins] == list(np.histogram(values, edges)[0])
    curve = mt.score_kde(df, "rerank_score").orderBy("i").collect()
    h = len(values) ** -0.2 * values.std(ddof=1)
    want = np.exp(-0.5 * ((curve[250].x - values) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi))
    assert len(curve) == 500 and curve[250].density == pytest.approx(want)
    direct = np.exp(-0.5 * ((np.array([[r.x] for r in curve]) - values) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
    assert np.abs(direct - np.array([r.density for r in curve])).max() < 1e-9
    plan = mt.score_kde(df, "rerank_score")._jdf.queryExecution().toString()
    assert "range(" not in plan and "sequence(" not in plan


def test_distributions_of_few_and_crowded_scores(spark):
    """Scores within a millionth of each other, no scores, one score, one class, null scores."""
    shape = "rerank_score double, contains_answer boolean"
    crowded = [(1e6 + i * 1e-7, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(crowded, shape)
    values, hit = np.array([v for v, _ in crowded]), np.array([h for _, h in crowded])
    out = {r["class"]: r for r in mt.score_distribution(df).collect()}
    assert out["positive"].p90 == pytest.approx(np.percentile(values[hit], 90), rel=1e-12) and out["negative"]["count"] == 2000
    pairs = values[hit][:, None] - values[~hit][None, :]
    assert mt.score_auc(df, "rerank_score", "contains_answer").first().auc == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
    one = spark.createDataFrame([(0.5, True), (None, False)], shape)
    assert [(r["class"], r["count"], r.p10, r["mean"]) for r in mt.score_distribution(one).collect()] == [("positive", 1, 0.5, 0.5)]
    assert mt.score_auc(one, "rerank_score", "contains_answer").first().auc is None
    assert {r.density for r in mt.score_kde(one, "rerank_score").collect()} == {None}
    assert mt.score_distribution(one.where("false")).count() == 0 and mt.score_kde(one.where("false"), "rerank_score").count() == 500


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "k string, v double")
    row = mt.exact_percentiles(df, "k", "v", [10, 50]).first()
    assert (row.p10, row.p50) == (pytest.approx(1.3), pytest.approx(2.5))


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (2.0,)], "v double")
    out = [(r.lower, r["count"]) for r in mt.score_histogram(df, "v").orderBy("lower").collect()]
    assert out == [(0.0, 2), (0.5, 0), (1.0, 0), (1.5, 1)]


def test_metrics_count_questions_without_hits(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame(
        [(1, 1, True, False), (1, 2, True, False), (2, 1, False, False), (2, 2, True, False), (3, 1, True, True)],
        "query_id int, rank int, contains_answer boolean, filtered boolean",
    )
    m = mt.retrieval_metrics(questions, hits, 3).first()
    assert (m.question_count, m.hit_rate_at_1, m.recall_at_k) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert (m.precision_at_k, m.mrr, m.mean_selected_count) == (pytest.approx(1 / 3), pytest.approx(0.5), pytest.approx(4 / 3))


def test_labelled_pairs_need_all_candidates(spark):
    questions = spark.createDataFrame([("a", "c1")], "query_id string, relevant_chunk_id string")
    rows = spark.createDataFrame([("a", "c1", 1.0), ("a", "c2", 0.5)], "query_id string, chunk_id string, score double")
    assert mt.labelled_pairs(questions, rows, 2).where("positive").count() == 1
    with pytest.raises(Exception, match="expected 20"):
        mt.labelled_pairs(questions, rows).collect()


def test_rows_at_one_distance_come_in_pieces(monkeypatch):
    """Equal vectors are all within the bound: no more than PAIRS of them are taken at once, and the lowest ids stay."""
    monkeypatch.setattr(nn, "PAIRS", 64)
    monkeypatch.setattr(nn, "CELLS", 1000)
    rows = pa.array([[1.0, 0.0]] * 600, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600, 0, -1)), rows], names=["chunk_id", "vector"])
    score, best = nn.vector_scorer(np.array([[0.0, 0.0], [1.0, 0.0]] * 5), None, 3), nn.Best(10, 3)
    sizes = []
    for query, row, cost in score(batch, best.bound):
        sizes.append(len(query))
        best.add(query, cost, batch.column("chunk_id").to_numpy()[row])
    assert 0 < max(sizes) <= 64
    assert best.chunk.tolist() == [1, 2, 3] * 10 and best.cost.tolist() == [1.0] * 3 + [0.0] * 3 + ([1.0] * 3 + [0.0] * 3) * 4


def test_technical_filter_takes_each_line_once(spark):
    from quillstone import fixed_values as fixed
    from quillstone.operators import evalset as ev

    texts = [
        "import a\nimport b\n\n| a | b |\n|--|--|\n| c | d |\n\n  \n\nplain text " + "w" * 80,
        " import a\n  def f\n\n" + "# x\n" * 30, "word " * 40, "import " * 30, "short", "\n\n" + " " * 90, "", None,
        "a | b\n" * 20, "a || b\n| c | d |\n|e|\n\n" * 9, "```\n~~~\n\nfrom x\n@tool\n\n" * 6, "漢字" * 50 + "\n\nimport",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")

    def blocks(text):
        for block in filter(lambda b: b.strip(), re.split(r"\n{2,}", text)):
            lines = re.sub(r"\n\Z", "", block).split("\n")
            code = sum(x.strip().startswith(tuple(fixed.BLOCK_CODE_STARTS)) for x in lines)
            yield code >= max(2, len(lines) // 2), sum(x.count("|") >= 2 for x in lines) >= max(3, len(lines) // 2)

    for han in (0, 25):
        asked = df.select("i", ev.technical_chunk_filter(F.col("content"), min_han=han).alias("technical"))
        for r in asked.collect():
            text = texts[r.i]
            if text is None:
                assert r.technical is None
                continue
            kinds = list(blocks(text))
            share = max((sum(k) / len(kinds) for k in zip(*kinds)), default=1)
            few = len(re.findall("[一-鿿]", text)) < han
            assert r.technical == (len(text) < 80 or few or share >= 0.55), r.i
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("trim(") <= 2 and plan.count("split(") <= 2
