"""Model-scored columns behind a content-keyed cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import lexical_features, pair_key, text_key
from quillstone.functions.vector import hashed_embedding

# Batches in, batches out; a model is loaded inside, once per task.
Embedder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
DIM = 64
# Texts whose features are Python objects at a time; an Arrow batch has up to 10 000.
FEATURE_ROWS = 512


def embed_features(df: DataFrame, keys: list[str], features: Column, dim: int = DIM) -> DataFrame:
    """Default embedder: hashed lexical features, unit length. Adds ``embedding`` to the key columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of: dict[str, int] = {}
        for batch in (b.slice(at, FEATURE_ROWS) for b in batches for at in range(0, b.num_rows, FEATURE_ROWS)):
            vectors = hashed_embedding(batch.column("_features").to_pylist(), dim, slots_of)
            flat = pa.array(vectors.reshape(-1))
            offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
            columns = [batch.column(k) for k in keys] + [pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "embedding"])

    source = df.select(*keys, features.alias("_features"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{schema}, embedding array<double>")


def _missing(wanted: DataFrame, cache: DataFrame | None) -> DataFrame:
    once = wanted.dropDuplicates(["key"])
    return once if cache is None else once.join(cache.select("key"), "key", "left_anti")


def embed_with_cache(
    texts: DataFrame,
    cache: DataFrame | None = None,
    model: str = "hashed-features",
    embedder: Embedder | None = None,
    dim: int = DIM,
) -> DataFrame:
    """(key, embedding) for every distinct ``text``; texts whose key is in the cache are not computed again."""
    wanted = texts.select(text_key(model, F.col("text")).alias("key"), "text")
    todo = _missing(wanted, cache)
    if embedder is None:
        fresh = embed_features(todo, ["key"], lexical_features("text"), dim)
    else:
        fresh = todo.mapInPandas(embedder, "key string, embedding array<double>")
    if cache is None:
        return fresh
    known = cache.select("key", "embedding").join(wanted.select("key"), "key", "left_semi")
    return known.unionByName(fresh)


def score_pairs_with_cache(
    pairs: DataFrame,
    cache: DataFrame | None = None,
    model: str = "lexical-overlap",
    scorer: Embedder | None = None,
) -> DataFrame:
    """(key, pair_score) for every distinct (query, chunk_id, content).

    The default score is the share of query features in the passage on a log-odds scale, so it can be negative as the
    scores of a cross-encoder are.
    """
    key = pair_key(model, F.col("query"), F.col("chunk_id").cast("string"), F.col("content"))
    wanted = pairs.select(key.alias("key"), "query", "content")
    todo = _missing(wanted, cache)
    if scorer is None:
        fresh = todo.select("key", log_odds_score(F.col("query"), F.col("content")).alias("pair_score"))
    else:
        fresh = todo.mapInPandas(scorer, "key string, pair_score double")
    if cache is None:
        return fresh
    known = cache.select("key", "pair_score").join(wanted.select("key"), "key", "left_semi")
    return known.unionByName(fresh)


def log_odds_score(query: Column, content: Column) -> Column:
    wanted, found = lexical_features(query), lexical_features(content)
    hits = F.size(F.array_intersect(wanted, found))
    return F.log((hits + 0.5) / (F.size(wanted) - hits + 0.5))


def align_scores(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Scores by candidate position.

    ``candidates`` has (query_id, position); ``results`` has (query_id, index, score) for scattered answers or
    (query_id, scores) for dense ones. A dense list must match the candidate count; a candidate without a score gets
    minus infinity, and a query for which nothing was scored is an error.
    """
    if "scores" in results.columns:
        results = results.select("query_id", F.posexplode("scores").alias("index", "score"))
    joined = candidates.join(
        results.withColumnRenamed("index", "position"), ["query_id", "position"], "left"
    )
    scored = joined.groupBy("query_id").agg(F.count("score").alias("_scored"))
    checked = scored.withColumn(
        "_ok", F.when(F.col("_scored") == 0, F.raise_error(F.lit("no candidate was scored"))).otherwise(True)
    )
    return joined.join(checked.where("_ok").select("query_id"), "query_id").withColumn(
        "score", F.coalesce("score", F.lit(float("-inf")))
    )
