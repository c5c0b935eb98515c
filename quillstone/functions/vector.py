"""Vector columns: distance, score and the default hashed embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def l2_distance(left: Column, right: Column) -> Column:
    """Euclidean distance as a column expression; squares are taken in double."""
    squares = F.zip_with(left, right, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


@F.pandas_udf(T.DoubleType())
def l2_distance_arrow(left: pd.Series, right: pd.Series) -> pd.Series:
    """The same distance on Arrow batches."""
    if left.empty:
        return pd.Series([], dtype="float64")
    a = np.stack(left.to_numpy()).astype(np.float64)
    b = np.stack(right.to_numpy()).astype(np.float64)
    return pd.Series(np.sqrt(np.square(a - b).sum(axis=1)))


def vector_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def mean_vector(vector: Column, dim: int) -> Column:
    """Element-wise mean, one partial aggregate per element."""
    return F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)])


def hashed_embedding(features: list[list[str]], dim: int, slots_of: dict[str, int]) -> np.ndarray:
    """Unit-length feature counts over hashed slots; one row per feature list, zero when it is empty.

    ``slots_of`` keeps the slots of frequent features between batches.
    """
    out = np.zeros((len(features), dim), dtype=np.float64)
    for row, items in enumerate(features):
        slots = []
        for item in items:
            slot = slots_of.get(item)
            if slot is None:
                slot = int(hashlib.md5(item.encode("utf-8")).hexdigest()[:8], 16) % dim
                if len(slots_of) < 200_000:
                    slots_of[item] = slot
            slots.append(slot)
        if slots:
            np.add.at(out[row], slots, 1.0)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)
