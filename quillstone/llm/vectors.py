"""Vectors of an Arrow batch as whole numbers, and the smallest types that hold them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, numbers): the rows whose vector has components, all of them finite, and floor(scale * x) of each.

    Null and empty vectors and those with a null or non-finite component are left out. All vectors have one length;
    another raises. Components are whole numbers of 64 bits; larger ones raise.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    owner = np.repeat(np.arange(len(column)), sizes)
    bad = np.bincount(owner[~np.isfinite(flat)], minlength=len(column)) > 0
    keep = (sizes > 0) & ~bad
    rows = np.flatnonzero(keep)
    if not len(rows):
        return rows, np.empty((0, 0), np.int64)
    if len(np.unique(sizes[rows])) > 1:
        raise ValueError("vectors differ in length")
    numbers = np.floor(scale * flat[keep[owner]])
    if np.abs(numbers).max() >= 2.0**63:
        raise ValueError("a scaled component does not fit 64 bits")
    return rows, numbers.astype(np.int64).reshape(len(rows), -1)


def narrowed(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of the signed types that holds them."""
    most = max(-int(numbers.min(initial=0)) - 1, int(numbers.max(initial=0)))
    for kind in (np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return numbers.astype(kind)
    return numbers.astype(np.int64)


def largest(numbers: np.ndarray) -> int:
    """The largest absolute value."""
    return max(-int(numbers.min(initial=0)), int(numbers.max(initial=0)))


def exact_type(bound: int):
    """A type in which sums of products up to ``bound`` in size are exact, whatever their order."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
