"""Table functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class ChunkText:
    """Slices of one text by the closed form of ``operators.chunking.slices``."""

    def eval(self, text: str, max_chars: int, overlap_chars: int, min_chars: int) -> Iterator[tuple]:
        if text is None:
            return
        size, step = len(text), max_chars - max(0, min(overlap_chars, max_chars - 1))
        over = size - max(min_chars - 1, 0) - max_chars
        last = 0 if size <= max_chars else max(1, -(-over // step))
        for i in range(last + 1):
            end = size if i == last else i * step + max_chars
            yield i, i * step, end, text[i * step : end].strip()


def register_table_functions(spark: SparkSession) -> None:
    """Makes ``chunk_text(text, max_chars, overlap_chars, min_chars)`` known to SQL."""
    columns = "slice_ix int, char_start int, char_end int, content string"
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=columns))
