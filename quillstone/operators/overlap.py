"""Passages met in documents: which share a run of words, and how long their longest common run of characters is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import lcs_substring_len, let
from quillstone.session import broadcast_if_small, materialise

WORDS = r"[^\x20\x09-\x0D]+"
# Words of a window that a passage and a document must share to be compared.
WINDOW = 8


def word_windows(text: Column | str, size: int = WINDOW) -> Column:
    """Hashes of the distinct windows of ``size`` words; a text with fewer words has none."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def windows(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found) - size + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, F.lit(size)))))

    return let(words, lambda found: F.when(F.size(found) >= size, windows(found)))


def passage_overlaps(passages: DataFrame, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(passage_id, doc_id, n_windows, longest) of each passage and document that share a window of ``size`` words.

    ``passages``: passage_id, text; ``docs``: doc_id, text; ids are unique and not null. ``longest`` is the length of the
    longest common substring of the whole compacted texts. Null texts and texts of fewer words meet nothing.

    Documents send only the hashes that a passage has: the passages' windows go to all tasks while their number is
    small, which is checked, else both sides are shuffled by hash. Whole texts move for pairs that met.
    """
    asked = materialise(passages.select("passage_id", F.explode(word_windows("text", size)).alias("window")), "windows")
    held = docs.select("doc_id", F.explode(word_windows("text", size)).alias("window"))
    pairs = held.join(broadcast_if_small(asked), "window").groupBy("passage_id", "doc_id").agg(F.count("*").alias("n_windows"))
    pairs = materialise(pairs, "pairs")
    texts = docs.select("doc_id", F.col("text").alias("_doc"))
    both = pairs.join(texts, "doc_id").join(passages.select("passage_id", F.col("text").alias("_passage")), "passage_id")
    return both.select("passage_id", "doc_id", "n_windows", lcs_substring_len("_passage", "_doc").alias("longest"))
