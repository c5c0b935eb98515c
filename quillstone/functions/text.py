"""Text columns: normal forms, match keys, lexical features and small extractors.

All are built-in column expressions. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone import fixed_values as fixed

# Unicode white space as a character class that Java patterns and RE2 both read.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same set as plain characters.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
CJK_RANGES = {
    "ranges": r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}",
    "scripts": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}",
    "han": r"\x{4e00}-\x{9fff}",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(c: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(c), F.lit(f"[^{WS}]")), F.lit(False))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def normalize_text(c: Column | str) -> Column:
    # Single spaces, the bulk of all matches, are left alone.
    spaces = F.regexp_replace(_col(c), r"[ \t\x{3000}]{2,}|[\t\x{3000}]", " ")
    return strip(F.regexp_replace(spaces, r"\n{3,}", "\n\n"))


def compact_text(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"[{WS}]+", "")


def normalize_content(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def remove_code_fences(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)```.*?```|~~~.*?~~~", "")


def strip_url_inline_code(c: Column | str) -> Column:
    without_urls = F.regexp_replace(_col(c), rf"https?://[^{WS}]+", "")
    return F.regexp_replace(without_urls, r"`([^`]+)`", "$1")


def count_cjk(c: Column | str) -> Column:
    runs = F.regexp_extract_all(_col(c), F.lit(rf"([{CJK_RANGES['han']}]+)"), F.lit(1))
    return F.length(F.array_join(runs, ""))


def latin_tokens(c: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits, two characters at least."""
    return F.array_distinct(_latin_runs(c))


def _latin_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z0-9]{2,})"), F.lit(1))


def cjk_ngrams(c: Column | str, form: str = "ranges") -> Column:
    """Single characters and adjacent pairs of the CJK characters, joined across gaps."""
    kept = F.array_join(F.regexp_extract_all(_col(c), F.lit(f"([{CJK_RANGES[form]}]+)"), F.lit(1)), "")
    chars = F.split(kept, "")
    pairs = F.zip_with(
        F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b)
    )
    empty = F.array().cast("array<string>")
    return F.when(F.length(kept) == 0, empty).otherwise(F.array_distinct(F.concat(chars, pairs)))


def lexical_features(c: Column | str, form: str = "ranges") -> Column:
    return F.array_union(_latin_runs(c), cjk_ngrams(c, form))


def feature_overlap(query_features: Column, text_features: Column) -> Column:
    """Share of the query's features that the text has; 0 when the query has none."""
    return F.when(
        F.size(query_features) > 0,
        F.size(F.array_intersect(query_features, text_features)) / F.size(query_features),
    ).otherwise(0.0)


def lexical_score(query: Column | str, text: Column | str, form: str = "ranges") -> Column:
    return feature_overlap(
        lexical_features(F.coalesce(_col(query), F.lit("")), form),
        lexical_features(F.coalesce(_col(text), F.lit("")), form),
    )


def searchable_text(title: Column, metadata: Column, content: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(part, F.lit("")) for part in (title, metadata, content)])


def embedding_text(title: Column, heading_path: Column, content: Column) -> Column:
    heading = F.array_join(F.filter(heading_path, has_text), " > ")
    return strip(F.concat(F.lit("文档："), title, F.lit("\n章节："), heading, F.lit("\n\n"), content))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``; a lambda would evaluate it once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shares_long_substring(left: Column | str, right: Column | str, limit: int) -> Column:
    """True when the compacted texts share a substring longer than ``limit``.

    Any such substring holds a common run of exactly ``limit + 1`` characters, so it is enough to look for the runs of
    the shorter text in the longer one.
    """

    def search(pair: Column) -> Column:
        swap = F.length(pair["a"]) > F.length(pair["b"])
        short = F.when(swap, pair["b"]).otherwise(pair["a"])
        long = F.when(swap, pair["a"]).otherwise(pair["b"])
        return let(F.struct(short.alias("short"), long.alias("long")), runs)

    def runs(texts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(texts["short"]) - limit))
        found = F.exists(starts, lambda i: F.contains(texts["long"], F.substring(texts["short"], i, F.lit(limit + 1))))
        return (F.length(texts["short"]) > limit) & found

    return let(F.struct(compact_text(left).alias("a"), compact_text(right).alias("b")), search)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


def _prefix_sums(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(_BASE, len(codes))[:-1], out=sums[1:])
    return sums


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring, by bisection over hashes of all substrings of one size.

    The hashes of the shorter text are sorted, those of the longer one looked up; what is found is compared as text, so
    equal hashes of different substrings do no harm. Memory grows with both lengths.
    """
    if len(a) > len(b):
        a, b = b, a
    sums = _prefix_sums(a), _prefix_sums(b)
    inverse = _powers(_INVERSE, len(b))

    def shared(size: int) -> bool:
        here, there = ((s[size:] - s[: len(s) - size]) * inverse[: len(s) - size] for s in sums)
        order = np.argsort(here, kind="stable")
        ranked = here[order]
        at = np.searchsorted(ranked, there)
        for j in np.flatnonzero(ranked[np.minimum(at, len(ranked) - 1)] == there).tolist():
            place = int(at[j])
            while place < len(ranked) and ranked[place] == there[j]:
                i = int(order[place])
                if a[i : i + size] == b[j : j + size]:
                    return True
                place += 1
        return False

    low, high = 0, len(a)
    while low < high:
        size = (low + high + 1) // 2
        if shared(size):
            low = size
        else:
            high = size - 1
    return low


@F.pandas_udf(T.IntegerType())
def lcs_substring_len(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common substring of the compacted texts, 0 where one is null or empty."""
    lengths = [longest_common("".join((a or "").split()), "".join((b or "").split())) for a, b in zip(left, right)]
    return pd.Series(lengths, dtype="int32")


def text_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), text), 256)


def pair_key(model: str, query: Column, chunk_id: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(model), query, chunk_id, content), 256)


def chunk_digest(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", *[p.cast("string") for p in parts])), 1, 10)


def strip_json_fence(c: Column | str) -> Column:
    body = strip(c)
    opened = F.regexp_replace(body, r"\A```(?:json)?[ \t\n\x0B\f\r]*", "")
    closed = F.regexp_replace(opened, r"[ \t\n\x0B\f\r]*```\z", "")
    return F.when(F.startswith(body, F.lit("```")), strip(closed)).otherwise(body)


def contains_sensitive(c: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(c), F.lit(fixed.SENSITIVE_PATTERN)), F.lit(False))


def strip_dsml(c: Column | str) -> Column:
    cleaned = F.regexp_replace(_col(c), fixed.DSML_TOOL_CALLS_PATTERN, "")
    return F.when(has_text(c), strip(cleaned)).otherwise(_col(c))


def truncate_json(c: Column | str, limit: int = fixed.TRACE_FIELD_CHARS) -> Column:
    size = max(1000, limit)
    text = _col(c)
    cut = F.to_json(
        F.struct(
            F.substring(text, 1, size).alias("content"),
            F.length(text).alias("originalSize"),
            F.lit(True).alias("truncated"),
        )
    )
    return F.when(F.length(text) > size, cut).otherwise(text)


def truncate_plain(c: Column | str, limit: int = fixed.TRACE_FIELD_CHARS) -> Column:
    return F.substring(_col(c), 1, max(1000, limit))


def extract_urls(c: Column | str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(fixed.WEB_URL_PATTERN), F.lit(0))
    return F.transform(found, lambda url: F.regexp_replace(url, r"[.,;:]+\z", ""))


def url_domain(url: Column | str) -> Column:
    host = F.try_parse_url(_col(url), F.lit("HOST"))
    return F.regexp_replace(host, r"\Awww\.", "")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(word)) for word in words])


def format_vector(c: Column | str) -> Column:
    return F.when(
        _col(c).isNotNull(),
        F.concat(F.lit("["), F.array_join(F.transform(_col(c), lambda x: x.cast("string")), ","), F.lit("]")),
    )


def parse_vector_text(c: Column | str) -> Column:
    """``[a,b,c]`` as an array of float; blank gives an empty array and null stays null."""
    body = F.regexp_replace(strip(c), r"\A\[|\]\z", "")
    empty = F.array().cast("array<float>")
    values = F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("float"))
    return F.when(_col(c).isNull(), F.lit(None)).when(~has_text(body), empty).otherwise(values)
