"""DuckDB expressions for the check SQL; each mirrors the meaning of a text column function."""

from __future__ import annotations

from quillstone.functions.text import WS

BLANK = f"[{WS}]"
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"^[{WS}]+|[{WS}]+\z")


def normalize(x: str) -> str:
    return strip(sub(sub(x, r"[ \t\x{3000}]+", " "), r"\n{3,}", "\n\n"))


def compact(x: str) -> str:
    return sub(x, f"[{WS}]+")


def latin(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}')"


def ngrams(x: str, chars: str = CJK) -> str:
    kept = sub(f"lower({x})", f"[^{chars}]")
    single = f"list_transform(range(length({kept})), lambda i: substr({kept}, i + 1, 1))"
    pairs = f"list_transform(range(length({kept}) - 1), lambda i: substr({kept}, i + 1, 2))"
    return f"list_concat({single}, {pairs})"


def features(x: str, chars: str = CJK) -> str:
    return f"list_distinct(list_concat({latin(x)}, {ngrams(x, chars)}))"


def overlap(q: str, t: str) -> str:
    return f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {t})) / len({q}) ELSE 0.0 END"


def has_text(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {text(f'[^{WS}]')}), false)"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def starts_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {text(w)})" for w in words) + ")"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(text(w) for w in words) + ")"


def slices(source: str, keys: str, body: str, max_chars: int = 1200, overlap_chars: int = 150, min_chars: int = 80) -> str:
    """SELECT of (keys, slice_ix, char_start, char_end, content) over ``source``."""
    step = max_chars - max(0, min(overlap_chars, max_chars - 1))
    return f"""
    SELECT {keys}, i AS slice_ix, i * {step} AS char_start,
           CASE WHEN i = k THEN n ELSE i * {step} + {max_chars} END AS char_end,
           {strip(f"substr(body, i * {step} + 1, CASE WHEN i = k THEN n ELSE {max_chars} END)")} AS content
    FROM (SELECT *, unnest(range(k + 1)) AS i FROM (
            SELECT *, CASE WHEN n <= {max_chars} THEN 0 ELSE greatest(1,
                       CAST(ceil((n - {max(min_chars - 1, 0)} - {max_chars}) / {step}.0) AS BIGINT)) END AS k
            FROM (SELECT {keys}, {body} AS body, length({body}) AS n FROM {source})))
    """
