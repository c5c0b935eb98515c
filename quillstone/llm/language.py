"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter three-gram is its letters' vectors, rotated by their place and
multiplied; a text is the sum over its three-grams (the gap between words counts as a letter); a language is the sum
over its texts. A document gets the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import in_blocks, mix, text_batches, tidy

DIMENSIONS = 1024
GRAM = 3
# At most about this many training documents per language, drawn by a hash of the id.
TRAIN_PER_LANGUAGE = 4_000
BLOCK_LETTERS = 1 << 19
# Gram vectors made at a time.
GRAM_ROWS = 1 << 12
GAP = 32
UNKNOWN = "und"

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """True for every code point that is a letter; built once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vector(code: int) -> np.ndarray:
    """The random vector of a letter: signs drawn by hashing the letter and the place."""
    if code not in _vectors:
        places = np.arange(DIMENSIONS, dtype=np.uint64) + np.uint64((code + 1) << 20)
        _vectors[code] = (mix(mix(places)) >> np.uint64(63)).astype(np.int8) * 2 - 1
    return _vectors[code]


def gram_vectors(grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """One row per gram: its letters' vectors, rotated by place and multiplied. Grams are numbers to base len(alphabet)."""
    base = np.stack([letter_vector(int(c)) for c in alphabet])
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    rest = grams
    for place in range(GRAM):
        out *= np.roll(base, place, axis=1)[rest % len(alphabet)]
        rest = rest // len(alphabet)
    return out.astype(np.float32)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one gap before, between and after words; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    solid = letter_table()[codes]
    if not solid.any():
        return np.empty(0, np.uint32)
    kept = solid | (np.concatenate([[False], solid[:-1]]))
    return np.concatenate([[GAP], np.where(solid, codes, GAP)[kept], [GAP]]).astype(np.uint32)[: kept.sum() + 1 + solid[-1]]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """The vectors of a block of texts; a text without letters has the zero vector."""
    streams = [letters_of(t) if t else np.empty(0, np.uint32) for t in texts]
    joined = np.concatenate(streams) if streams else np.empty(0, np.uint32)
    if not len(joined):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    alphabet = np.flatnonzero(np.bincount(joined))
    index = np.zeros(int(alphabet[-1]) + 1, np.int64)
    index[alphabet] = np.arange(len(alphabet))
    letters, owner = index[joined], np.repeat(np.arange(len(texts)), [len(s) for s in streams])
    n = len(letters) - GRAM + 1
    grams = np.zeros(max(0, n), np.int64)
    for place in range(GRAM):
        grams += letters[place : n + place] * len(alphabet) ** place
    same = owner[:n] == owner[GRAM - 1 :]
    grams, owner = grams[same], owner[:n][same]
    kinds = len(alphabet) ** GRAM
    seen, counts = np.unique(owner * kinds + grams, return_counts=True)
    owner, grams = seen // kinds, seen % kinds
    columns, at = np.unique(grams, return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for a in range(0, len(columns), GRAM_ROWS):
        b = min(a + GRAM_ROWS, len(columns))
        inside = (at >= a) & (at < b)
        bag = np.zeros((len(texts), b - a), np.float32)
        bag[owner[inside], at[inside] - a] = counts[inside]
        out += bag @ gram_vectors(columns[a:b], alphabet)
    return out


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Spans of texts with a bounded number of characters; a longer text comes alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and (size + n > BLOCK_LETTERS or i - at >= 256):
            yield at, i
            at = i
            size = 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """(language, vector) of ``labelled`` (doc_id, text, lang), in order of the name; null and unlearnable rows are left out.

    Of a language with more than ``per_language`` documents about that many are drawn by a hash of the id; of others all
    are used. The tasks add up their vectors, so one row per language and task is shuffled.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # one entry per language, as in the model itself
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                vectors = text_vectors(texts[a:b])
                for lang in set(langs[a:b]):
                    own = np.array([x == lang for x in langs[a:b]])
                    sums[lang] = sums.get(lang, 0) + vectors[own].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "part"],
            )

    parts = drawn.select("lang", "text").mapInArrow(tidy(run), "lang string, part array<double>")
    added = parts.select("lang", F.posexplode("part").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    model = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    learned = [(r["lang"], np.array([p["x"] for p in r["v"]])) for r in model.orderBy("lang").toLocalIterator()]
    return [(lang, v / np.linalg.norm(v)) for lang, v in learned if np.linalg.norm(v) > 0]


def predict(docs: DataFrame, model: list[tuple[str, np.ndarray]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` (``text`` may be one) and (lang_pred, score): the nearest language and its cosine, ``und`` and 0 without letters.

    Only the text is looked at. A cosine below 0 counts as 0; of equal cosines the first language by name wins. The
    model, one vector per language, goes to the tasks with the function.
    """
    names = [lang for lang, _ in model]
    matrix = np.stack([v for _, v in model]).astype(np.float32).T if model else np.zeros((DIMENSIONS, 1), np.float32)
    others = [c for c in keep if c != "text"]
    first = 0 if "text" in keep else 1  # the text goes to the workers once
    carried = docs.select(F.col("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    columns = [*carried.columns[first:], "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_blocks(whole, "text", 8 << 20)):
            texts = batch.column(0).to_pylist()
            found: list[str] = []
            scores: list[float] = []
            for a, b in blocks(texts):
                vectors = text_vectors(texts[a:b])
                norms = np.linalg.norm(vectors, axis=1)
                known = norms > 0 if names else np.zeros(b - a, bool)
                cosines = (vectors @ matrix) / np.where(known, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                value = np.clip(cosines[np.arange(b - a), best].astype(float), 0, 1)
                found += [names[k] if yes else UNKNOWN for k, yes in zip(best, known)]
                scores += np.where(known, value, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[first:], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=columns
            )

    shape = ["text string"][first:] + [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)]
    done = carried.mapInArrow(tidy(run), ", ".join([*shape, "lang_pred string, score double"]))
    return done.select(*["text"][first:], *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """One row per input row: (doc_id, held_out, lang_pred, score).

    Learns from rows with a language that are not held out (crc32 of the id as text, modulo 4, is not 2; a null id is
    not held out) and predicts every row from its text alone. A null text and one without letters are ``und`` with
    score 0, as is every row where nothing was learned. Equal texts get equal answers. An empty table gives an empty
    result; columns besides doc_id, text and lang are not looked at.
    """
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()), per_language)
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language; rejected rows (``und``) go. No row is shuffled."""
    with text_batches(docs.sparkSession):
        model = train(docs.select("doc_id", "text", "lang").where(~held_out()), per_language)
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    found = predict(docs.select("text", row.alias("_row")), model, ["text", "_row"]).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
