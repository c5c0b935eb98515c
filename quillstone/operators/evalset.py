"""Evaluation sets: candidate chunks, answer sentences, questions and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import (
    LINE_BREAK,
    compact_text,
    contains_any,
    count_cjk,
    normalize_text,
    remove_code_fences,
    shares_long_substring,
    strip,
    strip_url_inline_code,
)
from quillstone.operators.positions import first_per_key, running

# Sentence ends of the evaluation scripts; ``ends`` adds others for Latin texts.
SENTENCE_ENDS = "。！？；"


def _split_after(c: Column, ends: str) -> Column:
    return F.split(c, f"(?<=[{ends}])")


def sentences_with_terms(
    content: Column, terms: list[str] = fixed.CLUE_TERMS, low: int = 35, high: int = 180, ends: str = SENTENCE_ENDS
) -> Column:
    parts = F.transform(_split_after(normalize_text(content), ends), normalize_text)
    return F.filter(parts, lambda s: F.length(s).between(low, high) & contains_any(s, terms))


def sentences_plain(content: Column, low: int = 45, high: int = 260, ends: str = SENTENCE_ENDS) -> Column:
    plain = strip_url_inline_code(remove_code_fences(content))
    parts = F.transform(_split_after(plain, ends), normalize_text)
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def question_text(sentence: Column, number: Column, terms: list[str] = fixed.CLUE_TERMS) -> Column:
    """Clue-style question: template by number, topic is the first listed term in the sentence."""
    topics = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(sentence, t))
    topic = F.coalesce(F.get(topics, F.lit(0)), F.lit(fixed.CLUE_TOPIC_DEFAULT))
    joined = F.regexp_replace(compact_text(sentence), "[。！？；，,、]+", "，")
    clue = F.substring(F.regexp_replace(joined, r"\A，+|，+\z", ""), 1, 46)

    def filled(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{topic}"), topic), F.lit("{clue}"), clue)

    return F.get(F.array(*[filled(t) for t in fixed.CLUE_TEMPLATES]), (number % 4).cast("int"))


def build_questions(
    chunks: DataFrame,
    count: int | None,
    terms: list[str] = fixed.CLUE_TERMS,
    prefix: str = "rag",
    ends: str = SENTENCE_ENDS,
    block_width: int = 1 << 26,
) -> DataFrame:
    """Questions from answer sentences in (chunk_order, position) order, one per distinct compact answer.

    ``chunks`` has chunk_id, chunk_order (unique, ascending) and content. With a count the first ``count`` answers are
    numbered, and fewer is an error; without one every distinct answer becomes a question numbered by blocks of ``block_width`` chunk orders.
    """
    found = chunks.select(
        "chunk_id", "chunk_order", F.posexplode(sentences_with_terms(F.col("content"), terms, ends=ends)).alias("pos", "answer")
    ).withColumn("key", compact_text("answer"))
    distinct = found.groupBy("key").agg(
        F.min(F.struct("chunk_order", "pos", "chunk_id", "answer")).alias("first")
    )
    ordered = distinct.select("first.*")
    if count is not None:
        ordered = ordered.orderBy("chunk_order", "pos").limit(count)
        numbered = ordered.withColumn(
            "number", F.row_number().over(Window.orderBy("chunk_order", "pos"))
        )
        short = F.count("*").over(Window.partitionBy()) < count
        message = F.lit(f"fewer than {count} questions")
        numbered = numbered.withColumn("_ok", F.when(short, F.raise_error(message)).otherwise(True)).where("_ok")
    else:
        numbered = number_rows(ordered, ["chunk_order", "pos"], F.floor(F.col("chunk_order") / block_width))
    digits = F.col("number").cast("string")
    padded = F.lpad(digits, 3, "0")
    return numbered.select(
        F.concat(F.lit(f"{prefix}-"), F.when(F.col("number") < 1000, padded).otherwise(digits)).alias("id"),
        F.col("number").cast("long").alias("number"),
        question_text(F.col("answer"), F.col("number"), terms).alias("question"),
        "answer",
        F.col("chunk_id").alias("relevant_chunk_id"),
        F.col("answer").alias("answer_source"),
    )


def number_rows(df: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Consecutive numbers over a whole table, by blocks that follow the order."""


    return running(df, [], order, block, sums={"number": F.lit(1)})


def good_chunk_filter(content: Column, min_chars: int = 180, min_han: int = 80, max_code_share: float = 0.55) -> Column:
    lines = F.split(content, LINE_BREAK)
    code = _code_lines(lines, fixed.CODE_LINE_STARTS)
    return (
        (F.length(content) >= min_chars)
        & (count_cjk(content) >= min_han)
        & (code / F.greatest(F.lit(1), F.size(lines)) < max_code_share)
    )


def _starts_with(c: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for start in starts:
        out = out | F.startswith(c, F.lit(start))
    return out


def _code_lines(lines: Column, starts: list[str]) -> Column:
    # Each line is stripped once, not once for each start.
    return F.size(F.filter(F.transform(lines, strip), lambda line: _starts_with(line, starts)))


def _table_lines(lines: Column) -> Column:
    bars = lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return F.size(F.filter(lines, lambda line: bars(line) >= 2))


def _block_lines(block: Column) -> Column:
    # A block that ends in a line break has no empty last line.
    return F.split(F.regexp_replace(block, r"\n\z", ""), LINE_BREAK)


def blocks_of(content: Column) -> Column:
    return F.filter(F.split(content, r"\n{2,}"), lambda b: F.length(strip(b)) > 0)


def block_measures(block: Column) -> Column:
    lines = _block_lines(block)
    return F.struct(
        F.length(block).alias("chars"),
        count_cjk(block).alias("cjk"),
        _code_lines(lines, fixed.BLOCK_CODE_STARTS).alias("code_lines"),
        _table_lines(lines).alias("table_lines"),
        F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"^\s*([-*+]|[0-9]+\.)\s+")))).alias("bullet_lines"),
        F.size(lines).alias("line_count"),
    )


def block_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row per block of blank-line separated text."""
    return chunks.select(*keys, F.posexplode(blocks_of(F.col("content"))).alias("block_no", "block")).select(
        *keys, "block_no", block_measures(F.col("block")).alias("_m")
    ).select(*keys, "block_no", "_m.*")


def technical_chunk_filter(content: Column, min_chars: int = 80, min_han: int = 25, share: float = 0.55) -> Column:
    """True when a chunk is too short, has too little Han text, or is mostly code or tables.

    One pass over the blocks takes the measures that are asked for, and each block is cut into lines once.
    """
    half = lambda lines, least: F.greatest(F.lit(least), F.floor(F.size(lines) / 2))
    kinds = lambda lines: F.struct(
        (_code_lines(lines, fixed.BLOCK_CODE_STARTS) >= half(lines, 2)).cast("int").alias("code"),
        (_table_lines(lines) >= half(lines, 3)).cast("int").alias("tables"),
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("code"), F.lit(0).alias("tables"))
    add = lambda seen, kind: F.struct(
        (seen["n"] + 1).alias("n"), (seen["code"] + kind["code"]).alias("code"), (seen["tables"] + kind["tables"]).alias("tables")
    )
    technical = lambda seen: (
        (seen["n"] == 0) | (seen["code"] / F.greatest(seen["n"], F.lit(1)) >= share) | (seen["tables"] / F.greatest(seen["n"], F.lit(1)) >= share)
    )
    lined = F.transform(blocks_of(content), _block_lines)
    short = F.length(content) < min_chars
    if min_han > 0:
        short = short | (count_cjk(content) < min_han)
    return short | F.aggregate(F.transform(lined, kinds), none, add, technical)


def answer_source(
    content: Column,
    terms: list[str] = fixed.ANSWER_TERMS,
    reasons: list[str] = fixed.ANSWER_REASONS,
    ends: str = SENTENCE_ENDS,
) -> Column:
    """The best sentence of a chunk: domain terms, reasoning words, then length; the first wins ties. Null if none."""
    scored = F.transform(
        sentences_plain(content, ends=ends),
        lambda s, i: F.struct(
            (
                F.when(contains_any(s, terms), 3.0).otherwise(0.0)
                + F.when(contains_any(s, reasons), 2.0).otherwise(0.0)
                + F.least(F.length(s), F.lit(180)) / 180.0
            ).alias("score"),
            (-i).alias("early"),
            s.alias("sentence"),
        ),
    )
    return F.array_max(scored)["sentence"]


def section_sample(
    candidates: DataFrame, count: int, seed: int = 42, keep: float = 0.25, order: str = "chunk_order"
) -> DataFrame:
    """First chunk of each heading path, a fixed share of the later ones, then the first max(2n, n+40) by hash.

    Draws come from a hash of (seed, chunk), so the choice is the same on every run and for every partitioning.
    """
    path = F.array_join("heading_path", " / ")
    first = candidates.groupBy(path.alias("_path")).agg(F.min(order).alias("_first"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("chunk_id").cast("string"))), 1, 8), 16, 10)
    joined = candidates.withColumn("_path", path).join(first, "_path").withColumn("_draw", draw.cast("long"))
    kept = joined.where((F.col(order) == F.col("_first")) | (F.col("_draw") < int(keep * 2**32)))
    shuffled = F.md5(F.concat_ws("/", F.lit(seed), F.col("chunk_id").cast("string")))
    return kept.orderBy(shuffled, "chunk_id").limit(max(2 * count, count + 40)).drop("_path", "_first", "_draw")


def fallback_question(heading_path: Column, number: Column) -> tuple[Column, Column]:
    """(question, question_type) from the last two heading levels."""
    tail = F.slice(heading_path, F.greatest(F.size(heading_path) - 1, F.lit(1)), F.lit(2))
    heading = F.array_join(tail, " / ")
    slot = (number % 4).cast("int")
    texts = [F.replace(F.lit(t), F.lit("{heading}"), heading) for t in fixed.HEADING_TEMPLATES]
    return F.get(F.array(*texts), slot), F.get(F.array(*[F.lit(t) for t in fixed.HEADING_TYPES]), slot)


def validate_question(question: Column, answer: Column, source: Column) -> Column:
    asked = normalize_text(F.coalesce(question, F.lit("")))
    answered = normalize_text(F.coalesce(answer, F.lit("")))
    return (
        F.length(asked).between(8, 120)
        & (F.length(answered) >= 10)
        & ~contains_any(asked, fixed.BANNED_PHRASES)
        & ~shares_long_substring(asked, source, 10)
    )


def validate_item(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds reject_reason to generated items: joined by chunk_id with (chunk_id, content, heading_path)."""
    base = chunks.select(
        "chunk_id", F.col("content").alias("_content"), F.col("heading_path").alias("_path")
    )
    joined = items.join(base, "chunk_id", "left")
    asked = normalize_text(F.coalesce("question", F.lit("")))
    answered = normalize_text(F.coalesce("answer", F.lit("")))
    source = F.coalesce("answer_source", F.lit(""))
    heading = F.array_join("_path", " / ")
    reason = (
        F.when((F.length(asked) == 0) | (F.length(answered) == 0) | (F.length(source) == 0), "missing_field")
        .when(~F.length(asked).between(8, 120), "question_length")
        .when(~F.length(answered).between(10, 500), "answer_length")
        .when(~F.coalesce(F.col("question_type").isin(fixed.QUESTION_TYPES), F.lit(False)), "question_type")
        .when(contains_any(asked, fixed.BANNED_PHRASES), "banned_phrase")
        .when((F.length(heading) > 0) & F.contains(compact_text(asked), compact_text(heading)), "heading_copied")
        .when(shares_long_substring(asked, source, 10), "too_close_to_source")
        .when(~F.coalesce(F.contains(F.col("_content"), source), F.lit(False)), "source_not_in_chunk")
        .when(~F.coalesce(F.col("relevant_chunk_id") == F.col("chunk_id"), F.lit(False)), "wrong_chunk")
        .when(~F.coalesce(F.col("heading_path") == F.col("_path"), F.lit(False)), "wrong_heading")
    )
    return joined.withColumn("reject_reason", reason).drop("_content", "_path")


def accept_items(validated: DataFrame, per_chunk: int = 2, order: str = "position") -> DataFrame:
    valid = validated.where(F.col("reject_reason").isNull())
    return first_per_key(valid, ["chunk_id"], [F.col(order)], per_chunk)


def resume_pending(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    done = rows.where(F.col("relevant_chunk_id").isNotNull()).select(F.col("relevant_chunk_id").alias("chunk_id"))
    return chunks.join(done, "chunk_id", "left_anti")


def next_id(rows: DataFrame, prefix: str = "natural-rag") -> DataFrame:
    number = F.regexp_extract("id", rf"\A{prefix}-(\d+)\z", 1)
    return rows.agg((F.coalesce(F.max(number.try_cast("int")), F.lit(0)) + 1).cast("long").alias("next_id"))
