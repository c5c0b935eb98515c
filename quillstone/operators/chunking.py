"""Documents to chunks: sliding slices, Markdown sections with heading paths, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import (
    BLANKS,
    LINE_BREAK,
    WS,
    chunk_digest,
    embedding_text,
    has_text,
    let,
    normalize_text,
    strip,
)
from quillstone.operators.positions import running
from quillstone.session import materialise

HEADING = rf"^(#{{1,6}})[{WS}]+(.+?)[{WS}]*#*[{WS}]*$"
FENCE = rf"^[{WS}]*(```|~~~)"
LEVELS = range(1, 7)


def slices(
    text: Column,
    max_chars: int = fixed.CHUNK_MAX_CHARS,
    overlap_chars: int = fixed.CHUNK_OVERLAP_CHARS,
    min_chars: int = fixed.CHUNK_MIN_CHARS,
) -> Column:
    """Overlapping slices of a text as an array of (ix, start, end, content).

    The number of slices has a closed form. The text is cut once into pieces of one step, and a slice joins the pieces
    that it spans, so the work grows linearly with the text.
    """
    overlap = max(0, min(overlap_chars, max_chars - 1))
    step = max_chars - overlap
    span = -(-max_chars // step)

    def of_text(t: Column) -> Column:
        n = F.length(t)
        over = n - max(min_chars - 1, 0) - max_chars
        last = F.when(n <= max_chars, 0).otherwise(F.greatest(F.lit(1), F.ceil(over / step).cast("int")))
        pieces = F.regexp_extract_all(t, F.lit(f"(?s)(.{{1,{step}}})"), F.lit(1))

        def of_pieces(p: Column) -> Column:
            def one(i: Column) -> Column:
                width = F.when(i < last, F.lit(span)).otherwise(F.greatest(F.size(p), F.lit(1)))
                body = F.array_join(F.slice(p, i + 1, width), "")
                return F.struct(
                    i.alias("ix"),
                    (i * step).alias("start"),
                    F.when(i < last, i * step + max_chars).otherwise(n).alias("end"),
                    strip(F.when(i < last, F.substring(body, 1, max_chars)).otherwise(body)).alias("content"),
                )

            return F.transform(F.sequence(F.lit(0), last), one)

        return let(pieces, of_pieces)

    return let(text, of_text)


def sliding_chunks(df: DataFrame, text: Column, **sizes: int) -> DataFrame:
    """One row per slice, with every other input column kept; no shuffle."""
    sliced = df.withColumn("_slice", F.explode(slices(text, **sizes)))
    return sliced.select(
        *[c for c in df.columns if c != "content"],
        F.col("_slice.ix").alias("slice_ix"),
        F.col("_slice.start").alias("char_start"),
        F.col("_slice.end").alias("char_end"),
        F.col("_slice.content").alias("content"),
    )


def trust_headings(flag: Column, file_type: Column) -> Column:
    kind = F.regexp_replace(F.lower(strip(file_type)), r"\.", "")
    return F.coalesce(flag, kind.isin("md", "markdown"), F.lit(False))


def plain_text_chunks(docs: DataFrame, **sizes: int) -> DataFrame:
    """Chunks of texts whose heading marks are not trusted: (doc_id, title, text) in."""
    title = F.when(has_text("title"), F.col("title")).otherwise(fixed.UNTITLED_DOCUMENT)
    body = docs.where(has_text("text")).select("doc_id", title.alias("title"), strip("text").alias("text"))
    cut = sliding_chunks(body, F.col("text"), **sizes)
    return _chunk_columns(
        cut.select(
            "doc_id",
            "title",
            F.array("title").alias("heading_path"),
            F.lit(1).alias("heading_level"),
            F.col("title").alias("section_title"),
            F.col("slice_ix").alias("chunk_index"),
            (F.col("slice_ix") + 1).alias("section_chunk_index"),
            "char_start",
            "char_end",
            "content",
        )
    )


def _has_heading_line(text: Column) -> Column:
    # The pattern starts at a mark, so texts are scanned for that alone; what stands before it is looked up behind.
    start = r"(?:\A|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"
    return F.rlike(text, F.lit(rf"#{{1,6}}(?<={start}#{{1,6}})[{WS}]"))


def headed_lines(docs: DataFrame) -> DataFrame:
    """Lines of each document with their section number and the heading path that holds there.

    Every running value uses one window over a document's lines. A heading of level l is live as long as no later
    heading has a lower level, which a running maximum of positions per level decides.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = docs.select("doc_id", "title", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line"))
    fenced = F.sum(F.rlike("line", F.lit(FENCE)).cast("int")).over(order) % 2 == 1
    lines = lines.withColumn("is_head", ~fenced & F.rlike("line", F.lit(HEADING)))
    level = F.when(F.col("is_head"), F.length(F.regexp_extract("line", HEADING, 1)))
    head = F.when(F.col("is_head"), strip(F.regexp_extract("line", HEADING, 2)))
    lines = lines.withColumn("level", level).withColumn("head", head)
    seen = {i: F.max(F.when(F.col("level") == i, F.col("pos"))).over(order) for i in LEVELS}
    titles = {
        i: F.last(F.when(F.col("level") == i, F.col("head")), ignorenulls=True).over(order) for i in LEVELS
    }
    lines = lines.select(
        "*",
        F.sum(F.col("is_head").cast("int")).over(order).alias("section_id"),
        *[seen[i].alias(f"_p{i}") for i in LEVELS],
        *[titles[i].alias(f"_t{i}") for i in LEVELS],
    )

    def live(i: int) -> Column:
        lower = [F.coalesce(F.col(f"_p{j}"), F.lit(-1)) for j in range(1, i)]
        above = F.greatest(*lower, F.lit(-1)) if lower else F.lit(-1)
        return F.when(F.col(f"_p{i}") > above, F.col(f"_t{i}"))

    path = F.filter(F.array(*[live(i) for i in LEVELS]), lambda x: x.isNotNull())
    return lines.withColumn("path", F.when(F.col("is_head"), path)).drop(
        *[f"_p{i}" for i in LEVELS], *[f"_t{i}" for i in LEVELS]
    )


def markdown_sections(docs: DataFrame, keep_preamble: bool = True, keep_empty: bool = False) -> DataFrame:
    """Sections of (doc_id, title, text): doc_id, title, section_id, section_title, heading_level, heading_path, content.

    Documents without heading lines are one preamble section and stay where they are; only the others are exploded
    into lines and shuffled, once, by document.
    """
    headed = docs.where(_has_heading_line(F.col("text")))
    grouped = (
        headed_lines(headed)
        .groupBy("doc_id", "section_id")
        .agg(
            F.first("title").alias("title"),
            F.max("head").alias("_head"),
            F.max("level").alias("_level"),
            F.max("path").alias("_path"),
            F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))).alias("_lines"),
        )
    )
    body = normalize_text(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"))
    in_preamble = F.col("section_id") == 0
    sections = grouped.select(
        "doc_id",
        "title",
        F.col("section_id").cast("long").alias("section_id"),
        F.when(in_preamble, F.col("title")).otherwise(F.col("_head")).alias("section_title"),
        F.when(in_preamble, 1).otherwise(F.col("_level")).alias("heading_level"),
        F.when(in_preamble, F.array("title")).otherwise(F.col("_path")).alias("heading_path"),
        body.alias("content"),
    )
    if not keep_preamble:
        sections = sections.where("section_id > 0")
    else:
        plain = docs.where(~_has_heading_line(F.col("text"))).select(
            "doc_id",
            "title",
            F.lit(0).cast("long").alias("section_id"),
            F.col("title").alias("section_title"),
            F.lit(1).alias("heading_level"),
            F.array("title").alias("heading_path"),
            normalize_text("text").alias("content"),
        )
        sections = sections.unionByName(plain)
    return sections if keep_empty else sections.where(F.length("content") > 0)


def section_pairs(docs: DataFrame) -> DataFrame:
    """(title, content) of each headed section; no preamble, empty content kept."""
    return markdown_sections(docs, keep_preamble=False, keep_empty=True).select(
        "doc_id", "section_id", "section_title", "content"
    )


def chunk_document(docs: DataFrame, **sizes: int) -> DataFrame:
    """Heading-aware chunks of (doc_id, title, text)."""
    cut = sliding_chunks(markdown_sections(docs), F.col("content"), **sizes)
    columns = [
        "doc_id",
        "title",
        "heading_path",
        "heading_level",
        "section_title",
        "chunk_index",
        (F.col("slice_ix") + 1).alias("section_chunk_index"),
        "char_start",
        "char_end",
        "content",
    ]
    order = Window.partitionBy("doc_id").orderBy("section_id", "slice_ix")
    return _chunk_columns(cut.withColumn("chunk_index", F.row_number().over(order) - 1).select(*columns))


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    padded = F.when(F.col("chunk_index") > 9999, F.col("chunk_index").cast("string")).otherwise(
        F.lpad(F.col("chunk_index").cast("string"), 4, "0")
    )
    chunk_id = F.concat_ws(
        "-",
        F.col("doc_id").cast("string"),
        F.lit("chunk"),
        padded,
        chunk_digest(F.col("chunk_index"), F.col("content")),
    )
    return chunks.select(
        chunk_id.alias("chunk_id"),
        "*",
        embedding_text(F.col("title"), F.col("heading_path"), F.col("content")).alias("embedding_text"),
    )


def chunk_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    path = F.array_join("heading_path", " > ")
    size = F.length("content")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunk_count"),
        F.min(size).alias("min_chars"),
        F.max(size).alias("max_chars"),
        F.avg(size).alias("avg_chars"),
        F.min_by(path, F.struct("doc_id", "chunk_index")).alias("first_path"),
        F.max_by(path, F.struct("doc_id", "chunk_index")).alias("last_path"),
    )


def strip_inline_markup(c: Column | str) -> Column:
    """Plain text of a section: images, links, emphasis and quote marks go, table rows stay as they are."""
    table_row = r"^[ \t]*\|.*\|[ \t]*$"
    lines = F.transform(
        F.split(c, "\n"),
        lambda line: F.when(F.rlike(line, F.lit(table_row)), line).otherwise(
            F.regexp_replace(
                F.regexp_replace(
                    F.regexp_replace(line, r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
                    r"(\*\*|__|\*|`)(.+?)\1",
                    "$2",
                ),
                r"^[ \t]*>[ \t]?",
                "",
            )
        ),
    )
    return F.array_join(lines, "\n")


# Pages, and characters, per block of the running values over a document; characters of a document gathered in one row.
PAGE_BLOCK, CHAR_BLOCK = 64, 1 << 18
GATHERED_CHARS = 1 << 18


def page_range_chunks(
    pages: DataFrame,
    target_chars: int = fixed.PAGE_TARGET_CHARS,
    overlap_chars: int = fixed.PAGE_OVERLAP_CHARS,
    gathered_chars: int = GATHERED_CHARS,
) -> DataFrame:
    """Chunks over the pages of documents: (doc_id, page, text) in.

    Paragraphs are gathered until a chunk has ``target_chars``; the next one starts with the last ``overlap_chars`` of
    it, without blanks in front, on the page where the last one ended. What is left at the end is a chunk too.

    The paragraphs of a document of up to ``gathered_chars`` characters are brought together once and gathered in one
    fold. Longer documents are not put into one row: their chunks are found as spans.
    """
    if not 0 <= overlap_chars < target_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = pages.where("doc_id IS NOT NULL").select("doc_id", "page", "text")
    sizes = rows.groupBy("doc_id").agg(F.sum(F.length("text") + 1).alias("chars"))
    long = materialise(sizes.where(F.col("chars") > gathered_chars).select("doc_id"), "long")
    if long.isEmpty():
        chunks = _gathered(rows, target_chars, overlap_chars)
    else:
        chunks = _gathered(rows.join(long, "doc_id", "left_anti"), target_chars, overlap_chars).unionByName(
            _spanned(rows.join(long, "doc_id", "left_semi"), target_chars, overlap_chars)
        )
    digest = F.substring(F.sha1(F.concat_ws(":", F.col("page_start"), F.col("page_end"), F.col("content"))), 1, 12)
    return chunks.select(
        "doc_id",
        F.concat(F.lit("chunk-"), F.lpad(F.col("ordinal").cast("string"), 4, "0"), F.lit("-"), digest).alias("chunk_id"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("page_start").cast("int").alias("page_start"),
        F.col("page_end").cast("int").alias("page_end"),
        "content",
    )


def _paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, paragraph) without empty ones."""
    return (
        pages.select("doc_id", "page", F.posexplode(F.split(normalize_text("text"), r"\n+")).alias("pos", "paragraph"))
        .withColumn("paragraph", strip("paragraph"))
        .where(F.length("paragraph") > 0)
    )


def _gathered(pages: DataFrame, target: int, overlap: int) -> DataFrame:
    """(doc_id, ordinal, page_start, page_end, content): one fold over the paragraphs of each document."""
    ordered = _paragraphs(pages)
    page = ordered.schema["page"].dataType.simpleString()
    pieces = ordered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "pos", "paragraph"))).alias("_p"))

    def chunk(start: Column, end: Column, content: Column) -> Column:
        return F.array(F.struct(start.alias("page_start"), end.alias("page_end"), content.alias("content")))

    def add(seen: Column, x: Column) -> Column:
        start = F.when(seen["n"] == 0, x["page"]).otherwise(seen["start"])

        def with_buffer(text: Column) -> Column:
            full = F.length(text) >= target
            return F.struct(
                (seen["n"] + 1).alias("n"),
                F.when(full, F.right(text, F.lit(overlap))).otherwise(text).alias("buffer"),
                F.when(full, x["page"]).otherwise(start).alias("start"),
                x["page"].alias("page"),
                F.when(full, F.concat(seen["chunks"], chunk(start, x["page"], text))).otherwise(seen["chunks"]).alias("chunks"),
            )

        return let(strip(F.concat(seen["buffer"], F.lit("\n"), x["paragraph"])), with_buffer)

    def close(seen: Column) -> Column:
        rest = chunk(seen["start"], seen["page"], strip(seen["buffer"]))
        return F.when(has_text(seen["buffer"]), F.concat(seen["chunks"], rest)).otherwise(seen["chunks"])

    none = F.lit(None).cast(page)
    begin = F.struct(
        F.lit(0).alias("n"), F.lit("").alias("buffer"), none.alias("start"), none.alias("page"),
        F.array().cast(f"array<struct<page_start:{page},page_end:{page},content:string>>").alias("chunks"),
    )
    chunks = pieces.select("doc_id", F.posexplode(F.aggregate("_p", begin, add, close)).alias("_at", "_c"))
    return chunks.select("doc_id", (F.col("_at") + 1).cast("long").alias("ordinal"), "_c.page_start", "_c.page_end", "_c.content")


def _spanned(pages: DataFrame, target_chars: int, overlap_chars: int) -> DataFrame:
    """The same for documents of any length.

    With its paragraphs one below the other, a document is one text, and every chunk a span of it. Where a chunk that
    ends at a paragraph is followed by one that begins there, and where that one ends, follows from lengths alone, so
    the next end of every paragraph is looked up for all at once; the ends that the first chunk leads to are found by
    doubling these pointers. Texts are put together from the chosen spans only.
    """
    ordered = _paragraphs(pages)
    counted = running(
        ordered, ["doc_id"], ["page", "pos"], F.floor(F.col("page") / PAGE_BLOCK),
        sums={"j": F.lit(1), "upto": F.length("paragraph") + 1},
    )
    begin = F.col("upto") - 1 - F.length("paragraph")
    paragraphs = materialise(counted.select("doc_id", "page", "paragraph", "j", begin.alias("begin"), (F.col("upto") - 1).alias("end")), "paragraphs")
    nodes = materialise(_next_ends(paragraphs, target_chars, overlap_chars), "ends")
    ends = paragraphs.groupBy("doc_id").agg(F.max("j").alias("n"))
    spans = nodes.join(_reached(nodes), ["doc_id", "j"]).join(ends, "doc_id").withColumn("last", F.coalesce("nxt", "n"))
    spans = spans.where(F.col("first") <= F.col("last"))
    spans = running(spans, ["doc_id"], ["j"], F.floor(F.col("j") / 4096), sums={"ordinal": F.lit(1)})
    piece = F.when(F.col("i") == F.col("first"), F.expr("substring(paragraph, cast(start - begin + 1 as int))")).otherwise(F.col("paragraph"))
    texts = (
        spans.withColumn("i", F.explode(F.sequence("first", "last")))
        .join(paragraphs.withColumnRenamed("j", "i"), ["doc_id", "i"])
        .groupBy("doc_id", "ordinal")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", piece.alias("text")))), lambda x: x["text"]), "\n").alias("content"),
            F.max_by("page", "i").alias("page_end"),
        )
    )
    at = paragraphs.select("doc_id", F.col("j").alias("_at"), F.col("page").alias("page_start"))
    begun = spans.select("doc_id", "ordinal", F.greatest("j", F.lit(1)).alias("_at")).join(at, ["doc_id", "_at"])
    return texts.join(begun, ["doc_id", "ordinal"]).select("doc_id", "ordinal", "page_start", "page_end", "content")


def _next_ends(paragraphs: DataFrame, target: int, overlap: int) -> DataFrame:
    """(doc_id, j, start, first, nxt): a chunk that follows an end at paragraph j starts at ``start`` in paragraph
    ``first`` and ends at paragraph ``nxt``, the first one that reaches the target; j = 0 stands for the begin."""
    if overlap:
        # the paragraph in which the overlap starts is the last one that begins at or before that place
        nothing = F.lit(None).cast("long")
        places = paragraphs.select("doc_id", F.col("begin").alias("at"), F.lit(0).alias("kind"), F.col("j").alias("seen"), nothing.alias("j")).unionByName(
            paragraphs.where(F.col("end") >= overlap).select(
                "doc_id", (F.col("end") - overlap).alias("at"), F.lit(1).alias("kind"), nothing.alias("seen"), "j"
            )
        )
        met = running(places, ["doc_id"], ["at", "kind"], F.floor(F.col("at") / CHAR_BLOCK), lasts={"first": F.col("seen")}).where("kind = 1")
        own = paragraphs.select("doc_id", F.col("j").alias("first"), "begin", "end", "paragraph")
        rest = F.expr("substring(paragraph, cast(at - begin + 1 as int))")
        blanks = F.length(rest) - F.length(F.ltrim(rest, F.lit(BLANKS)))
        over = F.col("at") >= F.col("end")  # only the line end is left of that paragraph
        starts = met.join(own, ["doc_id", "first"]).select(
            "doc_id", "j",
            F.when(over, F.col("end") + 1).otherwise(F.col("at") + blanks).alias("start"),
            F.when(over, F.col("first") + 1).otherwise(F.col("first")).alias("first"),
        )
    else:
        starts = paragraphs.select("doc_id", "j", (F.col("end") + 1).alias("start"), (F.col("j") + 1).alias("first"))
    zero = F.lit(0).cast("long")
    nodes = starts.unionByName(paragraphs.select("doc_id").distinct().select("doc_id", zero.alias("j"), zero.alias("start"), F.lit(1).cast("long").alias("first")))
    # from the highest place down: the last end that was met is the nearest one at or after the asked place
    asked = nodes.select("*", (-(F.col("start") + target)).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seen"))
    known = paragraphs.select("doc_id", (-F.col("end")).alias("at"), F.lit(0).alias("kind"), F.col("j").alias("seen"))
    both = asked.unionByName(known, allowMissingColumns=True)
    looked = running(both, ["doc_id"], ["at", "kind"], F.floor(F.col("at") / CHAR_BLOCK), lasts={"nxt": F.col("seen")})
    return looked.where("kind = 1").select("doc_id", "j", "start", "first", "nxt")


def _reached(nodes: DataFrame) -> DataFrame:
    """(doc_id, j) of the ends that the begin leads to. A round doubles the steps of every pointer, so the rounds are the
    logarithm of the most chunks that a document has."""
    jump = nodes.where("nxt IS NOT NULL").select("doc_id", "j", "nxt")
    reached = nodes.where("j = 0").select("doc_id", "j")
    while True:
        more = reached.join(jump, ["doc_id", "j"]).select("doc_id", F.col("nxt").alias("j"))
        if more.isEmpty():
            return reached
        reached = materialise(reached.unionByName(more).distinct(), "reached")
        onward = jump.select("doc_id", F.col("j").alias("nxt"), F.col("nxt").alias("_to"))
        jump = materialise(jump.join(onward, ["doc_id", "nxt"]).select("doc_id", "j", F.col("_to").alias("nxt")), "jumps")
