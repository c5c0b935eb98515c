"""Uploaded files: type, gate, conversion to Markdown, and the chunk and evaluation sinks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import fixed_values as fixed
from quillstone.functions.text import has_text
from quillstone.session import materialise


def file_type(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("unknown")


def gate_format(
    files: DataFrame, formats: list[str] = fixed.ENABLED_FORMATS, max_mb: float = fixed.MAX_FILE_MB
) -> DataFrame:
    """Adds reject_reason (null for accepted files) and requires_conversion to (filetype, size) rows."""
    reason = (
        F.when(F.col("size") == 0, "empty_file")
        .when(~F.col("filetype").isin(formats), "unsupported_type")
        .when(F.col("size") > max_mb * 1024 * 1024, "too_large")
    )
    return files.withColumn("reject_reason", reason).withColumn(
        "requires_conversion", ~F.col("filetype").isin(fixed.DIRECT_FORMATS)
    )


def ensure_title(markdown: Column, filename: Column) -> Column:
    title = F.when(has_text(filename), filename).otherwise(fixed.UNTITLED_DOCUMENT)
    headed = F.rlike(markdown, F.lit(r"(?m)^[\t-\r\x1c-\x20]*#"))
    return (
        F.when(~has_text(markdown), "")
        .when(headed, markdown)
        .otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), markdown))
    )


def conversion_status(filetype: Column, error: Column) -> Column:
    return F.struct(
        F.when(filetype.isin(fixed.DIRECT_FORMATS), "direct").otherwise("markitdown-cli").alias("tool"),
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        error.alias("error"),
    )


def converted_name(filename: Column) -> Column:
    base = F.when(has_text(filename), filename).otherwise("converted")
    stem = F.regexp_extract(base, r"(?s)\A(.+)\.[^.]*\z", 1)
    name = F.when(F.length(stem) > 0, stem).otherwise(base)
    return F.concat(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), F.lit(".converted.md"))


def empty_files(found: DataFrame) -> list[str]:
    """Paths of the files of length zero behind a file scan, which lists them and leaves them out of its rows.

    Names come over one by one, without the round trips that ask each file for its length.
    """
    # the list is of URLs, some with an empty host; the scan tells plain paths without one
    listed = [re.sub(r"^([^/:]+):///", r"\1:/", unquote(url)) for url in found.inputFiles()]
    paths = found.sparkSession.createDataFrame(pd.DataFrame({"path": listed}, dtype=object), "path string")
    return [r.path for r in paths.join(found.select("path"), "path", "left_anti").collect()]


# Up to this many files go through Spark's reader, whose driver keeps about 1.5 KB of each.
READER_FILES = 50_000
# Bytes of contents that a task holds before it hands them on, and names of a folder that it hands on at once.
HELD_BYTES, NAMES = 8 << 20, 10_000


def _store(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(what the reader puts before a path, the folder) where tasks can list the folder themselves; None elsewhere."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    local = re.fullmatch(r"(?s)(?:file:(?://)?)?(/.*)", path) if path.startswith("file:") or default.startswith("file:") else None
    if local:
        prefix, root = "file:", local[1]
    else:
        try:
            root = fs.FileSystem.from_uri(path)[1]
        except (pa.ArrowException, OSError):
            return None
        if not path.rstrip("/").endswith(root.rstrip("/")):
            return None
        prefix = path.rstrip("/").removesuffix(root.rstrip("/"))
    try:
        found = _system(prefix, root).get_file_info(root)
    except (pa.ArrowException, OSError):
        return None
    return (prefix, root.rstrip("/")) if found.type == fs.FileType.Directory else None


def _system(prefix: str, root: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if prefix == "file:" else fs.FileSystem.from_uri(prefix + root)[0]


def _read(name: str) -> bool:
    """Spark's readers leave out names that begin with a dot or, without a =, an underscore, and files being copied."""
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def listed_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length) of the files below a folder, empty ones too, as the reader names them; None where only the reader
    reaches the folder. Folders are listed by tasks, level by level, so no list of files is on the driver."""
    store = _store(spark, path)
    if store is None:
        return None
    prefix, root = store

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = _system(prefix, root)
        for batch in batches:
            for folder in batch["path"]:
                found = system.get_file_info(fs.FileSelector(folder.removeprefix(prefix)))
                kept = [x for x in found if _read(x.base_name) and x.type in (fs.FileType.File, fs.FileType.Directory)]
                for at in range(0, len(kept), NAMES):
                    part = kept[at : at + NAMES]
                    yield pd.DataFrame(
                        {
                            "path": [prefix + x.path for x in part],
                            "length": [x.size or 0 for x in part],
                            "folder": [x.type == fs.FileType.Directory for x in part],
                        }
                    )

    cores = spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([(prefix + root,)], "path string"), []
    while True:
        below = folders.repartition(cores).mapInPandas(run, "path string, length long, folder boolean")
        levels.append(materialise(below, "listed"))
        folders = levels[-1].where("folder").select("path")
        if folders.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, levels).where("NOT folder").select("path", "length")


def with_content(listed: DataFrame, prefix: str) -> DataFrame:
    """(path, length, content) of listed files, read by tasks; a task holds one file and about HELD_BYTES of others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = None
        for batch in batches:
            rows, held = [], 0
            for path, length in zip(batch["path"], batch["length"]):
                system = system or _system(prefix, path.removeprefix(prefix))
                with system.open_input_stream(path.removeprefix(prefix)) as file:
                    rows.append((path, length, file.read()))
                held += len(rows[-1][2])
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "length", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return listed.mapInPandas(run, "path string, length long, content binary")


def ingest_files(
    spark: SparkSession, path: str, max_mb: float = fixed.MAX_FILE_MB, reader_files: int = READER_FILES
) -> DataFrame:
    """Files below a folder as documents: (doc_id, filename, filetype, size, markdown, status, error).

    Texts are read once, of files whose type is read here and whose length passes the gate; the others are judged by
    name and length alone. A file that is not UTF-8 fails alone, an empty one is rejected like other files. Spark's
    reader keeps every file on the driver, so more than ``reader_files`` of them are listed and read by tasks.
    """
    readable = [*fixed.DIRECT_FORMATS, "html"]
    limit = int(max_mb * 1024 * 1024)

    def named(files: DataFrame) -> DataFrame:
        filename = F.substring_index("path", "/", -1)
        return files.withColumns({"doc_id": F.sha1("path"), "filename": filename, "filetype": file_type(filename)})

    kind = file_type(F.substring_index("path", "/", -1))
    taken = (F.col("length") <= limit) & kind.isin(readable)
    listed = listed_files(spark, path)
    many = 0 if listed is None else listed.count()
    if many > reader_files:
        others = listed.where(~taken | (F.col("length") == 0))
        texts = listed.where(taken).where("length > 0").repartition(max(spark.sparkContext.defaultParallelism, many // NAMES))
        contents = with_content(texts, _store(spark, path)[0])
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        empty = spark.createDataFrame([(p, 0) for p in empty_files(found)], "path string, length long")
        others = found.where(~taken).select("path", "length").unionByName(empty)
        contents = found.where(F.col("length") <= limit).where(kind.isin(readable))
    columns = ["doc_id", "filename", "filetype", "size"]
    judged = gate_format(named(others).withColumnRenamed("length", "size"), max_mb=max_mb).select(
        *columns,
        F.lit(None).cast("string").alias("markdown"),
        F.lit("failed").alias("status"),
        F.coalesce("reject_reason", F.lit("needs an external converter")).alias("error"),
    )
    body = F.col("content").cast("string")
    texts = named(contents).select(
        "doc_id", "filename", "filetype", F.col("length").alias("size"), F.when(F.is_valid_utf8(body), body).alias("body")
    )
    return judged.unionByName(_converted(texts, columns))


def _converted(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Bodies as Markdown: direct formats as they are, HTML converted; a null body is one that is not UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, body in zip(batch["filetype"], batch["body"]):
                if body is None:
                    rows.append((None, "failed", "not_utf8"))
                elif kind != "html":
                    rows.append((body, "success", None))
                else:
                    rows.append(_page_row(body))
            told = pd.DataFrame(rows, columns=["markdown", "status", "error"], dtype=object)
            yield pd.concat([batch[columns].reset_index(drop=True), told], axis=1)

    return texts.mapInPandas(run, "doc_id string, filename string, filetype string, size long, markdown string, status string, error string")


class _Page(HTMLParser):
    """Collects Markdown lines; script, style, nav and footer are skipped with everything in them."""

    SKIPPED = {"script", "style", "nav", "footer"}
    BREAKS = {"p", "br", "div", "article", "section", "ul", "ol", "table", "tr", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip: list[str] = []
        self.head = False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "title":
            self.head = True
        elif tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif tag == "title":
            self.head = False
        elif re.fullmatch("h[1-6]", tag) or tag == "p":
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.parts.append(re.sub(r"\s+", " ", data))


def _page_markdown(html: str) -> str:
    page = _Page()
    page.feed(html)
    page.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(page.parts))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _page_row(body: str | None) -> tuple[str | None, str, str | None]:
    """(markdown, status, error) of one page."""
    try:
        text = _page_markdown(body or "")
    except Exception as error:  # noqa: BLE001
        return None, "failed", str(error)
    return (text, "success", None) if text else (None, "failed", "no text found")


def html_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, markdown, status, error); a page that cannot be read or has no text fails alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, *_page_row(body)) for name, body in zip(batch[key], batch[html])]
            yield pd.DataFrame(rows, columns=[key, "markdown", "status", "error"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, markdown string, status string, error string")


def chunk_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk-table rows: content and JSON metadata; ``documents`` has doc_id, kb_id, filename, filetype."""
    joined = chunks.join(documents.select("doc_id", "kb_id", "filename", "filetype"), "doc_id")
    metadata = F.to_json(
        F.struct(
            F.col("title").alias("documentTitle"),
            F.col("section_title").alias("sectionTitle"),
            F.col("heading_path").alias("headingPath"),
            F.col("heading_level").alias("headingLevel"),
            F.col("filetype").alias("sourceFileType"),
            F.col("filename").alias("originalFileName"),
            F.col("chunk_index").alias("chunkIndex"),
            F.col("section_chunk_index").alias("sectionChunkIndex"),
            F.col("char_start").alias("charStart"),
            F.col("char_end").alias("charEnd"),
        )
    )
    return joined.select(
        F.col("chunk_id").alias("id"), "kb_id", "doc_id", "content", metadata.alias("metadata"), "embedding_text"
    )


def sink_chunks(rows: DataFrame, path: str) -> None:
    """Writes the chunk table by knowledge base, so a search reads the folders of its own bases only.

    A large base is written by many tasks; rows are not gathered by kb_id.
    """
    rows.write.mode("overwrite").partitionBy("kb_id").parquet(path)


def sink_eval(path: str, **tables: DataFrame) -> None:
    """Dataset, per-question results and summary as JSON lines, one folder each."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
