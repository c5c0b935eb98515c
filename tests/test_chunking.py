"""Slices, sections and page folds against literal rows and a direct loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions.table_functions import register_table_functions
from quillstone.operators import chunking as ck
from quillstone.operators.positions import first_per_key
from quillstone.plans.catalog import QUERIES
from quillstone.sources import files


def loop_slices(text, size, overlap, least):
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if out and len(text) - end < least:
            end = len(text)
        out.append((start, end))
        if end == len(text):
            return out
        start = max(end - max(0, min(overlap, size - 1)), start + 1)


def test_slices_agree_with_a_loop(spark):
    rng = random.Random(7)
    for size, overlap, least in [(30, 5, 0), (10, 9, 3), (7, 0, 7), (12, 20, 5), (5, 2, 1), (1, 0, 0)]:
        texts = ["".join(rng.choice("ab知é😀") for _ in range(rng.randint(0, 90))) for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        cut = df.select("i", F.posexplode(ck.slices(F.col("t"), size, overlap, least)).alias("p", "s"))
        got: dict[int, list] = {}
        for r in cut.orderBy("i", "p").collect():
            got.setdefault(r.i, []).append((r.s.start, r.s.end, r.s.content))
        for i, text in enumerate(texts):
            assert got[i] == [(a, b, text[a:b]) for a, b in loop_slices(text, size, overlap, least)]


def chunks(spark, text, title="doc.md", **sizes):
    docs = spark.createDataFrame([(1, title, text)], "doc_id bigint, title string, text string")
    return ck.chunk_document(docs, **sizes).orderBy("chunk_index").collect()


def test_heading_paths_and_offsets(spark):
    long = "索引下推" * 15 + "结束"
    text = f"# MySQL\n基础内容\n## 索引\n索引内容\n### 索引下推\n{long}\n## 事务\n事务内容"
    rows = chunks(spark, text, max_chars=30, overlap_chars=5, min_chars=0)
    assert [" > ".join(r.heading_path) for r in rows] == ["MySQL", "MySQL > 索引", *["MySQL > 索引 > 索引下推"] * 3, "MySQL > 事务"]
    deep = [r for r in rows if len(r.heading_path) == 3]
    assert [(r.section_chunk_index, r.char_start, r.char_end) for r in deep] == [(1, 0, 30), (2, 25, 55), (3, 50, 62)]
    assert rows[0].embedding_text == "文档：doc.md\n章节：MySQL\n\n基础内容"


def test_preamble_skipped_levels_and_fences(spark):
    text = "前言\n\n### 跳级标题\n内容\n#### 空标题\n### 第二个标题\n```\n# not a heading\n```\n内容二"
    rows = chunks(spark, text)
    assert [r.heading_path for r in rows] == [["doc.md"], ["跳级标题"], ["第二个标题"]]
    assert "# not a heading" in rows[2].content and rows[0].heading_level == 1
    docs = spark.createDataFrame([(1, "d", text)], "doc_id bigint, title string, text string")
    assert [r.section_title for r in ck.section_pairs(docs).orderBy("section_id").collect()] == ["跳级标题", "空标题", "第二个标题"]


def test_plain_text_keeps_marks(spark):
    text = "## -p 指定密码\n" + "参数说明" * 12
    docs = spark.createDataFrame([(1, "mysql.pdf", text)], "doc_id bigint, title string, text string")
    rows = ck.plain_text_chunks(docs, max_chars=30, overlap_chars=5, min_chars=0).orderBy("chunk_index").collect()
    assert len(rows) > 1 and {tuple(r.heading_path) for r in rows} == {("mysql.pdf",)}
    assert [r.char_start for r in rows][:2] == [0, 25] and "## -p 指定密码" in rows[0].content


def test_heading_paths_agree_with_a_stack(spark):
    rng = random.Random(3)
    docs, expected = [], {}
    for d in range(60):
        lines, stack, paths = [], {}, []
        for i in range(rng.randint(1, 25)):
            level = rng.randint(1, 6)
            lines += ["#" * level + f" t{i}", "x"]
            stack = {k: v for k, v in stack.items() if k < level} | {level: f"t{i}"}
            paths.append([stack[k] for k in sorted(stack)])
        docs.append((d, "t", "\n".join(lines)))
        expected[d] = paths
    df = spark.createDataFrame(docs, "doc_id bigint, title string, text string")
    got: dict[int, list] = {}
    for r in ck.headed_lines(df).where("is_head").orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.path)
    assert got == expected


def test_page_fold(spark):
    pages = [(d, p, f"{d}{p} " + "word " * 40 + "\n\n" + "tail " * 20) for d in (1, 2) for p in (1, 2, 3, 4)]
    df = spark.createDataFrame(pages, "doc_id bigint, page int, text string")
    rows = ck.page_range_chunks(df, 300, 40).orderBy("doc_id", "ordinal").collect()
    for doc in (1, 2):
        mine = [r for r in rows if r.doc_id == doc]
        assert [r.ordinal for r in mine] == list(range(1, len(mine) + 1))
        assert mine[0].page_start == 1 and mine[-1].page_end == 4
        for a, b in zip(mine, mine[1:]):
            assert b.page_start == a.page_end and b.content.startswith(a.content[-40:].strip())


@pytest.mark.parametrize("target,overlap", [(60, 17), (25, 24), (40, 0)])
def test_page_ranges_follow_the_rule(spark, target, overlap):
    """Short paragraphs, blanks and line ends where the overlap starts, long paragraphs, empty pages."""
    rng = random.Random(target)
    docs = {
        d: [" ".join(rng.choice(["a", "bcd", "\u00a0e", "fghijklm" * rng.randint(1, 6), "漢"]) for _ in range(rng.randint(0, 12))).replace(" a ", "\n\n") for _ in range(rng.randint(1, 30))]
        for d in range(12)
    }
    docs[99] = ["", " \n "]
    rows = [(d, p, t) for d, pages in docs.items() for p, t in enumerate(pages, 1)]
    got: dict[int, list] = {}
    for r in ck.page_range_chunks(spark.createDataFrame(rows, "doc_id bigint, page int, text string"), target, overlap).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.page_start, r.page_end, r.content))
    for d, pages in docs.items():
        whole, ends, want, start, first = "", [], [], 0, None
        for page, text in enumerate(pages, 1):
            for paragraph in filter(None, (x.strip() for x in re.split(r"\n+", re.sub(r"[ \t\u3000]+", " ", text)))):
                whole += ("\n" if whole else "") + paragraph
                first = first or page
                ends.append((len(whole), page))
                if len(whole) - start >= target:
                    want.append((first, page, whole[start:]))
                    start = len(whole) - overlap if overlap else len(whole) + 1
                    start += len(whole[start:]) - len(whole[start:].lstrip())
                    first = page
        if ends and whole[start:]:
            want.append((first, ends[-1][1], whole[start:]))
        assert got.get(d, []) == want


def test_page_ranges_of_short_and_long_documents_are_the_same(spark, monkeypatch):
    """Documents that fit are gathered without the passes over spans; longer ones are not, and give the same chunks."""
    rng = random.Random(4)
    rows = [(d, p, "\n".join(" ".join(["word", "\u00a0x", "ab cd"][rng.randrange(3)] for _ in range(rng.randint(0, 9))) for _ in range(3))) for d in range(30) for p in range(rng.randint(1, 40))]
    rows += [(None, 1, "no id " * 50), (77, 1, None), (78, None, "first"), (78, 5, "then " * 30)]
    pages = spark.createDataFrame(rows, "doc_id bigint, page int, text string")
    key = lambda r: (r.doc_id, r.ordinal)
    long = sorted(ck.page_range_chunks(pages, 90, 30, gathered_chars=0).collect(), key=key)
    some = sorted(ck.page_range_chunks(pages, 90, 30, gathered_chars=900).collect(), key=key)
    assert long and some == long
    monkeypatch.setattr(ck, "_spanned", None)
    assert sorted(ck.page_range_chunks(pages, 90, 30).collect(), key=key) == long


def test_tables_survive_inline_stripping(spark):
    text = "a **bold** [link](http://x) `code`\n| a | **b** |\n> quoted"
    got = spark.createDataFrame([(text,)], "t string").select(ck.strip_inline_markup("t")).first()[0]
    assert got == "a bold link code\n| a | **b** |\nquoted"


def test_files_and_html(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\nx", encoding="utf-8")
    (tmp_path / "b.HTML").write_text("<h2>T &amp; U</h2><script>no()</script><p>one<br>two</p><ul><li>x</ul><nav>skip</nav>", encoding="utf-8")
    (tmp_path / "c.exe").write_text("zz")
    (tmp_path / "d.pdf").write_text("zz")
    (tmp_path / "e.txt").write_text("")
    rows = {r.filename: r for r in files.ingest_files(spark, str(tmp_path)).collect()}
    assert rows["a.md"].markdown == "# t\nx" and rows["a.md"].status == "success"
    assert rows["b.HTML"].markdown == "## T & U\n\none\ntwo\n\n- x"
    assert rows["c.exe"].error == "unsupported_type" and rows["d.pdf"].status == "failed"
    assert rows["e.txt"].error == "empty_file" and rows["e.txt"].size == 0


def test_one_bad_file_fails_alone(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "bad.txt").write_bytes(b"caf\xe9 au lait")
    (tmp_path / "sub" / "good.txt").write_text("café", encoding="utf-8")
    (tmp_path / "large.md").write_text("x" * 5000)
    (tmp_path / "none.html").write_text("")
    (tmp_path / "bad.html").write_bytes(b"<p>\xff\xfe")
    found = files.ingest_files(spark, str(tmp_path), max_mb=0.004)
    rows = {r.filename: (r.markdown, r.status, r.error) for r in found.collect()}
    assert rows == {
        "bad.txt": (None, "failed", "not_utf8"), "good.txt": ("café", "success", None), "large.md": (None, "failed", "too_large"),
        "none.html": (None, "failed", "empty_file"), "bad.html": (None, "failed", "not_utf8"),
    }
    plan = found._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len([x for x in scans if "content" in x.split("ReadSchema")[1]]) == 1 and "LessThanOrEqual(length" in plan
    assert files.ingest_files(spark, str(tmp_path / "sub")).count() == 2


def test_chunk_sink_is_partitioned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.md", "# h\nbody"), (2, "b.md", "text")], "doc_id bigint, title string, text string")
    base = docs.select("doc_id", F.concat(F.lit("kb"), "doc_id").alias("kb_id"), F.col("title").alias("filename"), F.lit("md").alias("filetype"))
    files.sink_chunks(files.chunk_rows(ck.chunk_document(docs), base), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where("kb_id = 'kb1'").collect()
    assert len(back) == 1 and '"headingPath":["h"]' in back[0].metadata and '"sectionChunkIndex":1' in back[0].metadata
    assert (tmp_path / "out" / "kb_id=kb2").exists()


def test_sql_table_function_agrees(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("texts_to_cut")
    register_table_functions(spark)
    by_sql = spark.sql("SELECT doc_id, c.* FROM texts_to_cut, LATERAL chunk_text(text, 500, 60, 40) c")
    by_column = ck.sliding_chunks(docs, F.col("text"), max_chars=500, overlap_chars=60, min_chars=40)
    columns = ["doc_id", "slice_ix", "char_start", "char_end", "content"]
    assert by_sql.select(columns).exceptAll(by_column.select(columns)).isEmpty()
    assert by_sql.count() == by_column.count()


def test_plans_stay_narrow_or_limited(spark, folder):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = plan(ck.sliding_chunks(docs.select("doc_id", "text"), F.col("text")))
    assert "Exchange" not in cut
    limited = plan(first_per_key(docs.select("source", "doc_id"), ["source"], [F.col("doc_id")], 3))
    assert limited.count("WindowGroupLimit") == 2
    searched = plan(QUERIES["knn_topk"](spark, folder))
    assert "NestedLoop" not in searched and "Cartesian" not in searched and "WindowGroupLimit" in searched


def test_empty_files_have_any_name_and_no_round_trips(spark, tmp_path):
    """The empty ones come from one list; their names are told as the scan tells others."""
    for name in ("a b+c%é.md", "plain.txt", "e +%20.txt", "ü.html", "full.md"):
        (tmp_path / name).write_text("# x" if name in ("a b+c%é.md", "full.md") else "", encoding="utf-8")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "none.exe").write_text("")
    (tmp_path / "_hidden.txt").write_text("")
    got = sorted((r.filename, r.size, r.error) for r in files.ingest_files(spark, str(tmp_path)).collect())
    empty = [(name, 0, "empty_file") for name in ("e +%20.txt", "none.exe", "plain.txt", "ü.html")]
    assert got == sorted([*empty, ("a b+c%é.md", 3, None), ("full.md", 3, None)])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    told = files.empty_files(found)
    assert {path.rsplit("/", 1)[1] for path in told} == {name for name, *_ in empty}
    assert {path[: path.index(str(tmp_path))] for path in [*told, *(r.path for r in found.collect())]} == {"file:"}


def test_many_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Beyond the reader's number no scan of files is planned, and the rows are those of the reader."""
    for folder in ("", "sub", "sub/deep=1", "_hid", ".dot", "a b%20c"):
        (tmp_path / folder).mkdir(exist_ok=True)
        for name, body in {
            "é +%20*.md": b"# x", "plain.txt": "caf\u00e9".encode(), "none.html": b"", "bad.md": b"\xff", "p.html": b"<h1>T</h1><p>x", "large.txt": b"x" * 5000,
            "c.exe": b"zz", "_hid.txt": b"x", "_a=1.txt": b"y", ".dot.md": b"x", "d.txt._COPYING_": b"x",
        }.items():
            (tmp_path / folder / name).write_bytes(body)
    key = lambda df: sorted(map(str, df.collect()))
    by_reader = files.ingest_files(spark, str(tmp_path), max_mb=0.004)
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        by_tasks = files.ingest_files(spark, path, max_mb=0.004, reader_files=0)
        assert "binaryFile" not in by_tasks._jdf.queryExecution().toString()
        assert key(by_tasks) == key(by_reader) and by_tasks.count() == 8 * 4
    listed = {r.path: r.length for r in files.listed_files(spark, str(tmp_path)).collect()}
    assert len(listed) == 8 * 4 and sum(x == 0 for x in listed.values()) == 4
    assert files.listed_files(spark, str(tmp_path / "*")) is None and files.listed_files(spark, str(tmp_path / "plain.txt")) is None
