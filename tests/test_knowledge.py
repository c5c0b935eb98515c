"""The knowledge index: what is cut, what a second upload changes, and what a search reads."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import knowledge as kn
from quillstone.plans import corpus as cp

UPLOAD = "doc_id long, kb_id string, filename string, size long, text string"


def uploads(spark, rows):
    return spark.createDataFrame([(i, kb, name, 10, text) for i, kb, name, text in rows], UPLOAD)


ROWS = [
    (1, "a", "one.md", "# Stones\nrivers carry stones\n## Quills\ngeese give quills"),
    (2, "a", "two.txt", "# not a heading here\nlamps burn oil"),
    (2**45 + 7, "b", "far.md", "ink stains paper"),
    (4, "b", "four.pdf", "needs a converter"),
    (5, "b", "five.md", "  "),
    (6, None, "six.md", "no base"),
]


def test_uploads_become_chunks_by_type(spark):
    rows = {(r.doc_id, r.content): r for r in kn.uploaded_chunks(uploads(spark, ROWS)).collect()}
    assert set(rows) == {
        (1, "rivers carry stones"), (1, "geese give quills"), (2, "# not a heading here\nlamps burn oil"),
        (2**45 + 7, "ink stains paper"),
    }
    quills, far = rows[1, "geese give quills"], rows[2**45 + 7, "ink stains paper"]
    assert '"headingPath":["Stones","Quills"]' in quills.metadata and quills.embedding_text == "文档：one.md\n章节：Stones > Quills\n\ngeese give quills"
    assert far.document_title == "far.md" and far.chunk_id.startswith(f"{2**45 + 7}-chunk-0000-")
    assert '"sectionTitle":"far.md"' in far.metadata  # the title that was put in front


def test_hidden_vectors_and_policy_find_the_text_of_far_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    kn.write_index(kn.uploaded_chunks(uploads(spark, ROWS)), path)
    index = kn.read_index(spark, path)
    asked = spark.createDataFrame([("q1", "b", "ink stains paper"), ("q2", "a", "ink stains paper"), ("q3", "none", "ink")], "query_id string, kb_id string, query string")
    found = {(r.query_id, r.content): r for r in kn.rag_search(index, asked, min_rerank_score=None, final_top_k=2).collect()}
    assert found["q1", "ink stains paper"].document_id == 2**45 + 7 and not found["q1", "ink stains paper"].filtered
    assert {q for q, _ in found} == {"q1", "q2"} and all(r.kb_id == "a" for (q, _), r in found.items() if q == "q2")


def test_chunk_numbers_without_room_raise(spark):
    far = spark.createDataFrame([(2**45 + 7, 0)], "doc_id long, ix int")
    with pytest.raises(Exception, match="no room in a chunk number"):
        far.select(cp.chunk_id(F.col("doc_id"), F.col("ix"))).collect()


def modified(path):
    return {d: max(os.stat(f"{path}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("kb_id=")}


def test_second_upload_embeds_and_writes_only_what_changed(spark, tmp_path):
    path, calls = str(tmp_path / "index"), str(tmp_path / "calls")
    os.mkdir(calls)

    def embedder(batches):
        import uuid

        for batch in batches:
            for text in batch["text"]:
                with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                    f.write(text)
            yield batch.assign(embedding=[[float(len(t)), 1.0] for t in batch["text"]])[["key", "embedding"]]

    kn.write_index(kn.uploaded_chunks(uploads(spark, ROWS)), path, embedder)
    assert len(os.listdir(calls)) == 4
    before, stamps = {r.chunk_id for r in kn.read_index(spark, path).collect()}, modified(path)
    again = [(1, "a", "one.md", ROWS[0][3].replace("geese", "swans")), *ROWS[1:3]]
    docs = spark.createDataFrame([(1,), (2,), (2**45 + 7,)], "doc_id long")
    assert kn.refresh_index(spark, path, kn.uploaded_chunks(uploads(spark, again)), docs, embedder) == {"came": 1, "went": 1}
    assert len(os.listdir(calls)) == 5
    rows = {r.chunk_id: r for r in kn.read_index(spark, path).collect()}
    assert len(set(rows) - before) == len(before - set(rows)) == 1
    assert "swans give quills" in {r.content for r in rows.values()} and all(len(r.vector) == 2 for r in rows.values())
    after = modified(path)
    assert after["kb_id=b"] == stamps["kb_id=b"] and after["kb_id=a"] > stamps["kb_id=a"]
    # nothing new, then a document that is gone and leaves its base empty
    assert kn.refresh_index(spark, path, kn.uploaded_chunks(uploads(spark, again)), docs, embedder) == {"came": 0, "went": 0}
    gone = spark.createDataFrame([(2**45 + 7,)], "doc_id long")
    assert kn.refresh_index(spark, path, kn.uploaded_chunks(uploads(spark, [])), gone, embedder) == {"came": 0, "went": 1}
    assert {r.kb_id for r in kn.read_index(spark, path).collect()} == {"a"}
    assert len(os.listdir(calls)) == 5


def test_search_reads_the_folders_of_its_bases_and_texts_of_hits(spark, tmp_path):
    path = str(tmp_path / "index")
    kn.write_index(kn.uploaded_chunks(uploads(spark, ROWS)), path)
    asked = spark.createDataFrame([("q1", "a", "stones")], "query_id string, kb_id string, query string")
    found = kn.search_candidates(kn.read_index(spark, path), asked)
    plan = found._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "content" in line)
    assert "PartitionFilters" in scan and "kb_id" in scan.split("PartitionFilters")[1] and "vector" not in scan.split("ReadSchema")[1]
    assert "LeftSemi" in plan and found.count() == 3
