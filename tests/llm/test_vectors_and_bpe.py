"""Hard negatives, resident codes and the streaming transducer against brute force and the library, on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from quillstone.llm import bpe_stream, resident_lloyd, threshold_negatives
from quillstone.llm.queries import tokenizer_file
from quillstone.sources.tables import table

rng = random.Random(11)
VECTORS = "vec_id long, label int, vector array<float>, code string, error string, anchor boolean, n string"


def vector(width: int = 8) -> list[float]:
    return [rng.choice([-1, 1]) * rng.randrange(0, 64) / 64 for _ in range(width)]


def odd_vectors(n: int = 300) -> list[tuple]:
    """Ties, repeats, a vector that a third of the rows share, and rows that take no part."""
    hot = vector()
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else vector()
        rows.append((i, i % 4 if i % 11 else None, v, "c", "e", i % 10 == 0, "n"))
    rows += [rows[20], rows[31], (20, 1, vector(), "c", "e", True, "n"), (None, 2, vector(), "c", "e", True, "n")]
    rows.append((n + 5, 0, [0.0] * 8, "c", "e", True, "n"))
    for broken in (None, [], [None] * 8, [float("nan")] + [0.5] * 7, [0.5] * 7 + [float("inf")], [0.25] * 7 + [None]):
        rows.append((n + 10, 1, broken, "c", "e", True, "n"))
    rng.shuffle(rows)
    return rows


def whole(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows: list[tuple], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> list[tuple]:
    kept = [(r[0], r[1], [math.floor(256 * x) for x in r[2]], r[5]) for r in rows if whole(r[2]) and r[0] is not None and r[1] is not None]
    out = []
    for a in (r for r in kept if r[3]):
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept]
        best = sorted((s, i) for s, i, label in scored if label == a[1] and i != a[0])[:positives]
        for s, i in best:
            inside = sorted((t, j) for t, j, label in scored if label != a[1] and low * -s <= 100 * -t <= high * -s)
            out += [(a[0], i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("block_rows,anchor_rows", [(8192, 1 << 16), (32, 4)])
def test_hard_negatives_are_those_of_brute_force(spark, block_rows, anchor_rows):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = threshold_negatives.hard_negatives(df, block_rows=block_rows, anchor_rows=anchor_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_few_and_no_rows(spark):
    few = [(50, 1, [1.0, 0.5], "c", "e", True, "n"), (51, 1, [1.0, 1.0], "c", "e", False, "n"), (52, 2, [0.75, 0.25], "c", "e", False, "n")]
    got = threshold_negatives.hard_negatives(spark.createDataFrame(few, VECTORS)).collect()
    assert [tuple(r) for r in got] == brute_negatives(few) != []
    assert threshold_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert threshold_negatives.hard_negatives(spark.createDataFrame([r[:5] + (False, "n") for r in few], VECTORS)).count() == 0


def test_threshold_stops_before_the_lists_end():
    """One strong dimension: the threshold falls below the kth score long before all rows came up, and loses none."""
    draw = np.random.default_rng(3)
    numbers = draw.integers(-3, 4, (4000, 6)).astype(np.int16)
    numbers[:, 0] = draw.permutation(4000)
    anchors = np.array([[50, 1, -1, 0, 1, 0], [-50, 0, 0, 2, 0, 1]], np.int64)
    best = threshold_negatives.Best(2, 5)
    scored = threshold_negatives.threshold_scan(
        threshold_negatives.Lists(numbers), anchors, lambda active, bound: bound < best.score[active, -1], lambda a, rows, s: best.add(a, s, rows)
    )
    assert scored < 0.6 * 2 * len(numbers)
    for a, anchor in enumerate(anchors):
        full = sorted((-int(s), i) for i, s in enumerate(numbers.astype(int) @ anchor))[:5]
        assert [(-s, i) for s, i in zip(best.score[a].tolist(), best.id[a].tolist())] == full


def test_scores_of_large_components_are_exact(spark):
    rows = [(50, 1, [1.0e6, 3.0], "c", "e", True, "n"), (1, 1, [1.0e6, 1.0], "c", "e", False, "n"), (2, 1, [1.0e6, 1.0], "c", "e", False, "n")]
    rows += [(3, 2, [6.0e5, 2.0], "c", "e", False, "n"), (4, 2, [6.0e5, 2.0 + 1 / 256], "c", "e", False, "n")]
    got = threshold_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows) != []


def brute_codes(rows: list[tuple], entries: int = 256, rounds: int = 4) -> list[tuple]:
    kept = [(r[0], r[1], [math.floor(1024 * x) for x in r[2]]) for r in rows if whole(r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 4 if kept else 0
    books = [[r[2][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            held = [[] for _ in books[p]]
            for r in kept:
                part = r[2][p * width : (p + 1) * width]
                held[near(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*m)] if m else e for e, m in zip(books[p], held)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r in kept:
        found = [near(r[2][p * width : (p + 1) * width], books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[r[1]] = by_label.get(r[1], 0) + error
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), error, r[1]))
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("entries,owner_rows", [(16, 4096), (256, 7)])
def test_resident_codes_are_those_of_brute_force(spark, monkeypatch, entries, owner_rows):
    monkeypatch.setattr(resident_lloyd, "OWNER_ROWS", owner_rows)
    rows = odd_vectors()
    got = resident_lloyd.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(got.collect()) == ordered(brute_codes(rows, entries))


def test_resident_codes_of_few_no_and_large_rows(spark):
    few = [(i, None, [1.0e6 * (i - 1), 0.5, -0.25, 3.0], "c", "e", True, "n") for i in range(3)]
    got = resident_lloyd.vector_codes(spark.createDataFrame(few, VECTORS))
    assert ordered(got.collect()) == ordered(brute_codes(few))
    assert resident_lloyd.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        resident_lloyd.vector_codes(spark.createDataFrame([*few, (9, 1, [1.0] * 8, "c", "e", True, "n")], VECTORS).coalesce(1)).collect()


def test_only_members_that_change_entry_move():
    numbers = np.array([[0, 0], [10, 10], [11, 11]], np.int16)
    block = np.zeros(3, np.uint8), np.array([0, 1, 0], np.uint16), np.zeros(3, np.uint32), numbers

    class Books:
        value = np.array([[[0, 0], [10, 10]]])

    found = list(resident_lloyd.moved_out(iter([(5, block)]), Books, 4))
    stay, go = [b for m, _, b in found if not m], [(at, b) for m, at, b in found if m]
    assert [b[3].tolist() for b in stay] == [[[0, 0], [10, 10]]]
    assert [(at, b[1].tolist(), b[3].tolist()) for at, b in go] == [(int(resident_lloyd.owner(*go[0][1][:3], 4)[0]), [1], [[11, 11]])]


def test_codes_restore_to_their_entries(spark):
    rows = odd_vectors(60)
    df = spark.createDataFrame(rows, VECTORS)
    books = resident_lloyd.train(df)
    back = resident_lloyd.restore(resident_lloyd.encode(df.select("vec_id", "vector"), books), books)
    for r in back.collect():
        entry = [x for p, book in enumerate(books) for x in book[int(r.code[2 * p : 2 * p + 2], 16)].tolist()]
        assert r.vector == [(x + 0.5) / 1024 for x in entry]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.Encoder(bpe_stream.spec_of(tokenizer_file()), bpe_stream.library_kinds(tokenizer_file()))


def ids_of(encoder, text: str, chunk: int) -> list[int]:
    return np.frombuffer(encoder.encode(text, chunk), "<u4").tolist()


BITS = [
    "a", "b", "don't", "'ll", "'", "r", "e", " ", "  ", "\n", "\t", "é", "ß", "漢", "字", "1", "23", "½", "²", "!", "...", "_",
    "<|endoftext|>", "<|endo", "|>", "\x1c", "՘", "꟔", "😀", " ", "　", "the", "ing", "ation", "x" * 30,
]


def test_transducer_gives_the_ids_of_the_library_in_chunks_of_any_size(library, encoder):
    for _ in range(1500):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 50)))
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 2, 3, 7, 1 << 16):
            assert ids_of(encoder, text, chunk) == want


LONG = [
    "a" * 50_000, "ab" * 30_000 + " x", " " * 50_000 + "a", " " * 50_000, "漢字" * 20_000, "1" * 30_000, "!" * 20_000 + "a",
    "instructionallowable" * 2000, "\n" * 9000 + " b", " " + "é" * 20_000 + "1" * 7000,
]


def test_long_runs_go_through_bounded_memory(library, encoder):
    mixed = "".join(rng.choice(["instruction", "allow", "able", "al", "guarantee", "ing"]) for _ in range(5000))
    for text in [*LONG, mixed, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000))]:
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1000, 5000, 1 << 16):
            assert ids_of(encoder, text, chunk) == want
    most = 0
    for at in range(0, 50_000, 500):
        encoder.feed("q" * 500)
        run = encoder.run[0].held if encoder.run else b""
        most = max(most, len(run) + len(encoder.rest) + len(encoder.tail))
    encoder.feed("", True)
    assert most < bpe_stream.RUN_CHARS + bpe_stream.STEP_BYTES + encoder.merges.lookahead + 1000


def test_lookahead_settles_every_token(encoder):
    """Tokens that end a lookahead before the end stay whatever follows; the bound comes from the list alone."""
    merges = encoder.merges
    assert merges.lookahead == 320
    for _ in range(300):
        data = bytes(rng.choice(b"aeinorst ") for _ in range(500))
        more = data + bytes(rng.choice(b"aeinorstlg") for _ in range(200))
        stable, end = [], 0
        for token in merges.tokens(data):
            end += len(merges.bytes_of[token])
            if end > len(data) - merges.lookahead:
                break
            stable.append(token)
        assert merges.tokens(more)[: len(stable)] == stable


def test_a_chain_of_merges_needs_its_whole_lookahead():
    """Toy list: x(n) = letters from n on; whether the first two merge depends on the last letter of the chain."""
    letters = bpe_stream.byte_letters()
    vocabulary = {c: b for c, b in letters.items()}
    merges = [["d", "e"], ["c", "d"], ["b", "c"], ["a", "b"]]
    for u, v in merges:
        vocabulary[u + v] = len(vocabulary)
    spec = {"model": {"vocab": vocabulary, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    made = bpe_stream.Merges(spec)
    names = {i: t for t, i in vocabulary.items()}
    assert made.lookahead == 4
    assert [names[i] for i in made.tokens(b"abcd")] == ["ab", "cd"] and [names[i] for i in made.tokens(b"abcde")] == ["a", "bc", "de"]


def test_decoder_is_the_library_for_any_ids_in_any_steps(library, encoder):
    decoder = bpe_stream.Decoder(encoder.merges.bytes_of)
    raw = encoder.merges.byte_ids
    for n in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(10))] + [rng.choice(raw) for _ in range(rng.randrange(6))] + [60_000] * (n % 2)
        want = library.decode(ids, skip_special_tokens=False)
        for step in (1, 2, 5, 100):
            assert decoder.decode(np.array(ids, "<u4"), step) == want


def test_round_trip_of_odd_rows(spark, library):
    texts = [None, "", " ", "x", "x", "naïve 漢字 <|endoftext|> it's\n\n", "long " * 60_000, "z" * 100_000]
    rows = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(4, "other", "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(2)
    got = ordered(bpe_stream.round_trip(df, tokenizer_file()).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == ordered(want)
    coded = bpe_stream.encode(df, tokenizer_file(), chunk=777)
    assert {r.doc_id: r.text for r in bpe_stream.decode(coded, tokenizer_file(), step=5).where("doc_id in (1, 5, 7)").collect()} == {1: "", 5: texts[5], 7: texts[7]}
    assert bpe_stream.round_trip(df.where("false"), tokenizer_file()).count() == 0


def test_queries_over_whole_tables(spark, folder, library):
    queries = __spark_entry__.queries()
    docs = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    rows = queries["op12_bpe_stream"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    vectors = [(r.vec_id, r.label, r.embedding, "", "", r.vec_id % 50 == 0) for r in table(spark, folder, "embeddings").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, *rest) for i, label, *rest in vectors]
    assert sorted(map(tuple, queries["op11_hard_negatives"](spark, folder).collect())) == brute_negatives(moved)
    assert ordered(queries["op13_resident_codes"](spark, folder).collect()) == ordered(brute_codes(vectors))


def test_new_words_skip_the_search_for_pre_tokens(library, monkeypatch):
    from quillstone.llm import byte_pieces

    enc = byte_pieces.PieceEncoder(tokenizer_file())
    searched: list[str] = []
    lines, whole = enc._lines, enc.whole
    monkeypatch.setattr(enc, "_lines", lambda words: searched.extend(words) or lines(words))
    monkeypatch.setattr(enc, "whole", lambda texts: searched.extend(texts) or whole(texts))

    def ids(text):
        return struct.pack(f"<{len(i := library.encode(text, add_special_tokens=False).ids)}I", *i)

    plain = "an erthea rean***\nÉLE!! geüß hareat. thoution&&&\nEst andhahaed, équeré ɏz"
    assert enc.encode([plain]) == [ids(plain)] and set(searched) <= {".", ","}
    rng = random.Random(5)
    chars = "abZéßÀǀɏ×÷ªº'’-_.,!<|>endoftext12 \n　中ʰ"
    odd = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    odd += ["a <|endoftext|> b", "x<|endoftext|>y", "a |endoftext|> b<| c", "I don't it's!'s I'll", "a'$ b$'s"]
    assert enc.encode(odd) == [ids(t) for t in odd]
