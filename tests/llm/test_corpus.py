"""The corpus operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import itertools
import math
import random
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillstone.llm import (
    archives,
    byte_pieces,
    exact_dedup,
    language,
    licences,
    line_join,
    mixing,
    near_dedup,
    outliers,
    packing,
    token_records,
)
from quillstone.llm.common import drop_rows, keep_rows, shingle_sets
from quillstone.llm.components import components
from quillstone.llm.queries import tokenizer_file
from quillstone.sources.tables import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, keep_id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(7)
VOCABULARY = ["the", "river", "stone", "quill", "müde", "été", "niño", "of", "and", "house", "seven", "lamps", "light"]


def prose(words: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(words))


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows() -> list[tuple]:
    base = prose(80)
    words = base.split()
    texts = [None, "", " \n\t ", "Same TEXT é", "same text é", "Same text É", "x", "x y", base, base.upper(), "漢字 テスト", prose(30_000)]
    for k in range(12):  # near copies with one to twelve changed words
        changed = list(words)
        for i in range(k + 1):
            changed[(7 * i + k) % 80] = f"edit{k}x{i}"
        texts.append(" ".join(changed))
    texts += ["x"] * 5 + [prose(60) + "\n# * | " + prose(3)] + [prose(rng.randrange(40, 200)) for _ in range(20)]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", ""][i % 4], None, "k", "s", 1) for i, t in enumerate(texts)]
    return rows + [(3, "Same TEXT é", "en", "a", 1, "k", "s", 1), (None, "no id", "en", None, 1, "k", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clean(df):
    """Rows that have one id each, as brute force by id needs."""
    return df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("bits", [64, 7])
def test_exact_dedup(docs, bits):
    groups = collections.defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    got = exact_dedup.exact_dedup(docs, bits).collect()
    want = []
    for r in rows:
        ids = groups[fold(r.text)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(fold(r.text).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    left = exact_dedup.drop_exact(docs, bits)
    assert left.columns == docs.columns and left.count() == sum(w[3] for w in want)


def test_filters_merge_without_loss():
    values = np.random.default_rng(1).integers(0, 1 << 20, 5000, dtype=np.uint64)
    parts = []
    for part in np.array_split(values, 7):
        v, n = np.unique(part, return_counts=True)
        parts.append(exact_dedup.pack_filter(v, n, 9))
        back = exact_dedup.unpack_filter(parts[-1], 9)
        assert (back[0] == v).all() and (back[1] == n).all()
    v, n = exact_dedup.merge_filters(parts, 9)
    assert dict(zip(v.tolist(), n.tolist())) == collections.Counter(values.tolist())


def test_row_filters(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("__x"))
    ids = spark.range(0, 2000, 7).select(F.col("id").alias("doc_id"))
    assert sorted(r.doc_id for r in keep_rows(rows, ids).collect()) == list(range(0, 2000, 7))
    assert sorted(r.doc_id for r in drop_rows(rows, ids).collect()) == [i for i in range(2000) if i % 7]


def sets_by_id(rows, k):
    out = {}
    for r in rows:
        w = fold(r.text).encode().split()
        out[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shingle,percent,block", [(3, 85, 1024), (5, 80, 3)])
def test_near_dedup(docs, shingle, percent, block):
    rows = clean(docs).collect()
    sets = sets_by_id(rows, shingle)
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = reachable(sets, links)
    got = near_dedup.near_dedup(clean(docs), shingle, percent, block).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), c, i == c) for i, c in want.items()}
    everything = near_dedup.near_dedup(docs, shingle, percent, block)
    assert everything.count() == docs.count()
    assert [tuple(r) for r in everything.where("doc_id IS NULL").collect()] == [(None, 1 if shingle > 2 else 0, None, True)]


def test_large_bucket_links_match_pairs():
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(70):
        changed = list(base)
        for i in range(k % 9):
            changed[rng.randrange(120)] = f"e{k}-{i}"
        texts.append(" ".join(changed).encode())
    sets = shingle_sets(texts, 3)
    near = near_dedup.linked(sets, 85)
    for i, j in itertools.combinations(range(70), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        assert near[i, j] == (100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common))
    want = reachable(range(70), [(i, j) for i, j in itertools.combinations(range(70), 2) if near[i, j]])
    assert near_dedup.local_roots(near).tolist() == [want[i] for i in range(70)]


def test_bands_suit_the_threshold():
    assert near_dedup.band_rows(80) == 4 and near_dedup.band_rows(85) == 5
    values = np.random.default_rng(11).integers(0, 1 << 63, (5000, 100), dtype=np.uint64)
    missed = 0
    for v in values:  # 80 of 100 in common: exactly at 0.8
        pair = np.stack([near_dedup.min_max(v[:90]), near_dedup.min_max(v[10:])])
        keys = near_dedup.band_keys(pair, near_dedup.band_rows(80))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 3)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reachable({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, times):
    chars = list(text)
    for _ in range(times):
        i = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("abcé")
        elif kind == 1:
            chars.insert(i, rng.choice("abcé"))
        elif len(chars) > 1:
            del chars[i]
    return "".join(chars)


def test_edit_distance_and_segments():
    for _ in range(1500):
        most = rng.randrange(1, 4)
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(6, 30)))
        b = edited(a, rng.randrange(5))
        d = distance(a, b)
        assert line_join.edit_distance(a, b, most) == min(d, most + 1)
        if d <= most:
            assert line_join.segment_keys(a, most) & line_join.segment_keys(b, most)


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    base = "".join(rng.choice("abcdef ") for _ in range(33)) + "end"
    lines = [edited(base, rng.randrange(4)) for _ in range(90)] + ["short", "shorT", "", "  ", "short"]
    texts = ["\n".join(rng.sample(lines, 8)) for _ in range(25)] + [None, "", "\n\n", "short"]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int").repartition(4)
    occurrences = collections.defaultdict(list)
    for i, t, _ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                occurrences[line].append((i, k))
    names = sorted(occurrences)
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if min(len(a), len(b)) >= 20 and distance(a, b) <= threshold]
    part = reachable(names, pairs)
    first = {}
    for line in names:
        first[part[line]] = min(first.get(part[line], (99, 0)), min(occurrences[line]))
    gone = collections.defaultdict(list)
    for line in names:
        for at in occurrences[line]:
            if at != first[part[line]]:
                gone[at[0]].append(at[1])
    got = line_join.line_dedup(df, threshold)
    assert {r.doc_id: r.dropped for r in got.collect()} == {i: " ".join(map(str, sorted(gone[i]))) for i, _, _ in rows}
    left = {r.doc_id: r.text for r in line_join.without_lines(df, got).collect()}
    for i, t, _ in rows:
        assert left[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]))


def test_near_lines_meet_at_every_length():
    for n in [*range(20, 260, 3), 299, 300, 999, 1000, 3001]:
        line = "".join(rng.choice("abcdef ") for _ in range(n))
        other = edited(line, line_join.edits_for(n, None))
        most = line_join.edits_for(min(n, len(other)), None)
        if line_join.edit_distance(line, other, most) > most:
            continue
        assert line_join.segment_keys(line, None) & line_join.segment_keys(other, None), n
        # the longer line's probes and segments meet the segments of the shorter, without the shorter one's probes
        low, high = sorted((line, other), key=len)
        own = set(line_join.keys_at([low], False, None)[0].tolist())
        assert own & line_join.segment_keys(high, None), n
    many = ["".join(rng.choice("abc ") for _ in range(n)) for n in (30, 200, 5, 201, 450, 5000)]
    for probes in (False, True):
        keys, counts = line_join.keys_at(many, probes, None)
        single = [line_join.keys_at([x], probes, None)[0].tolist() for x in many]
        assert keys.tolist() == [k for x in single for k in x] and counts.tolist() == [len(x) for x in single]
    for n in range(200, 100_000):
        assert (line_join.edits_for(n, None) + 1) * line_join.WIDTH <= n
    for n in (200, 1999, 2000, 30_000):
        start, size, _ = line_join.probe_places(n, None)
        assert start.min() >= 0 and (start + size).max() <= n and len(start) <= n + line_join.FAR**2


def test_edit_distance_of_long_lines():
    def plain(a, b):
        row = np.arange(len(a) + 1)
        codes = np.frombuffer(a.encode("utf-32-le"), "<u4")
        for j, c in enumerate(b, 1):
            best = np.concatenate([[j], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))])
            row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
        return int(row[-1])

    for n in (90, 400, 1500):
        for _ in range(12):
            a = "".join(rng.choice("abc ") for _ in range(n))
            b = edited(a, rng.randrange(1, n // 20))
            d = plain(a, b)
            for most in (d - 1, d, d + 1, d + 40):
                assert line_join.edit_distance(a, b, most) == line_join.edit_distance(b, a, most) == min(d, most + 1)
    line = "".join(rng.choice("abcdef ") for _ in range(120_000))
    other = edited(line, 2000)
    assert line_join.edit_distance(line, other, 2400) <= 2000
    assert line_join.segment_keys(line, None) & line_join.segment_keys(other, None)


def test_line_dedup_by_length(spark):
    lines = []
    for n in (15, 30, 50, 59, 62, 150, 198, 200, 202, 330, 500):
        base = "".join(rng.choice("abcdef ") for _ in range(n)) + "end"
        lines += [edited(base, rng.randrange(2 + 2 * line_join.edits_for(n, None))) for _ in range(8)]
    lines += [edited("y" + "".join(rng.choice("abcdef ") for _ in range(230)), 0)] * 2
    base = "".join(rng.choice("abcdef ") for _ in range(260))
    lines += [edited(base, rng.randrange(9)) for _ in range(70)]
    lines = list(dict.fromkeys(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    links = []
    for a, b in itertools.combinations(range(len(lines)), 2):
        n = min(len(lines[a]), len(lines[b]))
        most = max(min(3, n // 20), n // 50)
        if n >= 20 and line_join.edit_distance(lines[a], lines[b], most) <= most:
            links.append((a, b))
    part = reachable(range(len(lines)), links)
    got = {r.doc_id: r.n_dropped for r in line_join.line_dedup(df).collect()}
    assert got == {i: int(part[i] != i) for i in range(len(lines))}
    report = "On the evening of the third day the committee agreed to move the meeting of the {} to a later week."
    near = spark.createDataFrame([(1, report.format("17 May")), (2, report.format("28 May"))], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_join.line_dedup(near).collect()} == {1: 0, 2: 1}


def test_lines_of_one_segment_without_a_partner_get_no_text():
    own = random.Random(11)
    shared = "".join(own.choice("abcdef ") for _ in range(60))
    lines = [shared + "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(40)]
    lines += [lines[3][:200] + "Z" + lines[3][201:], lines[7] + "zé", "\ud800" + lines[7]]
    group = np.zeros(len(lines), np.int64)
    group[20:40] = 1
    order = sorted(range(len(lines)), key=lambda i: (group[i], len(lines[i])))
    group, lines = group[order], [lines[i] for i in order]
    size = np.array([len(x) for x in lines])
    found = line_join.with_partner(group, size, line_join.letter_counts(lines), None)
    near = set()
    for a, b in itertools.combinations(range(len(lines)), 2):
        most = line_join.edits_for(min(size[a], size[b]), None)
        if group[a] == group[b] and line_join.edit_distance(lines[a], lines[b], most) <= most:
            near |= {a, b}
    assert len(near) == 5 and set(np.flatnonzero(found).tolist()) == near
    assert line_join.with_partner(group[:0], size[:0], line_join.letter_counts([]), None).tolist() == []


def test_probes_in_slices_are_those_of_one_pass(spark, monkeypatch):
    own = random.Random(12)
    lines = []
    for n in (25, 50, 80, 150, 230, 400):
        base = "".join(own.choice("abcdef ") for _ in range(n)) + "end"
        for _ in range(8):
            at = own.randrange(n)
            lines.append(base[:at] + own.choice("xyz") + base[at + own.randrange(2) :])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    index = line_join.materialise(line_join.segment_rows(df, None, 20), "index")
    exact = index.select("seg").distinct()
    once = line_join.probe_rows(df, index, None, 20).join(exact, "seg", "left_semi").distinct().collect()
    monkeypatch.setattr(line_join, "PROBE_WORDS", index.count() // 20)
    sliced = line_join.probe_rows(df, index, None, 20)
    assert once and sorted(sliced.join(exact, "seg", "left_semi").distinct().collect()) == sorted(once)


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_whole_texts(tokens):
    enc = byte_pieces.PieceEncoder(tokenizer_file())
    texts = ["".join(rng.choice(" \n\tab,.1'é<日t") for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["don't. we'll, x", "a <|endoftext|> b", "z" * 300 + " y", "a\xa0b c", "", " ", "\n"] + [r[1] or "" for r in odd_rows()]
    want = [np.array(tokens(t), "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want and enc.encode(texts) == want
    for block in (7, 1 << 19):  # texts longer than a block are encoded in parts
        assert byte_pieces.PieceEncoder(tokenizer_file(), block).encode(texts) == want


def test_token_records(docs, none, tokens, tmp_path):
    rows = sorted(clean(docs).collect(), key=lambda r: r.doc_id)
    manifest = token_records.write_records(clean(docs), tokenizer_file(), str(tmp_path / "t"), shard_bytes=2000)
    assert manifest.count() > 2
    want, start = [], 0
    for r in rows:
        ids = tokens(r.text) + [0]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_records.read_records(manifest).collect())) == want
    mixed = token_records.read_shuffled(manifest, 3).collect()
    assert {r.doc_id: list(r.ids) for r in mixed} == {r.doc_id: tokens(r.text) + [0] for r in rows}
    assert [r.place for r in mixed] == sorted(r.place for r in mixed) and [r.doc_id for r in mixed] != [r.doc_id for r in rows]
    assert token_records.token_records(docs, tokenizer_file()).count() == docs.count()
    assert token_records.token_records(none, tokenizer_file()).count() == 0


def test_damaged_record_raises():
    data = token_records.frame(b"payload")
    assert token_records.read_frame(io.BytesIO(data)) == b"payload" and token_records.read_frame(io.BytesIO(b"")) is None
    for bad in (data[:-1], data[:5], b"\x01" + data[1:], data[:14] + b"X" + data[15:]):
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bad))


def check_packing(rows, texts, tokens, capacity):
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, at = tokens(text) + [0], 0
        for k, p in enumerate(sorted(pieces[doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, crc(ids[at : at + p.length])) and (k == 0 or p.length == capacity)
            at += p.length
        assert at == len(ids)
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, none, tokens):
    texts = {r.doc_id: r.text for r in clean(docs).collect()}
    got = packing.best_fit_packing(clean(docs), tokenizer_file(), shard_pieces=10).collect()
    check_packing(got, texts, tokens, 2048)
    assert packing.best_fit_packing(docs, tokenizer_file()).where("doc_id = 3").count() == 2
    assert packing.best_fit_packing(none, tokenizer_file()).count() == 0


def fewest(sizes, capacity):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    cases = [sorted((rng.randrange(3, 26) for _ in range(rng.randrange(1, 13))), reverse=True) for _ in range(2000)]
    for sizes in [*cases, [25, 24, 18, 17, 17, 14, 11, 9, 8, 8, 5]]:
        bins = packing.complete_bins(np.array(sizes), 40)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 40 for b in bins)
        assert len(bins) == fewest(sizes, 40) >= packing.lower_bound(np.bincount(sizes, minlength=41), 40)
    assert packing.complete_bins(np.array([], int), 40) == []


def test_bin_completion_finds_full_bins():
    """Twelve full bins of three pieces each: best-fit misses nearly all such cases, the search finds most."""
    draw = random.Random(5)
    found = greedy = 0
    for _ in range(20):
        sizes = []
        for _ in range(12):
            a = draw.randrange(200, 1000)
            b = draw.randrange(200, 2048 - a - 100)
            sizes += [a, b, 2048 - a - b]
        counts = np.bincount(sizes, minlength=2049)
        greedy += len(packing.best_fit(counts.tolist(), 2048)) == 12
        bins = packing.complete_bins(np.array(sizes), 2048)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in bins)
        found += len(bins) == 12
    assert found > greedy, (found, greedy)


def test_bin_completion_stays_within_its_trials(monkeypatch):
    """A third of the pieces are full and one bin is missing to the lower bound: wider searches may not run on for it."""
    made = []

    class Counted(packing.Fillings):
        def __init__(self, *limits):
            super().__init__(*limits)
            made.append(self)

    monkeypatch.setattr(packing, "Fillings", Counted)
    draw = np.random.default_rng(3)
    sizes = np.where(draw.random(3000) < 0.35, 2048, np.clip(draw.lognormal(6.2, 1.1, 3000).astype(int) + 1, 1, 2048))
    mixed = draw.integers(400, 1501, 3000)
    for case in (sizes, mixed):
        made.clear()
        bins = packing.complete_bins(case, 2048)
        assert sorted(s for b in bins for s in b) == sorted(case.tolist()) and all(sum(b) <= 2048 for b in bins)
        # the first descent looks at most at (options + 1) sizes a node, for at most as many bins as there are pieces
        first = len(case) * packing.FILLING_NODES * (packing.OPTIONS + 1)
        assert sum(m.used for m in made) <= first + packing.SEARCH_TRIALS + 2048


def test_first_descent_ends_where_the_search_turns_back():
    """No filling of a bin is within the allowance before all pieces are placed: what is tried from there on is bounded."""

    class Bounded(packing.Fillings):
        def of(self, *args):
            assert self.used <= 5000
            return super().of(*args)

    for seed in (46, 94, 99):
        sizes = np.minimum(1000, np.random.default_rng(seed).lognormal(5.5, 0.9, 300).astype(int) + 1)
        first = packing.best_fit(np.bincount(sizes, minlength=1001).tolist(), 1000)
        bins = packing.search(sizes, 1000, first, len(first) - 1, Bounded(4, 2, 2), 200)
        assert sorted(s for b in bins for s in b) == sorted(sizes.tolist()) and all(sum(b) <= 1000 for b in bins)
        assert len(bins) <= len(first)


def test_mixing(docs, none):
    rows = clean(docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # pour, stop what overflows, pour again
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            open_.remove(s)
    got = mixing.mix_sources(clean(docs)).collect()
    taken = collections.Counter()
    source = {r.doc_id: r.source for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and math.isclose(r.target, target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in names:
        largest = max(size[r.doc_id] for r in rows if r.source == s)
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(clean(docs).repartition(5)).collect()))
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_mixing_follows_the_weights(spark):
    rows = [(i, "ab" if i % 2 else "word like these", "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = mixing.mix_sources(df, share=0.25).collect()
    heavy = sum(r.copies for r in once if r["size"] == 3)
    light = sum(r.copies for r in once if r["size"] == 1)
    assert heavy > 300 and light > 0


def test_language(spark, docs, none):
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        (text,) = texts[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.identified_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in got)


def test_language_vectors_are_sums_of_bound_letters():
    word = [language.GAP, *map(ord, "abça"), language.GAP]
    want = np.zeros(language.DIMENSIONS)
    for grams in zip(word, word[1:], word[2:]):
        bound = np.ones(language.DIMENSIONS)
        for place, c in enumerate(grams):
            bound *= np.roll(language.letter_vector(c), place)
        want += bound
    got = language.text_vectors(["7 ABÇA!", None, "42"])
    assert (got[0] == want).all() and not got[1:].any()


def test_language_held_out_accuracy(spark, folder):
    source = table(spark, folder, "documents")
    rows = language.identify(source).join(source.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 40").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_archives(spark):
    bodies = ["", "x", None, "HTTP/1.1 200\r\n\r\n q", "é\r\n\r\n", "long " * 5000]
    rows = [(i, None if i % 7 == 0 else f"http://a b/{i}\n", bodies[i % 6], "m") for i in range(60)] + [(None, None, "only", "m")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    best = collections.defaultdict(list)
    for r in rows:
        best[r[2] or ""].append(r[0])
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        top = max((i for i in best[html or ""] if i is not None), default=None)
        revisit = page != top
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    files = archives.write_arc(pages, most_records=9)
    assert {r.version for r in files.collect()} == {"1", "2"}
    got = archives.warc_pages(archives.convert_arc(files))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    large = archives.warc_pages(archives.convert_arc(files, least_bytes=3)).where("record_type = 'revisit'")
    assert {r.payload_bytes for r in large.collect()} == {25_000, 18, len("é\r\n\r\n".encode())}
    assert archives.archive_pages(pages.limit(0)).count() == 0


def test_arc_parsing():
    old = b"filedesc://f 0.0.0.0 19970101000000 text/plain 20\n1 0 Origin\nURL IP\n\n\nhttp://a/b c 1.2.3.4 199702 text/html 5\n12345\n"
    bad = archives.version_block("1", "f") + b"http://a 1.2.3.4 1997 text/html 9\n123"
    new = archives.version_block("2", "f") + b"http://a 1.2.3.4 19970203040506 text/html 200 - - 0 f 3\nabc\n"
    records = list(archives.read_arc(io.BytesIO(new)))
    assert [(r.url, r.date, r.body) for r in records] == [("http://a", "19970203040506", b"abc")]
    for broken in (bad, old.replace(b" 5\n", b" x\n"), b"http://a 1.2.3.4 1997 text/html 3\nabc\n"):
        with pytest.raises((ValueError, KeyError)):
            list(archives.read_arc(io.BytesIO(broken)))
    assert archives.warc_date("199702") == "1997-02-01T00:00:00Z"


MIT = "\n".join(licences.SENTENCES["mit-grant"] + licences.SENTENCES["mit-notice"] + licences.SENTENCES["mit-warranty"])


def test_licences(spark):
    wrapped = re.sub(r"(.{40}\S*) ", r"\1\n * ", MIT)
    cases = {
        1: ("Copyright (c) 2020 A. Body\n\n" + wrapped, "MIT", 0),
        2: ("# Licensed under the Apache Licence, Version 2.0.\nSome prose.", "Apache-2.0", 0),
        3: ("prose. Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0 MIT", 0),
        4: ("We like the license of others. Permission is good.", "", 1),
        5: (None, "", 0),
        6: ("", "", 0),
        7: ("Copyright 2021 B\nAll rights reserved.", "all-rights-reserved", 0),
        9: ("All rights\nreserved.", "all-rights-reserved", 0),
        10: ("Released under CC BY 4.0.", "CC-BY-4.0", 0),
        8: ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "", 0),
    }
    df = spark.createDataFrame([(k, v[0], "x") for k, v in cases.items()], "doc_id long, text string, licences string")
    got = {r.doc_id: (r.licences, r.n_unknown) for r in licences.licence_scan(df).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    assert licences.licence_scan(df.limit(0)).count() == 0
    for sentence in licences.known():
        assert any(a in sentence for a in licences.ANCHORS)


def test_every_known_sentence_is_found(spark):
    names = [(name, sentence) for name, variants in licences.SENTENCES.items() for sentence in variants]
    rows = [(i, f"Some prose.\n\n// {sentence}\n\nMore prose.") for i, (_, sentence) in enumerate(names)]
    rows += [(1000 + i, f"Some prose. {sentence} \nMore prose.") for i, (_, sentence) in enumerate(names)]
    rows += [(2000 + i, "# " + sentence.replace(" ", "\n# ")) for i, (_, sentence) in enumerate(names)]
    alone = {seq[0]: licence for licence, seq in licences.RULES if len(seq) == 1}
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows:
        name = names[i % 1000][0]
        assert (got[i].sentence_ids, got[i].licences, got[i].n_unknown) == (name, alone.get(name, ""), 0)
    odd = ["SPDX-License-Identifier: Foo", "MIT", "This program is free software: take it.", "MIT\nSPDX-License-Identifier:\n"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    left = {r.doc_id: (r.licences, r.n_unknown) for r in licences.licence_scan(df).collect()}
    assert left == {0: ("", 1), 1: ("", 0), 2: ("", 0), 3: ("", 1)}


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    count = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, none):
    repeated = [(900, "a b c a b c a b c d\nx\nx\n \n \nx y", None, None, 1, "", "", 1)]
    df = clean(docs).union(docs.sparkSession.createDataFrame(repeated, SCHEMA))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in outliers.quality(df).collect():
        stats = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0]) and not (r.base_failed and r.kept)
    assert outliers.quality(none).count() == 0


def test_outliers_against_numpy(spark):
    local = random.Random(3)
    rows = []
    for i in range(400):
        text = " ".join(local.choice(VOCABULARY) + "abcdefg"[: local.randrange(7)] + str(local.randrange(900)) for _ in range(local.randrange(60, 160)))
        if i % 10 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en" if i < 300 else None, "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality(df).collect()}
    for lang in ("en", None):
        ids = [r[0] for r in rows if r[2] == lang]
        s = np.array([brute_stats(rows[i][1]) for i in ids], float)
        x = np.stack([np.log(s[:, 1] / s[:, 0]), np.log1p(100 * s[:, 2] / s[:, 0]), np.log1p(100 * s[:, 3] / s[:, 0]), np.log1p(100 * s[:, 4] / s[:, 0])], 1)
        floor = np.diag(np.array(outliers.FLOORS) ** 2)

        def low(v, q):
            return np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]

        centre, spread = low(x, 0.5), np.diag(((low(x, 0.75) - low(x, 0.25)) / 1.349) ** 2)
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread + floor), x - centre)
            core = x[d <= low(d, outliers.CORE)]
            centre, spread = core.mean(0), np.cov(core.T, bias=True) * outliers.CONSISTENCY
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread + floor), x - centre)
        for i, value in zip(ids, d):
            assert math.isclose(got[i].distance, value, rel_tol=1e-6, abs_tol=1e-9)
            assert got[i].kept == (value <= outliers.CUT)
        assert all(got[i].kept == (i % 10 != 0) for i in ids)


def test_outliers_rejects_what_is_far_from_its_group(spark):
    local = random.Random(4)
    words = [[local.choice(VOCABULARY) + str(local.randrange(9000)) for _ in range(100)] for _ in range(200)]
    texts = [" ".join(w) for w in words]
    texts[0] = " ".join(w + "#" * (i % 5 == 0) for i, w in enumerate(words[0]))  # 20 symbols per 100 words
    texts[1] = " ".join(w * 3 for w in words[1])
    texts[2] = " ".join(words[2][:80] + words[2][:80][-60:])
    texts[3] = " ".join(w + "#" * (i == 5) for i, w in enumerate(words[3]))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in outliers.quality(df).collect() if not r.kept and not r.base_failed) == [0, 1]
    assert math.isclose(math.exp(-outliers.CUT / 2) * (1 + outliers.CUT / 2), 0.001, rel_tol=1e-3)


def test_outliers_when_a_third_of_the_group_is_junk(spark):
    local = random.Random(5)
    rows = []
    for i in range(150):
        words = [local.choice(VOCABULARY) + str(local.randrange(9000)) for _ in range(100)]
        rows.append((i, " ".join(w + "###" * (i % 10 < 3) for w in words), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in outliers.quality(df).collect() if r.kept) == [i for i in range(150) if i % 10 >= 3]


def test_pipeline_stages(spark, docs, none, folder, tokens):
    frame = clean(docs).drop("kept", "size", "keep_id")
    given = {r.doc_id: r.text for r in frame.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = [r.doc_id for r in frame.collect()]
    texts = {i: t for i, t in given.items() if any(c.isalpha() for c in t or "")}
    assert sorted(after["language_id"]) == sorted(texts)
    largest = {fold(t): i for i, t in sorted(texts.items())}
    assert sorted(after["exact_dedup"]) == sorted(largest.values())
    left = [r for r in clean(docs).collect() if r.doc_id in set(largest.values())]
    sets = sets_by_id(left, 5)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(after["near_dedup"]) == sorted(set(reachable(sets, links).values()))
    assert set(after["mix_sources"]) <= set(after["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
    assert sum(r.length for r in packed) == sum(len(tokens(given[i])) + 1 for i in after["mix_sources"])
    blank = none.drop("kept", "size", "keep_id")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, blank, folder).count() == 0


def test_pipeline_drops_by_row(spark):
    """Ids that are missing or shared by other texts: no text is lost, one row of each group stays."""
    rows = [(None, "T"), (None, "T"), (3, "T"), (4, "U"), (4, "T"), (9, "t")]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_exact(spark, frame, "").collect()) == [(4, "U"), (9, "t")]
    base, other = prose(60), prose(60)
    near = " ".join(base.split()[:-1] + ["changed"])
    rows = [(None, base), (None, near), (None, other), (7, other), (7, base), (7, base), (8, near), (2, "short"), (2, "other short")]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near(spark, frame, "").collect())
    assert [t for _, t in left].count(other) == 1 and (2, "short") in left and (2, "other short") in left and (8, near) in left and len(left) == 4
    same = spark.createDataFrame([(5, base, "en", "a", 1)] * 50, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_exact(spark, same, "").count() == corpus_pipeline.drop_near(spark, same, "").count() == 1


def test_pipeline_stages_with_null_and_shared_ids(spark, docs, folder):
    """The whole fixture: after both stages every text that is no copy of another is there, by brute force over rows."""
    frame = docs.drop("kept", "size", "keep_id")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, frame = [tuple(r) for r in frame.collect()], stage(spark, frame, folder).cache()
        after = [tuple(r) for r in frame.collect()]
        assert not collections.Counter(after) - collections.Counter(before)
        if name == "exact_dedup":
            best = {}
            for r in before:
                key = fold(r[1])
                best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
            assert sorted((fold(r[1]), -1 if r[0] is None else r[0]) for r in after) == sorted(best.items())
        if name == "near_dedup":
            sets = sets_by_id([types.SimpleNamespace(doc_id=i, text=r[1]) for i, r in enumerate(before)], 5)
            links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            groups = collections.Counter(reachable(sets, links).values())
            assert len(after) == len(groups)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_licence_scan", "op2_exact_dedup", "op4_mix_sources"])
def test_queries_against_sql(spark, folder, name):
    from tests.oracle import compare, connect

    assert compare(__spark_entry__.queries()[name](spark, folder), connect(folder), __spark_entry__.oracle_sql()[name]) == []


def test_groups_of_lines_link_like_all_pairs():
    draw = random.Random(17)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(40)]
    lines = []
    for _ in range(6):
        line = " ".join(draw.choices(words, k=draw.randint(12, 60)))
        for _ in range(15):
            cut = list(line)
            for _ in range(draw.randint(0, 5)):
                cut[draw.randrange(len(cut))] = draw.choice("abcxyz ")
            lines.append("".join(cut))
    lines = sorted(set(lines))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    def parts(links, n):
        part = list(range(n))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return sorted(sorted(i for i in range(n) if part[i] == p) for p in set(part))

    near = []
    for i, a in enumerate(lines):
        for j in range(i):
            most = line_join.edits_for(min(len(a), len(lines[j])), None)
            if abs(len(a) - len(lines[j])) <= most and plain(a, lines[j]) <= most:
                near.append((i, j))
    n = len(lines)
    assert near and parts(line_join.group_links(list(range(n)), lines, None), n) == parts(near, n)
    # Each pair meets in the least group of both alone; together the groups link what all pairs link.
    among = [{draw.randrange(4) for _ in range(3)} | {9} for _ in lines]
    found = []
    for g in (0, 1, 2, 3, 9):
        held = [i for i in range(n) if g in among[i]]
        links = line_join.group_links(held, [lines[i] for i in held], None, [among[i] for i in held], g)
        assert all(min(among[a] & among[b]) == g for a, b in links)
        found += links
    assert parts(found, n) == parts(near, n)
