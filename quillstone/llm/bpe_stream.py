"""BPE as a streaming transducer with bounded lookahead, and an incremental byte-to-text decoder.

How far a later byte can reach back follows from the merge list. Compare the merges of a text with those of the text
and what comes after it, rank by rank: they agree on the left of a frontier that starts at the text's end. Only a merge
(u, v) across the frontier moves it, by the length of u; v then begins where the frontier was, so the u of the last such
merge is v, or its left part, or the left part of that, and so on; and its rank is higher. The longest sum of lengths
over such chains of merges is a sufficient lookahead: tokens that end that many bytes before the end of what was read
are stable. They are emitted and forgotten, so that a run without any cut needs constant memory.

Ahead of the merges, pieces are cut by the usual pattern of byte-level lists, and added tokens are found in the text;
both look a few characters ahead and carry on over the chunks of a text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import in_blocks, tidy

CHUNK_CHARS, RUN_CHARS, STEP_BYTES = 1 << 16, 1 << 12, 1 << 12
# Characters behind a piece that can still change it: two after an apostrophe, and the end of a run of white space.
PIECE_LOOKAHEAD = 3
# Pieces remembered (twice as many while the older half is given up) and their length; a matter of speed only.
MEMO_PIECES, MEMO_CHARS = 1 << 17, 32
SCAN_SYMBOLS = 128
NEVER = 1 << 62

# Kinds of characters that the cutting pattern tells apart: letters, numbers, white space; the rest are others.
KINDS = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list by ids, with its sufficient lookahead in bytes."""

    def __init__(self, spec: dict) -> None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        if not plain or before.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("the transducer needs a byte-level list with its usual pattern")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("added tokens have to stand as they are")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in self.added}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        left: dict[int, int] = {}
        reach: dict[int, int] = {}
        known = set(self.byte_ids)
        self.lookahead = 0
        for rank, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocabulary[u], vocabulary[v], vocabulary[u + v]
            if a not in known or b not in known or made in known:
                raise ValueError(f"merge {rank} is not made of earlier tokens, or makes one again")
            chain, part = reach.get(b, 0), b
            while part in left:
                part = left[part]
                chain = max(chain, reach.get(part, 0))
            chain += len(u)
            reach[a] = max(reach.get(a, 0), chain)
            self.lookahead = max(self.lookahead, chain)
            left[made] = a
            known.add(made)
            self.rank[a, b] = rank
            self.result.append(made)

    def tokens(self, data: bytes) -> list[int]:
        """Ids of a whole run: the pair of least rank is merged first, the leftmost of equal ones."""
        ids = [self.byte_ids[b] for b in data]
        if len(ids) > SCAN_SYMBOLS:
            return self._by_heap(ids)
        rank, result = self.rank.get, self.result
        ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [result[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) over a linked list; entries that no longer hold are passed over."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = self.result[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := rank((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [x for x in ids if x >= 0]


class Run:
    """Tokens of one run of bytes that comes bit by bit; holds the lookahead and one step at most."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""

    def feed(self, data: bytes, final: bool = False) -> list[int]:
        out: list[int] = []
        merges, need = self.merges, self.merges.lookahead + STEP_BYTES
        at = 0
        while at < len(data):
            take = max(1, need - len(self.held))
            self.held += data[at : at + take]
            at += take
            if len(self.held) >= need:
                stable, end = len(self.held) - merges.lookahead, 0
                for token in merges.tokens(self.held):
                    size = len(merges.bytes_of[token])
                    if end + size > stable:
                        break
                    out.append(token)
                    end += size
                self.held = self.held[end:]
        if final:
            out += merges.tokens(self.held)
            self.held = b""
        return out


def library_kinds(tokenizer: str) -> list[tuple[int, int, str]]:
    """(first, last, kind) of runs of code points that the library takes for letters, numbers, white space or others.

    Its tables and those of ``regex`` may be of different Unicode versions. All code points in order are cut by the
    library once; a piece has one kind, which two short probes tell.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    edges = sorted({0, *(a for _, (a, _) in cut("".join(map(chr, points)))), *range(0x100)})
    out = []
    for a, b in zip(edges, [*edges[1:], len(points)]):
        c = chr(points[a])
        kind = "L" if len(cut("a" + c)) == 1 else "N" if len(cut("1" + c)) == 1 else "O" if len(cut("!" + c)) == 1 else "S"
        out.append((points[a], points[b - 1], kind))
    return out


class Pieces:
    """The cutting pattern. Texts with a character on whose kind ``regex`` and the library differ use written-out classes."""

    def __init__(self, kinds: list[tuple[int, int, str]]) -> None:
        self.odd = np.zeros(0x110000, bool)
        own = {k: regex.compile(v) for k, v in KINDS.items()}
        written = {k: [] for k in KINDS}
        for first, last, kind in kinds:
            if kind in written:
                written[kind].append(f"\\U{first:08x}-\\U{last:08x}")
            span = "".join(chr(c) for c in range(first, last + 1) if not 0xD800 <= c < 0xE000)
            codes = np.frombuffer(span.encode("utf-32-le"), "<u4")
            for k, pattern in own.items():
                flags = np.zeros(len(codes), bool)
                for found in regex.finditer(pattern.pattern + "+", span):
                    flags[found.start() : found.end()] = True
                self.odd[codes[flags != (k == kind)]] = True
        self.plain = self._compiled(KINDS)
        self.exact = self._compiled({k: "".join(v) for k, v in written.items()})

    @staticmethod
    def _compiled(kinds: dict[str, str]) -> dict:
        """The cutting pattern, and for each kind the pattern of a run of it."""
        l, n, s = (kinds[k] for k in "LNS")
        # fixed: the pattern that byte-level lists of this kind are made with
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
        out = {"cut": regex.compile(pattern)}
        out |= {k: regex.compile(f"[{v}]*") for k, v in kinds.items()}
        out["O"] = regex.compile(f"[^{''.join(kinds.values())}]*")
        return out

    def of(self, text: str) -> dict:
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
            return self.plain
        return self.exact


class Encoder:
    """Text in, ids out, in chunks of any size; between calls it holds a bounded number of characters and bytes."""

    def __init__(self, spec: dict, kinds: list[tuple[int, int, str]]) -> None:
        self.merges, self.pieces = Merges(spec), Pieces(kinds)
        longest_first = sorted(self.merges.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.hold = max(map(len, longest_first), default=1) - 1
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._start()

    def _start(self) -> None:
        self.tail = ""  # may begin an added token
        self.rest = ""  # pieces that are not settled yet
        self.run: tuple[Run, str] | None = None  # a run too long to be held, and its kind

    def _piece(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.merges.tokens(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = found
        return found

    def _ids(self, pieces: list[str]) -> bytes:
        found = list(map(self.memo.get, pieces))
        if None in found:
            found = [f if f is not None else self.memo.get(p) or self._piece(p) for f, p in zip(found, pieces)]
        return b"".join(found)

    def _in_run(self, final: bool) -> bytes:
        """Goes on with a long run: its characters go through the transducer, the first other one ends it.

        The last character of white space belongs to what follows, unless nothing does.
        """
        run, kind = self.run
        end = self.pieces.of(self.rest)[kind].match(self.rest).end()
        over = end < len(self.rest) or final
        if kind == "S" and not (final and end == len(self.rest)):
            end = max(0, end - 1)
        data, self.rest = self.rest[:end].encode("utf-8", "surrogatepass"), self.rest[end:]
        ids = np.array(run.feed(data, over), "<u4").tobytes()
        if over:
            self.run = None
        return ids

    def _segment(self, text: str, final: bool) -> bytes:
        """Ids of the pieces that are settled once ``text`` is read; ``final`` where an added token or the end follows."""
        self.rest += text
        out = [self._in_run(final)] if self.run else []
        if self.run:
            return out[0]
        patterns = self.pieces.of(self.rest)
        found = patterns["cut"].findall(self.rest)
        if final:
            self.rest = ""
            return b"".join([*out, self._long(found)])
        settled, end = len(found), len(self.rest)
        while settled and end > len(self.rest) - PIECE_LOOKAHEAD:
            settled -= 1
            end -= len(found[settled])
        out.append(self._long(found[:settled]))
        self.rest = self.rest[end:]
        if len(self.rest) > RUN_CHARS and len(found[settled]) > RUN_CHARS - PIECE_LOOKAHEAD:
            last = found[settled][-1]
            kind = next(k for k in "LNSO" if patterns[k].match(last).end())
            run = Run(self.merges)
            if kind != "S" and found[settled][0] == " ":  # the space in front is of another kind
                out.append(np.array(run.feed(b" "), "<u4").tobytes())
                self.rest = self.rest[1:]
            self.run = run, kind
            out.append(self._in_run(False))
        return b"".join(out)

    def _long(self, pieces: list[str]) -> bytes:
        """Ids of whole pieces; those beyond RUN_CHARS go through the transducer."""
        if not pieces or max(map(len, pieces)) <= RUN_CHARS:
            return self._ids(pieces)
        out = []
        for piece in pieces:
            if len(piece) <= RUN_CHARS:
                out.append(self._ids([piece]))
            else:
                out.append(np.array(Run(self.merges).feed(piece.encode("utf-8", "surrogatepass"), True), "<u4").tobytes())
        return b"".join(out)

    def feed(self, text: str, final: bool = False) -> bytes:
        """Ids that are settled after ``text``, as little-endian unsigned 32-bit numbers; all that is left where final."""
        self.tail += text
        out, at = [], 0
        for found in self.added.finditer(self.tail) if self.added else ():
            if not final and found.start() > len(self.tail) - self.hold - 1:
                break  # a longer added token may begin here
            out.append(self._segment(self.tail[at : found.start()], True))
            out.append(np.array([self.merges.added[found[0]]], "<u4").tobytes())
            at = found.end()
        end = len(self.tail) if final else max(at, len(self.tail) - self.hold)
        out.append(self._segment(self.tail[at:end], final))
        self.tail = self.tail[end:]
        if final:
            self._start()
        return b"".join(out)

    def encode(self, text: str, chunk: int = CHUNK_CHARS) -> bytes:
        if len(text) <= chunk:
            return self.feed(text, True)
        ids = [self.feed(text[at : at + chunk]) for at in range(0, len(text), chunk)]
        return b"".join([*ids, self.feed("", True)])


def unfinished(data: bytes) -> int:
    """Bytes at the end that begin a character and may still become one: 0 to 3."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead & 0xC0 == 0x80:
            continue
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
        if size <= back:
            return 0
        if back > 1:  # the byte after the lead decides about overlong forms, surrogates and what is beyond the last code
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
            if not low <= data[1 - back] <= high:
                return 0
        return back
    return 0


class Decoder:
    """Ids in, text out; the state is the bytes of one unfinished character. Ids without a token are passed over."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)]
        self.held = b""

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        known = ids[ids < len(self.table)]
        data = self.held + b"".join(map(self.table.__getitem__, known.tolist()))
        keep = 0 if final else unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def decode(self, ids: np.ndarray, step: int = CHUNK_CHARS) -> str:
        parts = [self.feed(ids[at : at + step]) for at in range(0, len(ids), step)]
        return "".join([*parts, self.feed(ids[:0], True)])


def spec_of(tokenizer: str) -> dict:
    with open(tokenizer, encoding="utf-8") as f:
        return json.load(f)


def encode(docs: DataFrame, tokenizer: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit numbers.

    The tokenizer's file is read on the driver; its size bounds what the tasks are sent. A null text counts as empty and
    has no ids. Rows that repeat a doc_id are rows of their own, null ones too. Columns besides doc_id and text are not
    looked at; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((spec_of(tokenizer), library_kinds(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for block in in_blocks(batch, "text"):
                ids = [encoder.encode(t or "", chunk) for t in block.column(1).to_pylist()]
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([block.column(0), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, tokenizer: str, step: int = CHUNK_CHARS) -> DataFrame:
    """Adds ``text``, decoded from ``ids``. Bytes that are no UTF-8 become the replacement character, null ids a null."""
    shared = coded.sparkSession.sparkContext.broadcast(Merges(spec_of(tokenizer)).bytes_of)
    at = coded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for block in in_blocks(batch, "ids"):
                rows = block.column(at).to_pylist()
                texts = [None if i is None else decoder.decode(np.frombuffer(i, "<u4"), step) for i in rows]
                yield block.append_column("text", pa.array(texts, pa.string()))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(tidy(run), f"{shape}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what :func:`encode` and :func:`decode` return: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    texts = decode(encode(docs, tokenizer), tokenizer)
    return texts.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
