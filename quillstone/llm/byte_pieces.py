"""Token ids of whole texts with a byte-level tokenizer, through a table of the pieces between spaces and line ends.

With its usual pattern a byte-level tokenizer starts a new pre-token at a single space or line end between visible
characters, and at a comma or full stop after a letter. Ids of a text cut there are the ids of its cuts in order, so a
cut that was met before needs no second encoding. Cuts are found, hashed and put together for a whole block of texts
at once. A new cut of Latin letters with marks after them is one pre-token or two, which go straight to the library's
model; its search for pre-tokens takes half of the time of others. Texts with runs of white space are encoded as they are. The table holds a bounded number of cuts, told apart
by 128 bits of hash and at most LONGEST bytes long; it affects speed only.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

from quillstone.llm.common import mix, powers

TABLE_PIECES = 300_000
LONGEST = 64
BLOCK_CHARS = 1 << 18
RUN = re.compile(r"\s\s")
WHITE = re.compile(r"\s")
CUT = re.compile(r"(?<=\S) (?=\S)")
# Bytes of white space other than space and line end, and first bytes of such characters beyond ASCII.
ODD = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"
# A word of Latin letters (those that all versions of Unicode call letters) and ASCII marks other than the apostrophe.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = re.compile(rf"( ?[{LATIN}]+)([!-&(-/:-@\[-`{{-~]*)")
MARK_THEN_LETTER = re.compile(rf"[^{LATIN}][{LATIN}]")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

# Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from U+0100 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def single_spaced(text: str, data: bytes) -> bool:
    """True where no two white-space characters touch and none stands first or last."""
    if not text or text[0].isspace() or text[-1].isspace():
        return False
    if len(data.translate(None, ODD)) == len(data):
        return not (b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data)
    return not RUN.search(text)


def parts(text: str, block: int = BLOCK_CHARS) -> Iterator[str]:
    """A long text in parts of about ``block`` characters; all but the first begin with a single space between visible characters."""
    at = 0
    while len(text) - at > block:
        found = CUT.search(text, at + block)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class PieceEncoder:
    """Encodes batches of texts; ids come back as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, block: int = BLOCK_CHARS) -> None:
        from tokenizers import Tokenizer

        self.block = block
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.line_end = self.whole(["\n"])[0]
        self.cuts = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not any(WHITE.search(t["content"]) or t.get("lstrip") or t.get("rstrip") for t in added)
            and not any("," in t["content"] or "." in t["content"] for t in added)
            and len(self.line_end) == 4
        )
        # no added token is a part of a word
        split = all(MARK_THEN_LETTER.search(t["content"]) for t in added)
        self.model = self.tokenizer.model if self.cuts and split and (spec.get("model") or {}).get("type") == "BPE" else None
        self._empty()

    def _empty(self) -> None:
        # key (sorted), second hash, blocks it was met in again, and where its ids are in the pool
        self.keys, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.met = np.empty(0, np.int32)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> list[bytes]:
        """Ids of pieces without line ends, encoded as lines of one text and told apart by the line ends."""
        if not words:
            return []
        found = self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        at = [-1, *np.flatnonzero(ids == np.frombuffer(self.line_end, "<u4")[0]).tolist(), len(ids)]
        if len(at) != len(words) + 1:
            return self.whole(words)
        data = ids.tobytes()
        return [data[4 * a + 4 : 4 * b] for a, b in zip(at, at[1:])]

    def _token_ids(self, token: str) -> bytes:
        """Ids of one pre-token."""
        plain = token.isascii()
        chars = token.replace(" ", BYTE_CHARS[32]) if plain else token.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = [t.id for t in self.model.tokenize(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: each begins with its space or line end, or is a mark."""
        out: list[bytes] = [b""] * len(pieces)
        spaced, lines, rest = [], [], []
        known: dict[str, bytes] = {}  # marks after words are mostly the same
        for i, p in enumerate(pieces):
            line = p[0] == "\n"
            if self.model and (word := WORD.fullmatch(p, 1 if line else 0)):
                letters, marks = word.groups()
                if marks and marks not in known:
                    known[marks] = self._token_ids(marks)
                out[i] = (self.line_end if line else b"") + self._token_ids(letters) + (known[marks] if marks else b"")
                continue
            kind = rest if len(p) == 1 or WHITE.search(p, 1) else spaced if p[0] == " " else lines if p[0] == "\n" else rest
            kind.append(i)
        for i, ids in zip(spaced, self._lines([pieces[i] for i in spaced])):
            out[i] = ids
        for i, ids in zip(lines, self._lines([pieces[i][1:] for i in lines])):
            out[i] = self.line_end + ids
        for i, ids in zip(rest, self.whole([pieces[i] for i in rest])):
            out[i] = ids
        return out

    def _remember(self, keys: np.ndarray, second: np.ndarray, at: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Adds pieces, in order of their keys, to the table; one that is full keeps what was met again, or starts anew."""
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.second = np.insert(self.keys, spot, keys), np.insert(self.second, spot, second)
        self.met = np.insert(self.met, spot, 0)
        self.at, self.size, self.pool = np.insert(self.at, spot, at), np.insert(self.size, spot, size), pool
        if len(self.keys) > TABLE_PIECES:
            kept = self.met > 0
            if kept.sum() > TABLE_PIECES * 3 // 4:
                return self._empty()
            self.keys, self.second, size = self.keys[kept], self.second[kept], self.size[kept]
            self.pool, self.met = gather(pool, self.at[kept], size), np.zeros(len(size), np.int32)
            self.at, self.size = (np.cumsum(size) - size).astype(np.int64), size

    def _block(self, data: list[bytes]) -> list[bytes]:
        """Ids of single-spaced texts. Each gets a line end in front, whose id is taken off again."""
        joined = b"\n" + b"\n".join(data)
        buffer = np.frombuffer(joined, np.uint8)
        white = (buffer == 32) | (buffer == 10)
        after = np.concatenate([white[1:], [True]])
        mark = ((buffer == 44) | (buffer == 46)) & after
        mark[1:] &= LETTER[buffer[:-1]]
        start = np.flatnonzero(white | mark)
        end = np.concatenate([start[1:], [len(buffer)]])
        hashes = []
        for base in BASES:
            sums = np.zeros(len(buffer) + 1, np.uint64)
            np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(base, len(buffer))[: len(buffer)], out=sums[1:])
            raw = (sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(buffer) + 1)[start]
            hashes.append(mix(raw + (end - start).astype(np.uint64)))
        short = np.flatnonzero(end - start <= LONGEST)
        unique, first, inverse = np.unique(hashes[0][short], return_index=True, return_inverse=True)
        first = short[first]
        twin = hashes[1][first]
        place = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        taken = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        hit = taken & (self.second[place] == twin) if len(self.keys) else taken
        # pieces to encode: those not in the table, long ones, and any whose first hash is another's
        alone = np.concatenate([np.flatnonzero(end - start > LONGEST), short[hashes[1][short] != twin[inverse]]])
        fresh = np.concatenate([first[~hit], alone])
        ids = self._encode_pieces([joined[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[fresh], end[fresh])])
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        places = len(self.pool) + np.cumsum(sizes) - sizes
        new = int((~hit).sum())
        entry_at, entry_size = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        entry_at[hit], entry_size[hit] = self.at[place[hit]], self.size[place[hit]]
        entry_at[~hit], entry_size[~hit] = places[:new], sizes[:new]
        at, size = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        at[short], size[short] = entry_at[inverse], entry_size[inverse]
        at[alone], size[alone] = places[new:], sizes[new:]
        out = gather(pool, at, size).tobytes()
        if len(self.keys):
            self.met[place[hit]] += 1
        kept = ~taken[~hit]
        self._remember(unique[~hit][kept], twin[~hit][kept], places[:new][kept], sizes[:new][kept], pool)
        edge = np.concatenate([[0], np.cumsum(size)])
        text_start = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        cut = edge[np.searchsorted(start, text_start)].tolist()
        return [out[4 * a + 4 : 4 * b] for a, b in zip(cut, cut[1:])]

    def _others(self, data: list[bytes]) -> list[bytes]:
        return self.whole([d.decode("utf-8", "surrogatepass") for d in data])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text. Texts are encoded in blocks of bounded size, long ones in parts, copies once."""
        each: dict[str, list[bytes]] = {t: [] for t in texts}
        waiting: dict[bool, list[tuple[str, bytes]]] = {True: [], False: []}
        volume = {True: 0, False: 0}

        def flush(spaced: bool) -> None:
            run = self._block if spaced else self._others
            rows, waiting[spaced], volume[spaced] = waiting[spaced], [], 0
            if rows:
                for (t, _), ids in zip(rows, run([d for _, d in rows])):
                    each[t].append(ids)

        for t in each:
            data = t.encode("utf-8", "surrogatepass")
            spaced = self.cuts and single_spaced(t, data)
            long = self.cuts and len(t) > self.block
            for d in (p.encode("utf-8", "surrogatepass") for p in parts(t, self.block)) if long else (data,):
                if volume[spaced] + len(d) > self.block:
                    flush(spaced)
                waiting[spaced].append((t, d))
                volume[spaced] += len(d)
        flush(True)
        flush(False)
        return [b"".join(each[t]) for t in texts]


def gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pool's spans (at, size) one after another."""
    shift = np.repeat(at - (np.cumsum(size) - size), size)
    return pool[shift + np.arange(len(shift))]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, block: int = BLOCK_CHARS) -> PieceEncoder:
    """This worker's encoder for blocks of about ``block`` characters: larger ones take less time and more memory.

    It is kept between tasks: loading it takes as long as some hundred texts, a new table is met by pieces that the old
    one knew, and both are of bounded size.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, block) not in _encoders:
        _encoders[path, block] = PieceEncoder(path, block)
    return _encoders[path, block]
