"""Best-fit packing: bin completion around the largest piece, with best-fit solutions as incumbents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.byte_pieces import BLOCK_CHARS, encoder
from quillstone.llm.common import in_blocks, materialise, text_batches, tidy

SEQUENCE = 2048
END_ID = 0
# Pieces packed together: a random share of all pieces, so every shard has the corpus's mix of lengths.
SHARD_PIECES = 50_000
# Partial fillings looked at per largest piece, fillings kept of them and sizes tried for each next piece in the first
# search; every further search widens them. The sizes tried in all searches of a shard beyond the first descent of the
# first search are bounded; a wider search that runs out of them before its first bins are done gives way to the best.
FILLING_NODES, FILLINGS_KEPT, OPTIONS = 96, 4, 8
WIDER = 8
SEARCH_TRIALS = 1_500_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id, cut where longer than ``capacity``.

    All pieces of a cut document but the first are full; the first has the rest.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, block_chars), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in in_blocks(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                columns = zip(*rows)  # a block has a text at least, and a text has a piece at least
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), shape)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: for each k, pieces above capacity - k stand alone and what is over k must fit."""
    size = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(volume[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        alone = int(number[-1] - number[capacity - k])
        half = int(number[capacity - k] - number[capacity // 2])
        big = int(volume[capacity - k] - volume[capacity // 2])
        small = int(volume[capacity // 2] - (volume[k - 1] if k else 0))
        best = max(best, alone + half + max(0, -(-(small - (half * capacity - big)) // capacity)))
    return best


def best_fit(counts: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over sizes; each bin is the list of its sizes."""
    room_of: dict[int, list[list[int]]] = {}
    rooms, bins = 0, []
    for size in range(capacity, 0, -1):
        for _ in range(counts[size]):
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                chosen = room_of[room].pop()
                if not room_of[room]:
                    rooms ^= 1 << room
            else:
                room, chosen = capacity, []
                bins.append(chosen)
            chosen.append(size)
            if room > size:
                room_of.setdefault(room - size, []).append(chosen)
                rooms |= 1 << (room - size)
    return bins


class Fillings:
    """Undominated fillings of the room beside a largest piece, within limits; remembers whether a limit left any out."""

    def __init__(self, nodes: int, kept: int, options: int, trials: float = float("inf")) -> None:
        self.nodes, self.kept, self.options, self.trials = nodes, kept, options, trials
        self.used, self.cut = 0, False  # sizes tried so far; whether a limit left a filling out

    def of(self, counts: list[int], there: int, room: int) -> list[tuple[int, tuple[int, ...]]]:
        """(waste, sizes) of fillings, least waste first.

        ``there`` has a bit per size that is left. A filling is dominated when one more piece fits or when a larger piece
        that is left can take the place of one of its own; such fillings are never better. Two fillings without waste do
        not dominate each other, so all are listed.
        """
        found: list[tuple[int, tuple[int, ...]]] = []
        nodes = self.nodes
        stack = [(room, room, ())]
        while stack and nodes and self.used <= self.trials:
            nodes -= 1
            self.used += 1
            left, top, chosen = stack.pop()
            fits = there & ((1 << (min(left, top) + 1)) - 1)
            options = []
            while fits:
                self.used += 1
                size = fits.bit_length() - 1
                if counts[size] > chosen.count(size):
                    if len(options) == self.options:
                        self.cut = True
                        break
                    options.append((left - size, size, chosen + (size,)))
                fits ^= 1 << size
            if options:
                stack += reversed(options)
                continue
            used = there
            for size in set(chosen):
                if counts[size] == chosen.count(size):
                    used ^= 1 << size
            if used & ((1 << (left + 1)) - 1) or any((used >> (s + 1)) & ((1 << left) - 1) for s in set(chosen)):
                continue
            found.append((left, chosen))
        self.cut |= bool(stack) or len(found) > self.kept
        found.sort(key=lambda f: (f[0], len(f[1])))
        if not found:  # the search ended before any: the largest pieces that fit
            chosen, left = (), room
            fits = there & ((1 << (left + 1)) - 1)
            while fits:
                size = fits.bit_length() - 1
                if counts[size] > chosen.count(size):
                    chosen, left = chosen + (size,), left - size
                    fits &= (1 << (left + 1)) - 1
                else:
                    fits ^= 1 << size
            found = [(left, chosen)]
        return found[: self.kept]


def search(
    sizes: np.ndarray, capacity: int, incumbent: list[list[int]], least: int, limits: Fillings, budget: int, descent_free: bool = True
) -> list[list[int]]:
    """Branch and bound over fillings: the best bins found, and the incumbent where none is better.

    A bin is filled around the largest piece left; fillings are tried by waste, and the search turns back once the waste
    of the open bins exceeds what one bin less than the incumbent allows. ``budget`` bounds the sizes tried, after the
    first descent where that is free; the descent ends where the search first turns back.
    """
    count = np.bincount(sizes, minlength=capacity + 1).tolist()
    volume = int(sizes.sum())
    there = sum(1 << s for s in range(1, capacity + 1) if count[s])
    path: list[tuple[list, int, int, int]] = []  # fillings left to try, largest piece, waste before, filling in use
    open_bins: list[tuple[int, ...]] = []
    waste, descended = 0, not descent_free

    def take(chosen: tuple[int, ...], sign: int) -> None:
        nonlocal there
        for s in chosen:
            count[s] -= sign
            there = there | 1 << s if count[s] else there & ~(1 << s)

    while True:
        allowed = (len(incumbent) - 1) * capacity - volume
        if waste <= allowed and there:
            if descended and limits.used > budget:
                limits.cut = True
                return incumbent
            largest = there.bit_length() - 1
            take((largest,), 1)
            path.append((limits.of(count, there, capacity - largest), largest, waste, -1))
        else:
            if not descended:
                descended, budget = True, budget + limits.used
            if waste <= allowed:
                incumbent = [list(b) for b in open_bins]
                if len(incumbent) <= least:
                    return incumbent
        while path:  # the next filling of the deepest bin that has one within the allowance
            options, largest, before, used = path.pop()
            if used >= 0:
                take(options[used][1], -1)
                open_bins.pop()
            used += 1
            if used < len(options) and before + options[used][0] <= (len(incumbent) - 1) * capacity - volume:
                path.append((options, largest, before, used))
                take(options[used][1], 1)
                open_bins.append((largest, *options[used][1]))
                waste = before + options[used][0]
                break
            take((largest,), -1)
            if not descended:  # no filling of this bin is within the allowance
                descended, budget = True, budget + limits.used
        if not path:
            return incumbent


def complete_bins(sizes: np.ndarray, capacity: int, trials: int = SEARCH_TRIALS) -> list[list[int]]:
    """Bins for the sizes, as few as the searches find.

    Best-fit decreasing is the first incumbent. Bin completion searches with few fillings per bin first; while a limit
    left fillings out and trials are left, it searches again with wider limits. A search that no limit cut proves its
    bins to be the fewest, as do bins at the lower bound; else the best ones found stand.
    """
    counts = np.bincount(sizes, minlength=capacity + 1)
    least = lower_bound(counts, capacity)
    incumbent = best_fit(counts.tolist(), capacity)
    width = 1
    while len(sizes) and len(incumbent) > least and trials > 0:
        limits = Fillings(FILLING_NODES * width, FILLINGS_KEPT * width, OPTIONS * width, *([trials] if width > 1 else []))
        incumbent = search(sizes, capacity, incumbent, least, limits, trials, descent_free=width == 1)
        trials -= limits.used
        if not limits.cut:
            break
        width *= WIDER
    return incumbent


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece."""
    order = np.argsort(sizes, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(sizes, minlength=capacity + 1))])
    taken = first[:-1].copy()
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for number, members in enumerate(complete_bins(sizes, capacity)):
        at = 0
        for size in members:
            row = order[taken[size]]
            taken[size] += 1
            bins[row], offsets[row] = number, at
            at += size
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset. Shards are random shares of bounded size, so at most a bin or so is lost in each."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(group: pa.Table) -> pa.Table:
        bins, offsets = place(group.column("length").to_numpy(), capacity)
        shard = group.column("_shard")[0].as_py() if group.num_rows else 0
        columns = [group.column(c) for c in names[:-2]]
        return pa.Table.from_arrays([*columns, pa.array(bins + (shard << 32)), pa.array(offsets)], names=names)

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInArrow(run, shape)


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece of the end id alone. Rows that repeat a doc_id are packed as documents of their
    own. Columns besides doc_id and text are not looked at; an empty table gives an empty result. ``block_chars`` is what
    is encoded at once: more of it takes less time and more of a worker's memory, with the same ids.
    """
    with text_batches(docs.sparkSession):
        pieces = materialise(token_pieces(docs, tokenizer, capacity, block_chars), "pieces")
    return pack_pieces(pieces, capacity, shard_pieces)
