"""Line dedup: a segment-partition edit join over distinct lines.

How many edits make a near-equal line follows from the length of the shorter one (``edits_for``). Lines within k edits
share one of k + 1 segments of the shorter line, at a place that the lengths and the segment's number narrow down. Each
line indexes its own segments; its other substrings that may equal a segment of a line up to k shorter are probes. Probes
are held against a bit filter of the index keys where the texts lie, so that few of them are shuffled. Lines that meet at
a key are compared by their lengths and letter counts first; those left get their texts and are verified by banded
bit-parallel edit distance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BASE, INVERSE, bit_filter, flag_by_filter, in_blocks, materialise, mix, powers, text_batches, tidy
from quillstone.llm.components import components

# None: as many edits as edits_for gives for the shorter line. A number holds for every length.
THRESHOLD: int | None = None
# Shorter lines are compared exactly only: one edit makes another line of them.
SHORTEST = 20
# From this length on segments have WIDTH characters: length // 50 + 1 of them fit, one more than the edits. Their keys
# need not name the line's length, and those from the FAR-th on do not name their number either, which bounds the probes
# of a line by its length.
LONG, WIDTH, FAR = 200, 40, 32
# Larger groups with a threshold of one edit find their pairs by keys.
PAIRWISE = 48
# Lines of a group that meet in one task, at most twice as many.
BLOCK = 20_000
# The filter of index keys has 16 bits for each key up to this many words of 64 bits (128 MB), and from there on down to 8.
# More keys are taken in slices, each with its own filter and pass over the probes. A key sets up to BITS bits of one word.
PROBE_WORDS = 1 << 24
BITS = 4
# Bins that the characters of a line are counted in, modulo 256, before its text is looked at.
BINS = 32
# Slots that the three-grams of a line are counted in.
GRAM_SLOTS = 512
# Groups of up to this many lines have all their pairs looked at together.
FEW = 128
# Lines that a task remembers to look at repeated ones once.
REMEMBERED = 1 << 18

Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def edits_for(length: int, threshold: int | None) -> int:
    """Edits that make a near-equal line of one with ``length`` characters: one from 20, two from 40, three from 60, and
    2 % of the length from 200."""
    return max(min(3, length // 20), length // 50) if threshold is None else threshold


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of threshold + 1 segments of nearly equal length, the longer ones last."""
    parts = threshold + 1
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def _places(rows: list[tuple[int, int, int]]) -> Places:
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2].astype(np.uint64)


def own_places(n: int, threshold: int | None) -> Places:
    """Starts, sizes and tags of the segments of a line with ``n`` characters."""
    most = edits_for(n, threshold)
    if threshold is None and n >= LONG:
        return _places([(i * WIDTH, WIDTH, min(i, FAR)) for i in range(most + 1)])
    return _places([(start, size, n << 6 | i) for i, (start, size) in enumerate(segments(n, most))] if n > most else [])


def probe_places(n: int, threshold: int | None) -> Places:
    """Starts, sizes and tags of the substrings of a line with ``n`` characters that may equal a segment of another line
    of as many or fewer characters; its own segments are left out.

    Some segment i is untouched with exactly i edits before it and at most k - i behind it: the first one at which the
    edits so far are no more than the segments so far less one. Both bound the shift, which leaves few substrings.
    """
    rows = []
    top = edits_for(n, threshold)
    for length in range(max(1, n - top), n + 1 if threshold is not None else min(n + 1, LONG)):
        more, most = n - length, edits_for(length, threshold)
        if more > most or length <= most:
            continue
        for i, (start, size) in enumerate(segments(length, most)):
            low = max(0, start - i, start + more - (most - i))
            high = min(n - size, start + i, start + more + (most - i))
            rows += [(at, size, length << 6 | i) for at in range(low, high + 1) if more or at != start]
    if threshold is not None or n < LONG:
        return _places(rows)
    for i in range(min(top + 1, FAR)):
        start = i * WIDTH
        ends = max(0, start - min(i, top - i)), min(n - WIDTH, start + i)
        rows += [(at, WIDTH, i) for at in range(ends[0], ends[1] + 1) if at != start]
    start, size, tag = _places(rows)
    far = np.zeros(n, bool)
    for i in range(FAR, top + 1):
        far[i * WIDTH - min(i, top - i) : min(n - WIDTH, i * WIDTH + i) + 1] = True
    far[FAR * WIDTH : top * WIDTH + 1 : WIDTH] = False
    at = np.flatnonzero(far)
    return np.concatenate([start, at]), np.concatenate([size, np.full(len(at), WIDTH)]), np.concatenate([tag, np.full(len(at), FAR, np.uint64)])


@functools.lru_cache(maxsize=1024)
def _short_places(probes: bool, n: int, threshold: int | None) -> Places:
    return (probe_places if probes else own_places)(n, threshold)


def keys_at(lines: list[str], probes: bool, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments or of the probes of all lines, and the number of keys of each line.

    A key is a polynomial hash of the substring, read from prefix sums over all lines, mixed with its tag.
    """
    find = [(_short_places if len(x) < 1000 else _short_places.__wrapped__)(probes, len(x), threshold) for x in lines]
    many = np.array([len(p[0]) for p in find], np.int64)
    if not many.sum():
        return np.empty(0, np.uint64), many
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(BASE, n)[:n], out=sums[1:])
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])[:-1]
    start = np.concatenate([p[0] for p in find]) + np.repeat(first, many)
    end = start + np.concatenate([p[1] for p in find])
    tags = np.concatenate([p[2] for p in find])
    return mix((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start] + tags * np.uint64(0xD6E8FEB86659FD93)), many


def segment_keys(line: str, threshold: int | None) -> set[int]:
    """All keys at which this line meets those within ``threshold`` edits, its own segments and its probes."""
    return {x for probes in (False, True) for x in keys_at([line], probes, threshold)[0].tolist()}


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance where it is at most ``most``, else most + 1.

    Common ends go first. The rest is the bit-parallel method within a band: 2 * most + 1 rows, one row further down with
    each column. What lies outside the band counts as no better than its neighbours, which changes no distance up to
    ``most``. The value followed is that on the diagonal that leads to the end; it never falls.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) < len(b):
        a, b = b, a
    low, high = 0, len(b)
    while low < high:  # length of the common start
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(b)
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    n, score = len(a), len(a) - len(b)
    if not b:
        return min(n, most + 1)
    top = 2 * most
    full = (1 << top + 1) - 1
    end = most + score  # bit of the followed diagonal
    # up, down: rows whose value is one above or below that of the row before, in the last column. Bit t of column j
    # (from 1) is row j - most + t. The window of a character has the rows where it stands, as of the column given.
    up, down = full >> most << most, 0
    windows: dict[str, tuple[int, int]] = {}
    for i in range(min(most, n)):  # rows 1 to most enter with column 1, below its last row
        bits = windows.get(a[i], (0, 1))[0]
        windows[a[i]] = bits | 1 << most + i, 1
    for j, c in enumerate(b, 1):
        if j + most <= n:
            entered = a[j + most - 1]
            bits, at = windows.get(entered, (0, j))
            windows[entered] = bits >> j - at | 1 << top, j
        bits, at = windows.get(c, (0, j))
        equal = bits >> j - at
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        plus, minus = down | (full & ~(zero | up)), zero & up
        score += not zero >> end & 1
        if score > most:
            return most + 1
        zero >>= 1
        up, down = minus | (full & ~(zero | plus)), zero & plus
    return score


def one_edit_pairs(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Candidate pairs of lines one edit apart, in time linear in the text: enough of them to connect all such lines.

    Lines that differ in one character agree once that place is deleted; a line with one character more agrees with the
    shorter after a deletion. Lines that agree are chained, not paired with each other.
    """
    base = np.uint64(0x9E3779B97F4A7C15)
    keys, owners, whole = [], [], []
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n = len(codes)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        front = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:n], dtype=np.uint64)])
        behind = np.concatenate([[np.uint64(0)], np.cumsum(codes[1:] * power[: n - 1], dtype=np.uint64)])
        gone = front[:n] + (behind[n - 1] - behind[:n])
        whole.append((int(front[n]), n))
        keys.append(gone)
        owners.append(np.full(n, i))
    index: dict[tuple[int, int], int] = {}
    for i, key in enumerate(whole):
        if key in index:
            yield i, index[key]
        else:
            index[key] = i
    for i, gone in enumerate(keys):  # one character more
        n = len(gone) - 1
        for g in set(gone.tolist()):
            j = index.get((g, n))
            if j is not None:
                yield i, j
    flat = np.concatenate(keys)
    owner = np.concatenate(owners)
    place = np.concatenate([np.arange(len(k)) for k in keys])
    length = np.repeat([len(k) for k in keys], [len(k) for k in keys])
    order = np.lexsort((owner, place, length, flat))
    f, p, l, o = flat[order], place[order], length[order], owner[order]
    same = np.flatnonzero((f[1:] == f[:-1]) & (p[1:] == p[:-1]) & (l[1:] == l[:-1]))
    yield from zip(o[same + 1].tolist(), o[same].tolist())


def gram_counts(line: str) -> np.ndarray:
    """A line's three-grams, counted in GRAM_SLOTS slots; counts are cut off at 32767."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return np.minimum(np.bincount((mixed >> 16) % GRAM_SLOTS, minlength=GRAM_SLOTS), 32767).astype(np.int16)


def like_few(
    lines: list[str], threshold: int | None, groups: list[set[int]] | None, name: int
) -> Iterator[tuple[int, np.ndarray]]:
    """What :func:`like_lines` gives, for at most FEW lines: all pairs by lengths and letter counts at once, then the
    groups, and three-grams only of lines that still have a pair."""
    size = np.array([len(x) for x in lines], np.int64)
    most = np.array([edits_for(len(x), threshold) for x in lines], np.int64)
    counts = letter_counts(lines)
    edits = np.minimum(most[:, None], most[None, :])
    high, low = np.nonzero(np.tril(np.abs(size[:, None] - size[None, :]) <= edits, -1))
    x, y = counts[high], counts[low]
    near = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64) <= 2 * edits[high, low]
    lower = [{g for g in among if g < name} for among in groups or []]
    grams: dict[int, np.ndarray] = {}
    found: dict[int, list[int]] = {}
    for i, j in zip(high[near].tolist(), low[near].tolist()):
        if lower and not lower[i].isdisjoint(lower[j]):
            continue
        for k in (i, j):
            if k not in grams:
                grams[k] = gram_counts(lines[k])
        if np.abs(grams[i] - grams[j]).sum(dtype=np.int64) <= 6 * edits[i, j]:
            found.setdefault(i, []).append(j)
    for i, js in found.items():
        yield i, np.array(js, np.int64)


def like_lines(
    lines: list[str], threshold: int | None, groups: list[set[int]] | None = None, name: int = 0
) -> Iterator[tuple[int, np.ndarray]]:
    """Each line's number with those of earlier lines that lengths, letter counts and counts of three-grams leave: an edit
    changes the former by two and the latter by six at most, so no pair is lost. Counts that share a bucket or are cut off
    only come nearer. Where the groups of each line are given, lines that share a group below ``name`` with it are left
    out, since they meet there."""
    if len(lines) < 4:  # dearer to count than to compare
        for i in range(1, len(lines)):
            yield i, np.array([j for j in range(i) if groups is None or min(groups[i] & groups[j]) == name], np.int64)
        return
    if len(lines) <= FEW:
        yield from like_few(lines, threshold, groups, name)
        return
    size = np.array([len(x) for x in lines], np.int64)
    most = np.array([edits_for(len(x), threshold) for x in lines], np.int64)
    counts = np.zeros((len(lines), 64), np.int32)
    grams = np.zeros((len(lines), GRAM_SLOTS), np.int16)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        counts[i] = np.bincount(codes & 63, minlength=64)
        grams[i] = gram_counts(line)
    lower: dict[int, list[int]] = {}
    for i, among in enumerate(groups or []):
        for g in among:
            if g < name:
                lower.setdefault(g, []).append(i)
    # groups of each line, those with most lines first, so that a few of them mostly cover all
    covers: list[list[np.ndarray]] = [[] for _ in lines]
    for members in sorted((m for m in lower.values() if len(m) > 1), key=len, reverse=True):
        held = np.array(members, np.int64)
        for i in members:
            covers[i].append(held)
    for i in range(1, len(lines)):
        edits = np.minimum(most[:i], most[i])
        open_ = np.abs(size[:i] - size[i]) <= edits
        left = int(open_.sum())
        for held in covers[i]:
            if not left:
                break
            open_[held[: np.searchsorted(held, i)]] = False
            left = int(open_.sum())
        if left:
            near = np.flatnonzero(open_)
            near = near[np.abs(counts[near] - counts[i]).sum(axis=1) <= 2 * edits[near]]
            yield i, near[np.abs(grams[near] - grams[i]).sum(axis=1, dtype=np.int64) <= 6 * edits[near]]


def group_links(
    keys: list[int], lines: list[str], threshold: int | None, groups: list[set[int]] | None = None, name: int = 0
) -> list[tuple[int, int]]:
    """Verified links of a group, without those inside a part that is connected already. Where the groups of each line are
    given, a pair is compared only in the least group that both are in, so once in all."""
    part = np.arange(len(lines))
    out = []

    def link(i: int, j: int) -> bool:
        most = edits_for(min(len(lines[i]), len(lines[j])), threshold)
        if edit_distance(lines[i], lines[j], most) > most:
            return False
        part[part == part[i]] = part[j]
        out.append((keys[i], keys[j]))
        return True

    if threshold == 1 and len(lines) > PAIRWISE:
        for i, j in one_edit_pairs(lines):
            if part[i] != part[j] and (groups is None or min(groups[i] & groups[j]) == name):
                link(i, j)
        return out
    for i, near in like_lines(lines, threshold, groups, name):
        near = near[part[near] != part[i]]
        while len(near):
            j, near = int(near[0]), near[1:]
            if link(i, j):
                near = near[part[near] != part[i]]
    return out


def letter_counts(lines: list[str]) -> np.ndarray:
    """A row of BINS bytes for each line: its characters by their last bits, counted modulo 256."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & BINS - 1
    codes += np.repeat(np.arange(len(lines)) * BINS, np.array([len(x) for x in lines], np.int64))
    return np.bincount(codes, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.uint8)


def with_partner(group: np.ndarray, size: np.ndarray, counts: np.ndarray, threshold: int | None) -> np.ndarray:
    """Marks lines that may be within their edits of another line of their group, by lengths and letter counts alone.

    Rows lie by group and size. An edit changes the counts by two at most, and counts modulo 256 only come nearer, so no
    line with a partner is lost.
    """
    most = np.maximum(np.minimum(3, size // 20), size // 50) if threshold is None else np.full(len(size), threshold, np.int64)
    found = np.zeros(len(size), bool)
    low = np.arange(len(size))
    step = 0
    while len(low):
        step += 1
        low = low[low < len(size) - step]
        high = low + step
        # sizes grow within a group: what is out of reach here stays so further on
        low = low[(group[low] == group[high]) & (size[high] - size[low] <= most[low])]
        open_ = low[~(found[low] & found[low + step])]
        for at in range(0, len(open_), 1 << 16):
            a = open_[at : at + (1 << 16)]
            x, y = counts[a], counts[a + step]
            near = a[np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64) <= 2 * most[a]]
            found[near] = found[near + step] = True
    return found


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): lines with a visible character, numbered from 0 in their text."""
    cut = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    return docs.select(F.col("doc_id").cast("long"), cut).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key): key is a 64-bit hash of the line."""
    return lines_of(docs).select("doc_id", "pos", F.xxhash64("line").alias("key"))


def segment_rows(
    docs: DataFrame, threshold: int | None, shortest: int, words: np.ndarray | None = None, part: tuple[int, int] = (0, 1)
) -> DataFrame:
    """(seg, key): the segments of each line of ``shortest`` or more characters; or, where the words of a bit filter are
    given, the line's probes of slice ``part`` (number, of how many) that pass it. Lines repeated within a task come once
    as far as it remembers them."""
    told = None if words is None else docs.sparkSession.sparkContext.broadcast(words)

    def passing(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, slices = part
        if slices > 1:
            mine = (found >> np.uint64(24) & np.uint64(0xFFFF)) % np.uint64(slices) == number
            found, owner = found[mine], owner[mine]
        bits = told.value
        held = bits[(found & np.uint64(len(bits) - 1)).view(np.int64)]
        for b in range(BITS):  # most go at the first bits
            there = np.flatnonzero(held >> (found >> np.uint64(58 - 6 * b) & np.uint64(63)) & np.uint64(1))
            found, owner, held = found[there], owner[there], held[there]
        order = np.lexsort((found, owner))  # a line that repeats itself has few different keys
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        return found[new], owner[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in in_blocks(batch, "line"):
                if len(seen) > REMEMBERED:
                    seen.clear()
                fresh = {k: x for k, x in zip(block.column(0).to_pylist(), block.column(1).to_pylist()) if k not in seen}
                seen.update(fresh)
                found, many = keys_at(list(fresh.values()), told is not None, threshold)
                owner = np.repeat(np.fromiter(fresh, np.int64, len(fresh)), many)
                if told is not None and len(found):
                    found, owner = passing(found, owner)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(owner)], names=["seg", "key"])

    long = lines_of(docs).where(F.length("line") >= shortest).select(F.xxhash64("line").alias("key"), "line")
    return long.mapInArrow(tidy(run), "seg long, key long")


def filter_words(index: DataFrame, rows: int) -> np.ndarray:
    """The words of a bit filter over ``seg`` of about ``rows`` rows: 16 bits for each, PROBE_WORDS words at most."""
    size = 1024
    while size < PROBE_WORDS and size * 4 < rows:
        size *= 2
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        place = F.shiftrightunsigned("seg", 58 - 6 * b).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    table = index.groupBy(F.col("seg").bitwiseAND(F.lit(size - 1)).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return words


def probe_rows(docs: DataFrame, index: DataFrame, threshold: int | None, shortest: int) -> DataFrame:
    """(seg, key): the probes that pass the filter of the index keys, in as many slices of keys as keep it from filling."""
    rows = index.count()
    slices = max(1, -(-rows // (PROBE_WORDS * 8)))
    place = F.shiftrightunsigned("seg", 24).bitwiseAND(F.lit(0xFFFF)) % slices
    out = []
    for number in range(slices):
        words = filter_words(index.where(place == number) if slices > 1 else index, rows // slices)
        out.append(materialise(segment_rows(docs, threshold, shortest, words, (number, slices)), "probes"))
    return functools.reduce(DataFrame.unionByName, out)


PLACE = ["seg", "_i", "_j"]


def sketched(lines: DataFrame) -> DataFrame:
    """(key, line, size, counts) of (key, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in in_blocks(batch, "line"):
                texts = block.column(1).to_pylist()
                counts = pa.array([x.tobytes() for x in letter_counts(texts)], pa.binary())
                columns = [*block.columns, pa.array([len(x) for x in texts], pa.int64()), counts]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "line", "size", "counts"])

    return lines.select("key", "line").mapInArrow(tidy(run), "key long, line string, size long, counts binary")


def near_rows(rows: DataFrame, threshold: int | None) -> DataFrame:
    """The places and keys of ``rows`` (place, size, key, counts) that :func:`with_partner` leaves. A task holds one group
    and one batch of numbers, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch if kept is None else pa.concat_batches([kept, batch])
            last = group_of(kept)
            whole = int(last[-1])  # rows before the last group
            if whole:
                yield left(kept.slice(0, whole))
                kept = pa.concat_batches([kept.slice(whole)])
        if kept is not None:
            yield left(kept)

    def group_of(batch: pa.RecordBatch) -> np.ndarray:
        """Number of the first row of each row's group."""
        new = np.zeros(batch.num_rows, bool)
        for i in range(3):
            column = batch.column(i).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    def left(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BINS)
        found = with_partner(group_of(batch), batch.column(3).to_numpy(), counts, threshold)
        return batch.select([0, 1, 2, 4]).filter(pa.array(found))

    placed = rows.select(*PLACE, "size", "key", "counts").repartition(*PLACE).sortWithinPartitions(*PLACE, "size")
    return placed.mapInArrow(tidy(run), "seg long, _i int, _j int, key long")


def line_links(docs: DataFrame, threshold: int | None, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between line keys.

    Index keys are written first; probes that pass the filter of them follow. Keys that only one line has are dropped by
    a minimum and a maximum, summed before the shuffle. Keys with the same lines are looked at once. A group beyond
    ``block`` lines is cut into blocks and each two of them meet, so no task holds more than two blocks. Groups first meet
    without texts, by lengths and letter counts; texts go only to where a line may have a partner.
    """
    with text_batches(docs.sparkSession, 10_000):
        index = materialise(segment_rows(docs, threshold, shortest), "index")
        probes = probe_rows(docs, index, threshold, shortest)
    met = index.unionByName(probes)
    several = met.groupBy("seg").agg(F.min("key").alias("_low"), F.max("key").alias("_high")).where("_low < _high")
    several = materialise(several.select("seg"), "several")
    maybe = flag_by_filter(met, F.col("seg"), bit_filter(several, F.col("seg"))).where("__maybe").select("seg", "key")
    members = materialise(maybe.join(several, "seg", "left_semi").distinct(), "segments")
    groups = (
        members.groupBy("seg")
        .agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("key")).alias("_x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("_y"))
        .groupBy("_n", "_x", "_y")
        .agg(F.min("seg").alias("seg"))
        .select("seg", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    )
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("_blocks")).cast("int")
    others = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_own"))
    )
    placed = members.join(groups, "seg").withColumn("_own", own).withColumn("_other", F.explode(others))
    place = F.struct("seg", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    lists = materialise(placed.groupBy("key").agg(F.collect_list(place).alias("places")), "places")

    texts = lines_of(docs).select(F.xxhash64("line").alias("key"), "line")
    flagged = flag_by_filter(texts, F.col("key"), bit_filter(lists, F.col("key"))).where("__maybe").select("key", "line")
    # one copy of each line: equal keys are equal lines, and the group needs no text but as its key
    with text_batches(docs.sparkSession, 10_000):
        told = materialise(sketched(flagged.distinct()), "texts")
        placed = told.join(lists, "key").select(F.explode("places").alias("_at"), "key", "size", "counts")
        near = near_rows(placed.select("_at.*", "key", "size", "counts"), threshold)
        lists = materialise(near.groupBy("key").agg(F.collect_list(F.struct(*PLACE)).alias("places")), "near")
    # lines that may be near meet in all groups that both are in, so the least of them is still among those left
    rows = told.select("key", "line").join(lists, "key").withColumn("_at", F.explode("places"))
    rows = rows.select("_at.*", "key", "line", F.array_distinct("places.seg").alias("groups"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, lines, others = None, [], [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            names = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for at, key, line, among in zip(names, *(batch.column(i).to_pylist() for i in range(3, 6))):
                if at != group:
                    found += links_of(group, keys, lines, others)
                    group, keys, lines, others = at, [], [], []
                keys.append(key)
                lines.append(line)
                others.append(set(among))
            yield table_of(found)
        yield table_of(links_of(group, keys, lines, others))

    def links_of(group: tuple | None, keys: list[int], lines: list[str], others: list[set[int]]) -> list[tuple[int, int]]:
        return group_links(keys, lines, threshold, others, group[0]) if len(lines) > 1 else []

    def table_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(tidy(run), "a long, b long").distinct()


def line_classes(docs: DataFrame, threshold: int | None = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, pos, key, class, kept) of every line with a visible character.

    Lines are linked within ``threshold`` edits, or, where it is None, within those that :func:`edits_for` gives for the
    shorter line. A class holds the lines that links connect; its first line by doc_id and position stays, all others go, repeated
    lines of one text among them. A null doc_id comes before all numbers.
    """
    keyed = materialise(keyed_lines(docs), "lines")
    with text_batches(docs.sparkSession, 10_000):
        links = materialise(line_links(docs, threshold, shortest), "line-links")
    found = components(links)
    rows = keyed.select("doc_id", "pos", "key").join(found, keyed.key == found.node, "left")
    rows = rows.select("doc_id", "pos", "key", F.coalesce("component", "key").alias("class"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "pos")
    firsts = rows.groupBy("class").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(firsts.select("class", "_first"), "class", "left")
    return joined.select("doc_id", "pos", "key", "class", (F.col("_first").isNull() | (F.col("_first") == order)).alias("kept"))


def line_dedup(docs: DataFrame, threshold: int | None = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """One row per doc_id: (doc_id, n_lines, n_dropped, dropped); dropped has the numbers of the lines that go.

    Lines are cut at line feeds; those without a visible character are neither counted nor dropped. Null, empty and
    blank texts have 0 lines. Rows that repeat a doc_id are one row here, and of their equal lines with equal numbers
    each stays where the first does. Other columns are not looked at; an empty table gives an empty result.
    """
    lines = line_classes(docs, threshold, shortest)
    gone = F.when(~F.col("kept"), F.col("pos"))
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(gone)).alias("__gone"))
    ids = docs.select(F.col("doc_id").cast("long")).distinct()
    joined = ids.join(sums, ids.doc_id.eqNullSafe(sums.doc_id), "left").drop(sums.doc_id)
    return joined.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("__gone", lambda x: x.cast("string")), " "), F.lit("")).alias("dropped"),
    )


def without_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; rows without any are passed on as they are."""
    gone = decisions.where("n_dropped > 0").select("doc_id", F.transform(F.split("dropped", " "), lambda x: x.cast("int")).alias("__gone"))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i))
    joined = docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return joined.select(docs.columns)
