"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

A byte goes if a LENGTH-byte string over it also starts earlier (in a smaller id, or earlier in the same text).
Comparing all suffixes of a corpus would shuffle every position, so they are first brought together by anchors:

1. Every LENGTH-byte window has one anchor, the GRAM-byte string in it whose hash is smallest (the leftmost of
   equals), frequent ones last. Equal windows have equal anchors at equal places, so a window whose anchor stands nowhere else is unique.
   Anchors, one for about 39 bytes, are shuffled by their hash, and those that stand alone are dropped. A task sends
   one row for an anchor that it has several times.
2. Texts are joined with their anchors that are left, and each anchor gives a stretch: the bytes of all windows that
   it anchors. Of equal stretches a task sends the first, and the others' bytes go at once.
3. Stretches meet by their anchor and are sorted as suffixes: a mergesort whose comparisons find the common extension
   by binary search over polynomial prefix hashes, so in a logarithmic number of steps. Equal neighbours are compared
   byte by byte before they count. Of equal stretches the first stays; where a group has different stretches, their
   windows are sorted in the same way, as suffixes cut at LENGTH bytes.
4. Intervals that go are joined with the texts, merged, and cut out.

A string that a hash sample of the texts has often (a common line, say) is an anchor only where a window has no other:
else the many windows that hold it beside text of their own would all meet there, to no end. What the sample misses, or
has no room to note, makes a large group: past SORTED bytes a group is not held, and its windows are dealt out again, each
by a hash of all its bytes, so that only equal ones meet; the first of these stays, the others go as they stream by. So no
task holds more than SORTED bytes of a group, whatever the corpus.

Texts are shuffled once (both joins read the same exchange). A passage that a third of all texts share sends one row
a task at each step, so no group outgrows the number of tasks. Hashes here decide order, never equality; over 100
bytes, polynomials modulo 2^64 with a full-width base have no known systematic collisions.

Defined results: a null text is empty; texts under LENGTH bytes keep all bytes; a null id comes first; rows that
repeat an id count as documents one after another, in the order of their texts' hashes; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, width

LENGTH = 100
GRAM = 24
#: Bytes that are anchored at once; anchors and stretches that a task holds to send equal ones once; windows of a large
#: group in a batch; and bytes of stretches that are sorted at once, whole groups, a larger group going on by windows.
BLOCK = 1 << 20
HELD_ANCHORS = 4_000_000
HELD_STRETCHES = 300_000
HELD_WINDOWS = 20_000
SORTED = 4 << 20

#: Texts, in expectation, in which frequent strings are looked for, or SHARE of all if that is more; sampled texts that
#: make a string frequent; how many such strings are noted, the most frequent first, and bits of their table.
SAMPLE = 1000
SHARE = 1e-4
FREQUENT = 4
NOTED = 1 << 18
TABLE_BITS = 22
#: Bits of a place in a block, which has under twice BLOCK and LENGTH bytes; a string's hash has the other bits.
PLACE_BITS = 22

_BASE = 0x9E3779B97F4A7C15
_UNIT = (1 << 64) - 1
#: A number for each byte, from splitmix64's finaliser.
_VALUES = np.empty(256, dtype=np.uint64)
for _b in range(256):
    _z = (_b + 1) * 0xBF58476D1CE4E5B9 & _UNIT
    _z = (_z ^ _z >> 27) * 0x94D049BB133111EB & _UNIT
    _VALUES[_b] = _z ^ _z >> 31
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """One more than bytes: sums of the bytes' numbers times the base's powers."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data))[0], out=out[1:])
    return out


class Suffixes:
    """Suffixes of one byte array, in groups; sorts them within each group."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        """start, size: of each suffix; group: its group, equal ones next to each other."""
        self.data, self.start, self.size, self.group = data, start, size, group
        self.hashes, self.powers = prefix_hashes(data), powers(len(data) + 1)[0]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b."""
        x, y, h, p = self.start[a], self.start[b], self.hashes, self.powers
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.size[a], self.size[b])
        hx, hy, px, py = h[x], h[y], p[x], p[y]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (h[x + middle] - hx) * py == (h[y + middle] - hy) * px
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b, or is equal to it where that counts."""
        n = self.common(a, b)
        sa, sb = self.size[a], self.size[b]
        ends = n >= np.minimum(sa, sb)
        last = len(self.data) - 1
        byte = self.data[np.minimum(self.start[a] + n, last)] < self.data[np.minimum(self.start[b] + n, last)]
        return np.where(ends, (sa < sb) | ((sa == sb) & or_equal), byte)

    def sorted(self) -> np.ndarray:
        """Numbers of the suffixes in order; equal ones keep theirs. Runs of 1, 2, 4, ... are merged in all groups at
        once: an element's place is its own in its run and, by binary search, that in the run it is merged with."""
        n = len(self.start)
        order = np.arange(n)
        new = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        sizes = np.diff(np.append(new, n))
        run = 1
        while run < sizes.max(initial=0):
            big = sizes > run
            slot = np.flatnonzero(np.repeat(big, sizes))
            begin, end = np.repeat(new[big], sizes[big]), np.repeat((new + sizes)[big], sizes[big])
            inside = slot - begin
            base = begin + inside // (2 * run) * (2 * run)
            second = inside // run % 2 == 1
            split = np.minimum(base + run, end)
            low = np.where(second, base, split)
            high = np.where(second, split, np.minimum(base + 2 * run, end))
            first, me = low.copy(), order[slot]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                goes = self.before(order[middle], me[open_], second[open_])
                low[open_] = np.where(goes, middle + 1, low[open_])
                high[open_] = np.where(goes, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = slot - np.where(second, split - base, 0) + low - first
            merged = order.copy()
            merged[place] = me
            order = merged
            run *= 2
        return order

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, whether each in it equals the one before), equal bytes confirmed."""
        order = self.sorted()
        a, b = order[:-1], order[1:]
        same = (self.group[a] == self.group[b]) & (self.size[a] == self.size[b])
        at = np.flatnonzero(same)
        at = at[self.common(a[at], b[at]) == self.size[a[at]]]
        same[:] = False
        raw = self.data.tobytes()
        for i, x, y, n in zip(at.tolist(), self.start[a[at]].tolist(), self.start[b[at]].tolist(), self.size[a[at]].tolist()):
            same[i] = raw[x : x + n] == raw[y : y + n]
        return order, np.concatenate(([False], same)) if len(order) else same


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of each GRAM-byte string."""
    n = len(data) - GRAM + 1
    h = prefix_hashes(data)
    gram = (h[GRAM:] - h[:n]) * powers(n)[1]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    return gram


def anchors(data: np.ndarray, window_ok: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor; window_ok: starts of windows to look at; frequent: for
    the hashes' low bits, whether such a string comes last in the choice."""
    n = len(data) - GRAM + 1
    gram = grams(data)
    bits = np.uint64(PLACE_BITS)  # the same in all blocks, so that equal windows choose alike
    last = frequent[gram & np.uint64(len(frequent) - 1)].astype(np.uint64) << np.uint64(63)
    least = ((gram >> np.uint64(1) | last) >> bits << bits) | np.arange(n, dtype=np.uint64)  # by hash, then place
    span, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    starts = np.flatnonzero(window_ok[: len(least)])
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else starts
    last = starts[np.append(new[1:], len(starts)) - 1] if len(starts) else starts
    return gram[place[new]].view(np.int64), place[new], starts[new], last


def _blocks(keys: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, window starts to look at, key of each byte's text, offset of each byte) of about BLOCK bytes; a longer
    text is cut into pieces that share LENGTH - 1 bytes, so that each window is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def block():
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        ok = np.zeros(int(ends[-1]), dtype=bool)
        for a, n in zip((ends - sizes).tolist(), sizes.tolist()):
            ok[a : a + n - LENGTH + 1] = True
        return np.frombuffer(b"".join(x for _, _, x in held), dtype=np.uint8), ok, ends - sizes, np.array([k for k, _, _ in held]), np.array([o for _, o, _ in held])

    for key, text in zip(keys, texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[at : at + BLOCK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            held.append((key, at, piece))
            size += len(piece)
            if size >= BLOCK:
                yield block()
                held.clear()
                size = 0
    if held:
        yield block()


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each text's GRAM-byte strings, each once a text."""
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            if len(text) >= GRAM:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams(np.frombuffer(text, dtype=np.uint8))).view(np.int64))], ["gram"])


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """For the low bits of a hash, whether a string with such a hash is in FREQUENT sampled texts or more. It decides
    which anchors are preferred, and so how evenly work is dealt out, but no result."""
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    texts = max(1, docs.count())
    share = min(1.0, max(SAMPLE, SHARE * texts) / texts)
    sampled = docs.where(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share * 1_000_003).select("text")
    counts = sampled.mapInArrow(_distinct_grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    low = F.col("gram").bitwiseAND(F.lit(len(table) - 1)).alias("low")
    table[[r["low"] for r in counts.orderBy(F.desc("n"), "gram").limit(NOTED).select(low).collect()]] = True
    return table


def _anchor_rows(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(route, key, at): at packs a stretch's first window, its anchor's distance from it and its last window's. Kinds:
    an anchor that the task has once (route: its hash); one row without key for each that it has several times; and
    their rows, ready to pass (route: none)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        h, key, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, key, at = h[order], key[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(edge, len(h)))
        many = np.repeat(sizes > 1, sizes)
        told = h[edge[sizes > 1]]
        keys = pa.concat_arrays([pa.array(key), pa.nulls(len(told), pa.int64())])
        routes = np.concatenate((np.where(many, key * 31 + at, h), told))
        return pa.RecordBatch.from_arrays([pa.array(routes), keys, pa.array(np.concatenate((at, np.zeros(len(told), np.int64)))), pa.array(np.concatenate((many, np.zeros(len(told), bool))))], ["route", "key", "at", "passed"])

    for batch in batches:
        for data, ok, begins, keys, offsets in _blocks(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            h, place, first, last = anchors(data, ok, frequent)
            text = np.searchsorted(begins, first, "right") - 1
            at = (first - begins[text] + offsets[text]) << 14 | (place - first) << 7 | (last - first)
            held.append((h, keys[text], at))
            count += len(h)
        if count > HELD_ANCHORS:
            yield out()
            held.clear()
            count = 0
    if held:
        yield out()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route in; those that pass, and those whose route others have too, out."""
    carry: pa.RecordBatch | None = None

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        route = batch.column("route").to_numpy()
        passed = batch.column("passed").to_numpy(zero_copy_only=False)
        others = route.copy()
        # rows that pass have a route of no meaning and don't count for those that share it by chance
        same = np.zeros(len(route), dtype=bool)
        plain = np.flatnonzero(~passed)
        r = others[plain]
        eq = r[1:] == r[:-1]
        same[plain[1:]] |= eq
        same[plain[:-1]] |= eq
        keep = (passed | same) & ~batch.column("key").is_null().to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("at").take(at)], ["key", "at"])

    for batch in batches:
        if carry is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(carry.columns, batch.columns)], batch.schema.names)
        if not batch.num_rows:
            continue
        route = batch.column("route").to_numpy()
        n = int(np.searchsorted(route, route[-1], "left"))
        if n:
            yield chosen(batch.slice(0, n))
        carry = batch.slice(n)
    if carry is not None:
        yield chosen(carry)


_STRETCH = ["route", "key", "at", "stretch", "last"]


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, at, stretch) of stretches that the task has first, route being a hash of the anchor and its place
    in the stretch's windows left out; and, without stretch, (key, start, end) in (key, at, last) of what goes, dealt
    out by text and place."""
    seen: dict[tuple[int, bytes], tuple[int, int]] = {}
    gone: list[tuple[int, int, int]] = []

    def drop(key: int, at: int) -> None:
        first, end = at >> 14, (at >> 14) + (at & 127) + LENGTH
        if gone and gone[-1][0] == key and gone[-1][1] <= first <= gone[-1][2]:
            gone[-1] = (key, gone[-1][1], max(end, gone[-1][2]))
        else:
            gone.append((key, first, end))

    def out() -> Iterator[pa.RecordBatch]:
        if seen:
            routes, rows, texts = [], list(seen.values()), []
            for (place, stretch), _ in seen.items():
                routes.append(xxhash.xxh3_64_intdigest(stretch[place : place + GRAM]))
                texts.append(stretch)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(routes, dtype=np.uint64).view(np.int64)), pa.array([k for k, _ in rows], pa.int64()), pa.array([a for _, a in rows], pa.int64()), pa.array(texts, pa.binary()), pa.nulls(len(rows), pa.int64())], _STRETCH)
        if gone:
            yield _ready(*(np.array(x, dtype=np.int64) for x in zip(*gone)))
        seen.clear()
        gone.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, (key, places) in enumerate(zip(batch.column("key").to_pylist(), batch.column("places").to_pylist())):
            text = texts[i].as_py()
            for at in sorted(places):
                first = at >> 14
                name = (at >> 7 & 127, text[first : first + (at & 127) + LENGTH])
                old = seen.get(name)
                if old is None:
                    seen[name] = (key, at)
                elif old <= (key, at):
                    drop(key, at)
                else:
                    seen[name] = (key, at)
                    drop(*old)
        if len(seen) > HELD_STRETCHES:
            yield from out()
    yield from out()


def settle(route: np.ndarray, key: np.ndarray, at: np.ndarray, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of what goes, of whole groups by route; rows are sorted by route, key and place."""
    sizes = np.array([len(x) for x in stretches])
    data = np.frombuffer(b"".join(stretches), dtype=np.uint8)
    start = np.cumsum(sizes) - sizes
    first, place, span = at >> 14, at >> 7 & 127, at & 127
    # equal stretches: groups are by route and the anchor's place in the stretch
    _, group = np.unique(route, return_inverse=True)
    by = np.lexsort((np.arange(len(at)), place, group))
    order, same = Suffixes(data, start[by], sizes[by], group[by] << 7 | place[by]).repeats()
    copies = by[order[same]]
    out = [(key[copies], first[copies], first[copies] + span[copies] + LENGTH)]
    left = np.sort(by[order[~same]])
    several = np.bincount(group[left], minlength=int(group.max(initial=0)) + 1)[group[left]] > 1
    left = left[several]
    # windows of stretches that differ: groups are by route and the window's distance from the anchor
    while len(left):
        n = max(1, int(np.searchsorted(np.cumsum(span[left] + 1), SORTED)))
        if n < len(left):  # up to a whole group
            n = int(np.searchsorted(group[left], group[left[n]], "left")) or int(np.searchsorted(group[left], group[left[0]], "right"))
        part, left = left[:n], left[n:]
        windows = span[part] + 1
        owner = np.repeat(part, windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        name = group[owner] << 7 | (place[owner] - step)
        by = np.lexsort((first[owner] + step, key[owner], name))
        order, same = Suffixes(data, (start[owner] + step)[by], np.full(len(owner), LENGTH), name[by]).repeats()
        gone = np.sort(by[order[same]])  # by stretch and window: runs of windows become one interval
        if len(gone):
            new = np.flatnonzero(np.concatenate(([True], (owner[gone[1:]] != owner[gone[:-1]]) | (step[gone[1:]] != step[gone[:-1]] + 1))))
            last = gone[np.append(new[1:], len(gone)) - 1]
            o = owner[gone[new]]
            out.append((key[o], first[o] + step[gone[new]], first[o] + step[last] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ready(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Intervals that go as rows without stretch, dealt out by text and place."""
    spread = (key * 0x2545F4914F6CDD1D) ^ (first * 0x4F6CDD1D)
    return pa.RecordBatch.from_arrays([pa.array(spread), pa.array(key), pa.array(first), pa.nulls(len(key), pa.binary()), pa.array(last)], _STRETCH)


def _windows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each window of the batch's stretches as a row of its own: route is a hash of all its bytes and of its distance from
    the anchor, at its first byte."""
    rows: list[tuple[int, int, int, bytes]] = []
    for key, at, stretch in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("stretch").to_pylist()):
        first, place, span = at >> 14, at >> 7 & 127, at & 127
        for w in range(span + 1):
            window = stretch[w : w + LENGTH]
            rows.append((xxhash.xxh3_64_intdigest(window, place - w), key, first + w, window))
        if len(rows) > HELD_WINDOWS:
            yield _window_rows(rows)
            rows = []
    if rows:
        yield _window_rows(rows)


def _window_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    route, key, first, window = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(np.array(route, dtype=np.uint64).view(np.int64)), pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(window, pa.binary()), pa.nulls(len(rows), pa.int64())], _STRETCH)


def _settled(batches: Iterator[pa.RecordBatch], most: int = SORTED) -> Iterator[pa.RecordBatch]:
    """Rows of _stretch_rows sorted by route, key and place in; rows without stretch of what goes out, and, of a group of
    more than most bytes, which is not held, the windows."""
    held: list[pa.RecordBatch] = []
    size, passing = 0, None  # the route of a large group whose first part is out already

    def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        route, key, at = (batch.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
        sizes = np.diff(np.append(edge, len(route)))
        many = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if len(many):
            yield _ready(*(x.astype(np.int64) for x in settle(route[many], key[many], at[many], batch.column("stretch").take(pa.array(many)).to_pylist())))

    for batch in batches:
        ready = batch.column("stretch").is_null()
        if ready.true_count:
            yield batch.filter(ready)
            batch = batch.filter(pa.compute.invert(ready))
        if passing is not None and batch.num_rows:
            n = int(np.searchsorted(batch.column("route").to_numpy(), passing, "right"))
            yield from _windows_of(batch.slice(0, n))
            batch = batch.slice(n)
            if batch.num_rows:
                passing = None
        if batch.num_rows:
            held.append(batch)
            size += batch.column("stretch").nbytes
        if size > most:
            whole = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(5)], _STRETCH)
            route = whole.column("route").to_numpy()
            n = int(np.searchsorted(route, route[-1], "left"))
            if n:
                yield from out(whole.slice(0, n))
            rest = whole.slice(n)
            held, size = [rest], rest.column("stretch").nbytes
            if size > most:
                passing = route[-1]
                yield from _windows_of(rest)
                held, size = [], 0
    if held:
        yield from out(pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(5)], _STRETCH))


def _windows_settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _settled sorted by route, key and place in; (key, first, last) of what goes out. Of equal windows the first
    stays; only the different windows of one route, so of one hash, are held."""
    names = ["key", "first", "last"]
    seen: set[bytes] = set()
    current = None
    for batch in batches:
        ready = batch.column("stretch").is_null()
        if ready.true_count:
            rows = batch.filter(ready)
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("at"), rows.column("last")], names)
            batch = batch.filter(pa.compute.invert(ready))
        if not batch.num_rows:
            continue
        keys, firsts, gone = batch.column("key").to_numpy(), batch.column("at").to_numpy(), []
        for i, (route, window) in enumerate(zip(batch.column("route").to_pylist(), batch.column("stretch").to_pylist())):
            if route != current:
                seen.clear()
                current = route
            if window in seen:
                gone.append(i)
            else:
                seen.add(window)
        if gone:
            yield pa.RecordBatch.from_arrays([pa.array(keys[gone]), pa.array(firsts[gone]), pa.array(firsts[gone] + LENGTH)], names)


def merged(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Intervals joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = batch.column("text").cast(pa.binary()), []
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            text, at, kept = texts[i].as_py(), 0, []
            spans = merged([g["first"] for g in gone], [g["last"] for g in gone]) if gone else []
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((len(text), sum(b - a for a, b in spans), spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        n, removed, spans, digest = zip(*rows) if rows else ((), (), (), ())
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind), pa.array(digest, pa.string())],
            ["id", "n_bytes", "n_removed", "spans", "kept_sha256"],
        )


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with a key that orders them: the id, where no row repeats one or has none."""
    odd = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return rows.select("id", F.coalesce("id", F.lit(0)).alias("key"), "text")  # the key is not null for the planner too
    placed = rows.repartitionByRange(width(rows), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return cut(placed.withColumn("key", F.monotonically_increasing_id())).select("id", "key", "text")


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SORTED) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for each row; spans are the byte intervals [first, last) that go. A
    group of stretches of more than most bytes goes on window by window."""
    docs = _keyed(df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_grams(docs))  # 2^TABLE_BITS bytes
    anchored = lambda batches: _anchor_rows(batches, frequent.value)
    found = docs.select("key", "text").mapInArrow(anchored, "route long, key long, at long, passed boolean")
    found = found.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated, "key long, at long")
    places = found.groupBy(F.col("key").alias("__key")).agg(F.collect_list("at").alias("places"))
    # merge joins, and the same columns of the texts in both, let the second one read the first one's exchange
    stretches = docs.join(places.hint("merge"), F.col("key") == F.col("__key")).select("id", "key", "text", "places").mapInArrow(_stretch_rows, "route long, key long, at long, stretch binary, last long")
    large = lambda batches: _settled(batches, most)
    by_route = lambda rows: rows.repartition("route").sortWithinPartitions("route", "key", "at")
    sorted_out = by_route(stretches).mapInArrow(large, "route long, key long, at long, stretch binary, last long")
    settled = by_route(sorted_out).mapInArrow(_windows_settled, "key long, first long, last long")
    gone = settled.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    joined = docs.join(gone.hint("merge"), F.col("key") == F.col("__key"), "left").select("id", "key", "text", "gone")
    done = joined.mapInArrow(_cut_out, "id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept_sha256 string")
    return done.withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of find_repeats' rows."""
    return df.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
