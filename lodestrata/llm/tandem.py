"""Periodic runs of words by the linear method of Gusfield and Stoye for tandem repeats.

In a run of period q the windows of LEAST - q or more words at distance q are equal, so all of it is covered by windows that
occur again in its document: only such stretches are searched, and nothing else can hold a run. Windows are found by hashes,
which equal words share; what is searched are numbers, which only equal words share. Stretches of many documents are one
string, with a different symbol between each two.

1. The suffixes are sorted, and blocks of 1, 2, 4, ... symbols named, so that common extensions to both sides of any two
   places, and the equality of any two substrings, are looked up. These stand for the suffix tree.
2. The string is cut into Lempel-Ziv blocks. For each block and period, the extensions around its ends give the squares
   whose middle is in it: at least one of every rotation class that is leftmost somewhere.
3. Suffix-link walks complete the vocabulary: a square's next rotation follows at the next place as long as the period
   lasts; where it ends, the rotation is looked up among the suffixes, and the walk goes on from there.
4. The occurrences of each square of the vocabulary are an interval of the sorted suffixes. Those of one period that start
   at neighbouring places merge into a run.

Squares whose half is itself a repetition are left out: their runs are those of the shorter period. All steps work on
arrays of all squares at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .anchors import cut_words, spread

LEAST, EXPONENT = 24, 3  # words of a run, and times its period
GROUP = 1 << 17  # symbols that are searched together; a longer stretch is searched on its own
ODD = np.uint64(0x9E3779B97F4A7C15)


class Suffixes:
    """Sorted suffixes of a string of numbers, and the names of its blocks of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        levels, size = [rank], 1
        while n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, np.int64)
            fresh[0], fresh[1:] = 0, key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            levels.append(rank)
            size *= 2
        self.names = np.full((len(levels), n + 1), -1, np.int32)  # place n is behind the end
        for level, held in enumerate(levels):
            self.names[level, :n] = held
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from the places i and j on are equal; i and j differ."""
        i, j, first = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            same = (self.names[level][i] == self.names[level][j]).astype(np.int64) << level
            i += same
            j += same
        return i - first

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from the places i and j back, these included, are equal; i and j differ."""
        i, j, first = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << level) + 1, j - (1 << level) + 1
            names = self.names[level]
            same = ((np.minimum(a, b) >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << level
            i -= same
            j -= same
        return first - i

    def named(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Three numbers that are the same for equal substrings of one size only, where these end in the string."""
        level = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.names) - 1)
        return level, self.names[level, i], self.names[level, i + size - (1 << level)]

    def interval(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with the substring at i: from, to (exclusive) in their order."""
        level, first, last = self.named(i, size)
        gap = size - (1 << level)

        def begins(r: np.ndarray) -> np.ndarray:
            at = self.order[r]
            inside = at + size <= self.n
            return inside & (self.names[level, at] == first) & (self.names[level, np.minimum(at + gap, self.n)] == last)

        own = self.rank[i]
        low, high = np.zeros_like(own), own.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            good = begins(middle)
            high, low = np.where(good, middle, high), np.where(good, low, np.minimum(middle + 1, high))
        start = high
        low, high = own.copy(), np.full_like(own, self.n - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = begins(middle)
            low, high = np.where(good, middle, low), np.where(good, high, np.maximum(middle - 1, low))
        return start, low + 1

    def followed(self, i: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place of the substring at i with the symbol of the place `symbol` behind it; -1 where there is none."""
        low, high = self.interval(i, size)
        end, letters = high.copy(), self.names[0]
        while (low < high).any():
            middle = (low + high) >> 1
            less = (low < high) & (letters[np.minimum(self.order[np.minimum(middle, self.n - 1)] + size, self.n)] < letters[symbol])
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        at = self.order[np.minimum(low, self.n - 1)]
        found = (low < end) & (letters[np.minimum(at + size, self.n)] == letters[symbol])
        return np.where(found, at, -1)

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks begin: each is the longest that also begins earlier, or one new symbol."""
        n, rank = self.n, self.rank.tolist()
        up, down = list(range(-1, n)), list(range(1, n + 2))
        before, behind = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # of the suffixes up to i in their order, the neighbours of i
            r = rank[i]
            a, b = up[r], down[r]
            before[i], behind[i] = a, b
            if b < n:
                up[b] = a
            if a >= 0:
                down[a] = b
        longest = np.zeros(n, np.int64)
        place = np.arange(n)
        for near in (np.array(before), np.array(behind)):
            held = (near >= 0) & (near < n)
            longest[held] = np.maximum(longest[held], self.ahead(place[held], self.order[near[held]]))
        sizes, starts, at = longest.tolist(), [], 0
        while at < n:
            starts.append(at)
            at += sizes[at] or 1
        return np.array(starts, np.int64)


def _least_factors(most: int) -> np.ndarray:
    """The least prime factor of each number up to most."""
    least = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    return least


def _primitive(text: Suffixes, at: np.ndarray, period: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the words at `at` of these periods are no repetitions of shorter ones."""
    good, rest = np.ones(len(at), bool), period.copy()
    while True:
        open_ = np.flatnonzero(good & (rest > 1))
        if not len(open_):
            return good
        prime = least[rest[open_]]
        short = period[open_] // prime
        good[open_] = text.ahead(at[open_], at[open_] + short) < period[open_] - short
        rest[open_] //= prime


def _one_each(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows without repeats, sorted."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return tuple(c[fresh] for c in columns)


def covering(text: Suffixes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of a period begin that hold the leftmost-covering squares, and the periods; up to the period most."""
    start = text.blocks()
    bounds = np.concatenate([start, [text.n, text.n]])
    h, h1, h2 = bounds[:-2], bounds[1:-1], bounds[2:]
    found = []
    for anchor, count, sign in ((h1, h1 - h, -1), (h, h2 - h, 1)):
        count = np.minimum(count, most)
        period = spread(np.ones(len(count), np.int64), count)
        anchor = np.repeat(anchor, count)
        other = anchor + sign * period
        inside = (anchor < text.n) & (other < text.n) & (other >= 0)
        period, anchor, other = period[inside], anchor[inside], other[inside]
        right = text.ahead(anchor, other)
        good = right > 0
        period, anchor, other, right = period[good], anchor[good], other[good], right[good]
        left = text.behind(anchor - 1, other - 1)
        good = left + right >= period
        found.append((period[good], (np.minimum(anchor, other) - left)[good]))
    period, first = (np.concatenate(x) for x in zip(*found, strict=True))
    return _one_each(period, first)


def vocabulary(text: Suffixes, period: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every square (place, period) whose half is no repetition, from the stretches of covering()."""
    good = _primitive(text, first, period, _least_factors(int(period.max(initial=1))))
    period, first = period[good], first[good]
    squares: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    while len(period):
        seen.update(zip(period.tolist(), first.tolist(), strict=True))
        more = np.minimum(text.ahead(first, first + period) - period, period - 1)  # rotations that follow in place
        squares.append((spread(first, more + 1), np.repeat(period, more + 1)))
        open_ = more < period - 1
        period, last = period[open_], (first + more)[open_]
        at = text.followed(last + 1, 2 * period - 1, last)
        period, at = period[at >= 0], at[at >= 0]
        first = at - text.behind(at - 1, at + period - 1)
        period, first = _one_each(period, first)
        fresh = np.array([x not in seen for x in zip(period.tolist(), first.tolist(), strict=True)], bool)
        period, first = (period[fresh], first[fresh]) if len(fresh) else (period, first)
    place, period = (np.concatenate(x) for x in zip(*squares, strict=True)) if squares else (np.zeros(0, np.int64),) * 2
    _, a, b = text.named(place, 2 * period)
    order = np.lexsort((b, a, period))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (a, b, period)])
    return place[order][fresh], period[order][fresh]


def runs(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a string of numbers with at least so many symbols and periods: starts, lengths and periods, sorted.

    most: no run's period is longer."""
    text = Suffixes(symbols)
    nothing = np.zeros(0, np.int64)
    if text.n < 2:
        return nothing, nothing, nothing
    place, period = vocabulary(text, *covering(text, min(text.n // exponent, most or text.n)))
    low, high = text.interval(place, 2 * period)
    at, period = text.order[spread(low, high - low)], np.repeat(period, high - low)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    head = np.ones(len(at), bool)
    if len(at):
        head[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(head)
    last = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
    start, q = at[heads], period[heads]
    length = at[last] + 2 * q - start
    good = length >= np.maximum(least, exponent * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def stretches(keys: np.ndarray, offsets: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what may hold runs: words covered by windows that occur again, near enough, in their document.

    keys: 64-bit numbers that equal words share."""
    q = np.arange(1, least + 1)
    window = int((np.maximum(least, exponent * q) - q).min())  # at a run's period from each other so many words are equal
    key = (keys + np.uint64(1)) * ODD
    key ^= key >> np.uint64(31)
    single, size = key, 1
    while size < window:  # equal windows have equal keys; others may
        if 2 * size <= window:
            key = key[:-size] * ODD + key[size:] if len(key) > size else key[:0]
            size *= 2
        else:
            key = key[:-1] * ODD + single[size:] if len(key) else key
            size += 1
    return _repeated(key, offsets, window, exponent, len(keys), least)


def _repeated(key: np.ndarray, offsets: np.ndarray, window: int, exponent: int, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(key)]
    place = np.flatnonzero(offsets[1:][row] - np.arange(len(key)) >= window)
    row = row[place]
    own = key[place] ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    same = (own[order][1:] == own[order][:-1]) & (row[order][1:] == row[order][:-1]) & (place[order][1:] - place[order][:-1] <= sizes[row[order][1:]] // exponent)
    hit = np.zeros(len(place), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[place[hit]] += 1
    change[place[hit] + window] -= 1
    covered = np.cumsum(change[:-1]) > 0
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    edge = offsets[:-1][sizes > 0]
    begins[edge] = covered[edge]
    start = np.flatnonzero(begins)
    ends = np.flatnonzero(covered & np.append(begins[1:] | ~covered[1:], True)) + 1 if n else start
    long = ends - start >= least
    return start[long], ends[long]


def document_runs(keys: np.ndarray, offsets: np.ndarray, numbered: Callable[[int, int], np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of many documents, whose words lie end to end: places, lengths and periods, sorted.

    keys: 64-bit numbers that equal words share; numbered gives, for the words from one place to another, numbers that only
    equal words share."""
    start, end = stretches(keys, offsets, least, exponent)
    found = []
    at = 0
    while at < len(start):
        size = np.cumsum(end[at:] - start[at:] + 1)
        to = at + max(1, int(np.searchsorted(size, GROUP, "right")))
        own, sizes = start[at:to], (end - start)[at:to]
        base = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.concatenate([x for a, b in zip(own.tolist(), end[at:to].tolist(), strict=True) for x in (numbered(a, b), [0])])
        symbols[base + sizes] = int(symbols.max()) + 1 + np.arange(len(own))
        place, length, period = runs(symbols, least, exponent, int(sizes.max()) // exponent)
        which = np.searchsorted(base, place, "right") - 1
        found.append((place - base[which] + own[which], length, period))
        at = to
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Numbers(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, which go by their id: the word that each word becomes; for the others nothing."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def _each(batch: pa.RecordBatch, least: int, exponent: int, order: Callable[[int | None, int], np.ndarray | None]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its number, words, and runs."""
    data, at = common.utf8(batch["text"])
    hashes, _, offsets = cut_words(data, at)
    raw, at = data.tobytes(), at.tolist()
    doc_ids, words = batch["doc_id"].to_pylist(), []
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        own = raw[a:b].split()  # of bytes: at space and 0x09 to 0x0D
        to = order(doc_ids[i], len(own))
        if to is not None:
            own = [own[j] for j in to.tolist()]
            hashes[offsets[i] : offsets[i + 1]] = hashes[offsets[i] + to]
        words.append(own)
    numbers = Numbers()

    def numbered(a: int, b: int) -> np.ndarray:
        i = int(np.searchsorted(offsets, a, "right")) - 1
        return np.fromiter(map(numbers.__getitem__, words[i][a - offsets[i] : b - offsets[i]]), np.int64, b - a)

    place, length, period = document_runs(hashes, offsets, numbered, least, exponent)
    bounds = np.searchsorted(place, offsets)
    for i, own in enumerate(words):
        few = slice(bounds[i], bounds[i + 1])
        yield i, own, place[few] - offsets[i], length[few], period[few]


def _strongest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of the greatest length for its period; the first and shortest-period one of several."""
    best = 0
    for i in range(1, len(start)):
        a, b = length[i] * period[best], length[best] * period[i]
        if a > b or (a == b and (start[i], period[i]) < (start[best], period[best])):
            best = i
    return best


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(df: DataFrame, order: Callable[[int | None, int], np.ndarray | None] = lambda doc_id, n: None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of df: doc_id, n_runs, the strongest run's start, length, period and exponent_milli (nulls without
    one), runs_sha256 and collapsed_sha256.

    Words are what space and 0x09 to 0x0D part; order may give other words for a document's. A null or empty text has no
    words. Texts count whole, however long: one text is one task's work. Other columns are ignored; rows that repeat or have
    no doc_id stay; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha256 = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            out = []
            for _, words, *found in _each(batch, least, exponent, order):
                start, length, period = (x.tolist() for x in found)
                best = (None,) * 4
                if start:
                    i = _strongest(start, length, period)
                    best = start[i], length[i], period[i], 1000 * length[i] // period[i]
                    keep = _kept(len(words), *found).tolist()
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                said = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start, length, period, strict=True))
                out.append((len(start), *best, sha256(said.encode()), sha256(b" ".join(words))))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return common.documents(df).mapInArrow(run, DIGESTS)


def collapse_runs(df: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of df: doc_id, runs (start, length, period of each, in words) and text, in which of every run only the
    first period is left and words are joined by one space; a text without runs stays as it is. Odd rows: as run_digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            lists, texts = [], batch["text"].to_pylist()
            for i, words, start, length, period in _each(batch, least, exponent, lambda doc_id, n: None):
                if len(start):
                    keep = _kept(len(words), start, length, period).tolist()
                    texts[i] = b" ".join(w for w, k in zip(words, keep, strict=True) if k).decode()
                lists.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lists, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "text"])

    return common.documents(df).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")
