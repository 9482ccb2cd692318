"""Removes bytes that repeat what a smaller doc_id has, through suffix arrays built by linear grouping.

Candidates come from anchors (see anchors). Where different contexts share an anchor, their text is suffix-sorted: suffixes
are grouped by their first symbol, and groups are processed in descending order. Every suffix of a group finds, through
the previous-smaller pointers found so far, the nearest suffix before it that lies in a lower group; those are moved to new
groups behind their own, the higher the more suffixes point at them, so that in the end a group is the suffixes with one
Lyndon prefix. A second pass emits the order: the suffixes whose Lyndon prefix ends where the next smallest suffix begins
take the next free places of their groups. Nothing is renamed and there is no recursion. Windows that are equal then
stand side by side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

WINDOW = 50
GRAM = 20
SHORT = 4
SORTED = 4096  # bytes that are sorted together, or one anchor's: short texts stay in the cache


def _shorten(jump: list[int], p: int, to: int) -> None:
    """Searches that come this way again go straight to `to`."""
    while p > to:
        jump[p], p = to, jump[p]


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of text in order. Its last symbol must be smaller than all others."""
    n = len(text)
    symbols = np.array(text)
    ranked = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[ranked][1:] != symbols[ranked][:-1]
    heads = np.flatnonzero(fresh)
    count = np.zeros(n, np.int64)
    count[heads] = np.diff(np.append(heads, n))
    where, own = np.empty(n, np.int64), np.empty(n, np.int64)
    where[ranked], own[ranked] = np.arange(n), np.repeat(heads, count[heads])
    order, place, group, size = ranked.tolist(), where.tolist(), own.tolist(), count.tolist()
    smaller, jump = [-1] * n, list(range(-1, n - 1))  # jump: where the search for a lower group goes on
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:  # one suffix: at most one is moved, and it needs no count
            s = order[end]
            p, steps = s - 1, 0
            while p >= 0 and group[p] >= start:
                p = jump[p]
                steps += 1
            if steps > SHORT:
                _shorten(jump, s - 1, p)
            smaller[s] = jump[s] = p
            if p >= 0:
                h = group[p]
                k = size[h]
                if k > 1:
                    last, at = h + k - 1, place[p]
                    other = order[last]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                    size[h], size[last], group[p] = k - 1, 1, last
            end = start - 1
            continue
        counts: dict[int, int] = {}
        for s in sorted(order[start : end + 1]):
            p, steps = s - 1, 0
            while p >= 0 and group[p] >= start:
                p = jump[p]
                steps += 1
            if steps > SHORT:
                _shorten(jump, s - 1, p)
            smaller[s] = jump[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in counts.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                h = group[p]
                last, at = h + size[h] - 1, place[p]
                other = order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
                size[h] -= 1
                moved.setdefault(h, []).append(p)
            for h, members in moved.items():
                fresh = h + size[h]
                size[fresh] = len(members)
                for p in members:
                    group[p] = fresh
        end = start - 1
    free, out = list(range(n)), [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = smaller[p]
    return out


def _shared(contexts: anchors.Contexts, units: anchors.Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that may share a window with another of their anchor, and which of their windows, from and to, by hashes."""
    same = contexts.anchor[1:] == contexts.anchor[:-1]
    rows = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    count = contexts.number[rows]
    first = np.cumsum(count) - count
    start = anchors.spread(contexts.offset[rows], count)
    found = anchors.ROLLER.hashes(anchors.value_of, contexts.symbols, start, start + units.window) ^ np.repeat(contexts.anchor[rows], count)
    order = np.argsort(found, kind="stable")
    equal = found[order][1:] == found[order][:-1]
    again = np.zeros(len(found), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    places = np.flatnonzero(again)
    own = np.repeat(np.arange(len(rows)), count)[places]
    some, at = np.unique(own, return_index=True)
    last = np.append(at, len(own))[1:] - 1
    return rows[some], places[at] - first[some], places[last] - first[some] + 1


def smallest_by_suffix_order(contexts: anchors.Contexts, units: anchors.Units) -> np.ndarray:
    """For each window of each context the smallest doc_id of a context that holds it.

    What of two contexts is the same text, byte for byte, is sorted once, under the smaller doc_id."""
    number = contexts.number
    first = np.cumsum(number) - number
    best = np.repeat(contexts.doc_id, number)
    rows, begin, end = _shared(contexts, units)
    if not len(rows):
        return best
    start, count = contexts.offset[rows] + begin, end - begin
    size = count - 1 + units.window
    content = anchors.ROLLER.hashes(anchors.value_of, contexts.symbols, start, start + size)
    head, part = anchors.classes(contexts.anchor[rows], contexts.doc_id[rows], content, start, size, contexts.symbols)
    doc_id = contexts.doc_id[rows[head]]
    anchor, counts, sizes, starts = contexts.anchor[rows[head]], count[head], size[head], start[head]
    firsts = np.cumsum(counts) - counts
    least = np.repeat(doc_id, counts)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(head):  # some anchors together, whole
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SORTED)))
        while to < len(head) and anchor[to] == anchor[to - 1]:
            to += 1
        own = np.arange(at, to)
        text = contexts.symbols[anchors.spread(starts[own], sizes[own])]
        suffixes = np.array(suffix_array([*(text.astype(np.int64) + 1).tolist(), 0]))
        window = np.full(len(text) + 1, -1, np.int64)
        window[anchors.spread(np.cumsum(sizes[own]) - sizes[own], counts[own])] = anchors.spread(firsts[own], counts[own])
        suffixes = suffixes[window[suffixes] >= 0]
        views = np.lib.stride_tricks.sliding_window_view(text, units.window)
        fresh = np.ones(len(suffixes), bool)
        for a in range(1, len(suffixes), 1 << 16):
            b = min(len(suffixes), a + (1 << 16))
            fresh[a:b] = (views[suffixes[a:b]] != views[suffixes[a - 1 : b - 1]]).any(1)
        heads = np.flatnonzero(fresh)
        smallest = np.minimum.reduceat(least[window[suffixes]], heads)
        least[window[suffixes]] = np.repeat(smallest, np.diff(np.append(heads, len(suffixes))))
        at = to
    to = anchors.spread(first[rows] + begin, count)
    best[to] = np.minimum(best[to], least[anchors.spread(firsts[part], count)])
    return best


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _finish(held: bytes, covered) -> tuple:
    gone = covered(len(held))
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(held, np.uint8)[~gone].tobytes()
    return len(held), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def remove_repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `window` bytes that covers it also starts in a row with a smaller doc_id; strings never cross
    rows, may overlap, and are judged on the input. Texts count whole, however long. A null text counts as empty. Rows that
    share a doc_id do not remove from each other; a row without one neither loses bytes nor takes any. Other columns are
    ignored, and an empty table gives no rows."""
    units = anchors.Units(window, gram, "u1", anchors.cut_bytes)
    out = anchors.repeats(df, units, smallest_by_suffix_order, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", OUT)
    none = F.lit(0).cast("long")
    bare = common.documents(df).where("doc_id is null")
    return out.unionByName(bare.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))
