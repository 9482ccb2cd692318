"""Finds repeated windows of symbols (bytes or words) through winnowed anchors, for the two substring operators.

A window is W consecutive symbols of one document; its anchor is the gram of K symbols in it whose hash is least (the
first of these). Equal windows have equal anchors at equal places, so whatever two documents share meets by anchor:

1. documents are packed into chunks, a staged table; every chunk's anchors go, without repeats, to the anchors' buckets;
2. buckets tell the chunks which anchors occur more than once;
3. a chunk sends the contexts of those anchors (the symbols of all windows that have this anchor) to the bucket;
4. buckets collapse equal contexts, compare different ones (the operator's own method), and send back the windows that a
   smaller doc_id has too;
5. chunks cover the windows' symbols.

Equal contexts of a chunk are one before they are sent: a copy with a larger doc_id is covered by the one that is sent.
Contexts are equal when all their symbols are; hashes only say which to compare. Packed arrays of a bucket and a chunk are
the rows that Spark shuffles; how many buckets there are follows the input's size. An anchor that a third of all documents
hold costs its bucket two entries a chunk in (1), and one for each different context of each chunk in (3).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

CHUNK = 4 << 20  # bytes of text
BUCKET_BYTES = 1 << 20  # bytes of the table's files
BATCH = 1 << 19
HELD = 6 << 20  # bytes of contexts that are packed together
WIDEST = (1 << 16) - 1  # symbols of a window
SENT_BITS = np.uint64((1 << 40) - 1)  # of an anchor's hash; enough to find candidates, whose contexts carry all of it
LONG_WORD = 64  # bytes; a longer word is hashed on its own
PLACE = np.uint64((1 << 24) - 1)
STRETCH = 1 << 20  # symbols of a long row that are hashed together; their places fit PLACE
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Roller:
    """Hashes of runs of symbols from prefix sums: sum of value * base^place, modulo 2^64, moved to place 0."""

    def __init__(self, seed: int = 1_234_577):
        draw = np.random.default_rng(seed)
        self.byte = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(2**62, 2**63)) | 1
        self.power = self.inverse = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.power) <= n:
            self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BATCH), x, np.uint64)])) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[:n])])

    def hashes(self, value_of: Callable[[np.ndarray], np.ndarray], symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of short runs that start in ascending order, a stretch of symbols at a time."""
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(start, base + BATCH // 2)))
            sums = self.sums(value_of(symbols[base : int(stop[at:to].max())]))
            out[at:to] = self.runs(sums, start[at:to] - base, stop[at:to] - base)
            at = to
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.inverse[start])


@dataclass(frozen=True)
class Units:
    """What the symbols of a text are: cut gives the values to hash, the symbols to ship, and the rows' offsets."""

    window: int
    gram: int
    symbol: str
    cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


ROLLER = Roller()


def cut_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ROLLER.byte[data], data, offsets


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of anything but space and 0x09 to 0x0D) start and stop, and the rows' offsets in words."""
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    for edge in (offsets[1:-1],):
        edge = edge[edge < len(data)]
        first[edge] = ink[edge]
        last[edge - 1] = ink[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit digests of words: eight bytes at a time are mixed into what the bytes before them gave, and no step is linear.
    Words of one length and of up to eight bytes never share one; longer than LONG_WORD bytes they have a keyed digest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = stop - start
    out = _mix(size.astype(np.uint64) * MIX + np.uint64(77))
    long = size > LONG_WORD
    rows = np.flatnonzero(~long)
    at, left = start[rows], size[rows]
    while len(rows):
        block = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))
        out[rows] = _mix(_mix(out[rows] ^ block))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8, key=b"word").digest(), "little")
    return out


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, stop, at = word_places(data, offsets)
    values = word_digests(data, start, stop)
    return values, values, at


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each count, end to end."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def classes(key: np.ndarray, doc_id: np.ndarray, content: np.ndarray, offset: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups runs of symbols of one key that are equal, symbol by symbol: of each group the first by doc_id, in the order of
    keys, and the group of every run. content: hashes of the runs."""
    content = content.copy()
    group = np.empty(len(key), np.int64)
    while True:
        order = np.lexsort((doc_id, content, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])
        heads = order[fresh]
        group[order] = np.cumsum(fresh) - 1
        head = heads[group]
        wrong = size != size[head]
        rows = np.flatnonzero(~wrong & (head != np.arange(len(head))))
        at, ends = 0, np.cumsum(size[rows])
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH)))
            some = rows[at:to]
            differ = symbols[spread(offset[some], size[some])] != symbols[spread(offset[head[some]], size[some])]
            if differ.any():
                wrong[some[np.searchsorted(ends[at:to] - ends[at] + size[rows[at]], np.flatnonzero(differ), "right")]] = True
            at = to
        if not wrong.any():
            return heads, group
        content[wrong] = _mix(content[wrong] + np.uint64(1))  # two contents with one hash


def seeds(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of all rows: row, place of the anchor, first window, number of windows, hash of the gram.

    Stretches overlap by a window less one symbol, so that each window is in one of them; an anchor that goes on in the next
    stretch stays one."""
    n = len(values)
    if n <= STRETCH:
        return _stretch_seeds(values, offsets, window, gram)
    held = []
    for at in range(0, max(1, n - window + 1), STRETCH - window + 1):
        to = min(n, at + STRETCH)
        row, anchor, start, number, found = _stretch_seeds(values[at:to], np.clip(offsets, at, to) - at, window, gram)
        held.append((row, anchor + at, start + at, number, found))
    row, anchor, start, number, found = (np.concatenate(c) for c in zip(*held, strict=True))
    if not len(row):
        return row, anchor, start, number, found
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    return row[fresh], anchor[fresh], start[fresh], np.add.reduceat(number, fresh), found[fresh]


def _stretch_seeds(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(values)
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - window + 1, 0)
    total = int(windows.sum())
    if not total:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = np.arange(n - gram + 1)
    hashes = ROLLER.runs(ROLLER.sums(values), grams, grams + gram)
    least = (hashes & ~PLACE) | grams.astype(np.uint64)
    span, size = window - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    ends = np.cumsum(windows)
    start = np.repeat(offsets[:-1] - ends + windows, windows) + np.arange(total)
    anchor = (least[start] & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), windows)
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    return row[fresh], anchor[fresh], start[fresh], np.diff(np.append(fresh, total)), hashes[anchor[fresh]]


def batches_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of rows of at most BATCH bytes, or one longer row: the first row, bytes and offsets."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: numbers by planes of like bytes, which compress."""
    head = np.array([x.nbytes for x in arrays], "<i8").tobytes()
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T for x in arrays)
    return zstandard.compress(head + b"".join(x.tobytes() for x in planes), 1)


def _unpack(held: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(held), np.uint8)
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, raw[:at].view("<i8").tolist(), strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(width, -1).T).view(kind).reshape(-1))
        at += size
    return out


def _parts(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys in a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(keys[a]), slice(a, b)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most CHUNK bytes (or one longer row), packed; g numbers them by task."""
    task = TaskContext.get()
    g = (task.partitionId() if task else 0) << 32
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        row = _pack(np.concatenate(ids), np.concatenate(sizes), np.concatenate(texts))
        ids.clear(), sizes.clear(), texts.clear()
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([row], pa.binary())], names=["g", "packed"])

    for batch in batches:
        doc_id = batch["doc_id"].to_numpy(zero_copy_only=False).astype("<i8")
        data, offsets = common.utf8(batch["text"])
        at = 0
        while at < len(doc_id):
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK - held, "right")) - 1
            if to <= at and ids:
                yield out()
                g, held = g + 1, 0
                continue
            to = max(at + 1, to)
            ids.append(doc_id[at:to])
            sizes.append(np.diff(offsets[at : to + 1]).astype("<i8"))
            texts.append(data[offsets[at] : offsets[to]].copy())
            held += int(offsets[to] - offsets[at])
            at = to
    if ids:
        yield out()


def _rows(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of a chunk."""
    ids, sizes, data = _unpack(packed, "<i8", "<i8", "u1")
    return ids, data, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor % np.uint64(buckets)).astype(np.int64)


def _sent_anchors(units: Units, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, packed in zip(batch["g"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                _, chunk, bounds = _rows(packed)
                held = [np.zeros(0, np.uint64)]
                for _, data, offsets in batches_of(chunk, bounds):
                    values, _, places = units.cut(data, offsets)
                    held.append(seeds(values, places, units.window, units.gram)[4] & SENT_BITS)
                anchor = np.sort(np.concatenate(held))
                third = np.zeros(len(anchor), bool)  # two of a kind say that there are more than one
                third[2:] = anchor[2:] == anchor[:-2]
                anchor = anchor[~third]
                order = np.argsort(_bucket(anchor, buckets), kind="stable")
                anchor = anchor[order]
                rows = [(k, g, _pack(anchor[part])) for k, part in _parts(_bucket(anchor, buckets))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "g", "anchors"])

    return run


KNOWN = pa.schema([("g", pa.int64()), ("anchors", pa.binary())])


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: the anchors that occur more than once, for each chunk that holds them."""
    held = [_unpack(x, "<u8")[0] for x in table["anchors"].to_pylist()]
    anchor, own = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
    order = np.argsort(anchor, kind="stable")
    anchor, own = anchor[order], own[order]
    same = anchor[1:] == anchor[:-1]
    more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    anchor, own = anchor[more], own[more]
    order = np.argsort(own, kind="stable")
    anchor, own = anchor[order], own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    anchor, own = anchor[fresh], own[fresh]
    g = table["g"].to_pylist()
    rows = [(g[k], _pack(anchor[part])) for k, part in _parts(own)]
    return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(KNOWN.types)], schema=KNOWN)


CONTEXTS = ("<u8", "<i8", "<u4", "<u4", "<u2", "<u2")
SPANS = ("<u4", "<u4", "<u4")
SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("packed", pa.binary())])


def _content(anchor: np.ndarray, lead: np.ndarray, offset: np.ndarray, size: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return ROLLER.hashes(value_of, symbols, offset, offset + size) ^ _mix(anchor + lead.astype(np.uint64) * np.uint64(65537) + size.astype(np.uint64))


def _by_bucket(parts: list[tuple[np.ndarray, ...]], g: int, buckets: int) -> list[tuple]:
    """Contexts for the buckets, and for a bucket of none what a chunk knows itself: copies with a larger doc_id are covered."""
    found, doc_id, row, start, lead, number, size, taken = (np.concatenate(c) for c in zip(*parts, strict=True))
    first = np.cumsum(size) - size
    heads, group = classes(found, doc_id, _content(found, lead, first, size, taken), first, size, taken)
    covered = doc_id > doc_id[heads[group]]
    out = []
    if covered.any():
        out.append((-1 - g % buckets, g, _pack(row[covered], start[covered], start[covered] + size[covered].astype("<u4"))))
    sent = np.flatnonzero(~covered)
    bucket = _bucket(found[sent] & SENT_BITS, buckets)
    order = np.argsort(bucket, kind="stable")
    for k, part in _parts(bucket[order]):
        own = sent[order[part]]
        symbols = taken[spread(first[own], size[own])]
        out.append((k, g, _pack(found[own], doc_id[own], row[own], start[own], lead[own], number[own], symbols)))
    return out


def _sent_contexts(units: Units, buckets: int):
    def run(chunks: pa.Table, repeated: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(x, "<u8")[0] for x in repeated["anchors"].to_pylist())]))
        for g, packed in zip(chunks["g"].to_pylist(), chunks["packed"].to_pylist(), strict=True) if len(known) else ():
            ids, chunk, bounds = _rows(packed)
            parts: list[tuple[np.ndarray, ...]] = []
            held = 0
            for at, data, offsets in batches_of(chunk, bounds):
                values, symbols, places = units.cut(data, offsets)
                row, anchor, start, number, found = seeds(values, places, units.window, units.gram)
                if not len(row):
                    continue
                short = found & SENT_BITS
                keep = known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
                row, anchor, start, number, found = row[keep], anchor[keep], start[keep], number[keep], found[keep]
                size = number - 1 + units.window
                taken = symbols[spread(start, size)]
                parts.append((found, ids[at + row], (at + row).astype("<u4"), (start - places[row]).astype("<u4"), (anchor - start).astype("<u2"), number.astype("<u2"), size, taken))
                held += taken.nbytes
                if held > HELD:
                    out += _by_bucket(parts, g, buckets)
                    parts, held = [], 0
            if parts:
                out += _by_bucket(parts, g, buckets)
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(SENT.types)], schema=SENT)

    return run


@dataclass
class Contexts:
    """Of one bucket, the different contexts in the order of their anchors: symbols end to end, and for each its anchor's
    hash, smallest doc_id, the anchor's place in it, its number of windows and its offset among the symbols."""

    anchor: np.ndarray
    doc_id: np.ndarray
    lead: np.ndarray
    number: np.ndarray
    offset: np.ndarray
    symbols: np.ndarray


def value_of(symbols: np.ndarray) -> np.ndarray:
    return ROLLER.byte[symbols] if symbols.dtype == np.uint8 else _mix(symbols.astype(np.uint64) * MIX + np.uint64(77))


FLAGGED = pa.schema([("g", pa.int64()), ("packed", pa.binary())])


def _resolved(units: Units, smallest: Callable[[Contexts, Units], np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.select(["g", "packed"])
        held = [_unpack(x, *CONTEXTS, units.symbol) for x in table["packed"].to_pylist()]
        anchor, doc_id, row, start, lead, number, symbols = (np.concatenate(c) for c in zip(*held, strict=True))
        start, g = start.astype(np.int64), np.repeat(table["g"].to_numpy(), [len(x[0]) for x in held])
        del held
        lead, number = lead.astype(np.int64), number.astype(np.int64)
        size = number - 1 + units.window
        offset = np.cumsum(size) - size
        heads, class_of = classes(anchor, doc_id, _content(anchor, lead, offset, size, symbols), offset, size, symbols)
        sizes = size[heads]
        contexts = Contexts(anchor[heads], doc_id[heads], lead[heads], number[heads], np.cumsum(sizes) - sizes, symbols[spread(offset[heads], sizes)])
        best = smallest(contexts, units)  # for each window of each different context, end to end, the smallest doc_id that has it
        first = np.cumsum(contexts.number) - contexts.number
        # windows of every context, copies included
        total = np.cumsum(number)
        context = np.repeat(np.arange(len(number)), number)
        place = np.arange(len(context)) - np.repeat(total - number, number)
        flag = best[first[class_of[context]] + place] < doc_id[context]
        edge = flag.copy()
        edge[1:] &= ~(flag[:-1] & (context[1:] == context[:-1]))
        last = flag.copy()
        last[:-1] &= ~(flag[1:] & (context[1:] == context[:-1]))
        a, b = np.flatnonzero(edge), np.flatnonzero(last)
        rows = context[a]
        start_at, stop_at = start[rows] + place[a], start[rows] + place[b] + units.window
        order = np.argsort(g[rows], kind="stable")
        out = [(k, _pack(row[rows[order[part]]], start_at[order[part]].astype("<u4"), stop_at[order[part]].astype("<u4"))) for k, part in _parts(g[rows][order])]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(FLAGGED.types)], schema=FLAGGED)

    return run


def repeats(df: DataFrame, units: Units, smallest: Callable[[Contexts, Units], np.ndarray], finish: Callable[[bytes, Callable[[int], np.ndarray]], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """For each row of df, under doc_id, finish(bytes of its text, a function that tells which of n symbols are covered)."""
    spark = df.sparkSession
    if units.window > WIDEST:
        raise ValueError(f"a window is at most {WIDEST} symbols")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = min(2**31 - 1, max(common.partitions(spark), size // BUCKET_BYTES))
    docs = common.documents(df).where("doc_id is not null")
    chunks = common.staged(docs.mapInArrow(_chunks, "g long, packed binary"), "chunks")
    known = chunks.mapInArrow(_sent_anchors(units, buckets), "bucket int, g long, anchors binary").groupBy("bucket").applyInArrow(_repeated, "g long, anchors binary")
    contexts = chunks.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(_sent_contexts(units, buckets), "bucket int, g long, packed binary")
    flagged = contexts.groupBy("bucket").applyInArrow(_resolved(units, smallest), "g long, packed binary")

    def cover(chunks: pa.Table, flags: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        row, start, stop = none, none, none
        if flags.num_rows:
            row, start, stop = (np.concatenate(c).astype(np.int64) for c in zip(*(_unpack(x, *SPANS) for x in flags["packed"].to_pylist()), strict=True))
            order = np.argsort(row, kind="stable")
            row, start, stop = row[order], start[order], stop[order]
        out: list[tuple] = []
        for packed in chunks["packed"].to_pylist():
            ids, data, offsets = _rows(packed)
            edges = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, doc_id in enumerate(ids.tolist()):
                part = slice(edges[i], edges[i + 1])

                def covered(n: int, part: slice = part) -> np.ndarray:
                    if part.start == part.stop:
                        return np.zeros(n, bool)
                    return np.cumsum(np.bincount(start[part], minlength=n + 1) - np.bincount(stop[part], minlength=n + 1))[:n] > 0

                out.append((doc_id, *finish(data[offsets[i] : offsets[i + 1]].tobytes(), covered)))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(arrow.types)], schema=arrow)

    return chunks.groupBy("g").cogroup(flagged.groupBy("g")).applyInArrow(cover, schema)
