"""Best-fit packing of documents' tokens after a Martello-Toth reduction.

Pieces of one length are alike, so the plan is made over a histogram of at most `capacity` lengths: whatever the size of
the corpus, the driver holds that histogram and a table of bin patterns, each with a number of repeats. The reduction
fixes sets that dominate every other set that holds the same longest piece: a piece that nothing fits beside, a pair that
fills a sequence, the longest partner where only one more piece fits, and that partner where two more fit but no two
together are longer. What is left is packed by best fit, longest first. Then every piece gets a number within its
length, and the table turns that number into a sequence and an offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY = 1024


def _at_most(held: list[int], most: int) -> int | None:
    """The longest length that is at most `most`, in an ascending list."""
    i = bisect_left(held, most + 1)
    return held[i - 1] if i else None


def _best_pair(held: list[int], counts: Counter, most: int) -> int:
    """The largest sum, at most `most`, of two pieces that are left; 0 if there is none."""
    best, i, j = 0, 0, len(held) - 1
    while i <= j:
        total = held[i] + held[j]
        if total > most or (i == j and counts[held[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def reduce_instance(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets, takes their pieces out of counts, and returns them as (lengths, repeats)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    held = sorted(k for k, n in counts.items() if n)

    def take(lengths: tuple[int, ...], repeats: int) -> None:
        fixed.append((lengths, repeats))
        for length, times in Counter(lengths).items():
            counts[length] -= times * repeats
            if not counts[length]:
                del counts[length]
                held.remove(length)

    for length in sorted(counts, reverse=True):
        while counts.get(length):
            room = capacity - length
            counts[length] -= 1  # the others, beside one piece of this length
            least: list[int] = []
            for k in held:
                least += [k] * min(3 - len(least), counts[k])
                if len(least) == 3:
                    break
            partner = _at_most([k for k in held[: bisect_left(held, room + 1)] if counts[k]][-1:], room)
            one = not least or least[0] > room
            two = len(least) < 2 or sum(least[:2]) > room
            three = len(least) < 3 or sum(least) > room
            pair_dominated = not one and not two and three and partner is not None and partner >= _best_pair([k for k in held if counts[k] and k <= room], counts, room)
            counts[length] += 1
            if one:
                take((length,), counts[length])
            elif partner is not None and (partner == room or two or pair_dominated):
                repeats = counts[length] // 2 if partner == length else min(counts[length], counts[partner])
                if partner != room and pair_dominated and not two:  # as long as three of each are left, nothing that was asked changes
                    repeats = max(1, (counts[length] - 2) // 2 if partner == length else min(counts[length] - 3, counts[partner] - 2))
                take((length, partner), repeats)
            else:
                break
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: bins with one content are held as one group with a number."""
    groups: dict[int, Counter] = {}
    rooms: list[int] = []
    full: Counter = Counter()

    def put(content: tuple[int, ...], room: int, n: int) -> None:
        if room == 0:
            full[content] += n
            return
        if room not in groups:
            groups[room] = Counter()
            insort(rooms, room)
        groups[room][content] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                if left >= per:
                    put((length,) * per, capacity - per * length, left // per)
                    left %= per
                if left:
                    put((length,) * left, capacity - left * length, 1)
                break
            room = rooms[i]
            content, n = next(iter(groups[room].items()))
            used = min(n, left)
            groups[room][content] -= used
            if not groups[room][content]:
                del groups[room][content]
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            put((*content, length), room - length, used)
            left -= used
    for held in groups.values():
        full.update(held)
    return list(full.items())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths) with repeats that hold every piece of the histogram once."""
    counts = Counter({k: n for k, n in histogram.items() if n})
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length is outside 1 to the capacity")
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, sequence of that number, offset), sorted: number r of a length is in the last row with
    first number <= r, in sequence + r - first number."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, repeats in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += repeats
            offset += length
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.TextEncoder(bpe.vocabulary(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids_of = iter(batch["doc_id"].to_pylist())
            for ids, offsets, *_ in encoder.batch(*common.utf8(batch["text"])):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    doc_id, n, at, piece = next(ids_of), b - a + 1, 0, 0
                    held = ids[a:b].astype("<u4", copy=False).tobytes() + end
                    while at < n:
                        to = at + (n - at - 1) % capacity + 1
                        rows.append((doc_id, piece, at, to - at, zlib.crc32(held[4 * at : 4 * to])))
                        at, piece = to, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE.types, strict=True)], schema=PIECE)

    return run


def _placed(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length, number = batch["length"].to_numpy(zero_copy_only=False), batch["number"].to_numpy(zero_copy_only=False)
            row = np.searchsorted(keys, length << 40 | number, "right") - 1
            sequence, offset = table[row, 2] + number - table[row, 1], table[row, 3]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in PIECE.names), pa.array(sequence), pa.array(offset)], names=[*PIECE.names, "sequence_id", "offset"])

    return run


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a staged table of pieces (the columns of PIECE); lengths are 1 to capacity."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    parts = common.partitions(pieces.sparkSession)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    numbered = numbered.join(before, ["length", "part"]).select(*PIECE.names, (F.col("before") + F.col("place") - 1).alias("number"))
    return numbered.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """One row per piece of each row of df: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id; a null or empty text is end_id alone. Longer ones are cut into pieces of
    capacity, the first of which may be shorter. Pieces fill sequences from offset 0 without gaps. Pieces of one length go to
    their places by doc_id, piece and digest: those that tie are alike but for where they are put, which any run may change.
    Rows that repeat are packed as often as they are there, and so are rows without a doc_id, which no other row is taken
    for. Other columns are ignored, and an empty table gives no rows.
    """
    pieces = common.documents(df).mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack_lengths(common.staged(pieces, "pieces"), capacity)
