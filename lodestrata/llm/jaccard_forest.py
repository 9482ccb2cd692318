"""Near-duplicate join over word shingles by a MinHash LSH forest with exact verification.

A document is the set of its runs of five words. Equal sets become one representative, with a number of its own (doc_ids
may be shared by different texts). The forest has TREES prefix tries; a representative's label in each is DEPTH minhashes,
16 bits of each. Labels are sorted, so who shares a prefix stands together, and every trie is walked from full depth up:

1. among those that share the whole label one leads, and those whose signatures agree with its closely enough to stand for
   it are led: they leave the walk. Leaders go on to the next shorter prefix, down to the floor, the length at which pairs at
   the threshold meet in some trie with the target recall. Each task walks its own labels first, so that only leaders are
   shuffled: a group of near copies, however large, is a few rows of each task;
2. an edge is a leader and who meets it with a signature that may still belong to a linked pair; pairs that meet by chance
   give none, and of pairs that other edges connect none is needed. Of all pairs that met and agree as linked ones do, the share that meets at each depth is measured over all
   data: prefixes are shortened only until that share reaches the target recall;
3. components of the edges are the clusters. Within a cluster pairs are compared by the exact Jaccard similarity of their
   sets and counted, not written out. Clusters of many shingles are cut into blocks, and each pair of blocks is a task. What
   leaves a task is one row a representative and block pair: its number of links there and the root of its component there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 6
RECALL = 0.99999
SPREAD = 0.15  # what a signature's estimate may be below the similarity, about four standard deviations
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
PLANTED = 4_096  # representatives whose labels are walked together before the shuffle
GROUP_SHINGLES = 1 << 18  # of small clusters that are verified together


def floor_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold meet in some trie with the target recall: none shorter is needed."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the different hashes of its runs of `size` words, sorted, and the rows' offsets. A text of fewer words is
    one run; one without words has none."""
    values, _, at = anchors.cut_words(data, offsets)
    n = np.diff(at)
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(runs)
    total = int(ends[-1]) if len(ends) else 0
    row = np.repeat(np.arange(len(n)), runs)
    start = np.repeat(at[:-1] - ends + runs, runs) + np.arange(total)
    stop = np.minimum(start + size, at[1:][row])
    found = anchors.ROLLER.runs(anchors.ROLLER.sums(values), start, stop) + (stop - start).astype(np.uint64)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    row, found = row[fresh], found[fresh]
    return found, np.searchsorted(row, np.arange(len(n) + 1))


class MinHash:
    def __init__(self, number: int = TREES * DEPTH, seed: int = 97):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 2**31, number, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 2**32, number, dtype=np.uint32)

    def labels(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """16 bits of each minhash of every row that has shingles."""
        low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
        out = np.empty((len(at) - 1, len(self.a)), np.uint16)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, k] = (np.minimum.reduceat(low * a + b, at[:-1]) * np.uint32(2654435761)) >> np.uint32(16)
        return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("same", pa.binary()), ("n", pa.int64()), ("labels", pa.binary())])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = MinHash()
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for first, data, offsets in anchors.batches_of(*common.utf8(batch["text"])):
            found, at = shingles(data, offsets)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            labels = forest.labels(found, np.append(at[:-1][some], at[-1])) if len(some) else np.zeros((0, len(forest.a)), np.uint16)
            held: list = [None] * len(sizes)
            same: list = [None] * len(sizes)
            for row, label in zip(some.tolist(), labels, strict=True):
                held[row] = label.astype(">u2").tobytes()
                same[row] = _digest(found[at[row] : at[row + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(sizes)]), batch["text_sha256"].slice(first, len(sizes)), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], schema=SIGNED)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    n, width = matrix.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


def _sketches(labels: np.ndarray) -> np.ndarray:
    """Two bits of each minhash, 32 to a word."""
    n, number = labels.shape
    bits = np.zeros((n, -(-number // 32) * 32), np.uint64)
    bits[:, :number] = labels & np.uint16(3)
    return np.bitwise_or.reduce(bits.reshape(n, -1, 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=2)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the minhashes of each pair agree by two bits."""
    differ = a ^ b
    return TREES * DEPTH - np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1).astype(np.int64)


def agreement(similarity: float) -> float:
    """How many minhashes are expected to agree by two bits: unequal ones do so once in four."""
    return TREES * DEPTH * (0.25 + 0.75 * max(0.0, similarity))


@dataclass(frozen=True)
class Bounds:
    """From which agreement one leads another, and from which they share an edge. If a and b are linked and each is led by
    another, these two leaders differ by no more than the three distances between them together."""

    lead: float
    edge: float

    @staticmethod
    def of(threshold: float) -> Bounds:
        lead = (1 + threshold) / 2
        return Bounds(agreement(lead), agreement(1 - 2 * (1 - lead) - (1 - threshold) - SPREAD))


@dataclass
class Labels:
    """Places in the forest, sorted: the hash of a trie and its floor prefix, the levels below that, who stands there, and
    the signature."""

    prefix: np.ndarray
    levels: np.ndarray
    rep: np.ndarray
    sketch: np.ndarray

    def take(self, rows: np.ndarray) -> Labels:
        return Labels(self.prefix[rows], self.levels[rows], self.rep[rows], self.sketch[rows])

    def sorted(self) -> Labels:
        return self.take(np.lexsort((self.rep, *self.levels.T[::-1], self.prefix)))

    def walk(self, floor: int, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
        """Edges (rep, leader, depth, agreement) and the places of those that nobody leads. Of the pairs that share a prefix and
        an edge, those are left out that other edges connect: edges are fewer than places. Smaller reps lead larger ones, so
        that tries agree on leaders."""
        alive, parent, edges = np.arange(len(self.rep)), np.arange(len(self.rep)), [np.zeros((0, 4), np.int64)]

        def root(x: np.ndarray) -> np.ndarray:
            while (parent[x] != x).any():
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for depth in range(floor + self.levels.shape[1], floor - 1, -1):
            fresh = np.ones(len(alive), bool)
            own = self.levels[alive, : depth - floor]
            fresh[1:] = (self.prefix[alive[1:]] != self.prefix[alive[:-1]]) | (own[1:] != own[:-1]).any(1)
            run, led = np.cumsum(fresh), np.zeros(len(alive), bool)
            left = np.lexsort((self.rep[alive], run))
            while len(left):
                first = np.concatenate([[True], run[left[1:]] != run[left[:-1]]])
                head, rest = left[first][np.cumsum(first) - 1][~first], left[~first]
                a, h = alive[rest], alive[head]
                agree = _agreeing(self.sketch[a], self.sketch[h])
                near = np.flatnonzero(agree >= bounds.edge)
                of_a, of_h = root(a[near]), root(h[near])
                one = np.unique(of_a, return_index=True)[1]
                one = one[of_a[one] != of_h[one]]
                parent[of_a[one]] = of_h[one]
                some = near[one]
                edges.append(np.stack([self.rep[a[some]], self.rep[h[some]], np.full(len(some), depth), agree[some]], 1))
                led[rest[agree >= bounds.lead]] = True
                left = rest[agree < bounds.lead]
            alive = alive[~led]
        found = np.concatenate(edges)
        found[:, :2] = np.sort(found[:, :2], axis=1)
        found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
        return found[fresh & (found[:, 0] != found[:, 1])], alive


FOREST = pa.schema([("prefix", pa.int64()), ("levels", pa.binary()), ("rep", pa.int64()), ("sketch", pa.binary()), ("other", pa.int64()), ("depth", pa.int32()), ("agree", pa.int32())])


def _forest(places: Labels, edges: np.ndarray) -> pa.RecordBatch:
    """Rows of places, and of edges, which go to the task of any prefix."""
    n, m = len(places.rep), len(edges)
    none = lambda kind, k: pa.nulls(k, kind)
    join = lambda x, y: pa.concat_arrays([x, y])
    return pa.RecordBatch.from_arrays(
        [
            join(pa.array(places.prefix.view(np.int64)), pa.array(edges[:, 0])), join(_binary(places.levels.astype(">u2").view(np.uint8).reshape(n, -1)), none(pa.binary(), m)),
            join(pa.array(places.rep), pa.array(edges[:, 0])), join(_binary(places.sketch.view(np.uint8).reshape(n, -1)), none(pa.binary(), m)),
            join(none(pa.int64(), n), pa.array(edges[:, 1])), join(none(pa.int32(), n), pa.array(edges[:, 2], pa.int32())), join(none(pa.int32(), n), pa.array(edges[:, 3], pa.int32())),
        ],
        schema=FOREST,
    )


def _planted(floor: int, bounds: Bounds):
    """The places of representatives in all tries, walked within the batch: leaders and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLANTED):
                part = batch.slice(at, PLANTED)
                n = part.num_rows
                flat = np.frombuffer(b"".join(part["labels"].to_pylist()), ">u2").astype(np.uint16)
                labels = flat.reshape(n, TREES, DEPTH)
                key = np.arange(TREES, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for level in range(floor):
                    key = (key ^ labels[:, :, level].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                reps = np.repeat(part["rep"].to_numpy(zero_copy_only=False), TREES)
                places = Labels(key.ravel(), labels[:, :, floor:].reshape(n * TREES, DEPTH - floor), reps, np.repeat(_sketches(flat.reshape(n, -1)), TREES, 0)).sorted()
                edges, leaders = places.walk(floor, bounds)
                yield _forest(places.take(leaders), edges)

    return run


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("depth", pa.int32()), ("agree", pa.int32())])


def _walked(floor: int, bounds: Bounds):
    """Edges among the places that come sorted by prefix; a prefix may go on in the next batch. Edges go through."""

    def out(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[:, i], t) for i, t in enumerate(EDGES.types)], schema=EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = -(-TREES * DEPTH // 32)
        held: list[Labels] = []
        for batch in batches:
            place = pc.is_null(batch["other"])
            found = batch.filter(pc.invert(place))
            if found.num_rows:
                yield pa.RecordBatch.from_arrays([found[c] for c in ("rep", "other", "depth", "agree")], schema=EDGES)
            some = batch.filter(place)
            n = some.num_rows
            if not n:
                continue
            levels = np.frombuffer(b"".join(some["levels"].to_pylist()), ">u2").astype(np.uint16).reshape(n, DEPTH - floor)
            sketch = np.frombuffer(b"".join(some["sketch"].to_pylist()), np.uint64).reshape(n, words)
            held.append(Labels(some["prefix"].to_numpy().view(np.uint64), levels, some["rep"].to_numpy(), sketch))
            last = held[-1].prefix[-1]
            if held[0].prefix[0] == last:
                continue
            now = Labels(*(np.concatenate([getattr(x, c) for x in held]) for c in ("prefix", "levels", "rep", "sketch")))
            whole = now.prefix != last
            held = [now.take(~whole)]
            yield out(now.take(whole).sorted().walk(floor, bounds)[0])
        if held:
            now = Labels(*(np.concatenate([getattr(x, c) for x in held]) for c in ("prefix", "levels", "rep", "sketch")))
            yield out(now.sorted().walk(floor, bounds)[0])

    return run


def reached(edges: DataFrame, threshold: float, recall: float, floor: int) -> int:
    """The longest prefix at which the target share of the pairs that agree like linked ones has met in some trie."""
    met = {r["depth"]: r["n"] for r in edges.where(F.col("agree") >= agreement(threshold)).groupBy("depth").agg(F.count("*").alias("n")).collect()}  # at most DEPTH rows
    total, depth, n = sum(met.values()), DEPTH, met.get(DEPTH, 0)
    while depth > floor and n < recall * total:
        depth -= 1
        n += met.get(depth, 0)
    return depth if total else floor


def _intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first `split` sets with all others, or of all with all where there are no others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((split, len(sets) - split if split < len(sets) else split), np.float32)
    for at in range(0, width, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        held = np.zeros((len(sets), min(2048, width - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        out += held[:split] @ (held[split:] if split < len(sets) else held).T
    return out


def _linked(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    sizes = np.array([len(x) for x in sets], np.float64)
    left, right = sizes[:split, None], (sizes[split:] if split < len(sets) else sizes)[None, :]
    inter = _intersections(sets, split).astype(np.float64)
    million = round(threshold * 1_000_000)
    linked = inter * 1_000_000 >= million * (left + right - inter)
    if split == len(sets):
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray, reps: np.ndarray, split: int) -> np.ndarray:
    """Smallest representative of each one's component."""
    label = reps.copy()
    largest = np.iinfo(np.int64).max
    while True:
        if split == len(reps):
            near = np.where(linked, label[None, :], largest).min(1)
        else:
            near = np.concatenate([np.where(linked, label[None, split:], largest).min(1), np.where(linked, label[:split, None], largest).min(0)])
        after = np.minimum(label, near)
        if (after == label).all():
            return label
        label = after


VERIFIED = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("many", pa.bool_())])


def _verified(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cluster, side, rep, copies = (table[c].to_numpy() for c in ("cluster", "side", "rep", "copies"))
        many = table["many"].to_numpy()
        blobs = table["shingles"].to_pylist()
        apart = bool((table["i"].to_numpy() != table["j"].to_numpy()).any())  # two blocks, not one with itself; only where a cluster has blocks
        order = np.lexsort((rep, side, cluster))
        out: list[list[np.ndarray]] = []
        for _, part in anchors._parts(cluster[order]):
            own = order[part]
            again = (rep[own][1:] == rep[own][:-1]) & (side[own][1:] == side[own][:-1])  # a row that repeats its id and text
            own = own[np.concatenate([[True], ~again])]
            sets = [np.frombuffer(blobs[i], np.uint64) for i in own]
            split = int((side[own] == 0).sum())
            if apart and split in (0, len(own)):  # one of the blocks is empty
                continue
            linked = _linked(sets, split, threshold)
            reps, n = rep[own], copies[own]
            links = linked @ n if split == len(own) else np.concatenate([linked @ n[split:], linked.T @ n[:split]])
            out.append([reps, links, _roots(linked, reps, split), many[own]])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, VERIFIED.types, strict=True)], schema=VERIFIED)

    return run


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of representatives; another text may have the doc_id of one, but not its digest."""
    for batch in batches:
        same = batch["same"].to_pylist()
        for first, data, offsets in anchors.batches_of(*common.utf8(batch["text"])):
            found, at = shingles(data, offsets)
            own = [i for i in range(len(at) - 1) if _digest(found[at[i] : at[i + 1]]) == same[first + i]]
            if own:
                part = batch.take(pa.array([first + i for i in own]))
                sets = pa.array([found[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("rep", "cluster", "blocks", "copies")), sets], names=["rep", "cluster", "blocks", "copies", "shingles"])


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of df: doc_id, class_id, copy_of, n_links, text_sha256, stays.

    n_links is the number of other rows whose sets of five-word shingles have a Jaccard similarity of at least `threshold`
    with this one's; class_id is the smallest doc_id of the component that these links make, copy_of the smallest doc_id
    with the same set. stays is true on one row of each class, and on rows that repeat it. Words are runs of anything but space and 0x09 to 0x0D, unchanged. A text of one to four words has
    one shingle, all of it; a text without words, or null, is linked to nothing and a class of its own. Rows that share a
    doc_id are different rows with one id, whether their texts are equal or not. A row without an id takes no part: it comes
    back with null ids and no links. Texts count whole, however long. Other columns are ignored; an empty table gives no
    rows."""
    docs, bare = common.documents(df).where("doc_id is not null"), common.documents(df).where("doc_id is null")
    signed = docs.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(_signed, "doc_id long, text_sha256 string, same binary, n long, labels binary")
    signed = common.staged(signed, "signed")
    reps = signed.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.min(F.struct("doc_id", "text_sha256"))["text_sha256"].alias("first_text"))
    reps = common.staged(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")

    floor, bounds = floor_length(threshold, recall), Bounds.of(threshold)
    forest = reps.select("rep", "labels").mapInArrow(_planted(floor, bounds), "prefix long, levels binary, rep long, sketch binary, other long, depth int, agree int")
    walked = forest.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_walked(floor, bounds), "u long, v long, depth int, agree int")
    edges = common.staged(walked.groupBy("u", "v").agg(F.max("depth").alias("depth"), F.max("agree").alias("agree")), "met")
    edges = edges.where(F.col("depth") >= reached(edges, threshold, recall, floor)).select("u", "v")
    clusters = common.staged(components(edges).withColumnRenamed("node", "rep").withColumnRenamed("root", "cluster"), "clusters")

    members = clusters.join(reps.select("rep", "doc_id", "copies", "n", "same"), "rep")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = common.staged(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")), "sizes")
    total = sizes.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    slots = F.lit(max(common.partitions(df.sparkSession), -(-total // GROUP_SHINGLES)))
    members = members.select("rep", "doc_id", "cluster", "copies", "same").join(sizes.select("cluster", "blocks"), "cluster")
    held = docs.join(members, "doc_id").mapInArrow(_sets, "rep long, cluster long, blocks int, copies long, shingles binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), slots)).otherwise(F.col("cluster")).alias("slot"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cluster",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "copies", (F.col("blocks") > 1).alias("many"), "shingles",
    )
    verified = common.staged(dealt.groupBy("slot", "i", "j").applyInArrow(_verified(threshold), "rep long, links long, root long, many boolean"), "verified")
    linked = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    across = verified.where("many and rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    if not across.isEmpty():
        joined = components(across).withColumnRenamed("node", "rep").withColumnRenamed("root", "wide")
        linked = linked.join(joined, "rep", "left").select("rep", "links", F.least("root", F.coalesce("wide", "root")).alias("root"))
    known = reps.select("same", "rep", F.col("doc_id").alias("copy_of"), "copies", "first_text").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = common.staged(known, "known")
    least = known.groupBy("root").agg(F.min(F.struct("copy_of", "rep")).alias("least"))
    full = known.join(least, "root").select("same", "copy_of", "copies", "links", "least", F.when(F.col("rep") == F.col("least.rep"), F.col("first_text")).alias("first_text"))
    out = signed.select("doc_id", "text_sha256", "same").join(full, "same", "left").select(
        "doc_id",
        F.coalesce("least.copy_of", "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        "text_sha256",
        (F.col("same").isNull() | F.coalesce((F.col("doc_id") == F.col("copy_of")) & (F.col("text_sha256") == F.col("first_text")), F.lit(False))).alias("stays"),
    )
    null = F.lit(None).cast("long")
    return out.unionByName(bare.select("doc_id", null.alias("class_id"), null.alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.sha2("text", 256).alias("text_sha256"), F.lit(True).alias("stays")))
