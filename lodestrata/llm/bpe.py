"""Byte-level BPE with a contiguous rank array.

A word (pre-token) is an array of parts and an array of the ranks of adjacent pairs. The smallest rank is found by a
scan, its boundary is deleted, and the two neighbouring ranks are looked up again. New words of one length go through
these steps together, as rows of an array. Words of over LONG bytes use a heap over the same ranks, so that a text without
spaces stays n log n. Words repeat: results are kept in bounded tables.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

LONG = 256
KEPT = 400_000
NONE = 1 << 60
NO_RANK = np.int32(2**31 - 1)
#: Fixed value: the pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Kept(dict):
    """A bounded table: what is missing is made; at the bound it starts afresh."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Vocabulary:
    """A tokenizer file: tokens by id, ranks by pair of ids, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = _byte_letters()
        ids = read["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        by_letter = {b: c for c, b in letters.items()}
        self.byte_id = [ids[by_letter[b]] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(read["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[ids[left] << 32 | ids[right]] = rank
            self.merged.append(ids[left + right])
        order = np.argsort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.sorted_keys = np.fromiter(self.pairs, np.int64, len(self.pairs))[order]
        self.sorted_ranks = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))[order]
        self.merged_ids, self.byte_ids = np.array(self.merged, np.int32), np.array(self.byte_id, np.int32)
        self.byte_ranks = self.ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.pattern = regex.compile(PATTERN)
        self.words = Kept(lambda word: self.encode_word(word.encode()))
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def encode_word(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        if len(parts) > LONG:
            return self._encode_long(parts)
        get, merged = self.pairs.get, self.merged
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = joined = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | joined, NONE)
            if i < len(ranks):
                ranks[i] = get(joined << 32 | parts[i + 1], NONE)
        return parts

    def encode_rows(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode_word for words of one length, the rows of an array of bytes: each step deletes one boundary of every row
        that has one to delete. Gives the rows that end with one number of parts, and these."""
        parts, row = self.byte_ids[raw], np.arange(len(raw))
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        while len(row) and parts.shape[1] > 1:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            left = least != NO_RANK
            if not left.all():
                yield row[~left], parts[~left]
                row, parts, ranks, at, least = row[left], parts[left], ranks[left], at[left], least[left]
            width, index = parts.shape[1] - 1, np.arange(len(row))
            columns = np.arange(width)
            parts = np.where(columns <= at[:, None], parts[:, :-1], parts[:, 1:])
            parts[index, at] = self.merged_ids[least]
            ranks = np.where(columns[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for near in (at - 1, at):
                ok = (near >= 0) & (near < width - 1)
                i, j = index[ok], near[ok]
                ranks[i, j] = self.ranks_of(parts[i, j], parts[i, j + 1])
        if len(row):
            yield row, parts

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.sorted_keys, keys)
        at[at == len(self.sorted_keys)] = 0
        return np.where(self.sorted_keys[at] == keys, self.sorted_ranks[at], NO_RANK)

    def _encode_long(self, parts: list[int]) -> list[int]:
        get, n = self.pairs.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(parts[a] << 32 | parts[b], NONE)) != NONE:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode_chunk(self, chunk: str, keep: bool = True) -> list[int]:
        words = self.words
        return [i for word in self.pattern.findall(chunk) for i in (words[word] if keep else self.encode_word(word.encode()))]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in ([part] if isinstance(part, int) else self.encode_chunk(part))]

    def parts(self, text: str) -> Iterator[str | int]:
        """The text between added tokens, and the ids of these."""
        if self.added_pattern is None:
            yield text
            return
        at = 0
        for m in self.added_pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TextEncoder:
    """Encodes many texts at once. Texts are cut into chunks where the pre-tokenizer always starts a word: before a space
    that a non-space follows, and around a single line feed between non-spaces. Chunks are looked up by a 64-bit hash in
    a bounded table; new ones are encoded together, one array for each length. What the ids spell is compared with the
    texts byte by byte: texts in which two chunks share a hash are encoded without the table."""

    MOST = 64  # bytes of a chunk that is looked up

    def __init__(self, vocab: Vocabulary, kept: int = 2 * KEPT, size: int = 1 << 20):
        self.vocab, self.kept, self.size = vocab, kept, size
        self.spelling = Spelling([vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)])
        draw = np.random.default_rng(50_257)
        self.value = draw.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(draw.integers(2**62, 2**63)) | 1
        self.powers = self.inverse = np.ones(1, np.uint64)
        byte = np.arange(256)
        blank = np.isin(byte, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
        self.may_be_blank = blank | np.isin(byte, [0xC2, 0xE1, 0xE2, 0xE3])  # first bytes of white space
        self.surely_ink = ~blank & (byte < 128)
        self.letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
        self.mark = np.isin(byte, list(b",.;:!?"))
        self.tail = (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)  # after 0xC3: a Latin letter
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, list[int]]]:
        """For groups of rows of a string column: their ids end to end and the offsets of the rows in them, and the same of
        the bytes that the ids spell."""
        at, rows = 0, len(offsets) - 1
        while at < rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.size, "right")) - 1)
            yield self._group(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, list[int]]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), b"", [0] * len(offsets)
        raw = data.tobytes()
        if not any(token.encode() in raw for token in self.vocab.added):
            starts = self._starts(data, offsets)
            keys, sizes = self._hash(data, starts)
            entry, counts = self._entries(data, starts, sizes, keys)
            ends = np.cumsum(counts)
            ids = self.pool[np.repeat(entry - ends + counts, counts) + np.arange(ends[-1])]
            places = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
            said, at = self.spelling.spell(ids, places)
            if said == raw and at == offsets.tolist():
                return ids, places, said, at
        found = [np.array(self.vocab.encode(raw[a:b].decode()), np.int32) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        ids, places = np.concatenate(found), np.cumsum([0, *map(len, found)])
        return ids, places, *self.spelling.spell(ids, places)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start = np.zeros(len(data) + 1, bool)
        start[:-2] = (data[:-1] == 32) & ~self.may_be_blank[data[1:]]
        ink = self.surely_ink[data]
        feed = np.flatnonzero(data[1:-1] == 10) + 1
        before = ink[feed - 1] | (data[np.maximum(feed - 2, 0)] == 0xC3)
        feed = feed[before & (ink[feed + 1] | (data[feed + 1] == 0xC3))]
        start[feed] = start[feed + 1] = True
        inner = offsets[1:-1]
        start[np.maximum(inner - 1, 0)] &= ~np.isin(data[np.minimum(np.maximum(inner - 1, 0), len(data) - 1)], [32])  # a space that ends its text
        start[offsets] = True
        # a line feed beside a text's end is no cut of its own
        start[-1] = False
        return np.flatnonzero(start)

    def _hash(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < len(data):
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), x, np.uint64)])) for x in (self.base, pow(self.base, -1, 1 << 64)))
        ends = np.append(starts[1:], len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.powers[: len(data)])])
        keys = (sums[ends] - sums[starts]) * self.inverse[starts]
        return (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64), ends - starts

    def _entries(self, data, starts, sizes, keys) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's ids are in the pool, and how many."""
        entry, counts = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        long = np.flatnonzero(sizes > self.MOST)
        short = np.flatnonzero(sizes <= self.MOST)
        one, where, back = np.unique(keys[short], return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, one), max(0, len(self.keys) - 1))
        known = self.keys[at] == one if len(self.keys) else np.zeros(len(one), bool)
        if not known.all():
            if len(self.keys) + len(one) > self.kept:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            rows = short[where[new]]
            first, count = self._learn(data, starts[rows], sizes[rows])
            spot = np.searchsorted(self.keys, one[new])
            self.keys, self.first, self.count = (np.insert(held, spot, more) for held, more in ((self.keys, one[new]), (self.first, first), (self.count, count)))
            at = np.searchsorted(self.keys, one)
        entry[short], counts[short] = self.first[at][back], self.count[at][back]
        if len(long):
            found = [self.vocab.encode_chunk(data[starts[i] : starts[i] + sizes[i]].tobytes().decode(), keep=False) for i in long]
            held = self.used
            entry[long], counts[long] = self._store([np.array([i for ids in found for i in ids], np.int32)], np.array([len(ids) for ids in found]))
            self.used = held  # long chunks are not kept: the next ones overwrite them
        return entry, counts

    def _store(self, flat: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)) * 2, np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return first, counts

    def _learn(self, data, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sizes, kind="stable")
        flat, counts = [], []
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for rows in np.split(order, bounds):
            n = int(sizes[rows[0]])
            raw = data[starts[rows][:, None] + np.arange(n)]
            lead, letter = raw == 0xC3, self.letter[raw]
            tail = np.zeros_like(lead)
            tail[:, 1:] = lead[:, :-1] & self.tail[raw[:, 1:]]
            good = letter | tail
            good[:, :-1] |= lead[:, :-1] & tail[:, 1:]
            good[:, 0] |= (raw[:, 0] == 32) & (n > 1)
            plain = good.all(1)
            marked = self.mark[raw[:, -1]] & good[:, :-1].all(1) & (good[:, -2] & (raw[:, -2] != 32) if n > 1 else False)
            other = ~plain & ~marked
            count = np.zeros(len(rows), np.int64)
            parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their ids as an array
            for kind, body in ((plain, raw), (marked, raw[:, :-1])):
                if kind.any():
                    index = np.flatnonzero(kind)
                    for done, ids in self.vocab.encode_rows(body[index]):
                        if kind is marked:
                            ids = np.concatenate([ids, self.vocab.byte_ids[raw[index[done], -1]][:, None]], 1)
                        parts.append((index[done], ids))
            for i in np.flatnonzero(other):
                parts.append((np.array([i]), np.array([self.vocab.encode_chunk(raw[i].tobytes().decode())], np.int32)))
            for index, ids in parts:
                count[index] = ids.shape[1]
            first = np.cumsum(count) - count
            out = np.empty(int(count.sum()), np.int32)
            for index, ids in parts:
                out[first[index][:, None] + np.arange(ids.shape[1])] = ids
            flat.append(out)
            counts.append(count)
        first, count = self._store(flat, np.concatenate(counts))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return first[back], count[back]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder, sha256 = TextEncoder(vocab), hashlib.sha256
        decimal = Spelling([b"%d," % i for i in range(max(vocab.bytes_of) + 1)])
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, offsets, decoded, places in encoder.batch(*common.utf8(batch["text"])):
                n += np.diff(offsets).tolist()
                said, at = decimal.spell(ids, offsets)
                ids_sha += [sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                text_sha += [sha256(decoded[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(places, places[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=OUT)

    return run


class Spelling:
    """Writes ids as bytes, each id by its own spelling."""

    def __init__(self, spellings: list[bytes]):
        self.size = np.array([len(x) for x in spellings])
        self.first = np.cumsum(self.size) - self.size
        self.held = np.frombuffer(b"".join(spellings), np.uint8)

    def spell(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        """All bytes, and where the rows begin in them."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        said = self.held[np.repeat(self.first[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()
        return said, np.concatenate([[0], ends])[offsets].tolist()


def encode_decode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    A null text counts as empty: no tokens, digests of the empty string. Texts count whole, however long. Other columns are ignored; an empty table gives
    no rows; rows that repeat stay. path: the vocabulary file, the same on every machine.
    """
    return common.documents(df).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, ids."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([vocab.encode(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))], schema=IDS)

    return common.documents(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, text; null ids give null, bytes that are no UTF-8 the replacement character."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids).decode("utf-8", "replace") for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
