"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised from left to right: the longest prefix that the model's compiled character map has becomes its
replacement, anything else one character as it is; a space becomes the mark of a word. Every normalised byte keeps the
place in the original text that it comes from, so that each piece projects to a span of original bytes.

Pieces are byte pairs over the normalised characters: the neighbours whose union scores best are joined, the left ones of
several. No piece holds a mark behind another character, so a text is cut before every such mark; the cuts are encoded
once and kept in a bounded table. Characters that no piece has become one piece for each byte.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .anchors import spread
from .bpe import Kept, Spelling

#: Fixed values of the model's format: kinds of pieces, the mark of a space, what an undecodable byte becomes.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
MARK, BAD = "▁", b"\xef\xbf\xbd"
NONE = 1 << 60
SHORT = 64  # parts of a cut that are scanned for the best pair; more go through a heap
REMEMBERED = 48  # characters of a cut that is kept
SIZE = 1 << 20  # bytes that are encoded together


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 2: None, 5: 4}[tag & 7]
            size = number() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double-array trie of prefixes, and the replacements that its leaves point to."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:], and the prefix's length."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node = self._child(node)
            if leaf:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(0, found[0])], found[1]

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << (unit >> 6 & 8))


class Model:
    """A model file: pieces with scores, the normaliser's settings, the decoder's."""

    def __init__(self, data: bytes):
        self.pieces, scores, self.kinds = [], [], []
        trainer: dict = {3: 1, 24: 0, 35: 0, 44: " ⁇ ".encode()}
        normaliser: dict = {2: b"", 3: 1, 4: 1, 5: 1}
        denormaliser: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field in (2, 3, 5):
                {2: trainer, 3: normaliser, 5: denormaliser}[field].update(_fields(value))
        if trainer[3] != BPE or not trainer[35] or trainer[24] or denormaliser.get(2) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte pair models with byte fallback, marks before words, no user defined or unused pieces, and no denormaliser")
        self.unknown, self.surface = self.kinds.index(UNKNOWN), trainer[44]
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(normaliser[2]), *map(bool, (normaliser[3], normaliser[4], normaliser[5]))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in self.ids.items()}  # equal scores have equal ranks: the left pair goes first
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self.mark = MARK if self.escape else " "
        apart = all(self.mark not in p.lstrip(self.mark) for p in self.ids)
        self.cut = re.compile(f"{self.mark}*[^{self.mark}]+|{self.mark}+" if apart else "(?s).+")
        is_byte = np.array([k == BYTE for k in self.kinds])
        self.is_byte, byte_of = is_byte, {i: bytes([b]) for b, i in enumerate(self.byte_ids) if is_byte[i]}
        self.length = np.array([1 if is_byte[i] else len(p.encode()) for i, p in enumerate(self.pieces)])
        said = [byte_of.get(i, b"") if is_byte[i] else self.surface if i == self.unknown else b"" if self.kinds[i] == CONTROL else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.said, self.spelling = said, Spelling(said)
        self.decimal = Spelling([b"%d," % i for i in range(len(self.pieces))])

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and for its end, the place in text."""
        plain = not self.map.units and not self.squeeze
        if not text:
            return b"", np.zeros(1, np.int64)
        mark = self.mark.encode()
        head = mark if self.prefix else b""
        if plain:
            data = np.frombuffer(text, np.uint8)
            places = np.repeat(np.arange(len(data)), np.where(data == 32, len(mark), 1))
            return head + text.replace(b" ", mark), np.concatenate([np.zeros(len(head), np.int64), places, [len(data)]])
        at, steps = 0, []
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                size = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
                found = text[at : at + size], size
            steps.append((found[0], at, found[1]))
            at += found[1]
        out, places, blank = bytearray(), [], self.squeeze
        lead = 0
        while self.squeeze and lead < len(steps) and steps[lead][0] == b" ":
            lead += 1
        if lead == len(steps):
            return b"", np.zeros(1, np.int64)
        out += head
        places += [steps[lead][1]] * len(head)
        end = len(text)
        for said, start, size in steps[lead:]:
            if self.squeeze and blank:
                said = said.lstrip(b" ")
            if said:
                for byte in said:
                    new = mark if byte == 32 else bytes([byte])
                    out += new
                    places += [start] * len(new)
                blank = said.endswith(b" ")
                end = start + size
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while out.endswith(mark):
                end = places[len(out) - len(mark)]
                del out[-len(mark) :], places[len(places) - len(mark) :]
        else:
            end = len(text)
        return bytes(out), np.array([*places, end], np.int64)

    def merge(self, cut: str) -> list[str]:
        """The pieces of a cut, as they are joined."""
        parts, rank = list(cut), self.rank
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [rank.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, union = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != union:
                continue
            parts[i], parts[j] = union, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def encode_cut(self, cut: str) -> list[int]:
        out = []
        for part in self.merge(cut):
            if part in self.ids:
                out.append(self.ids[part])
            else:
                out += [self.byte_ids[b] for b in part.encode()]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of any ids: the first mark goes if the model puts one there; bytes that are no UTF-8 become BAD."""
        out, run, lead = bytearray(), bytearray(), self.prefix or self.squeeze
        gone = False
        for i in ids:
            if self.is_byte[i]:
                run += self.said[i]
                continue
            out += _sound(bytes(run))
            run.clear()
            lead = lead and not gone and not out
            said = self.said[i]
            if lead and self.kinds[i] == NORMAL and said.startswith(b" "):
                said, gone = said[1:], not self.squeeze
            out += said
        return bytes(out + _sound(bytes(run)))


def _sound(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = bytearray(), 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out += run[at : at + size].decode().encode()
                    at += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out += BAD
                at += 1
        return bytes(out)


@cache
def model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


class Encoder:
    """Encodes texts a group at a time; ids of cuts that were met are kept end to end in a pool."""

    def __init__(self, own: Model, kept: int = 400_000):
        self.model, self.kept = own, kept
        self._forget()

    def _forget(self) -> None:
        self.entry = Kept(self._learn, 1 << 60)
        self.pool, self.first, self.count, self.used = np.zeros(1 << 16, np.int32), [], [], 0

    def _learn(self, cut: str) -> int:
        ids = self.model.encode_cut(cut)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first.append(self.used)
        self.count.append(len(ids))
        self.used += len(ids)
        return len(self.first) - 1

    def group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, the texts' offsets in them, and the start and end of each id's span in its own text."""
        own = self.model
        if len(self.first) > self.kept:
            self._forget()
        normal = [own.normalise(t) for t in texts]
        cuts = [own.cut.findall(said.decode()) for said, _ in normal]
        entry = np.array([self.entry[c] for found in cuts for c in found], np.int64)
        first, count = np.array(self.first, np.int64), np.array(self.count, np.int64)
        sizes = count[entry] if len(entry) else np.zeros(0, np.int64)
        ids = self.pool[spread(first[entry], sizes)] if len(entry) else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cuts)])]
        for found in cuts:  # what is long, or seldom met again, does not stay
            for c in found:
                if len(c) > REMEMBERED:
                    self.entry.pop(c, None)
        start, end = self._spans(ids, offsets, normal)
        return ids, offsets, start, end

    def _spans(self, ids: np.ndarray, offsets: np.ndarray, normal: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The normalised bytes of every id, projected to the original ones. Of a character's bytes the last has its span."""
        own, lengths = self.model, self.model.length[ids]
        ends = np.cumsum(lengths)
        bases = np.cumsum([0, *(len(said) for said, _ in normal)])[:-1]
        row = np.repeat(np.arange(len(normal)), np.diff(offsets))
        places = np.concatenate([p for _, p in normal]) if normal else np.zeros(0, np.int64)
        shift = bases + np.arange(len(normal))  # each text has one place more than bytes
        of = lambda at: places[at - bases[row] + shift[row]]
        start, end = of(ends - lengths), of(ends)
        part = own.is_byte[ids]
        if part.any():
            data = np.frombuffer(b"".join(said for said, _ in normal) + b" ", np.uint8)
            whole = np.flatnonzero((data & 0xC0) != 0x80)
            at = (ends - lengths)[part]
            start[part] = places[whole[np.searchsorted(whole, at, "right") - 1] - bases[row[part]] + shift[row[part]]]
            last = (data[at + 1] & 0xC0) != 0x80
            end[part] = np.where(last, end[part], start[part])
        return start, end


def groups(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a string column without nulls, SIZE bytes at a time; a longer row is a group of its own."""
    data, offsets = common.utf8(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SIZE, "right")) - 1)
        raw, own = data[offsets[at] : offsets[to]].tobytes(), (offsets[at : to + 1] - offsets[at]).tolist()
        yield at, to, [raw[a:b] for a, b in zip(own, own[1:], strict=False)]
        at = to


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode_decode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and
    spans_sha256 (of each id's start and end in the text's bytes, as little-endian 64-bit numbers).

    A null text counts as empty: no tokens, digests of nothing. Texts count whole, however long. Other columns are ignored;
    an empty table gives no rows; rows that repeat or have no doc_id stay. path: the model, the same on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        encoder, sha256 = Encoder(own), hashlib.sha256
        lead = own.prefix and not own.squeeze  # what is encoded begins with a mark, and decodes without it
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, _, texts in groups(batch["text"]):
                ids, offsets, start, end = encoder.group(texts)
                out[0] += np.diff(offsets).tolist()
                said, at = own.decimal.spell(ids, offsets)
                out[1] += [sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                if lead:
                    said, at = own.spelling.spell(ids, offsets)
                    out[2] += [sha256(said[a + (b > a) : b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                else:
                    out[2] += [sha256(own.decode(ids[a:b].tolist())).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
                spans = np.stack([start, end], 1).astype("<i8")
                out[3] += [sha256(spans[a:b].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return common.documents(df).mapInArrow(run, OUT)


def encode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, ids, and the starts and ends of their spans in the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model(path))
        for batch in batches:
            for at, to, texts in groups(batch["text"]):
                ids, offsets, start, end = encoder.group(texts)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (start, pa.int64()), (end, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at:to], *lists], names=["doc_id", "ids", "starts", "ends"])

    return common.documents(df).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """One row per row of df: doc_id, text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids).decode() for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
