"""Language identification with hyperdimensional profiles.

Every letter, of whatever script, has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each rotated (permuted) by its place; a document's vector bundles (adds) those of its n-grams; a language's
prototype bundles its documents, each at unit length. A document gets the language whose prototype has the largest cosine
with it.

Letters are the lower-case letters of the text; whatever is no letter is a space, which has a vector too, and runs of
spaces are one. Vectors of n-grams are kept in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSION = 512
GRAM = 3
SEED = 7
LETTER_BITS = 21
KEPT = 1 << 16  # n-grams in the table; it is emptied when it is full
#: Documents of each language, as expected, that the prototypes are fitted on: a bounded sample.
PER_LANGUAGE = 2000
LANGUAGES = 100_000  # rows of counts that are broadcast at most
UNKNOWN = "und"


@cache
def _alphabetic() -> np.ndarray:
    """Which code points are letters."""
    return np.array([not 0xD800 <= code < 0xE000 and chr(code).isalpha() for code in range(0x110000)])


def letter_vector(code: int, dimension: int = DIMENSION, seed: int = SEED) -> np.ndarray:
    """The random vector of a letter; the code of a space is 0."""
    return np.random.default_rng([seed, code]).choice(np.array([-1, 1], np.int8), dimension)


class Hypervectors:
    """Vectors of n-grams, made on demand; an n-gram is the number that its letters' code points make."""

    def __init__(self, dimension: int = DIMENSION, gram: int = GRAM, kept: int = KEPT):
        self.dimension, self.gram, self.kept = dimension, gram, kept
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.zeros((kept, dimension), np.int8)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a text and their counts."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.concatenate([[0], code * _alphabetic()[code], [0]])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        n = len(code) - self.gram + 1
        if n < 1 or not code.any():
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        number = code[:n]
        for place in range(1, self.gram):
            number = number << LETTER_BITS | code[place : n + place]
        one, counts = np.unique(number, return_counts=True)
        return one, counts.astype(np.float32)

    def bound(self, number: int) -> np.ndarray:
        """The vector of an n-gram."""
        out = np.ones(self.dimension, np.int8)
        for turns in range(self.gram):  # the last letter is not rotated
            code = number >> LETTER_BITS * turns & (1 << LETTER_BITS) - 1
            if code not in self.letters:
                self.letters[code] = letter_vector(code, self.dimension)
            out *= np.roll(self.letters[code], turns)
        return out

    def rows(self, grams: list[int]) -> np.ndarray:
        if len(self.row) + len(grams) > self.kept:
            self.row.clear()
        for number in grams:
            if number not in self.row:
                self.table[len(self.row)] = self.bound(number)
                self.row[number] = len(self.row)
        return self.table[[self.row[x] for x in grams]]

    def bundle(self, text: str) -> np.ndarray | None:
        """The document's vector; None if it has no letter."""
        grams, counts = self.grams(text)
        if not len(grams):
            return None
        step = min(4096, self.kept)
        return sum(counts[at : at + step] @ self.rows(grams[at : at + step].tolist()).astype(np.float32) for at in range(0, len(grams), step))


_held: dict[tuple[int, int], Hypervectors] = {}


def vectors(dimension: int = DIMENSION, gram: int = GRAM) -> Hypervectors:
    if (dimension, gram) not in _held:
        _held[dimension, gram] = Hypervectors(dimension, gram)
    return _held[dimension, gram]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Prototypes from columns doc_id, text, lang (none of them null). Of a language with more rows a share is taken, by
    digests of their ids, that makes `per_language` rows as expected."""
    counts = common.staged(df.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    if counts.count() <= LANGUAGES:  # so that texts need not be shuffled by language
        counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30))
    sample = df.join(counts, "lang").where(place * F.col("rows") < F.lit(per_language << 30))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                vector = vectors().bundle(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64) / max(np.linalg.norm(vector), 1e-12)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "total"])

    parts = sample.select("lang", "text").mapInArrow(bundled, "lang string, total array<double>").select("lang", F.posexplode("total").alias("place", "value"))
    totals: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():  # one number for each language and dimension
        totals.setdefault(row["lang"], np.zeros(DIMENSION))[row["place"]] = row["value"]
    names = sorted(totals)
    if not names:
        return [], np.zeros((0, DIMENSION), np.float32)
    raw = np.array([totals[x] / max(np.linalg.norm(totals[x]), 1e-12) for x in names])
    return names, raw.astype(np.float32)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(df: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of df: doc_id, held_out, lang_pred, score (the cosine, 0 to 1).

    Learns from text and lang of rows that are not held out and have a lang. A text that is null or has no letter gets
    `und` and score 0, as does every text where nothing can be learned. Ties go to the language that sorts first. Other
    columns are ignored, rows that repeat stay, an empty table gives no rows, and whole texts count, however long."""
    common.bounded(df.sparkSession)
    known = df.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, prototypes = fit(known, per_language)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vectors()
        for batch in batches:
            said, scores = [], []
            for text in batch["text"].to_pylist():
                vector = own.bundle(text) if names else None
                if vector is None:
                    said.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-12)
                best = int(cosines.argmax())
                said.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(said, pa.string()), pa.array(scores, pa.float64())], schema=OUT)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
