"""Removes words that repeat what a smaller doc_id has, by seeds and extension.

Seeds are winnowed anchors of a few words (see anchors). The documents that meet at a seed are extended word by word, to
the right and to the left, each step splitting those that still match by their next word; who is left alone drops out. A
window is a number of words to the left and the rest to the right: the documents that match over both share it, and
neighbouring windows make up the maximal repeats over the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

WINDOW = 13
GRAM = 5


def _split(classes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Classes of equal class and symbol; -1 for those that are alone."""
    order = np.lexsort((symbols, classes))
    c, s = classes[order], symbols[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    numbers = np.cumsum(fresh) - 1
    numbers[np.bincount(numbers)[numbers] < 2] = -1
    out = np.empty(len(order), np.int64)
    out[order] = numbers
    return out


def _extended(contexts: anchors.Contexts, rows: np.ndarray, seed: np.ndarray, first: np.ndarray, room: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """Classes of the rows after 0, 1, 2 ... words beyond the seed in one direction; -1: no longer matches any other."""
    found, now = [seed], seed
    for n in range(most):
        alive = np.flatnonzero((now >= 0) & (room[rows] > n))
        after = np.full(len(rows), -1, np.int64)
        if len(alive):
            after[alive] = _split(now[alive], contexts.symbols[first[rows[alive]] + step * n])
        found.append(after)
        now = after
    return found


def smallest_by_extension(contexts: anchors.Contexts, units: anchors.Units) -> np.ndarray:
    """For each window of each context the smallest doc_id of a context that holds it."""
    number = contexts.number
    first_window = np.cumsum(number) - number
    best = np.repeat(contexts.doc_id, number)
    same = contexts.anchor[1:] == contexts.anchor[:-1]
    rows = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if not len(rows):
        return best
    spare = units.window - units.gram
    seed = np.unique(contexts.anchor[rows], return_inverse=True)[1].astype(np.int64)
    anchor = contexts.offset + contexts.lead
    size = number - 1 + units.window
    right = _extended(contexts, rows, seed, anchor + units.gram, size - contexts.lead - units.gram, 1, spare)
    left = _extended(contexts, rows, seed, anchor - 1, contexts.lead, -1, spare)
    for reach in range(spare + 1):  # words of the window to the left of the seed
        window = contexts.lead[rows] - reach
        ok = np.flatnonzero((window >= 0) & (window < number[rows]) & (left[reach] >= 0) & (right[spare - reach] >= 0))
        if not len(ok):
            continue
        classes = _split(left[reach][ok], right[spare - reach][ok])
        ok, classes = ok[classes >= 0], classes[classes >= 0]
        if not len(ok):
            continue
        least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, contexts.doc_id[rows[ok]])
        best[first_window[rows[ok]] + window[ok]] = least[classes]
    return best


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _finish(raw: bytes, covered) -> tuple:
    held = np.frombuffer(raw, np.uint8)
    start, stop, _ = anchors.word_places(held, np.array([0, len(held)]))
    gone = covered(len(start))
    words = [raw[a:b] for a, b in zip(start[~gone].tolist(), stop[~gone].tolist(), strict=True)]
    return len(start), int(gone.sum()), hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256 (the words that stay, joined by one space).

    Words are runs of anything but space and 0x09 to 0x0D. A word goes if `window` consecutive words that cover it also start
    in a row with a smaller doc_id; windows are judged on the input. Words count as equal when the 64-bit
    digests of anchors.word_digests are, a window when those of all its words are. Texts count whole, however long; a null text has no words. Rows that share a doc_id do not remove
    from each other; a row without one neither loses words nor takes any. Other columns are ignored, and an empty table
    gives no rows."""
    units = anchors.Units(window, gram, "<u8", anchors.cut_words)
    out = anchors.repeats(df, units, smallest_by_extension, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", OUT)
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    bare = common.documents(df).where("doc_id is null").withColumn("words", words)
    return out.unionByName(bare.select("doc_id", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(F.array_join("words", " "), 256).alias("kept_sha256")))
