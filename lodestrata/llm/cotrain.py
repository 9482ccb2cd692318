"""Quality classification by co-training of two views.

One classifier sees the text (hashed words, pairs of words and runs of four bytes, shares of printable bytes, how words and
lines repeat), the other the page's metadata (source, lang, n_chars). Both start from labelled rows. Over several rounds
every document outside these of which one view is sure teaches the other view, with its pseudo-label: executors add up
gradients and curvatures over all documents, and the driver takes a damped Newton step a round for each view. The pseudo-labelled
documents of a round weigh as much as the labelled ones together at most, and their classes as among these, however many
there are. A view's log-odds are calibrated, before it teaches and at last, on labelled rows that neither view has seen;
calibrated views are combined, and all documents are scored.

Labelled rows are a bounded sample (parameter `labelled`); all else covers every row and its whole text. Features are held
in half precision, a staged table that each round reads once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, common

LABELLED = 20_000
ROUNDS = 4
SURE = 0.95
RIDGE = {"text": 3.0, "meta": 1.0}
CALM = 0.1  # ridge of what calibrates and combines
KEEP_FROM = 0.5
WORD_FEATURES = 9
SHARES = 97 + WORD_FEATURES
WORD_SLOTS, RUN_SLOTS, RUN = 256, 128, 4
TEXT_FEATURES = SHARES + WORD_SLOTS + RUN_SLOTS
MOST = 10.0  # standard deviations that a feature counts at most
FAN = 16  # sums that are added up together
PIECE = 2048
SOURCES, LANGS, SIZES = 64, 16, 24
META_FEATURES = SOURCES + LANGS + SIZES + 1


def _slots(hashes: np.ndarray, row: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """Signed sums of hashes in slots, for each row, and beside them how many there are."""
    slot = (hashes >> np.uint64(32)) % np.uint64(slots)
    sign = ((hashes >> np.uint64(20)) & np.uint64(1)).astype(np.float64) * 2 - 1
    total = np.bincount(row * slots + slot.astype(np.int64), sign, rows * slots).reshape(rows, slots)
    return np.hstack([total, np.bincount(row, minlength=rows)[:, None]])


def _gram_sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    words, _, at = anchors.cut_words(data, offsets)
    own = np.repeat(np.arange(rows), np.diff(at))
    pair = np.flatnonzero(own[1:] == own[:-1])
    pairs = anchors._mix(words[pair] * anchors.MIX + words[pair + 1])
    said = _slots(np.concatenate([words, pairs]), np.concatenate([own, own[pair]]), rows, WORD_SLOTS)
    byte = np.repeat(np.arange(rows), np.diff(offsets))
    start = np.flatnonzero(byte[RUN - 1 :] == byte[: max(0, len(byte) - RUN + 1)])
    runs = anchors.ROLLER.runs(anchors.ROLLER.sums(anchors.ROLLER.byte[data]), start, start + RUN)
    return np.hstack([said, _slots(runs, byte[start], rows, RUN_SLOTS)])


def hashed_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of every row the words and pairs of words, and the runs of RUN bytes, each kind in slots of its own, over the root of
    their number. A row longer than a batch is added up by pieces of that length."""
    if len(offsets) == 2 and offsets[1] > anchors.BATCH:
        pieces = [data[at : at + anchors.BATCH] for at in range(0, len(data), anchors.BATCH)]
        total = sum(_gram_sums(piece, np.array([0, len(piece)])) for piece in pieces)
    else:
        total = _gram_sums(data, offsets)
    said, runs = total[:, : WORD_SLOTS + 1], total[:, WORD_SLOTS + 1 :]
    return np.hstack([x[:, :-1] / np.sqrt(np.maximum(x[:, -1:], 1)) for x in (said, runs)])


def text_shares(text: str | None) -> np.ndarray:
    """Shares of printable bytes, and how words and lines repeat."""
    out = np.zeros(SHARES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    out[:96] = np.sqrt(counts[32:128] / len(text))
    out[96] = np.sqrt(counts[128:].sum() / len(text))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    distinct, piped = len(set(words)) / n, sum("|" in x for x in lines) / max(1, len(lines))
    long = counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum())
    ink = (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n
    out[97:] = again, np.sqrt(again), distinct, piped, len(set(lines)) / max(1, len(lines)), long, min(ink, 8.0), min(len(text) / n, 30.0), sum(map(str.isupper, words)) / n
    return out


def text_matrix(column: pa.Array) -> np.ndarray:
    """The text view of a string column without nulls, in half precision."""
    out = np.zeros((len(column), TEXT_FEATURES), np.float16)
    for first, data, offsets in anchors.batches_of(*common.utf8(column)):
        out[first : first + len(offsets) - 1, SHARES:] = hashed_grams(data, offsets)
    for i, text in enumerate(column.to_pylist()):
        out[i, :SHARES] = text_shares(text)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META_FEATURES)
    out[zlib.crc32(str(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1
    size = np.log1p(max(0.0, float(n_chars))) if n_chars is not None and n_chars == n_chars else 0.0
    out[SOURCES + LANGS + min(SIZES - 1, int(2 * size))] = 1
    out[-1] = size / 10
    return out


def meta_matrix(source: list, lang: list, n_chars: list) -> np.ndarray:
    return np.array([meta_features(*row) for row in zip(source, lang, n_chars, strict=True)], np.float16).reshape(-1, META_FEATURES)


@dataclass
class Logistic:
    """Ridge logistic regression over standardised features, by Newton steps from sums over rows."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features by their mean and deviation, and a one."""
        return np.hstack([np.clip((x.astype(np.float64) - self.mean) / self.scale, -MOST, MOST), np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the log-likelihood."""
        gradient, curvature = np.zeros(len(self.weights)), np.zeros((len(self.weights), len(self.weights)))
        for part in _pieces(x):
            z = self.standard(x[part])
            p = _chance(z @ self.weights)
            gradient += z.T @ (y[part] - p)
            curvature += (z * (p * (1 - p))[:, None]).T @ z
        return gradient, curvature

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        """One Newton step."""
        penalty = self._penalty()
        move = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.weights)
        self.weights = self.weights + move
        return move

    def _penalty(self) -> np.ndarray:
        return np.r_[np.full(len(self.weights) - 1, self.ridge), 1e-6]

    def _likelihood(self, x: np.ndarray, y: np.ndarray) -> float:
        p = np.clip(_chance(self.odds(x)), 1e-13, 1 - 1e-13)
        return float(np.log(np.where(y > 0.5, p, 1 - p)).sum() - self._penalty() @ self.weights**2 / 2)

    def learn(self, x: np.ndarray, y: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """One Newton step with other rows' sums beside the rows at hand. It is halved until the rows at hand, with what the
        sums promise, gain."""
        now = self._likelihood(x, y)
        own = self.sums(x, y)
        move = self.step(own[0] + gradient, own[1] + curvature)
        while np.abs(move).max() > 1e-6 and self._likelihood(x, y) + gradient @ move - move @ curvature @ move / 2 < now:
            move = move / 2
            self.weights = self.weights - move

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Newton steps, each halved until it gains: where the classes are apart, whole ones leap too far."""
        self.mean = sum(x[part].astype(np.float64).sum(0) for part in _pieces(x)) / len(x)
        self.scale = np.maximum(np.sqrt(sum(((x[part].astype(np.float64) - self.mean) ** 2).sum(0) for part in _pieces(x)) / len(x)), 1e-6)
        self.weights = np.zeros(x.shape[1] + 1)
        now = self._likelihood(x, y)
        for _ in range(25):
            move = self.step(*self.sums(x, y))
            after = self._likelihood(x, y)
            while after < now and np.abs(move).max() > 1e-6:
                move = move / 2
                self.weights = self.weights - move
                after = self._likelihood(x, y)
            now = after
            if np.abs(move).max() < 1e-4:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.standard(x[part]) @ self.weights for part in _pieces(x))])


def _pieces(x: np.ndarray) -> list[slice]:
    """Rows that are widened to double precision together."""
    return [slice(at, at + PIECE) for at in range(0, len(x), PIECE)]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class CoTrained:
    """Both views and their combination; prior is the share of good rows, all there is to say where nothing was fitted."""

    prior: float
    text: View | None = None
    meta: View | None = None
    both: Logistic | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality by the text, by the metadata, and by both."""
        if self.both is None:
            same = np.full(len(text), self.prior)
            return same, same.copy(), same.copy()
        t, m = self.text.odds(text), self.meta.odds(meta)
        return _chance(t), _chance(m), _chance(self.both.odds(np.c_[t, m]))


#: For each view and pseudo-label: rows, gradient and curvature.
Taught = dict[tuple[str, int], tuple[float, np.ndarray, np.ndarray]]


@dataclass
class View:
    """A view's classifier and, on its log-odds, the one that calibrates them."""

    model: Logistic
    scale: Logistic = field(default_factory=lambda: Logistic(ridge=CALM))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.scale.fit(self.model.odds(x)[:, None], y)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.scale.odds(self.model.odds(x)[:, None])


def taught(views: dict[str, View], rows: dict[str, np.ndarray]) -> Taught:
    """What the rows of which one view is sure add to the other's sums."""
    out: Taught = {}
    for giver, taker in (("text", "meta"), ("meta", "text")):
        chance = _chance(views[giver].odds(rows[giver]))
        for label, sure in ((1, chance >= SURE), (0, chance <= 1 - SURE)):
            if sure.any():
                out[taker, label] = (float(sure.sum()), *views[taker].model.sums(rows[taker][sure], np.full(int(sure.sum()), float(label))))
    return out


def co_train(rows: dict[str, np.ndarray], y: np.ndarray, held: np.ndarray, teach: Callable[[dict[str, View]], Taught], rounds: int = ROUNDS) -> CoTrained:
    """rows: the labelled rows by each view; held marks those that only calibrate. teach gives the sums of `taught` over all
    unlabelled documents."""
    prior = float(y.mean()) if len(y) else 0.5
    if any(len(set(y[side].tolist())) < 2 for side in (held, ~held)):
        return CoTrained(prior)
    known = y[~held]
    views = {v: View(Logistic(ridge=RIDGE[v]).fit(x[~held], known)) for v, x in rows.items()}
    for turn in range(rounds + 1):
        for v, view in views.items():
            view.calibrate(rows[v][held], y[held])
        if turn == rounds:
            break
        sums = teach(views)
        for v, view in views.items():
            classes = [(prior, sums.get((v, 1))), (1 - prior, sums.get((v, 0)))]
            if all(x for _, x in classes):  # of one class alone only the share would be learned
                total = min(float(len(known)), *(n / part for part, (n, _, _) in classes))
                view.model.learn(rows[v][~held], known, *(sum(total * part / n * x[i] for part, (n, *x) in classes) for i in range(2)))
    both = np.stack([views[v].odds(rows[v][held]) for v in ("text", "meta")], 1)
    return CoTrained(prior, views["text"], views["meta"], Logistic(ridge=CALM).fit(both, y[held]))


def _meta_columns(df: DataFrame) -> list[Column]:
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]


FEATURES = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("meta", pa.binary())])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = text_matrix(batch["text"]), meta_matrix(*(batch[c].to_pylist() for c in ("source", "lang", "n_chars")))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([row.tobytes() for row in x], pa.binary()) for x in (text, meta))], schema=FEATURES)


def features(df: DataFrame) -> DataFrame:
    """A staged table with doc_id and both views of every row of df."""
    common.bounded(df.sparkSession)
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_meta_columns(df))
    return common.staged(slim.mapInArrow(_featured, "doc_id long, text binary, meta binary"), "features")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch[c].to_pylist()), np.float16).reshape(-1, n) for c, n in (("text", TEXT_FEATURES), ("meta", META_FEATURES)))


def _added(parts: Iterator[tuple[str, int, float, bytes, bytes]]) -> Taught:
    out: Taught = {}
    for view, label, rows, gradient, curvature in parts:
        n, g, c = out.get((view, label), (0.0, 0.0, 0.0))
        g = g + np.frombuffer(gradient)
        out[view, label] = (n + rows, g, c + np.frombuffer(curvature).reshape(len(g), len(g)))
    return out


SUMS = pa.schema([("view", pa.string()), ("label", pa.int32()), ("rows", pa.float64()), ("gradient", pa.binary()), ("curvature", pa.binary())])


def _sums(found: Taught, schema: pa.Schema, *block: int) -> pa.RecordBatch:
    rows = [(*block, view, label, n, g.tobytes(), c.tobytes()) for (view, label), (n, g, c) in found.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _teaching(rows: DataFrame, tasks: int) -> Callable[[dict[str, View]], Taught]:
    """The sums of `taught` over a table of features that so many tasks read: in each task, then of FAN sums at a time."""
    schema = pa.schema([("block", pa.int32()), *SUMS])
    kinds = "block int, view string, label int, rows double, gradient binary, curvature binary"

    def teach(views: dict[str, View]) -> Taught:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, total = TaskContext.get(), {}
            for batch in batches:
                for part in (batch.slice(at, PIECE) for at in range(0, batch.num_rows, PIECE)):
                    for key, (n, g, c) in taught(views, dict(zip(("text", "meta"), _views(part), strict=True))).items():
                        m, h, d = total.get(key, (0.0, 0.0, 0.0))
                        total[key] = (n + m, g + h, c + d)
            if total:
                yield _sums(total, schema, (task.partitionId() if task else 0) // FAN)

        def together(table: pa.Table) -> pa.Table:
            found = _added(zip(*(table[c].to_pylist() for c in SUMS.names), strict=True))
            return pa.Table.from_batches([_sums(found, schema, table["block"][0].as_py() // FAN)])

        found, left = rows.mapInArrow(own, kinds), tasks
        while left > 0:
            found = found.groupBy("block", "view").applyInArrow(together, kinds)
            left = -(-left // FAN) if left > FAN else 0
        return _added(tuple(r)[1:] for r in found.collect())  # four rows

    return teach


def fit(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """rows: what `features` makes. labels: doc_id and quality (0 or 1; rows with a null go, several of one document are
    averaged). Of the labelled rows those with the smallest digests of their ids are taken, at most `labelled`, and of rows that
    share one of these ids the one with the least features; the others neither teach nor are held out."""
    digest = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    number = known.count()
    few = known.where(F.pmod(digest, F.lit(1 << 30)) < F.lit(min(1 << 30, int((1 << 30) * 1.2 * labelled / max(number, 1)))))  # so that few rows go to the task of the limit
    few = few.orderBy(F.pmod(digest, F.lit(1 << 30)), "doc_id").limit(labelled)
    found = rows.join(F.broadcast(few), "doc_id")  # at most `labelled` rows of two numbers are broadcast
    found = found.groupBy("doc_id").agg(F.min(F.struct("text", "meta", "quality")).alias("one")).select("doc_id", "one.*").orderBy("doc_id").toArrow()  # and come back
    if not found.num_rows:
        return CoTrained(0.5)
    ids, y = found["doc_id"].to_pylist(), found["quality"].to_numpy()
    held = np.array([zlib.crc32(b"held %d" % i) % 4 == 0 for i in ids], bool)
    text, meta = _views(found.combine_chunks().to_batches()[0])
    del found
    common.give_back()
    sample = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"doc_id": sorted(set(ids))})))  # at most `labelled` numbers
    model = co_train({"text": text, "meta": meta}, y, held, _teaching(rows.join(sample, "doc_id", "left_anti"), rows.rdd.getNumPartitions()), rounds)
    del text, meta
    common.give_back()
    return model


def _scored(model: CoTrained, text: np.ndarray, meta: np.ndarray, keep_from: float) -> dict[str, np.ndarray]:
    by_text, by_meta, both = model.score(text, meta)
    return {"score_text": by_text, "score_meta": by_meta, "score": both, "keep": (both >= keep_from) | (model.both is None)}


def classify(df: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of df: doc_id, score_text, score_meta, score (chance of good quality), keep.

    A null text counts as empty, null or missing metadata as a value of its own. Texts count whole, however long. Where the
    labels are empty or hold one class only, every row gets their share of good rows (0.5 without labels) and stays. Other
    columns are ignored, rows that repeat or have no doc_id stay, and an empty table gives no rows."""
    rows = features(df)
    model = fit(rows, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, PIECE) for at in range(0, batch.num_rows, PIECE)):
                scored = _scored(model, *_views(part), keep_from)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, scored.values())], names=["doc_id", *scored])

    return rows.mapInArrow(score, "doc_id long, score_text double, score_meta double, score double, keep boolean")


def keep_good(df: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of df that classify keeps, with their own columns."""
    model = fit(features(df), labels)

    @F.pandas_udf(T.BooleanType())
    def keep(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, *meta in batches:
            yield pd.Series(_scored(model, text_matrix(pa.array(text, pa.string())), meta_matrix(*(x.where(x.notna(), None).tolist() for x in meta)), keep_from)["keep"])

    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own")
    scored = df.select(own, keep(F.coalesce("text", F.lit("")), *_meta_columns(df)).alias("kept"))
    return scored.where("kept").select(*(F.col("own").getField(c).alias(c) for c in df.columns))
