import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import common, cotrain, hyperlang, ivfpq, queries

from . import cases

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = common.table(spark, SF, "documents")
    found = hyperlang.identify(docs)
    scored = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und' and lang is not null").collect()
    assert len(scored) > 150
    assert np.mean([r.lang == r.lang_pred for r in scored]) > 0.9
    assert all(0 <= r.score <= 1 for r in scored)


def plain_languages(rows):
    """lang_pred and score by definition: vectors letter by letter, bundles n-gram by n-gram."""

    def vector(text):
        said = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        said = " " + " ".join(said.split()) + " "
        if not said.strip():
            return None
        out = np.zeros(hyperlang.DIMENSION)
        for i in range(len(said) - 2):
            a, b, c = (hyperlang.letter_vector(0 if x == " " else ord(x)).astype(float) for x in said[i : i + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
        return out

    totals = {}
    for doc_id, text, lang in rows:
        v = vector(text)
        if v is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            totals[lang] = totals.get(lang, 0) + v / np.linalg.norm(v)
    found = {}
    for doc_id, text, _ in rows:
        v = vector(text)
        cosines = {k: v @ totals[k] / np.linalg.norm(v) / np.linalg.norm(totals[k]) for k in sorted(totals)} if v is not None else {}
        found[doc_id] = cosines
    return found


def test_language_is_the_plain_versions(spark):
    rows = [(i, r.text, r.lang) for i, r in enumerate(common.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(60).collect())]
    rows = [(i, t and t[:400], lang) for i, t, lang in rows] + [(60, "日本語の文 と 中文", "ja"), (61, "日本 文", "ja"), (62, "ß", None), (63, "Привет мир", "ru"), (64, "мир", None), (65, None, "ru"), (66, "12 !", "de")]
    want = plain_languages(rows)
    for r in hyperlang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect():
        cosines = want[r.doc_id]
        if not cosines:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(cosines.values())
        assert cosines[r.lang_pred] > best - 1e-5 and abs(r.score - min(1.0, max(0.0, best))) < 1e-5
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_a_full_table_of_grams_is_emptied():
    small, large = hyperlang.Hypervectors(kept=50), hyperlang.Hypervectors()
    for text in ("the quick brown fox jumps over the lazy dog and runs away into the deep dark wood", "другой текст", "again the fox"):
        assert np.allclose(small.bundle(text), large.bundle(text)) and len(small.row) <= 50


def test_language_odd_rows(spark):
    found = {r.doc_id: r for r in hyperlang.identify(cases.odd(spark)).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {0, 1, 2, 9, 10}
    assert hyperlang.identify(cases.empty(spark)).count() == 0
    unknown = hyperlang.identify(cases.odd(spark).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_a_document_never_helps_itself(spark):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "l1" if i % 2 else "l2") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.selectExpr("doc_id", "text", "case when crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2 then 'l9' else lang end lang")
    same = lambda df: sorted(map(tuple, hyperlang.identify(df).collect()))
    assert same(docs) == same(other)


def test_quality_of_labelled_documents(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    scored = cotrain.classify(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in scored]) > 0.9
    assert np.mean([r.keep for r in scored if r.quality == 1]) > 0.97


def test_quality_odd_rows(spark):
    df = cases.odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = cotrain.classify(df, none).collect()
    assert len(found) == len(cases.rows()) and all(r.keep and r.score == 0.5 for r in found)
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in cotrain.classify(df, one).collect())
    two = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] * 2, "doc_id long, quality int, toxic int")
    assert len(cotrain.classify(df, two).collect()) == len(cases.rows())
    assert cotrain.classify(cases.empty(spark), two).count() == 0
    kept = cotrain.keep_good(df.withColumnRenamed("g", "quality"), one)
    assert kept.columns == [c if c != "g" else "quality" for c in df.columns] and kept.count() == len(cases.rows())


def test_a_step_with_others_sums_does_not_leap():
    """Classes that are almost apart, and others that say the same: whole Newton steps would leap to and fro."""
    draw = np.random.default_rng(4)
    y = (draw.random(4000) < 0.86).astype(float)
    x = draw.normal(size=(4000, 30)) + 3 * y[:, None] * (np.arange(30) < 4)
    model = cotrain.Logistic(ridge=3.0).fit(x, y)
    for _ in range(8):
        model.learn(x, y, *model.sums(x, (model.odds(x) > 0).astype(float)))
    assert np.mean((model.odds(x) > 0) == (y == 1)) > 0.99


def test_classes_that_are_apart_are_fitted_too():
    x = np.r_[np.full((5, 1), -40.0), np.full((60, 1), 7.0), [[6.0]]]
    y = np.r_[np.zeros(5), np.ones(61)]
    assert ((cotrain.Logistic(ridge=cotrain.CALM).fit(x, y).odds(x) > 0) == (y == 1)).all()


def test_views_teach_each_other():
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 600).astype(float)
    text, meta = draw.normal(size=(600, 4)) + 2 * y[:, None], draw.normal(size=(600, 3)) + 2 * y[:, None]
    held = np.arange(40) % 4 == 0
    model = cotrain.co_train({"text": text[:40], "meta": meta[:40]}, y[:40], held, lambda views: cotrain.taught(views, {"text": text[40:], "meta": meta[40:]}))
    by_text, by_meta, both = model.score(text[40:], meta[40:])
    right = lambda p: np.mean((p >= 0.5) == (y[40:] == 1))
    assert right(both) > 0.95 and right(both) >= right(by_meta) - 0.02 and right(by_text) > 0.9


def plain_logistic(x, y, weight, mean, scale, w, ridge, steps, others=0):
    """Newton steps of ridge logistic regression, written out row by row; each is halved until it gains, where the last `others`
    rows count by their gradient and curvature before the step."""
    z = np.hstack([np.clip((x - mean) / scale, -cotrain.MOST, cotrain.MOST), np.ones((len(x), 1))])
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    own = len(x) - others

    def likelihood(w):
        p = np.clip(1 / (1 + np.exp(-np.clip(z[:own] @ w, -30, 30))), 1e-13, 1 - 1e-13)
        return np.log(np.where(y[:own] == 1, p, 1 - p)).sum() - penalty @ w**2 / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        bends = [v * q * (1 - q) * np.outer(r, r) for r, q, v in zip(z, p, weight, strict=True)]
        pulls = [v * (t - q) * r for r, q, t, v in zip(z, p, y, weight, strict=True)]
        move = np.linalg.solve(sum(bends) + np.diag(penalty), sum(pulls) - penalty * w)
        promise = lambda m: sum(pulls[own:], np.zeros(z.shape[1])) @ m - m @ sum(bends[own:], np.zeros((z.shape[1],) * 2)) @ m / 2  # noqa: B023, E731
        while likelihood(w + move) + promise(move) < likelihood(w) and np.abs(move).max() > 1e-6:
            move = move / 2
        w = w + move
        if np.abs(move).max() < 1e-4:
            break
    return w


def plain_quality(text, meta, quality, held):
    """Co-training by definition, on all rows at once: quality is nan where there is no label."""
    views, known = {"text": text, "meta": meta}, ~np.isnan(quality)
    ridge, first, free = cotrain.RIDGE, known & ~held, ~known
    mean, scale = ({v: f(x[first]) for v, x in views.items()} for f in (lambda x: x.mean(0), lambda x: np.maximum(x.std(0), 1e-6)))
    odds = lambda v, w: np.hstack([np.clip((views[v] - mean[v]) / scale[v], -cotrain.MOST, cotrain.MOST), np.ones((len(text), 1))]) @ w
    chance = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
    fit = lambda v, rows, y, weight, w, steps, others=0: plain_logistic(views[v][rows], y, weight, mean[v], scale[v], w, ridge[v], steps, others)
    calm = lambda x: cotrain.Logistic(ridge=cotrain.CALM).fit(x[known & held], quality[known & held]).odds(x)
    w = {v: fit(v, first, quality[first], np.ones(first.sum()), np.zeros(x.shape[1] + 1), 25) for v, x in views.items()}
    prior = quality[known].mean()
    for _ in range(cotrain.ROUNDS):
        after = {}
        for giver, taker in (("text", "meta"), ("meta", "text")):
            p = chance(calm(odds(giver, w[giver])[:, None]))
            good, bad = np.flatnonzero(free & (p >= cotrain.SURE)), np.flatnonzero(free & (p <= 1 - cotrain.SURE))
            rows, y, weight = [np.flatnonzero(first)], [quality[first]], [np.ones(first.sum())]
            after[taker] = w[taker]
            if len(good) and len(bad):
                total = min(first.sum(), len(good) / prior, len(bad) / (1 - prior))
                rows, y, weight = [*rows, good, bad], [*y, np.ones(len(good)), np.zeros(len(bad))], [*weight, np.full(len(good), total * prior / len(good)), np.full(len(bad), total * (1 - prior) / len(bad))]
                after[taker] = fit(taker, np.concatenate(rows), np.concatenate(y), np.concatenate(weight), w[taker], 1, len(good) + len(bad))
        w = after
    t, m = (calm(odds(v, w[v])[:, None]) for v in ("text", "meta"))
    return chance(t), chance(m), chance(calm(np.c_[t, m]))


def test_quality_is_the_plain_versions(spark, monkeypatch):
    """The query's rows against the plain version: features of each row alone, sums written out."""
    docs, labels = common.table(spark, "/root/testdata/sf0.001", "documents"), common.table(spark, "/root/testdata/sf0.001", "labels")
    found = {r.doc_id: r for r in cotrain.classify(docs.repartition(5), labels).collect()}
    said = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    text = np.concatenate([cotrain.text_matrix(pa.array([r.text or ""])) for r in rows]).astype(float)
    meta = np.concatenate([cotrain.meta_matrix([r.source], [r.lang], [r.n_chars]) for r in rows]).astype(float)
    quality = np.array([said.get(r.doc_id, np.nan) for r in rows], float)
    held = np.array([zlib.crc32(b"held %d" % r.doc_id) % 4 == 0 for r in rows])
    for r, t, m, b in zip(rows, *plain_quality(text, meta, quality, held), strict=True):
        assert np.allclose([found[r.doc_id].score_text, found[r.doc_id].score_meta, found[r.doc_id].score], [t, m, b], atol=1e-3)
        assert found[r.doc_id].keep == (found[r.doc_id].score >= cotrain.KEEP_FROM)


def test_sums_of_many_tasks_are_added_level_by_level(spark, monkeypatch):
    """Thirty tasks, two sums at a time: the same scores."""
    docs, labels = common.table(spark, "/root/testdata/sf0.001", "documents"), common.table(spark, "/root/testdata/sf0.001", "labels")
    want = {r.doc_id: r.score for r in cotrain.classify(docs, labels).collect()}
    monkeypatch.setattr(cotrain, "FAN", 2)
    monkeypatch.setattr(cotrain, "features", lambda df, make=cotrain.features: make(df).repartition(30))
    rows = cotrain.features(docs)
    assert rows.rdd.getNumPartitions() == 30
    found = {r.doc_id: r.score for r in cotrain.classify(docs, labels).collect()}
    assert found.keys() == want.keys() and max(abs(found[i] - want[i]) for i in want) < 1e-6


def test_a_long_text_is_added_up_by_pieces(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = cotrain.text_matrix(pa.array([text, "a", ""]))
    monkeypatch.setattr(cotrain.anchors, "BATCH", 700)
    assert np.abs(cotrain.text_matrix(pa.array([text, "a", ""])).astype(float) - whole).max() < 0.6
    assert whole.shape == (3, cotrain.TEXT_FEATURES) and not whole[2].any()


def exact(ids, vectors, every, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in [i for i in range(len(ids)) if ids[i] % every == 0]:
        cos = unit @ unit[q]
        order = np.lexsort((ids, -np.round(cos, 12)))
        out[int(ids[q])] = [int(ids[i]) for i in order if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = common.table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = df.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 50, 5)
    found = {}
    for r in queries.op10_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert found.keys() == want.keys() and all(sorted(x) == list(range(1, len(x) + 1)) for x in found.values())
    assert np.mean([len(set(found[q].values()) & set(want[q])) / len(want[q]) for q in want]) > 0.9


def test_ties_and_unfit_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)] + [(100, [3.0, 2.0, 1.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 1.0]), (104, [nan, 1.0, 1.0]), (150, [inf, 1.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<float>, list int, codes string")
    found = ivfpq.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (50, 0), (50, 1), (50, 2), (50, 3), (50, 4), (100, 0), (100, 1), (100, 2), (100, 3), (100, 4)]
    assert ivfpq.search(df.where("false")).count() == 0
    assert ivfpq.search(df.where("vec_id in (0, 100)")).count() == 2
    assert ivfpq.search(df.where("vec_id = 0")).count() == 0


def test_recall_among_near_copies(spark):
    """A third of the rows are near copies of one vector: their codes are equal, their neighbours are not."""
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(6000, 16))
    copies = draw.permutation(6000)[:2000]
    vectors[copies] = vectors[0] + 1e-3 * draw.normal(size=(2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = exact(np.arange(6000), vectors, 50, 5)
    found = {}
    for r in ivfpq.search(rows).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for some in (set(copies.tolist()) & set(want), set(want) - set(copies.tolist())):
        assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in some]) > 0.9


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e200, 2.1e200]), (2, [3e-200, 1e-200]), (3, [1.0, 2.05]), (4, [-1e300, 1.0]), (5, [1e-310, 2e-310])]
    found = ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [5, 3, 1, 2, 4] and abs(found[0].score - 1) < 1e-9 and abs(found[4].score + 1 / 5**0.5) < 1e-9


def test_lists_are_probed_until_they_hold_enough_rows():
    index = ivfpq.Index(2, np.eye(2).repeat(2, 0), np.zeros((1, 1, 4)), 1)
    row, lists = index.lists_of(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([2, 1, 9, 9]), np.array([6, 6]))
    assert list(zip(row.tolist(), lists.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 2)]


def test_every_query_finds_k_neighbours_among_lonely_clusters(spark):
    draw = np.random.default_rng(6)
    vectors = np.concatenate([draw.normal(size=(1, 8)) * 100 + 1e-3 * draw.normal(size=(n, 8)) for n in [2] * 30 + [900]])
    rows = spark.createDataFrame([(25 * i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = ivfpq.search(rows).groupBy("query_id").count().collect()
    assert len(found) == 480 and all(r["count"] == 5 for r in found)


@pytest.mark.parametrize("rows", [3, 30_000])
def test_rows_that_repeat_do_not_empty_the_sample(spark, rows):
    df = spark.range(rows).selectExpr("100300L AS vec_id", "array(1f, 2f) AS embedding")
    assert ivfpq.search(df).count() == 0  # rows of the query's own vec_id are no neighbours
    more = df.unionByName(spark.createDataFrame([(7, [2.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [(r.query_id, r.rank, r.vec_id) for r in ivfpq.search(more).collect()] == [(100300, 1, 7)]


def test_a_labelled_document_that_repeats_comes_to_the_driver_once(spark):
    rows = [(i % 60, ("good words here " if i % 2 else "BAD!!! 111 ") * (3 + i % 5)) for i in range(60)] + [(1, "good words here " * 9)] * 3000
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    own = cotrain.co_train
    try:
        cotrain.co_train = lambda views, y, *rest: seen.append(len(y)) or own(views, y, *rest)
        found = cotrain.classify(docs, labels).collect()
    finally:
        cotrain.co_train = own
    assert seen == [60] and len(found) == len(rows)
