"""What must not grow with the tables: broadcasts, states and rows of plans."""

from __future__ import annotations

import glob
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.operators import chunking, claims, exports, graph, index, releases, selection, surface_chunks
from lodestrata.operators.staging import shared_folder
from lodestrata.plans import catalog, tools

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_cited_is_not_broadcast(spark, tmp_path, monkeypatch):
    """Exploded spans were planned by the size of the table under them."""
    rows = spark.range(20).select(F.lit("s").alias("scope"), F.col("id").alias("ord"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    prose = rows.select("scope", F.col("ord").alias("k"), F.concat(F.lit("`"), "name", F.lit("` `"), F.lit("no.such`")).alias("text"))
    monkeypatch.setattr(surface_chunks.AnchorIndex, "MOST_ASKED", 1)
    index = surface_chunks.AnchorIndex.build(surface_chunks.anchor_forms(rows, ["scope"]), str(tmp_path / "anchors"), ["scope"])
    out = index.neutralised(prose, "k")
    assert "Broadcast" not in plan(out)
    assert {(r.text, r.neutralised) for r in out.collect()} == {(f"`N{i}` no.such", 1) for i in range(20)}


def test_members_of_one_group_take_linear_work(spark):
    """One group of many members, each with a name of its own: looking each up among all of them took minutes."""
    n = 40_000
    name = F.concat(F.lit("m"), F.col("id").cast("string"))
    m = spark.range(n).select(F.lit("g").alias("g"), "id", name.alias("name"), F.concat(name, F.lit("()")).alias("line"), F.when(F.col("id") == 7, "a.m7").alias("inherited_from"), F.lit(False).alias("is_constructor"))
    began = time.time()
    held = m.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("ms"))
    assert held.select(F.size(selection.first_of_name(F.col("ms")))).first()[0] == n
    row = selection.member_summary(m, ["g"], "id").first()
    assert (row.n_lines, row.n_names, row.firsts) == (n - 1, n, list(range(n)))
    assert time.time() - began < 20
    few = spark.createDataFrame([([("b", 1), ("a", 2), (None, 3), ("b", 4), ("a", 5)],), ([],), (None,)], "ps array<struct<name:string,i:int>>")
    assert [None if r.x is None else [p.i for p in r.x] for r in few.select(selection.first_of_name(F.col("ps")).alias("x")).collect()] == [[1, 2], [], None]


def test_the_limit_cuts_no_release(spark):
    own = spark.createDataFrame([("v3.0", 0), ("v2.0", 1), ("v1.0", 2)], "tag_name string, ord int")
    tags = spark.createDataFrame([("9.0", 0), ("v1.0.0", 1), ("8.0", 2), ("v9.0.0", 3)], "tag_name string, ord int")
    padded = lambda n: [r.tag_name for r in releases.pad_with_older_tags(own, tags, n).collect()]
    assert padded(2) == ["v3.0", "v2.0", "v1.0"] == padded(3)
    assert padded(4) == ["v3.0", "v2.0", "v1.0", "9.0"] and padded(9) == ["v3.0", "v2.0", "v1.0", "9.0", "8.0"]


def test_defects_are_met_as_sets(spark):
    symbols = spark.createDataFrame([("A", "c1", ["x", "y"]), ("B", "c2", ["x"]), ("B", "c1", None), ("C", None, [])], "name string, commit string, aliases array<string>")
    defects = spark.createDataFrame([(1, ["x", "A"], None), (1, ["x"], None), (2, ["y", "B"], "c1"), (3, ["x"], "c2"), (4, ["C"], "c1"), (5, ["C"], None)], "defect_id int, refs array<string>, indexed_commit string")
    found = claims.applicable_defects(symbols, defects)
    assert sorted((r.name, r.defect_id) for r in found.collect()) == [("A", 1), ("A", 2), ("B", 1), ("B", 2), ("B", 3), ("C", 5)]
    assert "keys=[name" in plan(found) and not re.search(r"keys=\[name#\d+, defect_id", plan(found))  # no state of the answer's rows


def test_the_sketch_is_kept_once_a_group(spark):
    """Next to a distinct count it was kept for each pair of group and key."""
    found = plan(catalog.QUERIES["approximate_distinct"](spark, SF))
    sketches = [x for x in found.split("\n") if "approx_count_distinct" in x]
    assert sketches and not any(re.search(r"keys=\[[^\]]*p_partkey", x) for x in sketches)


def test_scores_add_up_where_their_document_is(spark, tmp_path):
    """Postings travel, once each; pairs of query and document do not."""
    docs = spark.createDataFrame([(i, f"red widget w{i % 3} reds") for i in range(12)], "doc_id long, text string")
    held = index.build(docs, str(tmp_path / "index"), buckets=4)
    asked = spark.createDataFrame([(q, "red w1 widget") for q in range(5)], "q int, query string")
    terms = held.weights(spark.createDataFrame([(q, t) for q in range(5) for t in ("red", "w1")], "q int, term string"))
    scored, covered = held.bm25(asked, "q", "query"), held.coverage(terms, "q")
    for out in (scored, held.tf_idf(asked, "q", "query"), covered):
        assert not re.search(r"Exchange hashpartitioning\(q#\d+, doc_id", plan(out)) and "Exchange hashpartitioning(doc_id" in plan(out)
    assert scored.count() == 60
    assert {(r.doc_id % 3 == 1, r.n_present) for r in covered.collect()} == {(True, 2), (False, 1)} and covered.count() == 60


def test_no_task_holds_all_of_a_common_word(spark):
    refs = spark.createDataFrame([("a", "uses x x"), ("a", "x again"), ("b", "uses x"), ("x", "x of its own"), ("c", None)], "owner string, text string")
    found = graph.centrality(refs, spark.createDataFrame([("x",), ("uses",), ("none",), ("x",)], "name string"))
    assert {r.name: r.score for r in found.collect()} == {"x": 2, "uses": 2, "none": 0}
    assert re.search(r"Exchange hashpartitioning\(word#\d+, owner#\d+", plan(found))


def test_parts_are_given_out_before_a_batch_is_through():
    texts = ["a\n" * 500, None, "b" * 3000, ""] * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    out = list(chunking._oversize_batches(iter([batch]), "doc_id", 400, 10_000))
    assert len(out) > 10 and max(sum(map(len, x.column(3).to_pylist())) for x in out) < 14_000
    found = [(r["doc_id"], r["part"], r["parts"], r["text"]) for x in out for r in x.to_pylist()]
    assert found == [(k, i, len(p), x) for k, t in enumerate(texts) for p in [chunking.split_oversize(t or "", 400)] for i, x in enumerate(p)]


def test_wildcards_carry_pairs_of_modules(spark):
    """Each of a chain takes all of the next one: pairs of modules grow, not the names of all, and what is known is not shuffled again."""
    n, names = 5, 40
    modules = spark.createDataFrame([("s", "0", None, "", True), *(("s", f"m{i}", "0", f"m{i}", False) for i in range(n))], "scope string, module string, parent string, name string, public boolean")
    items = spark.createDataFrame([("s", f"m{n - 1}", f"T{i}", i > 0) for i in range(names)], "scope string, module string, name string, public boolean")
    uses = spark.createDataFrame([("s", f"m{i}", ["super", f"m{i + 1}"], None, True) for i in range(n - 1)], "scope string, module string, path array<string>, bound string, public boolean")
    pattern = f"{shared_folder(spark).removeprefix('file:')}/exports-*/links/*"
    before = set(glob.glob(pattern))
    found = exports.resolved_names(modules, items, uses)
    assert found.count() == n + names + (n - 1) * (names - 1)
    written = sorted(set(glob.glob(pattern)) - before)
    assert {tuple(r) for r in spark.read.schema(exports.LINK).parquet(*written).collect()} == {("s", f"m{i}", f"m{n - 1}", True) for i in range(n - 1)}


def test_words_travel_by_document_and_group_of_buckets(spark, tmp_path, monkeypatch):
    """The index's one shuffle carried a row for each posting."""
    kind, moved = type(spark.range(0)), []
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: deal(moved.append(self.count()) or self, *a))
    docs = spark.createDataFrame([(i, " ".join(f"w{j} w{j // 2}x" for j in range(300))) for i in range(20)] + [(90, ""), (91, None), (92, "of the")], "doc_id long, text string")
    held = index.build(docs, str(tmp_path / "index"), buckets=4, tokeniser="plain")
    assert moved == [20 * 4 + 2] and held.postings.count() == 20 * 450 + 2
    assert {(r.token, r.tf, r.dl) for r in held.postings.where("doc_id = 7").collect()} == {(f"w{j}", 1, 600) for j in range(300)} | {(f"w{j}x", 2, 600) for j in range(150)}
    assert held.stats.first().n_docs == 23


def test_a_bare_name_ranks_symbols_once_and_holds_nothing_else(spark):
    """All chunks were held with their category, and all symbols were ranked twice for each look at the answer."""
    rows = [(f"s{i}", i, f"FQN: Goods.P{i}\nKind: class\nMethods:\n  - open()") for i in range(12)] + [("d", 90, "about P7"), ("n", 91, None), ("e", 92, "FQN: Example: P7\nKind: verified_example\nExample:\nrun()")]
    e = tools.Engine(spark, "goods", "python", spark.createDataFrame(rows, "chunk_id string, ord long, text string"))
    answer = e.lookup("P7", top_k=1)
    assert "frequently asked" not in plan(answer)  # no document was classified
    spark.sparkContext.setJobGroup("again", "the answer is there")
    assert [(r.kind, r.name) for r in answer.collect()] == [("symbol", "Goods.P7")]
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("again")) == 1
    held = e._index("symbol")
    whole, few = (held.bm25(e._asked("P7"), "q", "query", *x) for x in ((), (spark.createDataFrame([("s7",), ("s3",), ("d",)], "chunk_id string"),)))
    scores = {r.chunk_id: r.score for r in whole.collect()}
    assert len(scores) == 12 and {r.chunk_id: r.score for r in few.collect()} == {k: scores[k] for k in ("s3", "s7")}
    e.close()
