"""The nine query tools over one scope's chunks. Each returns a DataFrame with `found` and `reason`: a miss is a row that says
why, and is never widened to another scope.

chunks: chunk_id, ord, text (in the chunk grammar). The first call that needs a kind of chunks holds those, and no others, and
builds the index of them that keyword stages read. Stages are DataFrame plans; the driver runs the next one only where the
one before it found nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates, relevance, versions
from lodestrata.functions import text as T
from lodestrata.operators import index, lexical, symbols, vectors
from lodestrata.operators.staging import shared_folder

from . import reference

RELEVANT, PARTIAL, PARTIAL_TERMS, PARTIAL_ROWS = 0.6, 0.41, 6, 3
DOC_FLOOR, EXAMPLE_FLOOR = 0.55, 0.45
SECTIONS = ("install", "formats", "limitations", "compatibility", "license", "support", "contributing", "agent_guidance")


def checked(query: str, most: int = 1000) -> str:
    """The query, or an error: empty, too long, or with control characters."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query is empty")
    if len(query) > most:
        raise ValueError(f"the query is longer than {most} characters")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", query):
        raise ValueError("the query holds control characters")
    return query


def checked_page(top_k: int, offset: int = 0) -> tuple[int, int]:
    if not 0 < top_k <= 100 or offset < 0:
        raise ValueError("top_k is 1 to 100 and offset not negative")
    return top_k, offset


class Engine:
    def __init__(self, spark: SparkSession, family: str, platform: str, chunks: DataFrame):
        self.spark, self.family, self.platform = spark, family, platform
        self._held: list[DataFrame] = []
        self._within = False
        self._pools: dict[str, DataFrame] = {}
        self._indexes: dict[tuple[str, str | None], index.KeywordIndex] = {}
        self.chunks = chunks.select("chunk_id", "ord", "text", predicates.chunk_kind("text").alias("kind"), grammar.fqn("text").alias("fqn"))

    def _of(self, kind: str) -> DataFrame:
        """The chunks of one kind, held for all stages and calls. Symbols and examples are short, so few files hold very many:
        they are dealt out before they are worked on. Documents have their category."""
        if kind not in self._pools:
            pool = self.chunks.where(F.col("kind") == kind)
            pool = pool.withColumn("category", predicates.category("text")) if kind == "documentation" else pool.repartition("chunk_id")
            self._pools[kind] = pool.cache()
        return self._pools[kind]

    def _index(self, kind: str, category: str | None = None) -> index.KeywordIndex:
        """The keyword index of the chunks of one kind, or of one category of it; its buckets grow in number with the text."""
        if (kind, category) not in self._indexes:
            pool = self._of(kind)
            pool = pool.where(F.col("category") == category) if category else pool
            size = pool.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            buckets = max(8, -(-size // index.BUCKET_BYTES))
            self._indexes[kind, category] = index.build(pool, f"{shared_folder(self.spark)}/scope-{uuid.uuid4().hex}", "chunk_id", buckets=buckets)
        return self._indexes[kind, category]

    def _hold(self, df: DataFrame) -> DataFrame:
        """df, kept for the stages of this call and let go by the next one."""
        self._held.append(df.cache())
        return self._held[-1]

    def _release(self) -> None:
        """At the start of a call; not of one that another call makes."""
        while self._held and not self._within:
            self._held.pop().unpersist()

    def close(self) -> None:
        """Lets go of all that is held for the next stage or call."""
        self._release()
        while self._pools:
            self._pools.popitem()[1].unpersist()

    def _miss(self, reason: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([(False, reason)], "found boolean, reason string").selectExpr("found", "reason", *(f"cast(null as {kind}) as {name}" for name, kind in (x.split(" ", 1) for x in schema.split(", "))))

    def _terms(self, query: str, held: index.KeywordIndex) -> tuple[DataFrame, DataFrame, list[str]]:
        """Weighted and required terms of one query, and its distinctive terms."""
        asked = self._asked(query)
        excluded = T.excluded_terms(self.family, self.platform)
        said = asked.select(T.query_terms("query", excluded).alias("terms"), T.required_terms("query").alias("required"), T.distinctive_terms("query", excluded).alias("distinctive")).first()  # one query's words
        frame = lambda words: self.spark.createDataFrame([(0, w) for w in words], "q int, term string")
        return self._hold(held.weights(frame(said["terms"]))), frame(said["required"]), said["distinctive"]

    def _asked(self, query: str) -> DataFrame:
        return self.spark.range(1, numPartitions=1).select(F.lit(0).alias("q"), F.lit(query).alias("query"))  # without Python's workers

    def search_docs(self, query: str, content_type: str | None = None, top_k: int = 10) -> DataFrame:
        """found, reason, match_quality, chunk_id, category, coverage, score: confident, else partial, else nearest vectors. A query
        that only names a category gets that category's documents, whatever words they use."""
        checked(query), checked_page(top_k)
        self._release()
        columns = "match_quality string, chunk_id string, category string, coverage double, score double"
        if content_type is not None and content_type not in predicates.CATEGORIES:
            raise ValueError(f"content_type is one of {', '.join(predicates.CATEGORIES)}")
        pool = self._of("documentation")
        if content_type:
            pool = pool.where(F.col("category") == content_type)
        if not self._asked(query).select(T.has_minimum_evidence("query")).first()[0]:
            return self._miss("too_little_evidence", columns)
        held = self._index("documentation", content_type)
        bm = held.bm25(self._asked(query), "q", "query").select("chunk_id", "score")
        intent = None if content_type else self._asked(query).select(relevance.category_intent("query")).first()[0]
        if intent:
            named = pool.where(F.col("category") == intent).join(bm, "chunk_id", "left").withColumn("score", F.coalesce(F.round("score", 6), F.lit(0.0))).orderBy(F.desc("score"), "chunk_id").limit(top_k)
            if not named.isEmpty():
                return named.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), F.lit("category").alias("match_quality"), "chunk_id", "category", F.lit(None).cast("double").alias("coverage"), "score")
        weighted, required, _ = self._terms(query, held)
        n = weighted.count()
        covered = held.guarded(held.coverage(weighted, "q"), required, "q")
        listed = weighted.agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        passage = lexical.best_passage(F.col("lines"), F.col("terms"), F.col("weights"))
        scored = covered.where(F.col("coverage") >= PARTIAL).join(pool, "chunk_id").withColumn("lines", lexical.passage_lines(F.col("text"))).crossJoin(F.broadcast(listed)).where(~predicates.table_dominated("text") | (F.col("n_present") >= 2)).withColumn("passage", passage)
        scored = self._hold(scored.join(bm, "chunk_id", "left").select("chunk_id", "category", F.round("coverage", 6).alias("coverage"), "passage", "n_present", F.coalesce(F.round("score", 6), F.lit(0.0)).alias("score")))
        order = (F.desc("coverage"), F.desc("score"), "chunk_id")
        confident = scored.where((F.col("coverage") >= RELEVANT) & (F.col("passage") >= RELEVANT)).orderBy(*order).limit(top_k)
        partial = scored.where((F.col("coverage") >= PARTIAL) & (F.col("n_present") >= 2)).orderBy(*order).limit(min(top_k, PARTIAL_ROWS))
        for quality, rows, on in (("confident", confident, True), ("partial", partial, n >= PARTIAL_TERMS)):
            if on and not rows.isEmpty():
                return rows.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), F.lit(quality).alias("match_quality"), "chunk_id", "category", "coverage", "score")
        near = self._nearest(pool, query, DOC_FLOOR, top_k)
        if not near.isEmpty():
            return near.join(pool.select("chunk_id", "category"), "chunk_id").select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), F.lit("vector").alias("match_quality"), "chunk_id", "category", F.lit(None).cast("double").alias("coverage"), "score")
        return self._miss("nothing_relevant", columns)

    def _nearest(self, pool: DataFrame, query: str, floor: float, top_k: int) -> DataFrame:
        asked = self._asked(query).select(vectors.hash_embedding(T.plain_tokens("query"))).first()[0]
        return vectors.cosine_top_k(vectors.embedded(pool), asked, top_k, "chunk_id", "vector", floor)

    def search_symbols(self, query: str, top_k: int = 10, offset: int = 0) -> DataFrame:
        """found, reason, fqn, tier, score, total_matches, next_offset: by tiers; else, for a task in words, by what types show of its
        terms (tier 5) or by its naming words (tier 6); else close names as suggestions."""
        checked(query), checked_page(top_k, offset)
        self._release()
        columns = "fqn string, tier int, score double, total_matches bigint, next_offset int, suggestions array<string>"
        pool = self._of("symbol")
        asked = self._asked(query)
        members = F.transform(grammar.declared_members("text"), lambda m: F.lower(m["name"]))
        tier = symbols.match_tier(F.lit(query), F.col("fqn"))
        own = F.array_contains(members, query.strip().split(".")[-1].lower()) & (F.lit("." not in query) | F.lower("fqn").endswith(query.rsplit(".", 1)[0].lower()))
        ranked = F.when(tier <= 1, tier).when(own, 2).when(tier.isNotNull(), tier + 1)
        hits = self._hold(pool.withColumn("tier", ranked).where("tier is not null").select("chunk_id", "ord", "fqn", "tier", (F.size(members) == 0).alias("empty")))
        total = hits.count()  # works them out, once; what follows looks at them only
        if total > offset:
            bm = self._index("symbol").bm25(asked, "q", "query", hits.select("chunk_id")).select("chunk_id", "score")
            order = ("tier", "empty", F.desc(F.round("score", 6)), "ord")
            scored = hits.join(bm, "chunk_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
            first = scored.orderBy(*order).limit(offset + top_k)  # so few rows are numbered in one task
            page = first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)
            found = page.select(
                F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), "fqn", "tier", "score", F.lit(total).cast("bigint").alias("total_matches"), F.lit(offset + top_k if total > offset + top_k else None).cast("int").alias("next_offset"),
                F.lit(None).cast("array<string>").alias("suggestions"), "rank",
            )
            return self._hold(found).orderBy("rank").drop("rank")
        if total:
            return self._miss("past_the_end", columns)
        task = self._by_words(query, pool, top_k, offset) if re.search(r"\s", query.strip()) else None
        if task is not None:
            return task
        close = symbols.suggestions(asked, pool.select("fqn")).first()["suggestions"]
        return self._miss("no_symbol", columns).withColumn("suggestions", F.lit(close).cast("array<string>"))

    def _by_words(self, query: str, pool: DataFrame, top_k: int, offset: int) -> DataFrame | None:
        """The symbols that show a task's terms, or whose names and members are its naming words."""
        last = F.element_at(F.split("fqn", r"\.|::"), -1)
        words = lambda name: F.transform(T.symbol_words(name), T.canon)
        shown = pool.select("fqn", F.explode(F.array(F.struct(F.lit("type").alias("place"), words(last).alias("words")), F.struct(F.lit("member").alias("place"), F.flatten(F.transform(grammar.declared_members("text"), lambda m: words(m["name"]))).alias("words")))).alias("x"))
        entries = shown.select(F.col("fqn").alias("entry"), "x.place", F.explode("x.words").alias("word"))
        terms = symbols.evidence_terms(self._asked(query), self.family, key="q").select("concept", F.explode("forms").alias("word"), F.lit(1.0).alias("weight"), "light")
        by_terms = symbols.evidence(entries, terms).select(F.col("entry").alias("fqn"), F.lit(5).alias("tier"), "score")
        tokens = self._asked(query).select(relevance.naming_tokens("query", T.excluded_terms(self.family, self.platform))).first()[0]
        named = reference.token_fallback(pool.select("fqn", F.transform(grammar.declared_members("text"), lambda m: m["name"]).alias("members")), F.array(*map(F.lit, tokens)).cast("array<string>"))
        by_names = named.select("fqn", F.lit(6).alias("tier"), (F.col("matched") + F.col("named") / 1000).cast("double").alias("score"))
        for found in (by_terms, by_names):
            order = (F.desc("score"), "fqn")
            page = found.orderBy(*order).limit(offset + top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > offset)  # so few rows are numbered in one task
            page = page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total_matches"))))  # one row
            out = page.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), "fqn", "tier", "score", "total_matches", F.when(F.col("total_matches") > offset + top_k, F.lit(offset + top_k)).alias("next_offset"), F.lit(None).cast("array<string>").alias("suggestions"), "rank")
            if not out.isEmpty():
                return out.orderBy("rank").drop("rank")
        return None

    def get_symbol(self, fqn: str) -> DataFrame:
        """found, reason, fqn, text, signature: the exact name, the only one that ends with it, or the owner of a member;
        a re-export's definition is followed."""
        checked(fqn, 512)
        columns = "fqn string, text string"
        pool = self._of("symbol")
        asked = self.spark.createDataFrame([(fqn,)] + ([(re.split(r"::|\.", fqn)[-2],)] if re.search(r"::|\.", fqn) else []), "query string")
        found = {r["query"]: r for r in symbols.resolve(pool.select("fqn").distinct(), asked).collect()}
        hit, member = found[fqn], None
        if hit["reason"] == "not_found" and len(found) > 1:
            owner = re.split(r"::|\.", fqn)[-2]
            hit, member = found[owner], re.split(r"::|\.", fqn)[-1]
        if not hit["found"]:
            return self._miss(hit["reason"], columns)
        shells = pool.select(F.col("fqn").alias("name"), grammar.header("text", "Defined-In").alias("defined_in")).where("defined_in is not null")
        end = hit["fqn"]
        for _ in range(8):
            step = shells.where(F.col("name") == end).first()
            if step is None:
                break
            end = step["defined_in"]
        rows = pool.where(F.col("fqn") == end)
        if member is not None:
            rows = rows.where(F.exists(grammar.declared_members("text"), lambda m: m["name"] == member))
        if rows.isEmpty():
            return self._miss("not_found", columns)
        return rows.limit(1).select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), "fqn", "text", grammar.signature("text").alias("signature"), grammar.coverage_note("text").alias("note"))

    def list_members(self, fqn: str) -> DataFrame:
        """found, reason, place, header, name, line of a symbol's members in order."""
        symbol = self.get_symbol(fqn)
        if "signature" not in symbol.columns:
            return self._miss(symbol.first()["reason"], "place int, header string, name string, line string")
        return symbol.select("found", "reason", F.posexplode(grammar.declared_members("text")).alias("place", "m")).select("found", "reason", "place", "m.header", "m.name", "m.line")

    def find_examples(self, query: str, top_k: int = 5) -> DataFrame:
        """found, reason, basis, confidence, chunk_id, title, code, status, score of verified examples: by title, by words, by
        vectors. Words that cover an example find it if its title holds one of them, or the beginning of a longer word, or its
        code an identifier of the query: that alone is a loose match."""
        checked(query), checked_page(top_k)
        self._release()
        columns = "basis string, confidence string, chunk_id string, title string, code string, status string, score double"
        pool = self._of("example").where(predicates.verified_example("text")).withColumn("title", F.substring("fqn", 10, 1 << 30)).withColumn("code", grammar.example_code("text")).where("code is not null").withColumn("run", grammar.runtime("text"))
        out = lambda rows, basis, confidence: rows.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), F.lit(basis).alias("basis"), confidence.alias("confidence"), "chunk_id", "title", "code", "run.status", "score")
        exact = pool.where(F.lower(F.trim("title")) == query.strip().lower()).withColumn("score", F.lit(1.0))
        if not exact.isEmpty():
            return out(exact.orderBy("run.rank", "chunk_id").limit(top_k), "title", relevance.lexical_confidence(F.lit("exact_title")))
        held = self._index("example")
        weighted, required, distinctive = self._terms(query, held)
        covered = held.guarded(held.coverage(weighted, "q"), required, "q").where(F.col("coverage") >= RELEVANT)
        listed = lambda found: F.array(*map(F.lit, found)).cast("array<string>")
        of_title = relevance.title_anchored(listed(distinctive), "title") | relevance.title_prefix_anchored(listed(distinctive), "title")
        of_code = relevance.code_anchored(listed([r["term"] for r in required.collect()]), "code")  # one query's words
        anchored = covered.join(pool, "chunk_id").withColumn("score", F.round("coverage", 6)).withColumn("by_title", of_title).where(F.col("by_title") | of_code)
        best = Window.partitionBy(F.lower("title")).orderBy("run.rank", F.desc("score"), "chunk_id")
        anchored = anchored.withColumn("n", F.row_number().over(best)).where("n = 1").orderBy("run.rank", F.desc("score"), "chunk_id").limit(top_k)
        if not anchored.isEmpty():
            return out(anchored, "words", relevance.lexical_confidence(F.when(F.col("by_title"), "title_word_and_example_text")))
        near = self._nearest(pool, query, EXAMPLE_FLOOR, top_k)
        if not near.isEmpty():
            return out(near.join(pool, "chunk_id").orderBy("run.rank", F.desc("score"), "chunk_id"), "vector", F.lit(None).cast("string"))
        return self._miss("no_example", columns)

    def lookup(self, query: str, content_type: str | None = None, top_k: int = 10) -> DataFrame:
        """found, reason, kind, name, score: documents, an example and symbols for a task; symbols first for a bare name."""
        checked(query), checked_page(top_k)
        self._release()
        self._within = True
        try:
            return self._looked_up(query, content_type, top_k)
        finally:
            self._within = False

    def _looked_up(self, query: str, content_type: str | None, top_k: int) -> DataFrame:
        """The answer of lookup, whose few rows are held."""
        task = self._asked(query).select(predicates.task_question("query")).first()[0]
        part = lambda rows, kind, name: rows.where("found").select("found", "reason", F.lit(kind).alias("kind"), F.col(name).alias("name"), "score")
        docs = lambda: part(self.search_docs(query, content_type, top_k), "documentation", "chunk_id")
        if content_type or self._asked(query).select(relevance.category_intent("query")).first()[0]:
            answer = self._hold(docs())
        elif task:
            answer = self._hold(docs().unionByName(part(self.find_examples(query, 1), "example", "chunk_id")).unionByName(part(self.search_symbols(query, 3), "symbol", "fqn")))
        else:
            answer = self._hold(part(self.search_symbols(query, top_k), "symbol", "fqn"))
            if answer.isEmpty():
                answer = self._hold(docs())
        return answer if not answer.isEmpty() else self._miss("nothing_found", "kind string, name string, score double")

    def get_product_reference(self, section: str, inputs: dict[str, str | None]) -> DataFrame:
        """found, reason, section, text: one of the eight sections from the staged inputs; text that only agents follow is cut."""
        if section not in SECTIONS:
            raise ValueError(f"section is one of {', '.join(SECTIONS)}")
        text = inputs.get(section) or (inputs.get("license_text") if section == "license" else None)
        if not text:
            return self._miss("not_available", "section string, text string")
        rows = self.spark.createDataFrame([(section, text)], "section string, text string")
        if section == "license":
            rows = rows.withColumn("text", F.coalesce(predicates.licence("text"), "text"))
        if section == "agent_guidance":
            rows = rows.withColumn("text", relevance.without_agent_lines("text"))
        return rows.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), "section", "text")

    def list_recent_changes(self, releases: DataFrame, indexed_commit: str, indexed_version: str, limit: int = 10) -> DataFrame:
        """found, reason, tag_name, richness, in_index, basis of the newest releases (tag_name, body, target_commitish, ord)."""
        align = versions.alignment("tag_name", F.col("target_commitish"), F.lit(indexed_commit), versions.parsed(F.lit(indexed_version)))
        rows = releases.withColumn("v", versions.parsed("tag_name")).orderBy(F.desc_nulls_last("v"), "ord").limit(limit)
        out = rows.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), "tag_name", versions.richness("body").alias("richness"), align.alias("a")).select("found", "reason", "tag_name", "richness", "a.in_index", "a.basis")
        return out if not out.isEmpty() else self._miss("no_releases", "tag_name string, richness string, in_index boolean, basis string")

    def report_index_freshness(self, current_commit: str | None = None, ahead: int | None = None, behind: int | None = None) -> DataFrame:
        """found, reason, indexed_commit, n_chunks, fresh, basis: by the caller's commit, else by ancestry, else unknown."""
        if current_commit is not None and not re.fullmatch(r"[0-9a-fA-F]{7,64}", current_commit):
            raise ValueError("a commit is 7 to 64 hexadecimal digits")
        self._release()
        commits = self.chunks.select(grammar.header("text", "Source-Commit").alias("commit"), "kind").where("commit is not null").groupBy("commit").agg(F.count("*").alias("n_chunks"), F.sum((F.col("kind") == "symbol").cast("int")).alias("n_symbols"))
        best = self._hold(commits.orderBy(F.desc("n_symbols"), "commit").limit(1))
        if best.isEmpty():
            return self._miss("no_commit", "indexed_commit string, n_chunks bigint, fresh boolean, basis string")
        same = F.startswith(F.lower("commit"), F.lit((current_commit or "").lower())) | F.startswith(F.lit((current_commit or "").lower()), F.lower("commit"))
        drift = versions.drift(F.lit(ahead).cast("int"), F.lit(behind).cast("int"))
        fresh = same if current_commit else F.when(drift != "unknown", drift.isin("in_sync", "index_ahead_of_package"))
        return best.select(F.lit(True).alias("found"), F.lit(None).cast("string").alias("reason"), F.col("commit").alias("indexed_commit"), "n_chunks", fresh.alias("fresh"), (F.lit("caller_commit") if current_commit else F.when(drift != "unknown", "ancestry").otherwise("unknown")).alias("basis"))
