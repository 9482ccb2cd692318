"""A keyword index of one generation of documents: postings, dictionary and statistics as Parquet.

Documents are tokenised once, when the index is built. Postings are partitioned by a hash of the token and sorted by it. A
query set's tokens, as long as they are at most MOST_ASKED, become filters on bucket and token: only their files
(partition filters) and row groups (pushed filters) are read. More tokens are joined. The dictionary holds every token's
stem and document frequency: statistics of stems come from it without a look at the postings.

An index is named by what it was built from: the table's files with their lengths and times, the tokeniser and the columns.
The same generation is built once and read from then on; another one is another folder. A folder is complete when its
statistics, which are written last, are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T

from . import lexical
from .staging import shared_folder

BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 32  # of text
SPREAD = 4  # files of a bucket, at least where its words are that frequent; twice as many parts as buckets are dealt out
MOST_ASKED = 4096  # tokens that come to the driver and become filters
MOST_ROWS = 50_000  # of a query set's words that are broadcast
TOKENISERS = {"full": T.tokens, "plain": T.plain_tokens}


def _files(df: DataFrame) -> str:
    """The input files of a table with their lengths and times."""
    spark = df.sparkSession
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        path = path_of(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name}\x1f{status.getLen()}\x1f{status.getModificationTime()}")
    return "\n".join(out)


@dataclass
class Words:
    """A query set's words: a DataFrame, to be broadcast where there are at most MOST_ROWS; these rows, else None."""

    df: DataFrame
    rows: list[Row] | None

    @staticmethod
    def of(df: DataFrame) -> Words:
        rows = df.limit(MOST_ROWS + 1).coalesce(1).collect()  # a stated query set's words, in one job
        if len(rows) > MOST_ROWS:
            return Words(df, None)
        return Words(F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows)

    def some(self, column: str) -> list | None:
        """The different values of a column, if they are at most MOST_ASKED."""
        if self.rows is None:
            return None
        found = sorted({r[column] for r in self.rows})
        return found if len(found) <= MOST_ASKED else None


@dataclass
class KeywordIndex:
    """postings: bucket, token, key, tf, dl. dictionary: bucket, token, stem, df. stats: n_docs, avgdl (one row)."""

    key: str
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    buckets: int
    tokeniser: str

    def bucket(self, token: Column | str) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def asked(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """query_key, token, times, bucket: repeats of a token in a query count again."""
        tokens = TOKENISERS[self.tokeniser](F.coalesce(F.col(query_text), F.lit("")))
        found = queries.select(query_key, F.explode(tokens).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
        return found.withColumn("bucket", self.bucket("token"))

    def of_tokens(self, table: DataFrame, words: Words) -> DataFrame:
        """The rows of postings or dictionary whose token is in words (bucket, token)."""
        tokens = words.some("token")
        if tokens is None:
            return table.join(words.df.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi")
        return table.where(F.col("bucket").isin(words.some("bucket")) & F.col("token").isin(tokens))

    def _weighed(self, queries: DataFrame, query_key: str, query_text: str) -> tuple[DataFrame, DataFrame]:
        """The postings of the queries' tokens; and query_key, bucket, token, times, df with the statistics."""
        asked = Words.of(self.asked(queries, query_key, query_text))
        words = self.of_tokens(self.dictionary, asked).select("bucket", "token", "df")
        weighed = words.join(asked.df, ["bucket", "token"]).crossJoin(F.broadcast(self.stats))  # one row
        return self.of_tokens(self.postings, asked), weighed if asked.rows is None else F.broadcast(weighed)  # no more rows than asked

    def bm25(self, queries: DataFrame, query_key: str, query_text: str, among: DataFrame | None = None) -> DataFrame:
        """Rows (query_key, key, score) with a positive score; of the documents whose key is in among, where that is given."""
        posted, weighed = self._weighed(queries, query_key, query_text)
        posted = posted if among is None else posted.join(among, self.key, "left_semi")
        weighed = weighed.withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
        long = 1 - lexical.B + lexical.B * F.col("dl") / F.col("avgdl")
        gain = F.col("times") * F.col("idf") * F.col("tf") * (lexical.K1 + 1) / (F.col("tf") + lexical.K1 * long)
        return self._dealt(posted).join(weighed, ["bucket", "token"]).groupBy(query_key, self.key).agg(F.sum(gain).alias("score")).where("score > 0")

    def tf_idf(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """(tf / dl) * (ln((N + 1) / (df + 1)) + 1), summed over a query's tokens."""
        posted, weighed = self._weighed(queries, query_key, query_text)
        weighed = weighed.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
        gain = F.col("times") * F.col("tf") / F.col("dl") * F.col("idf")
        return self._dealt(posted).join(weighed, ["bucket", "token"]).groupBy(query_key, self.key).agg(F.sum(gain).alias("score"))

    def stem_freq(self) -> DataFrame:
        """stem, df: the sum of the document frequencies of the tokens with this stem; may exceed the number of documents."""
        return self.dictionary.groupBy("stem").agg(F.sum("df").alias("df"))

    def forms(self, terms: Words) -> DataFrame:
        """term, bucket, token, df: the tokens with a stem of terms (with a column term)."""
        words, found = self.dictionary.withColumnRenamed("stem", "term"), terms.some("term")
        return words.join(terms.df.select("term").distinct(), "term", "left_semi") if found is None else words.where(F.col("term").isin(found))

    def weights(self, terms: DataFrame) -> DataFrame:
        """terms (with a column term, a stem) with their weights."""
        asked = Words.of(terms)
        df = self.forms(asked).groupBy("term").agg(F.sum("df").alias("df"))
        total = F.broadcast(self.stats.select("n_docs"))  # one row
        return asked.df.join(df, "term", "left").crossJoin(total).select(*terms.columns, lexical.idf_weight(F.col("df"), F.col("n_docs")).alias("weight"))

    def _dealt(self, posted: DataFrame) -> DataFrame:
        """Rows of documents, dealt by document in as many parts as the generation has buckets: what then meets or adds up within a
        document stays in its part, whose size does not grow with the table."""
        return posted.repartition(self.buckets, self.key)

    def _met(self, terms: DataFrame) -> DataFrame:
        """The columns of terms with the keys of the documents that hold a token of their stem, once each; dealt by document.
        Postings travel once, under their stem, and meet the queries where their document is."""
        asked = Words.of(terms.distinct())
        stems = asked.df.select("term").distinct()
        forms = Words.of(self.forms(asked).select("bucket", "token", "term").join(stems, "term"))
        held = self.of_tokens(self.postings, forms).join(forms.df, ["bucket", "token"]).select(self.key, "term")
        return self._dealt(held).distinct().join(asked.df, "term").select(self.key, *terms.columns)

    def holders(self, terms: DataFrame) -> DataFrame:
        """key, term: which documents hold a stem of terms, once each."""
        return self._met(terms.select("term"))

    def coverage(self, weighted: DataFrame, query: str) -> DataFrame:
        """query, key, coverage, n_present for documents that hold a term: the weight of its terms over the weight of all."""
        weighted = Words.of(weighted.select(query, "term", "weight")).df
        total = weighted.groupBy(query).agg(F.sum("weight").alias("total"))
        held = self._met(weighted).groupBy(query, self.key).agg(F.sum("weight").alias("held"), F.count("*").alias("n_present"))
        share = F.col("held") / F.col("total")
        return held.join(total, query).select(query, self.key, F.when(F.col("total") > 0, share).otherwise(F.lit(0.0)).alias("coverage"), "n_present")

    def guarded(self, covered: DataFrame, required: DataFrame, query: str) -> DataFrame:
        """coverage, but 0 where a required term (query, term) is not in the document."""
        need = required.groupBy(query).agg(F.count("*").alias("needed"))
        has = self.holders(required).join(required, "term").groupBy(query, self.key).agg(F.count("*").alias("has"))
        joined = covered.join(need, query, "left").join(has, [query, self.key], "left")
        return joined.select(query, self.key, F.when(F.coalesce("needed", F.lit(0)) <= F.coalesce("has", F.lit(0)), F.col("coverage")).otherwise(F.lit(0.0)).alias("coverage"), "n_present")

    def ubiquitous(self, fraction: float = lexical.UBIQUITY, least: int = lexical.UBIQUITY_LEAST) -> DataFrame:
        """stem, df of the stems in at least a fraction of the documents, where there are enough of them. Only stems whose
        tokens' frequencies add up to that much are counted by documents."""
        total = F.broadcast(self.stats.select("n_docs"))  # one row
        enough = (F.col("n_docs") >= least) & (F.col("df") / F.col("n_docs") >= fraction)
        likely = self.stem_freq().crossJoin(total).where(enough).select(F.col("stem").alias("term"))
        return self.holders(likely).groupBy(F.col("term").alias("stem")).agg(F.count("*").alias("df")).crossJoin(total).where(enough).select("stem", "df")


def _table(docs: DataFrame, folder: str, key: str, name: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schemas = {"postings": f"`{key}` {kind}, token string, tf long, dl int, bucket int", "dictionary": "token string, df long, stem string, bucket int", "stats": "n_docs long, avgdl double"}
    return docs.sparkSession.read.schema(schemas[name]).parquet(f"{folder}/{name}")


def _read(docs: DataFrame, folder: str, key: str, buckets: int, tokeniser: str) -> KeywordIndex:
    return KeywordIndex(key, *(_table(docs, folder, key, name) for name in ("postings", "dictionary", "stats")), buckets, tokeniser)


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokeniser: str = "full", buckets: int = 8) -> KeywordIndex:
    """Writes the index of docs into a folder: one tokenisation and one shuffle. What travels is a row for each document and
    group of buckets, with the words that the document holds there and how often, so a posting costs little more than its
    letters. A word that very many documents hold is dealt over several files of its bucket. The parts grow in number with
    the buckets, not in size."""
    at = KeywordIndex(key, docs, docs, docs, buckets, tokeniser)
    groups = min(buckets, LEAST_BUCKETS)
    spread = max(SPREAD, -(-2 * buckets // groups))
    marked = F.transform(TOKENISERS[tokeniser](F.coalesce(F.col(text), F.lit(""))), lambda t: F.concat(F.chr(at.bucket(t) % groups + 48), t))
    begins = lambda xs, n, same: F.when(F.col(n) > 0, F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda i: (i == 0) | (same(F.get(xs, i)) != same(F.get(xs, i - 1)))))
    listed = docs.select(key, F.sort_array(marked).alias("tokens")).withColumn("dl", F.size("tokens"))  # a filter on dl would work the tokens out twice
    listed = listed.withColumn("first", begins("tokens", "dl", lambda t: t))  # equal tokens stand together: they are counted within the document
    times = lambda i, n: F.coalesce(F.get("first", n + 1), F.col("dl")) - i
    word = lambda i, n: F.concat(F.get("tokens", i), F.when(times(i, n) > 1, F.concat(F.lit(":"), times(i, n).cast("string"))).otherwise(""))
    listed = listed.select(key, "dl", F.transform("first", word).alias("words")).withColumn("n", F.size("words"))
    listed = listed.withColumn("start", begins("words", "n", lambda w: F.substring(w, 1, 1)))  # and those of a group
    own = lambda i, n: F.transform(F.slice("words", i + 1, F.coalesce(F.get("start", n + 1), F.col("n")) - i), lambda w: F.substring(w, 2, 1 << 30))
    packed = F.transform("start", lambda i, n: F.struct((F.ascii(F.get("words", i)) - 48).alias("g"), F.array_join(own(i, n), " ").alias("words")))
    moved = listed.select(key, "dl", F.explode(packed).alias("x")).select(key, "dl", "x.g", "x.words")
    moved = moved.repartitionById(groups * spread, (F.col("g") * spread + F.pmod(F.xxhash64(key), F.lit(spread))).cast("int"))
    said = moved.select(key, "dl", F.explode(F.split("words", " ")).alias("word")).withColumn("token", F.substring_index("word", ":", 1))
    tf = F.when(F.length("word") > F.length("token"), F.substring_index("word", ":", -1).cast("long")).otherwise(F.lit(1).cast("long"))
    dealt = said.select(key, "token", tf.alias("tf"), "dl").withColumn("bucket", at.bucket("token")).sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    posted = _table(docs, folder, key, "postings")
    words = posted.groupBy("bucket", "token").agg(F.count("*").alias("df")).withColumn("stem", T.stem("token"))
    words.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/dictionary")
    sizes = posted.agg(F.sum("tf").alias("tokens"))
    stats = docs.agg(F.count("*").alias("n_docs")).crossJoin(sizes).withColumn("avgdl", F.try_divide(F.coalesce("tokens", F.lit(0)).cast("double"), F.col("n_docs")))
    stats = stats.select("n_docs", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    return _read(docs, folder, key, buckets, tokeniser)


def of_generation(docs: DataFrame, key: str = "doc_id", text: str = "text", tokeniser: str = "full") -> KeywordIndex:
    """The index of a table's present files, built if there is none yet."""
    spark = docs.sparkSession
    name = hashlib.sha256("\x1e".join((_files(docs), key, text, tokeniser)).encode()).hexdigest()[:32]
    folder = f"{shared_folder(spark).rsplit('/', 1)[0]}/lodestrata-index-{name}"
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/stats/_SUCCESS")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return _read(docs, folder, key, buckets, tokeniser)
    return build(docs, folder, key, text, tokeniser, buckets)
