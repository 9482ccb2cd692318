"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, common, cotrain, exact_lsm, hyperlang, ivfpq, jaccard_forest, packing, pieces, secrets, seed_extend, suffix_dedup, tandem


def _vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(common.table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_lsm.exact_dedup(common.table(spark, sf_dir, "documents"), keep="largest")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), _vocabulary_path())


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.remove_repeats(common.table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.identify(common.table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(common.table(spark, sf_dir, "documents"), _vocabulary_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(common.table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.run_digests(common.table(spark, sf_dir, "documents"), tandem.planted)


def op12_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(common.table(spark, sf_dir, "documents"), _model_path())


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_ngram_jaccard_join,
        op3_exact_dedup,
        op4_best_fit_packing,
        op5_suffix_array_dedup,
        op6_substring_dedup,
        op7_language_id,
        op8_bpe_round_trip,
        op9_quality_classifier,
        op10_nearest_neighbours,
        op11_periodic_runs,
        op12_sentencepiece_round_trip,
        op13_centroid_clustering,
    )
}

def _lloyd_sql(clusters: int, rounds: int) -> str:
    """DuckDB's SQL for the clustering: each round's assignments (a) and centroids (c) are tables of their own."""
    parts = [
        "k AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE) OR abs(x::DOUBLE) * 64 >= 134217728)) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT {clusters}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (SELECT k.*, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k, c{n} c) GROUP BY row)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{n} GROUP BY c) m USING (c))")
    return (
        "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
               sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} f ON f.c = a.best.c"""
    )


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1 : i + 5], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 10 >= 8 * (x.n + y.n - c)),
        r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
        k AS (SELECT doc_id, min(other) AS root FROM r GROUP BY doc_id),
        c AS (SELECT a AS doc_id, count(*) AS links, min(CASE WHEN same THEN b END) AS copy FROM l GROUP BY a)
        SELECT d.doc_id, coalesce(k.root, d.doc_id) AS class_id, least(coalesce(c.copy, d.doc_id), d.doc_id) AS copy_of, coalesce(c.links, 0)::BIGINT AS n_links
        FROM w d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, h FROM d),
        b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= length(h) THEN md5(substr(h, 2 * i + 1, 100)) END AS w FROM p),
        m AS (SELECT doc_id, i, x, CASE WHEN w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id THEN 1 ELSE 0 END AS hit FROM b),
        c AS (SELECT doc_id, i, x, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
        e AS (SELECT doc_id, i, x, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS edge FROM c),
        r AS (SELECT doc_id, sum(gone) AS n_removed, sum(edge) AS n_spans, coalesce(string_agg(CASE WHEN gone = 0 THEN x END, '' ORDER BY i), '') AS kept FROM e GROUP BY doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
        b AS (SELECT doc_id, i, ws[i + 1] AS x, CASE WHEN i + 13 <= len(ws) THEN md5(array_to_string(ws[i + 1 : i + 13], ' ')) END AS w
              FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d)),
        m AS (SELECT doc_id, i, x, CASE WHEN w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id THEN 1 ELSE 0 END AS hit FROM b),
        c AS (SELECT doc_id, i, x, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
        r AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN x END, ' ' ORDER BY i), '') AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op13_centroid_clustering": _lloyd_sql(16, 3),
}
