"""The registered queries of this subpackage and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, itq, kneser_ney, langid, language_model, lexical, packing, pii, sentencepiece_codec, sharding, simhash, substring

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents onto 40 shards of near equal bytes, by 8,192 virtual slots. ``slot`` is the place in the shard."""
    placed = sharding.shard(_documents(spark, sf_dir), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of the documents labelled good and not toxic, and whether it is kept."""
    return kneser_ney.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Files of public tokenizers, which each worker looks up on its own machine.
VOCABULARY, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, verified against the sentencepiece library, and decoded again; digests of the ids."""
    return sentencepiece_codec.encode(_documents(spark, sf_dir), PIECES, with_ids=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens into sequences of 2,048, 32 windows open in each partition; a row for each piece."""
    return packing.pack(_documents(spark, sf_dir), VOCABULARY, special=True)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(_documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op8_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under the model of six sevenths of them."""
    return language_model.score_corpus(_documents(spark, sf_dir))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in 8 clusters after 10 rounds."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return lexical.search(lexical.build(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_itq": op8_itq,
    "op9_langid": op9_langid,
    "op10_substring": op10_substring,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_centroids": op12_centroids,
    "op13_lexical": op13_lexical,
}


def _lloyd_sql(k: int, rounds: int) -> str:
    """Round after round as one chain of tables: ``c`` are centroids, ``a`` nearest ones."""
    near = "SELECT v.vec_id, v.q, min((list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.c)) AS best FROM v CROSS JOIN c{i} c GROUP BY v.vec_id, v.q"
    near = near.replace("min((", "min(ROW(")
    parts = [
        "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)",
        "v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS q FROM x WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({near.replace('{i}', str(i))})")
        if i < rounds:
            parts.append(f"d{i} AS (SELECT best[2] AS c, unnest(range(64)) AS d, unnest(q) AS x FROM a{i})")
            parts.append(f"m{i} AS (SELECT c, d, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM d{i} GROUP BY c, d)")
            parts.append(f"n{i} AS (SELECT c, list(x ORDER BY d) AS q FROM m{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN n{i} n ON o.c = n.c)")
    parts.append(f"r AS (SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance FROM a{rounds})")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM r JOIN c{rounds} c ON c.c = r.cluster
    """

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), w AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
    "op8_itq": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0),
        links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
        reach(i, j) AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
        n AS (SELECT i, count(*) AS n_links FROM links GROUP BY i), c AS (SELECT i, min(j) AS low FROM reach GROUP BY i)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.i LEFT JOIN c ON e.vec_id = c.i
    """,
    "op10_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
        x AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 34 <= len(w) THEN md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) END AS h FROM p),
        r AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
        m AS (SELECT x.doc_id, x.pos, x.word, max(CASE WHEN r.h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN r ON x.h = r.h),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone = 1) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY pos), '') AS kept FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op12_centroids": _lloyd_sql(8, 10),
    "op13_lexical": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
            FROM documents
        ),
        b AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
        x AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM b) GROUP BY doc_id, n, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
        i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS impact FROM p JOIN w USING (term), s),
        r AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN i USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r QUALIFY rank <= 10
    """,
}
