"""Queries of the concept graph over ``embeddings``: label is the domain, five consecutive ids share a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, layout, neighbour_graph, walk
from ..staging import stage

DEEP = 60
TOP = 20


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return graph.concepts(rows, "vec_id", "embedding", F.col("label"), F.floor(F.col("vec_id") / 5))


def _near(spark: SparkSession, sf_dir: str, keep: int = DEEP) -> DataFrame:
    return graph.neighbours(_nodes(spark, sf_dir), keep)


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, graph.K).select("i", "j", F.round("sim", 6).alias("sim"), F.col("rk").cast("long").alias("rk"))


def knn_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.synapses(_near(spark, sf_dir, graph.K))


def knn_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synapses of the refined neighbour graph, without all pairs."""
    return graph.synapses(graph.neighbours(_nodes(spark, sf_dir), graph.K, exact=False))


def knn_refined_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against brute force for ids divisible by 50 over all rows: how many nodes, how many neighbours, and whether 0.9 of these were found."""
    nodes = stage(_nodes(spark, sf_dir), "nodes")
    found = neighbour_graph.recall(nodes, graph.neighbours(nodes, graph.K, exact=False), graph.K)
    sums = found.agg(F.count(F.lit(1)).alias("asked"), F.sum("wanted").alias("wanted"), F.sum("found").alias("found"))
    return sums.select("asked", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("enough"))


def neighbor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard overlap of the neighbourhoods of each node and its nearest."""
    near = stage(_near(spark, sf_dir, graph.NEIGHBOURS), "near")
    return graph.overlap(near, near.where("rk = 1").select("i", "j")).select("i", "j", F.round("overlap", 6).alias("overlap"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    """Pairs with scores, the number of nodes, and the neighbours that both come from."""
    nodes = _nodes(spark, sf_dir)
    n = nodes.count()
    near = stage(graph.neighbours(nodes, DEEP), "near")
    return graph.rated(near, nodes, n), n, near


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most surprising pairs, with labels."""
    scored, *_ = _scored(spark, sf_dir)
    return graph.labelled(scored.orderBy(F.desc("score"), "i", "j").limit(TOP), _nodes(spark, sf_dir))


def _bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synapses and the most surprising bridges as one edge list."""
    scored, _, near = _scored(spark, sf_dir)
    return graph.with_bridges(graph.synapses(near), scored.orderBy(F.desc("score"), "i", "j").limit(TOP))


def bridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    found = graph.candidates(graph.neighbours(nodes, DEEP), nodes.count())
    return found.select("i", "j", F.col("rk").cast("long").alias("rk"), F.round("sim", 6).alias("sim"))


def surprise_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, *_ = _scored(spark, sf_dir)
    return scored.select("i", "j", F.round("sim", 4).alias("sim"), F.round("overlap", 4).alias("overlap"), "cross", "same_source", F.round("score", 4).alias("score"))


def bridges_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, n, _ = _scored(spark, sf_dir)
    scored = stage(scored.select("i", "j", "rk", "score"), "scored")
    return graph.diverse(scored, graph.bridge_limit(n)).select("i", "j", F.round("score", 4).alias("score"))


def bridge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the most surprising pairs, with what was measured in words."""
    return graph.cards(_first(spark, sf_dir)).select("i", "j", "why", "angle")


def insight_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.digest(_first(spark, sf_dir), TOP)


def graph_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return graph.meta(nodes, graph.synapses(graph.neighbours(nodes, graph.K)))


def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.adjacency(knn_synapses(spark, sf_dir))
    return rows.select("node", "degree", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"), "weight")


def domain_bridge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.domain_matrix(_scored(spark, sf_dir)[0])


def long_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synapses and the most surprising bridges as one edge list."""
    edges = _bridged(spark, sf_dir)
    return edges.groupBy("is_long").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("weight"))


def nearest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_baseline(_near(spark, sf_dir, 1))


def engine_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.engine_band(_near(spark, sf_dir, evaluation.BAND[1] + 1))


def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating sheet for 12 sampled concepts (sampling is the feature)."""
    return evaluation.sheet(stage(_near(spark, sf_dir, evaluation.BAND[1] + 1), "near"), 12)


def spread_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stage(knn_synapses(spark, sf_dir), "edges")
    act = graph.spread_activation(edges, edges.select(F.col("s").alias("node")).where("node % 50 = 0").distinct())
    return act.select("node", F.round(graph.decay(F.col("act"), 0.13), 6).alias("act"))


def layout_axis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.axis_stats(layout.layout(_nodes(spark, sf_dir)))


def walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_bridged(spark, sf_dir), walkers=8, steps=50)


_BASE = """
    WITH raw AS (SELECT vec_id AS i, CAST(label AS VARCHAR) AS domain, vec_id // 5 AS source, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT i, domain, source, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS v FROM raw),
    n AS (SELECT count(*) AS n FROM u),
    sims AS (SELECT a.i AS i, b.i AS j, list_dot_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.i <> b.i),
    near AS (SELECT * FROM (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rk FROM sims) WHERE rk <= 60),
    edges AS (SELECT least(i, j) AS s, greatest(i, j) AS t, round(max(sim), 4) AS w FROM near WHERE rk <= 8 GROUP BY ALL),
    cand AS (
        SELECT i, j, rk, sim FROM (
            SELECT i, j, rk, sim, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY i, rk) AS f FROM near, n
            WHERE rk BETWEEN least(12, greatest(2, n.n // 4)) + 1 AND least(60, n.n - 1)
        ) WHERE f = 1 AND sim > 0
    ),
    sets AS (SELECT i, list(j) AS s FROM near WHERE rk <= 12 GROUP BY i),
    lap AS (
        SELECT c.i, c.j, c.rk, c.sim, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE AS overlap
        FROM cand c JOIN sets a ON c.i = a.i JOIN sets b ON c.j = b.i
    ),
    scored AS (
        SELECT l.i, l.j, l.rk, l.sim, l.overlap, a.domain AS di, b.domain AS dj, a.domain <> b.domain AS "cross", a.source = b.source AS same_source, a.source AS si,
               l.sim * (1 - l.overlap) * (CASE WHEN a.domain <> b.domain THEN 1.15 ELSE 1.0 END) * (CASE WHEN a.source = b.source THEN 0.35 ELSE 1.0 END) AS score
        FROM lap l JOIN u a ON l.i = a.i JOIN u b ON l.j = b.i
    )
"""
_TOP = f"(SELECT * FROM scored ORDER BY score DESC, i, j LIMIT {TOP})"
_CARDS = f"""
    , cards AS (
        SELECT i, j, "cross", score,
            CASE WHEN sim >= 0.75 THEN 'Strongly related' WHEN sim >= 0.55 THEN 'Clearly related' ELSE 'Loosely related' END
            || ' (cosine ' || printf('%.2f', round(sim, 2)) || '), '
            || CASE WHEN overlap = 0 THEN 'without any common near neighbour' ELSE 'with ' || CAST(CAST(round(overlap * 100) AS INTEGER) AS VARCHAR) || '% of near neighbours in common' END
            || ': ' || CASE WHEN same_source THEN 'both stand in ' || CAST(si AS VARCHAR) WHEN "cross" THEN 'a bridge from ' || di || ' to ' || dj ELSE 'two groups apart inside ' || di END || '.' AS why,
            'How would c' || CAST(i AS VARCHAR) || ' look through c' || CAST(j AS VARCHAR) || '?' AS angle
        FROM {_TOP}
    )
"""
_BOTH = "SELECT s AS node, t AS other, w FROM edges UNION ALL SELECT t, s, w FROM edges"

QUERIES = {f.__name__: f for f in (
    knn_topk, knn_synapses, knn_refined, knn_refined_recall, neighbor_overlap, bridge_candidates, surprise_ranked, bridges_diverse, bridge_cards, insight_digest, graph_meta, adjacency_lists,
    domain_bridge_matrix, long_edges, nearest_baseline, engine_band, blind_sheet, spread_one_step, layout_axis_stats, walk_events,
)}

ORACLES = {
    "knn_topk": f"{_BASE} SELECT i, j, round(sim, 6) AS sim, rk FROM near WHERE rk <= 8",
    "knn_synapses": f"{_BASE} SELECT s, t, w FROM edges",
    "knn_refined_recall": f"{_BASE} SELECT count(DISTINCT i) AS asked, count(*) AS wanted, true AS enough FROM near WHERE rk <= 8 AND i % 50 = 0",
    "neighbor_overlap": f"""{_BASE} SELECT m.i, m.j, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE, 6) AS overlap
        FROM near m JOIN sets a ON m.i = a.i JOIN sets b ON m.j = b.i WHERE m.rk = 1""",
    "bridge_candidates": f"{_BASE} SELECT i, j, rk, round(sim, 6) AS sim FROM cand",
    "surprise_ranked": f'{_BASE} SELECT i, j, round(sim, 4) AS sim, round(overlap, 4) AS overlap, "cross", same_source, round(score, 4) AS score FROM scored',
    "bridges_diverse": f"""{_BASE.replace("WITH", "WITH RECURSIVE", 1)},
        ranked AS MATERIALIZED (SELECT i, j, score, row_number() OVER (ORDER BY score DESC, i, rk) AS place FROM scored), most AS MATERIALIZED (SELECT greatest(8, n // 4) AS n FROM n),
        go AS (
            SELECT 0::BIGINT AS place, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS score, false AS took, []::BIGINT[] AS ends
            UNION ALL
            SELECT place, i, j, score, took, CASE WHEN took THEN list_concat(ends, [i, j]) ELSE ends END FROM (
                SELECT r.place, r.i, r.j, r.score, g.ends, len(list_filter(g.ends, lambda x: x = r.i)) < {graph.USES} AND len(list_filter(g.ends, lambda x: x = r.j)) < {graph.USES} AS took
                FROM go g JOIN ranked r ON r.place = g.place + 1, most WHERE len(g.ends) < 2 * most.n
            )
        )
        SELECT i, j, round(score, 4) AS score FROM go WHERE took""",
    "bridge_cards": f"{_BASE} {_CARDS} SELECT i, j, why, angle FROM cards",
    "insight_digest": f"""{_BASE} {_CARDS}, numbered AS (SELECT *, row_number() OVER (ORDER BY score DESC, i, j) AS place FROM cards)
        SELECT string_agg(CAST(place AS VARCHAR) || '. **c' || CAST(i AS VARCHAR) || '** and **c' || CAST(j AS VARCHAR) || '**' || CASE WHEN "cross" THEN ' (cross-domain)' ELSE '' END || ': ' || why || ' ' || angle, chr(10) ORDER BY place) AS digest,
               count(*) AS bridges FROM numbered""",
    "graph_meta": f"{_BASE} SELECT (SELECT count(*) FROM u) AS n, (SELECT max(len(v)) FROM u) AS dim, 8::BIGINT AS k, (SELECT count(*) FROM edges) AS n_synapses",
    "adjacency_lists": f"{_BASE} SELECT node, count(*) AS degree, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours, round(sum(w), 4) AS weight FROM ({_BOTH}) GROUP BY node",
    "domain_bridge_matrix": f"{_BASE} SELECT least(di, dj) AS domain_a, greatest(di, dj) AS domain_b, count(*) AS pairs, round(max(score), 4) AS best FROM scored GROUP BY ALL",
    "long_edges": f"""{_BASE}, far AS (SELECT least(i, j) AS s, greatest(i, j) AS t, round(sim, 4) AS bw FROM {_TOP})
        SELECT far.s IS NOT NULL AS is_long, count(*) AS n, round(sum(greatest(coalesce(w, bw), coalesce(bw, w))), 2) AS weight
        FROM edges FULL JOIN far ON edges.s = far.s AND edges.t = far.t GROUP BY 1""",
    "nearest_baseline": f"{_BASE} SELECT i, j AS baseline, round(sim, 4) AS sim FROM near WHERE rk = 1",
    "engine_band": f"{_BASE} SELECT i, count(*) AS band_size, arg_min(j, rk) AS first_j, arg_max(j, rk) AS last_j FROM near WHERE rk BETWEEN 16 AND 50 GROUP BY i",
    "spread_one_step": f"""{_BASE}, f AS (SELECT DISTINCT s AS node FROM edges WHERE s % 50 = 0),
        g AS (SELECT b.other AS node, least(1.0, sum(greatest(0.0, b.w) * 0.6)) AS act FROM ({_BOTH}) b JOIN f ON b.node = f.node GROUP BY b.other)
        SELECT node, round(act * pow(0.35, 0.13), 6) AS act FROM (SELECT * FROM g WHERE node NOT IN (SELECT node FROM f) UNION ALL SELECT node, 1.0 FROM f)""",
}
