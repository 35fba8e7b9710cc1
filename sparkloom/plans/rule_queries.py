"""Queries of the rule sets. A user of ``events`` is a profile; a few counts stand for the metrics that rules refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from . import nudges, rules
from .sequence_queries import ORACLES as MINED
from .sequence_queries import _events


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics for each user: counts of event types, scaled so that many rules hold for some users."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = lambda t: F.count_if(F.col("event_type") == t)
    hours = [F.count_if(F.hour("ts") == h) for h in range(24)]
    days = [F.count_if(F.weekday("ts") == d) for d in range(7)]
    per = rows.groupBy(F.col("user_id").alias("profile")).agg(
        F.count(F.lit(1)).alias("n"), n("click").alias("clicks"), n("view").alias("views"), n("purchase").alias("purchases"), n("error").alias("errors"),
        F.create_map(*[x for h, c in enumerate(hours) for x in (F.lit(str(h)), c)]).alias("hour_histogram"), F.create_map(*[x for d, c in enumerate(days) for x in (F.lit(str(d)), c)]).alias("weekday_histogram"),
    )
    c, whole = F.col, lambda x: x.cast("long")
    edit = c("clicks")
    return per.select(
        "profile", "hour_histogram", "weekday_histogram", F.lit(2).alias("sessions"), (c("n") * 10).alias("assistant_turns"), (c("n") * 4).alias("real_user_prompts"), (c("n") * 5).alias("tool_calls"),
        c("errors").cast("double").alias("pounce_median_sec"), (c("errors") * 2).alias("corrections_caught"), c("views").alias("reversal_count"), stats.percent(c("views"), c("n") * 4).alias("reversal_rate_per_100"),
        c("views").alias("read"), edit.alias("edit"), c("purchases").alias("write"), stats.ratio(c("views"), c("clicks")).alias("read_to_edit_ratio"), stats.percent(c("purchases"), c("n")).alias("reread_pct"),
        (c("n") * 2).alias("bash"), whole(c("clicks") * 3).alias("distinct_files_edited"), (c("views") * 3).alias("most_churned_file_edits"), (c("purchases") * 2).alias("workflow_calls"), c("purchases").alias("agent_calls"),
        whole(c("errors") % 2).alias("todo_calls"), (c("n") * 10).alias("max_turns_in_session"), (c("clicks") * 12.0).alias("avg_session_min"), whole(c("views") % 16).alias("mcp_servers_used"),
        (100.0 - c("errors") % 7).alias("opus_pct"), F.create_map(F.lit("Bash"), c("n") * 2).alias("top_tools"), F.create_map(F.lit("opus"), c("n") * 10, F.lit("haiku"), c("errors")).alias("models"),
        F.create_map(F.lit("cache_read"), c("n") * 2_000_000).alias("tokens"), F.create_map(F.lit("chrome"), c("clicks") * 4).alias("top_mcp_servers"),
    )


def archetype_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.archetype(_profiles(spark, sf_dir))


def insight_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.cards(_profiles(spark, sf_dir)).select("profile", "metric", "family", F.col("score").cast("long").alias("score"), F.round("value", 2).alias("value"))


def insight_cards_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.visible_cards(_profiles(spark, sf_dir))


def report_edges_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.edges_and_taxes(_profiles(spark, sf_dir))
    return found.select("profile", "side", "key", "family", F.col("priority").cast("long").alias("priority"))


def report_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.moves(rules.edges_and_taxes(_profiles(spark, sf_dir)))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.report(_profiles(spark, sf_dir))
    return out.select("profile", F.col("archetype.name").alias("archetype"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"), F.coalesce(F.size("taxes"), F.lit(0)).alias("n_taxes"), F.coalesce(F.size("moves"), F.lit(0)).alias("n_moves"))


def nudges_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed: any lift from 1.0, without the interval test; purchases stand for plans."""
    return nudges.ranked(_events(spark, sf_dir), min_lift=1.0, above_base=False, early={"a purchase": ("purchase",)})


_COUNTS = """
    WITH c AS (
        SELECT user_id AS profile, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views,
               count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors,
               count(*) FILTER (WHERE hour(ts) BETWEEN 6 AND 12) AS morning, count(*) FILTER (WHERE hour(ts) BETWEEN 2 AND 4) AS night, count(*) FILTER (WHERE isodow(ts) >= 6) AS weekend
        FROM events GROUP BY user_id
    ),
    m AS (
        SELECT *, n * 10 AS turns, n * 5 AS calls, errors * 2 AS corrections, round(100.0 * views / greatest(n * 4, 1)::DOUBLE, 1) AS rev, round(views / greatest(clicks, 1)::DOUBLE, 1) AS r2e,
               round(100.0 * purchases / greatest(n, 1)::DOUBLE, 1) AS reread, clicks * 3 AS files, views * 3 AS churn, purchases * 3 AS dispatches, errors % 2 AS planning, 100.0 - errors % 7 AS opus,
               clicks * 12.0 AS avg_min, n * 2 AS bash, clicks * 4 AS browser, CASE WHEN clicks > 0 THEN round(clicks / (clicks * 3)::DOUBLE, 1) ELSE 0.0 END AS epf,
               CASE WHEN clicks > 0 THEN round((clicks + purchases) / (clicks * 3)::DOUBLE, 1) ELSE 0.0 END AS tpf, views % 16 AS servers, weekend * 100.0 / n::DOUBLE AS wk,
               errors AS pounce, views AS reversals, n * 4 AS prompts, n * 2000000 AS cache, n * 10 AS max_turns, errors AS smaller, 2 AS sessions
        FROM c
    )
"""
#: Cards, archetypes, edges and taxes of a table ``m`` of metrics.
RULES_SQL = """
    cards AS (
        SELECT profile, 'model_mix' AS metric, 'model' AS family, 95 AS score, opus AS value, 0 AS rule FROM m WHERE opus >= 95
        UNION ALL SELECT profile, 'pounce', 'latency', 94, pounce, 1 FROM m WHERE pounce <= 20 AND corrections >= 15
        UNION ALL SELECT profile, 'reversals', 'reversals', 93, rev, 2 FROM m WHERE rev >= 4 AND reversals >= 10
        UNION ALL SELECT profile, 'read_edit', 'read_edit', 92, r2e, 3 FROM m WHERE r2e < 1.2
        UNION ALL SELECT profile, 'todo', 'todo', 90, 0, 4 FROM m WHERE planning = 0 AND turns > 500
        UNION ALL SELECT profile, 'dispatch', 'dispatch', 86, dispatches, 5 FROM m WHERE dispatches >= 40
        UNION ALL SELECT profile, 'edits_per_file', 'churn', 84, churn, 6 FROM m WHERE churn >= 25 AND files >= 30
        UNION ALL SELECT profile, 'corrections', 'corrections', 83, corrections, 7 FROM m WHERE corrections >= 20
        UNION ALL SELECT profile, 'edits_per_file', 'churn', 82, epf, 8 FROM m WHERE files >= 40 AND epf > 0 AND epf <= 2 AND reread < 20
        UNION ALL SELECT profile, 'weekend', 'weekend', 80, round(wk, 0), 9 FROM m WHERE wk >= 35
        UNION ALL SELECT profile, 'bash', 'bash', 79, round(100 * bash / calls::DOUBLE, 0), 10 FROM m WHERE bash / calls::DOUBLE >= 0.25
        UNION ALL SELECT profile, 'browser', 'browser', 78, browser, 11 FROM m WHERE browser >= 100
        UNION ALL SELECT profile, 'hours', 'tempo', 74, night, 12 FROM m WHERE morning = 0 AND night > 200
        UNION ALL SELECT profile, 'max_turns', 'endurance', 68, max_turns, 13 FROM m WHERE max_turns >= 500
        UNION ALL SELECT profile, 'reread', 'reread', 66, reread, 14 FROM m WHERE reread >= 25
        UNION ALL SELECT profile, 'cache', 'scale', 60, cache, 15 FROM m WHERE cache > 100000000
        UNION ALL SELECT profile, 'mcp', 'stack', 58, servers, 16 FROM m WHERE servers >= 12
    ),
    arch AS (
        SELECT profile, name, score FROM (
            SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, rule) AS place FROM (
                SELECT profile, 'The Pouncer' AS name, round(95 * least(100.0 * corrections / prompts::DOUBLE / 8, 1.6), 2) AS score, 0 AS rule FROM m WHERE prompts >= 50 AND 100.0 * corrections / prompts::DOUBLE >= 8 AND rev >= 4
                UNION ALL SELECT profile, 'The Director', round(88 * least(100.0 * dispatches / calls::DOUBLE / 2, 1.6), 2), 1 FROM m WHERE calls >= 300 AND 100.0 * dispatches / calls::DOUBLE >= 2
                UNION ALL SELECT profile, 'The Bulldozer', 84.0, 2 FROM m WHERE opus >= 98 AND r2e < 1 AND planning = 0
                UNION ALL SELECT profile, 'The Surgeon', 82.0, 3 FROM m WHERE files >= 15 AND epf <= 2 AND reread < 20
                UNION ALL SELECT profile, 'The Marathoner', 76.0, 4 FROM m WHERE max_turns >= 800 AND avg_min >= 120
                UNION ALL SELECT profile, 'The Night Builder', 80.0, 5 FROM m WHERE morning = 0
                UNION ALL SELECT profile, 'The Terminal Native', 74.0, 6 FROM m WHERE round(100.0 * bash / calls::DOUBLE, 0) >= 30
                UNION ALL SELECT profile, 'The Puppeteer', round(72 * least(100.0 * browser / calls::DOUBLE / 5, 1.6), 2), 7 FROM m WHERE calls >= 300 AND 100.0 * browser / calls::DOUBLE >= 5
            )
        ) WHERE place = 1
    ),
    et AS (
        SELECT * FROM (
            SELECT profile, 'edge' AS side, 'reflex' AS key, 'reflex' AS family, 95 AS priority, 0 AS rule FROM m WHERE pounce <= 12 AND corrections >= 15
            UNION ALL SELECT profile, 'edge', 'dispatch', 'dispatch', 90, 1 FROM m WHERE dispatches >= 40
            UNION ALL SELECT profile, 'edge', 'endurance', 'endurance', 85, 2 FROM m WHERE max_turns >= 300
            UNION ALL SELECT profile, 'edge', 'bash', 'bash', 80, 3 FROM m WHERE bash / calls::DOUBLE >= 0.3
            UNION ALL SELECT profile, 'edge', 'churn', 'churn', 79, 4 FROM m WHERE files >= 40 AND tpf > 0 AND tpf <= 2 AND reread < 20
            UNION ALL SELECT profile, 'edge', 'reread', 'reread', 78, 5 FROM m WHERE reread >= 25
            UNION ALL SELECT profile, 'edge', 'planning', 'planning', 76, 6 FROM m WHERE planning >= 15
            UNION ALL SELECT profile, 'tax', 'steer', 'planning', 90, 7 FROM m WHERE r2e < 1 AND corrections >= 20
            UNION ALL SELECT profile, 'tax', 'onegear', 'model', 85, 8 FROM m WHERE opus >= 98 AND smaller <= greatest(20.0, round(turns * 0.01, 0))
            UNION ALL SELECT profile, 'tax', 'churn', 'churn', 72, 9 FROM m WHERE churn >= 40 AND files >= 20 AND churn >= 3 * tpf
            UNION ALL SELECT profile, 'tax', 'handoff', 'dispatch', 91, 10 FROM m WHERE dispatches >= 40 AND planning = 0 AND turns >= 500
            UNION ALL SELECT profile, 'tax', 'longhaul', 'endurance', 86, 11 FROM m WHERE max_turns >= 800 AND avg_min >= 180
            UNION ALL SELECT profile, 'tax', 'verify', 'reread', 80, 12 FROM m WHERE reread >= 40 AND r2e >= 3
        )
    ),
    report AS (
        SELECT profile, side, key, family, priority FROM (
            SELECT *, row_number() OVER (PARTITION BY profile, side ORDER BY priority DESC, rule) AS place FROM (
                SELECT *, row_number() OVER (PARTITION BY profile, family ORDER BY priority DESC, rule) AS one FROM et
            ) WHERE one = 1
        ) WHERE place <= CASE WHEN side = 'edge' THEN 4 ELSE 3 END
    )
"""
_M = f"{_COUNTS}, {RULES_SQL}"
_OWNS = ", ".join(f"('{a}', '{f}')" for a, fs in rules.OWNS.items() for f in fs)
_MOVES = ", ".join(f"('{k}', '{b}')" for k, b in rules.MOVES.items())
CARDS_SQL = f"""owns(name, family) AS (VALUES {_OWNS}),
        k AS (SELECT c.profile, c.metric, c.family, c.score, c.rule, row_number() OVER (PARTITION BY c.profile, c.metric ORDER BY c.score DESC, c.rule) AS one FROM cards c
              WHERE c.family NOT IN ('scale', 'stack') AND NOT EXISTS (SELECT 1 FROM arch a JOIN owns o ON a.name = o.name WHERE a.profile = c.profile AND o.family = c.family)),
        cat(metric, what) AS (VALUES ('model_mix', 'taste'), ('pounce', 'reflex'), ('reversals', 'psyche'), ('read_edit', 'instinct'), ('todo', 'style'), ('dispatch', 'automation'), ('corrections', 'psyche'),
              ('weekend', 'devotion'), ('bash', 'instinct'), ('browser', 'operator'), ('hours', 'tempo'), ('max_turns', 'endurance'), ('reread', 'discipline'), ('cache', 'scale'), ('mcp', 'stack')),
        r AS (SELECT profile, 0 AS tier, name AS what, 'archetype' AS family, score::DOUBLE AS score, 0 AS rule FROM arch
              UNION ALL SELECT k.profile, 1, CASE WHEN k.rule = 6 THEN 'craft' WHEN k.rule = 8 THEN 'precision' ELSE cat.what END, k.family, k.score::DOUBLE, k.rule FROM k LEFT JOIN cat ON k.metric = cat.metric WHERE one = 1)
        SELECT profile, place AS at, what, family, score FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY tier, score DESC, rule) AS place FROM r) WHERE place <= 10"""
REPORTS_SQL = """n AS (SELECT profile, count(*) FILTER (WHERE side = 'edge') AS e, count(*) FILTER (WHERE side = 'tax') AS t FROM report GROUP BY profile)
        SELECT m.profile, CASE WHEN NOT (a.name = 'The Night Builder' AND m.night <= 200) AND NOT (m.turns < 50 AND m.sessions < 2) THEN a.name END AS archetype, CAST(coalesce(e, 0) AS INTEGER) AS n_edges,
               CAST(coalesce(t, 0) AS INTEGER) AS n_taxes, CAST(coalesce(t, 0) AS INTEGER) AS n_moves
        FROM m LEFT JOIN arch a ON m.profile = a.profile LEFT JOIN n ON m.profile = n.profile"""
EDGES_SQL = "SELECT profile, side, key, family, priority::BIGINT AS priority FROM report"

QUERIES = {f.__name__: f for f in (archetype_fit, insight_cards, insight_cards_ranked, report_edges_taxes, report_moves, reports, nudges_ranked)}

ORACLES = {
    "archetype_fit": f"{_M} SELECT profile, name, score::DOUBLE AS score FROM arch",
    "insight_cards": f"{_M} SELECT profile, metric, family, score::BIGINT AS score, round(value::DOUBLE, 2) AS value FROM cards",
    "insight_cards_ranked": f"{_M}, {CARDS_SQL}",
    "nudges_ranked": f"""WITH h AS ({MINED["high_lift_moves"]}), s AS ({MINED["signature_chain"]}), p AS ({MINED["post_trigger_rocky"]}), g AS ({MINED["significance_gate"]}),
        made AS (
            SELECT 'determined' AS family, printf('After %s comes %s in %.0f %% of %d cases, %.2f times its usual share.', context, next, pct, total, lift) AS body FROM (SELECT * FROM h ORDER BY rank_score DESC, context LIMIT 1)
            UNION ALL SELECT 'signature', printf('The chain %s recurs %d times, %.1f times as often as its parts suggest.', chain, n, lift) FROM s WHERE "at" = 1
            UNION ALL SELECT 'trans_' || g.trigger, printf('After %s, %s comes next in %.0f %% of cases (%d).', g.trigger, usual, p.pct, p.n)
                || CASE WHEN better IS NOT NULL THEN printf(' Where %s came instead (%d cases), trouble followed in %.0f %%: beyond the noise, yet no proof.', better, b.rocky_n, b.rocky_pct) ELSE ' No other move does better beyond the noise.' END
            FROM g JOIN p ON p.trigger = g.trigger AND p.next_tool = usual LEFT JOIN p b ON b.trigger = g.trigger AND b.next_tool = better WHERE g.trigger <> 'reversal'
        ),
        ranked(family, priority) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in nudges.PRIORITY.items())})
        SELECT row_number() OVER (ORDER BY priority DESC, family) AS "at", family, priority, body FROM made JOIN ranked USING (family) WHERE regexp_matches(body, '[0-9]')""",
    "report_edges_taxes": f"{_M} {EDGES_SQL}",
    "reports": f"{_M}, {REPORTS_SQL}",
    "report_moves": f"{_M}, mv(key, body) AS (VALUES {_MOVES}) SELECT r.profile, r.key, mv.body FROM report r JOIN mv ON r.key = mv.key WHERE r.side = 'tax'",
}
