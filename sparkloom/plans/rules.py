"""Declarative rules over rows of metrics: cards, archetypes, edges and taxes, nudges.

A rule is a condition with what it yields. All rules of a set become one array of structs, of which the rows that hold are
exploded: one pass over the metrics whatever the number of rules. ``profile`` identifies a row of metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# The families that an archetype already tells of, and those that never show.
OWNS = {
    "The Pouncer": ("corrections", "reversals", "latency", "read_edit"),
    "The Director": ("dispatch", "model", "stack"),
    "The Bulldozer": ("model", "read_edit", "todo"),
    "The Night Builder": ("tempo",),
    "The Terminal Native": ("bash",),
    "The Puppeteer": ("browser",),
    "The Surgeon": ("churn", "read_edit"),
    "The Marathoner": ("endurance",),
}
COMMODITY = ("scale", "stack")
MAX_EDGES, MAX_TAXES, MAX_NUDGES = 4, 3, 5
TRACKERS = ("TaskCreate", "TaskUpdate", "TaskList")


def _at(column: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(key)), F.lit(0))


def _sum(column: str, keys) -> Column:
    total = F.lit(0).cast("long")
    for k in keys:
        total = total + _at(column, str(k))
    return total


def signals(metrics: DataFrame) -> DataFrame:
    """``metrics`` with the derived signals that rules refer to; absent maps count as empty."""
    values = F.coalesce(F.aggregate(F.map_values("weekday_histogram"), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    browser = F.aggregate(
        F.map_entries(F.coalesce("top_mcp_servers", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"),
        lambda s, e: s + F.when(F.lower(e["key"]).rlike("chrome|browser|playwright"), e["value"]).otherwise(0),
    )
    files = F.greatest(F.col("distinct_files_edited"), F.lit(1))
    some = F.col("distinct_files_edited") > 0
    share = _sum("weekday_histogram", (5, 6)) * 100.0 / F.greatest(values, F.lit(1))
    return metrics.select(
        "*", _sum("hour_histogram", range(6, 13)).alias("morning"), _sum("hour_histogram", range(2, 5)).alias("night"), browser.alias("browser"),
        (F.col("workflow_calls") + F.col("agent_calls")).alias("dispatches"), (F.col("todo_calls") + _sum("top_tools", TRACKERS)).alias("planning"),
        _at("top_tools", "Bash").alias("bash_top"), _sum("models", ("haiku", "sonnet")).alias("smaller"), share.alias("weekend_pct"),
        F.when(some, F.round(F.col("edit") / files, 1)).otherwise(0.0).alias("edits_per_file"),
        F.when(some, F.round((F.col("edit") + F.col("write")) / files, 1)).otherwise(0.0).alias("touches_per_file"), _at("tokens", "cache_read").alias("cache_read"),
    )


def _fired(rows: DataFrame, rules: list[tuple], fields: tuple[str, ...]) -> DataFrame:
    def column(x) -> Column:
        return x if isinstance(x, Column) else F.array(*[F.lit(v) for v in x]) if isinstance(x, tuple) else F.lit(x)

    built = [F.struct(F.coalesce(when, F.lit(False)).alias("holds"), F.lit(k).alias("rule"), *[column(v).alias(n) for n, v in zip(fields, values, strict=True)]) for k, (when, *values) in enumerate(rules)]
    out = rows.select("profile", F.explode(F.array(*built)).alias("r")).where("r.holds")
    return out.select("profile", "r.rule", *[f"r.{n}" for n in fields])


def cards(metrics: DataFrame) -> DataFrame:
    """(profile, rule, category, metric, family, score, value) of every card whose condition holds."""
    c = F.col
    bash_share = c("bash_top") / F.greatest(c("tool_calls"), F.lit(1))
    rules = [
        (c("opus_pct") >= 95, "taste", "model_mix", "model", 95, c("opus_pct")),
        ((c("pounce_median_sec") <= 20) & (c("corrections_caught") >= 15), "reflex", "pounce", "latency", 94, c("pounce_median_sec")),
        ((c("reversal_rate_per_100") >= 4) & (c("reversal_count") >= 10), "psyche", "reversals", "reversals", 93, c("reversal_rate_per_100")),
        (c("read_to_edit_ratio") < 1.2, "instinct", "read_edit", "read_edit", 92, c("read_to_edit_ratio")),
        ((c("planning") == 0) & (c("assistant_turns") > 500), "style", "todo", "todo", 90, c("planning")),
        (c("dispatches") >= 40, "automation", "dispatch", "dispatch", 86, c("dispatches")),
        ((c("most_churned_file_edits") >= 25) & (c("distinct_files_edited") >= 30), "craft", "edits_per_file", "churn", 84, c("most_churned_file_edits")),
        (c("corrections_caught") >= 20, "psyche", "corrections", "corrections", 83, c("corrections_caught")),
        ((c("distinct_files_edited") >= 40) & (c("edits_per_file") > 0) & (c("edits_per_file") <= 2) & (c("reread_pct") < 20), "precision", "edits_per_file", "churn", 82, c("edits_per_file")),
        (c("weekend_pct") >= 35, "devotion", "weekend", "weekend", 80, F.round("weekend_pct", 0)),
        (bash_share >= 0.25, "instinct", "bash", "bash", 79, F.round(100 * bash_share, 0)),
        (c("browser") >= 100, "operator", "browser", "browser", 78, c("browser")),
        ((c("morning") == 0) & (c("night") > 200), "tempo", "hours", "tempo", 74, c("night")),
        (c("max_turns_in_session") >= 500, "endurance", "max_turns", "endurance", 68, c("max_turns_in_session")),
        (c("reread_pct") >= 25, "discipline", "reread", "reread", 66, c("reread_pct")),
        (c("cache_read") > 100_000_000, "scale", "cache", "scale", 60, c("cache_read")),
        (c("mcp_servers_used") >= 12, "stack", "mcp", "stack", 58, c("mcp_servers_used")),
    ]
    rules = [(*r[:-1], r[-1].cast("double")) for r in rules]
    return _fired(signals(metrics), rules, ("category", "metric", "family", "score", "value"))


def archetypes(metrics: DataFrame) -> DataFrame:
    """(profile, name, score) of every archetype that fits; score is weight times how far the rates clear their bars."""
    c = F.col
    calls, prompts = F.greatest(c("tool_calls"), F.lit(1)), F.coalesce(F.nullif(c("real_user_prompts"), F.lit(0)), F.greatest(c("assistant_turns"), F.lit(1)))
    corrections, dispatch, browse = 100.0 * c("corrections_caught") / prompts, 100.0 * c("dispatches") / calls, 100.0 * c("browser") / calls
    epf = F.when(c("distinct_files_edited") > 0, c("edits_per_file")).otherwise(9.0)
    enough_calls = calls >= 300
    rules = [
        ((prompts >= 50) & (corrections >= 8) & (c("reversal_rate_per_100") >= 4), "The Pouncer", 95, corrections / 8),
        (enough_calls & (dispatch >= 2), "The Director", 88, dispatch / 2),
        ((c("opus_pct") >= 98) & (c("read_to_edit_ratio") < 1) & (c("todo_calls") == 0), "The Bulldozer", 84, F.lit(1.0)),
        ((c("distinct_files_edited") >= 15) & (epf <= 2) & (c("reread_pct") < 20), "The Surgeon", 82, F.lit(1.0)),
        ((c("max_turns_in_session") >= 800) & (c("avg_session_min") >= 120), "The Marathoner", 76, F.lit(1.0)),
        (c("morning") == 0, "The Night Builder", 80, F.lit(1.0)),
        (F.round(100.0 * c("bash_top") / calls, 0) >= 30, "The Terminal Native", 74, F.lit(1.0)),
        (enough_calls & (browse >= 5), "The Puppeteer", 72, browse / 5),
    ]
    rules = [(when, name, F.round(weight * F.least(fit.cast("double"), F.lit(1.6)), 2)) for when, name, weight, fit in rules]
    return _fired(signals(metrics), rules, ("name", "score"))


def archetype(metrics: DataFrame) -> DataFrame:
    """(profile, name, score): the best fit, the first declared of equals."""
    at = F.row_number().over(W.partitionBy("profile").orderBy(F.desc("score"), "rule"))
    return archetypes(metrics).withColumn("_at", at).where("_at = 1").select("profile", "name", "score")


def visible_cards(metrics: DataFrame, top: int = 10) -> DataFrame:
    """Archetype first, then cards by score: none that the archetype tells, no commodity, one for each metric."""
    best = archetype(metrics)
    owned = metrics.sparkSession.createDataFrame([(a, f) for a, fs in OWNS.items() for f in fs], "name string, family string")
    owned = best.join(F.broadcast(owned), "name").select("profile", "family")
    kept = cards(metrics).where(~F.col("family").isin(*COMMODITY)).join(owned, ["profile", "family"], "left_anti")
    one = F.row_number().over(W.partitionBy("profile", "metric").orderBy(F.desc("score"), "rule"))
    kept = kept.withColumn("_one", one).where("_one = 1").select("profile", F.lit(1).alias("tier"), F.col("category").alias("what"), "family", F.col("score").cast("double").alias("score"), "rule")
    head = best.select("profile", F.lit(0).alias("tier"), F.col("name").alias("what"), F.lit("archetype").alias("family"), "score", F.lit(0).alias("rule"))
    at = F.row_number().over(W.partitionBy("profile").orderBy("tier", F.desc("score"), "rule"))
    return head.unionByName(kept).withColumn("at", at).where(F.col("at") <= top).select("profile", F.col("at").cast("long").alias("at"), "what", "family", "score")


def edges_and_taxes(metrics: DataFrame) -> DataFrame:
    """(profile, side, key, family, priority, cites): one for each family over both sides, 4 edges and 3 taxes at most."""
    c = F.col
    bash = F.coalesce(F.nullif(c("bash"), F.lit(0)), c("bash_top"))
    share = bash / F.greatest(c("tool_calls"), F.lit(1))
    epf, small = c("touches_per_file"), F.greatest(F.lit(20.0), F.round(c("assistant_turns") * 0.01, 0))

    def cites(*xs: Column) -> Column:
        return F.array(*[x.cast("double") for x in xs])

    e, t = "edge", "tax"
    rules = [
        ((c("pounce_median_sec") <= 12) & (c("corrections_caught") >= 15), e, "reflex", "reflex", 95, cites(c("pounce_median_sec"), c("corrections_caught"))),
        (c("dispatches") >= 40, e, "dispatch", "dispatch", 90, cites(c("dispatches"))),
        (c("max_turns_in_session") >= 300, e, "endurance", "endurance", 85, cites(c("max_turns_in_session"))),
        (share >= 0.3, e, "bash", "bash", 80, cites(share)),
        ((c("distinct_files_edited") >= 40) & (epf > 0) & (epf <= 2) & (c("reread_pct") < 20), e, "churn", "churn", 79, cites(c("distinct_files_edited"), epf)),
        (c("reread_pct") >= 25, e, "reread", "reread", 78, cites(c("reread_pct"))),
        (c("planning") >= 15, e, "planning", "planning", 76, cites(c("planning"))),
        ((c("read_to_edit_ratio") < 1) & (c("corrections_caught") >= 20), t, "steer", "planning", 90, cites(c("read_to_edit_ratio"), c("corrections_caught"))),
        ((c("opus_pct") >= 98) & (c("smaller") <= small), t, "onegear", "model", 85, cites(c("smaller"))),
        ((c("most_churned_file_edits") >= 40) & (c("distinct_files_edited") >= 20) & (c("most_churned_file_edits") >= 3 * epf), t, "churn", "churn", 72, cites(c("most_churned_file_edits"), c("distinct_files_edited"), epf)),
        ((c("dispatches") >= 40) & (c("planning") == 0) & (c("assistant_turns") >= 500), t, "handoff", "dispatch", 91, cites(c("dispatches"), c("assistant_turns"), c("planning"))),
        ((c("max_turns_in_session") >= 800) & (c("avg_session_min") >= 180), t, "longhaul", "endurance", 86, cites(c("max_turns_in_session"), F.round(c("avg_session_min") / 60, 1))),
        ((c("reread_pct") >= 40) & (c("read_to_edit_ratio") >= 3), t, "verify", "reread", 80, cites(c("reread_pct"), c("read_to_edit_ratio"))),
    ]
    fired = _fired(signals(metrics), rules, ("side", "key", "family", "priority", "cites"))
    one = F.row_number().over(W.partitionBy("profile", "family").orderBy(F.desc("priority"), "rule"))
    kept = fired.withColumn("_one", one).where("_one = 1")
    at = F.row_number().over(W.partitionBy("profile", "side").orderBy(F.desc("priority"), "rule"))
    first = kept.withColumn("_at", at).where(F.col("_at") <= F.when(F.col("side") == "edge", MAX_EDGES).otherwise(MAX_TAXES))
    return first.where(T.personalised(F.col("cites"))).select("profile", "side", "key", "family", "priority", "cites")


#: What to try against each tax, in our own words.
MOVES = {
    "steer": "State goal and finish line in one sentence before handing over.",
    "onegear": "Give one routine task a week to a smaller model and compare.",
    "churn": "Sketch the shape of the most edited file before the next change.",
    "handoff": "Write the steps down once before dispatching them.",
    "longhaul": "End a session at a natural break and restart with a summary.",
    "verify": "Note what a file told you, so that it need not be read again.",
}


def moves(report: DataFrame) -> DataFrame:
    """(profile, key, body) for every tax that is still in the report."""
    known = report.sparkSession.createDataFrame(list(MOVES.items()), "key string, body string")
    return F.broadcast(known).join(report.where("side = 'tax'").select("profile", "key"), "key").select("profile", "key", "body")


def guarded_archetype(metrics: DataFrame) -> DataFrame:
    """The archetype, unless the data are thin or the night was not really worked through."""
    rows = archetype(metrics).join(signals(metrics).select("profile", "assistant_turns", "sessions", "night"), "profile")
    thin = (F.col("assistant_turns") < 50) & (F.col("sessions") < 2)
    hollow = (F.col("name") == "The Night Builder") & (F.col("night") <= 200)
    return rows.where(~thin & ~hollow).select("profile", "name", "score")


def report(metrics: DataFrame) -> DataFrame:
    """One row for each profile: archetype, edges, taxes, moves, sessions."""
    found = edges_and_taxes(metrics)
    body = F.struct("priority", "key", "family", "cites")
    sides = found.groupBy("profile").agg(F.sort_array(F.collect_list(F.when(F.col("side") == "edge", body)), False).alias("edges"), F.sort_array(F.collect_list(F.when(F.col("side") == "tax", body)), False).alias("taxes"))
    acts = moves(found).groupBy("profile").agg(F.sort_array(F.collect_list(F.struct("key", "body"))).alias("moves"))
    head = guarded_archetype(metrics).select("profile", F.struct("name", "score").alias("archetype"))
    return metrics.select("profile", "sessions").join(head, "profile", "left").join(sides, "profile", "left").join(acts, "profile", "left")


def select_nudges(nudges: DataFrame) -> DataFrame:
    """``nudges(family, priority, body)`` -> the five to show: one for each family, with a number; novelty last, if any."""
    one = F.row_number().over(W.partitionBy("family").orderBy(F.desc("priority"), "body"))
    kept = nudges.where(T.has_number(F.col("body"))).withColumn("_one", one).where("_one = 1")
    last = F.col("family") == "novelty"
    kept = kept.withColumn("_slots", MAX_NUDGES - F.max(last.cast("int")).over(W.partitionBy()))
    at = F.row_number().over(W.partitionBy(last).orderBy(F.desc("priority"), "family"))
    kept = kept.withColumn("_at", at).where(last | (F.col("_at") <= F.col("_slots")))
    place = F.row_number().over(W.orderBy(last, F.desc("priority"), "family"))
    return kept.select(place.cast("long").alias("at"), "family", "priority", "body")


def teaser(report: DataFrame) -> DataFrame:
    """(profile, teaser): a line on the archetype and the first edge, or that there is not enough yet."""
    head = F.when(F.col("archetype").isNotNull(), F.col("archetype.name"))
    first = F.try_element_at("edges", F.lit(1))["key"]
    nothing = head.isNull() & first.isNull()
    line = F.when(nothing, "Not enough yet.").otherwise(F.concat_ws(": ", head, F.concat(F.lit("edge in "), first)))
    untaxed = F.when(~nothing & (F.coalesce(F.size("taxes"), F.lit(0)) <= 0), " No tax stands out.").otherwise("")
    return report.select("profile", F.concat(line, untaxed).alias("teaser"))
