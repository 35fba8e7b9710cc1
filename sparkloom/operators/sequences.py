"""Sequence mining over ordered events ``(session, seq, kind, name)``: kind is tool, error, correction or reversal.

Everything is window functions partitioned by session and small aggregates of their results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats, text

# The miner's thresholds, and the tools that hand over a whole task.
MIN_CHAIN, MIN_TRIGGER, MIN_CTX, MIN_ALT, WINDOW, MIN_LIFT = 8, 8, 12, 15, 5, 1.4
DISPATCH = ("Workflow", "Agent", "Task")
PLAN = ("TodoWrite", "TaskCreate", "TaskUpdate", "TaskList")


def tools(events: DataFrame) -> DataFrame:
    """(session, pos, name): tool events in order, numbered from 1."""
    at = F.row_number().over(W.partitionBy("session").orderBy("seq"))
    return events.where("kind = 'tool'").select("session", "seq", "name", at.alias("pos"))


def session_stats(events: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    grouped = events.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_events"), n("tool").alias("n_tools"), n("correction").alias("n_corrections"), n("error").alias("n_errors"),
        F.count_distinct(F.when(F.col("kind") == "tool", F.col("name"))).alias("n_distinct"),
    )
    rate = F.when(F.col("n_tools") > 0, F.round(100.0 * F.col("n_corrections") / F.col("n_tools"), 1)).otherwise(0.0)
    return grouped.withColumn("correction_rate", rate)


def base_freq(events: DataFrame) -> DataFrame:
    """(name, n, share) over all sessions."""
    n = tools(events).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def markov(events: DataFrame, order: int) -> DataFrame:
    """(context array, next, n) for contexts of ``order`` tools within a session."""
    w = W.partitionBy("session").orderBy("pos")
    prior = F.array(*[F.lag("name", k).over(w) for k in range(order, 0, -1)])
    rows = tools(events).select("pos", F.col("name").alias("next"), prior.alias("context")).where(F.col("pos") > order)
    return rows.groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))


def high_lift(events: DataFrame, min_ctx: int = MIN_CTX, min_lift: float = MIN_LIFT, above_base: bool = True) -> DataFrame:
    """Contexts whose most likely next tool is likelier than at large by ``min_lift``, best first."""
    model = markov(events, 1).unionByName(markov(events, 2))
    total = F.sum("n").over(W.partitionBy("context"))
    modal = F.row_number().over(W.partitionBy("context").orderBy(F.desc("n"), "next"))
    best = model.withColumn("total", total).withColumn("_m", modal).where(F.col("_m") == 1).where(F.col("total") >= min_ctx)
    base = base_freq(events).select(F.col("name").alias("next"), "share")
    lift = F.col("n") / F.col("total") / F.col("share")
    low, _ = stats.wilson(F.col("n"), F.col("total"))
    out = best.join(base, "next").withColumn("raw", lift).withColumn("low", low).where(F.col("raw") >= min_lift)
    if above_base:
        out = out.where(F.col("low") > 100 * F.col("share"))
    pct = F.round(100.0 * F.col("n") / F.col("total"), 0)
    rank = F.round("raw", 1) * pct * F.log(F.col("total").cast("double"))
    return out.select(F.array_join("context", ">").alias("context"), "next", "n", "total", pct.alias("pct"), F.round("raw", 2).alias("lift"), F.round(rank, 3).alias("rank_score"))


def signature(events: DataFrame, min_chain: int = MIN_CHAIN, top: int = 1) -> DataFrame:
    """Chains of three tools that recur more than independence would have them, other than of the two most used tools."""
    w = W.partitionBy("session").orderBy("pos")
    chain = tools(events).select(F.array("name", F.lead("name", 1).over(w), F.lead("name", 2).over(w)).alias("chain"), F.lead("pos", 2).over(w).alias("_end")).where("_end is not null")
    base = base_freq(events)
    common = base.orderBy(F.desc("n"), "name").limit(2).agg(F.collect_list("name").alias("common"))
    counted = chain.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).where(F.col("n") >= min_chain).where(F.size(F.array_distinct("chain")) >= 2)
    share = share.crossJoin(F.broadcast(common)).where(F.size(F.array_except("chain", "common")) > 0)
    for k in (1, 2, 3):
        share = share.withColumn(f"_t{k}", F.col("chain")[k - 1]).join(base.select(F.col("name").alias(f"_t{k}"), F.col("share").alias(f"_p{k}")), f"_t{k}")
    lift = F.col("share") / (F.col("_p1") * F.col("_p2") * F.col("_p3"))
    out = share.select(F.array_join("chain", ">").alias("chain"), "n", lift.alias("raw"))
    at = F.row_number().over(W.orderBy(F.desc("raw"), F.desc("n"), "chain"))
    return out.orderBy(F.desc("raw"), F.desc("n"), "chain").limit(top).withColumn("at", at).select("chain", "n", F.round("raw", 3).alias("lift"), F.col("at").cast("long").alias("at"))


def triggers(events: DataFrame) -> DataFrame:
    """Events with their triggers: errors, corrections, reversals, and dispatches among tools."""
    dispatch = (F.col("kind") == "tool") & F.col("name").isin(*DISPATCH)
    return events.withColumn("trigger", F.when(F.col("kind") != "tool", F.col("kind")).when(dispatch, "dispatch"))


def after_trigger(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of every trigger: the next tool, and whether a correction, reversal or error came before ``window`` tools after it.

    ``rocky`` is null where the session ends first. Running windows in reverse order, one step a row, find what follows.
    """
    before = W.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    tool = F.col("kind") == "tool"
    steer = F.col("kind").isin("correction", "reversal", "error")
    marked = triggers(events).withColumn("_tool", tool).withColumn("_steer", F.last(F.when(steer, F.col("seq")), True).over(before))
    marked = marked.withColumn("_end", F.lead("seq", window).over(W.partitionBy("session", "_tool").orderBy("seq")))
    marked = marked.withColumn("_next", F.last(F.when(tool, F.struct("name", "_steer", "_end")), True).over(before))
    rows = marked.where(F.col("trigger").isNotNull() & F.col("_next").isNotNull())
    steer_at, end = F.col("_next._steer"), F.col("_next._end")
    rocky = F.when(steer_at.isNotNull() & (end.isNull() | (steer_at < end)), True).when(end.isNotNull(), False)
    return rows.select("session", "seq", "trigger", F.col("_next.name").alias("next_tool"), rocky.alias("rocky"))


def post_trigger(events: DataFrame, window: int = WINDOW, min_trigger: int = MIN_TRIGGER) -> DataFrame:
    """(trigger, next_tool, n, pct, rocky_n, rocky_hits, rocky_pct, ci_low, ci_high); rocky_n counts full windows."""
    grouped = after_trigger(events, window).groupBy("trigger", "next_tool").agg(F.count(F.lit(1)).alias("n"), F.count("rocky").alias("rocky_n"), F.count_if("rocky").alias("rocky_hits"))
    total = F.sum("n").over(W.partitionBy("trigger"))
    low, high = stats.wilson(F.col("rocky_hits"), F.col("rocky_n"))
    some = F.col("rocky_n") > 0
    out = grouped.withColumn("_total", total).where(F.col("_total") >= min_trigger)
    return out.select(
        "trigger", "next_tool", "n", stats.percent(F.col("n"), F.col("_total"), 0).alias("pct"), "rocky_n", "rocky_hits",
        F.when(some, stats.percent(F.col("rocky_hits"), F.col("rocky_n"), 0)).alias("rocky_pct"), F.when(some, low).alias("ci_low"), F.when(some, high).alias("ci_high"),
    )


def significance(post: DataFrame, min_alt: int = MIN_ALT) -> DataFrame:
    """Of each trigger its most frequent move, and the first other whose rocky interval lies wholly below."""
    at = F.row_number().over(W.partitionBy("trigger").orderBy(F.desc("n"), "next_tool"))
    ranked = post.withColumn("_at", at)
    top = ranked.where("_at = 1").select("trigger", F.col("next_tool").alias("usual"), F.col("ci_low").alias("usual_low"))
    alt = ranked.where(F.col("_at") > 1).where(F.col("n") >= min_alt).select("trigger", "_at", F.col("next_tool").alias("better"), F.col("ci_high").alias("better_high"))
    clear = alt.join(top.select("trigger", "usual_low"), "trigger").where("better_high < usual_low").groupBy("trigger").agg(F.min_by("better", "_at").alias("better"))
    return top.join(clear, "trigger", "left").select("trigger", "usual", "better")


def shape(events: DataFrame, early_tools: tuple[str, ...], min_sessions: int = 6, min_side: int = 3) -> DataFrame:
    """Mean correction rate of sessions with and without one of ``early_tools`` in their first fifth."""
    w = W.partitionBy("session")
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy("seq"))
    early = (F.col("_at") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 5))) & (F.col("kind") == "tool") & F.col("name").isin(*early_tools)
    has = events.withColumn("_n", n).withColumn("_at", at).groupBy("session").agg(F.max(early).alias("has"))
    rates = session_stats(events).join(has, "session")
    with_, without = F.col("has"), ~F.col("has")
    out = rates.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(with_).alias("n_with"), F.count_if(without).alias("n_without"),
        F.round(F.avg(F.when(with_, F.col("correction_rate"))), 3).alias("rate_with"), F.round(F.avg(F.when(without, F.col("correction_rate"))), 3).alias("rate_without"),
    )
    return out.where((F.col("sessions") >= min_sessions) & (F.col("n_with") >= min_side) & (F.col("n_without") >= min_side))


def novelty(events: DataFrame, min_sessions: int = 8, min_used: int = 3) -> DataFrame:
    """Tools of some sessions only that go with lower correction rates, even without the session that favours them most.

    Rates have one digit: they are added up as whole tenths, and each difference is a quotient of whole numbers, so that its
    rounding doesn't depend on the order of sessions.
    """
    rates = session_stats(events).select("session", F.round(F.col("correction_rate") * 10).cast("long").alias("tenths"))
    totals = rates.agg(F.count(F.lit(1)).alias("m"), F.sum("tenths").alias("all_sum"))
    used = tools(events).select("session", "name").distinct().where(~text.is_probe(F.col("name")))
    per = used.join(rates, "session").groupBy("name").agg(F.count(F.lit(1)).alias("used_in"), F.sum("tenths").alias("s"), F.min("tenths").alias("low"))
    both = per.crossJoin(F.broadcast(totals)).where((F.col("m") >= min_sessions) & F.col("used_in").between(F.lit(min_used), F.greatest(F.lit(min_used), F.floor(F.col("m") / 4))))
    others = F.greatest(F.col("m") - F.col("used_in"), F.lit(1))
    apart = lambda s, n: ((F.col("all_sum") - F.col("s")) * n - s * others) / (10 * others * n)
    delta = apart(F.col("s"), F.col("used_in"))
    loo = F.when(F.col("used_in") > 3, apart(F.col("s") - F.col("low"), F.col("used_in") - 1)).otherwise(delta)
    return both.select("name", "used_in", F.round(delta, 4).alias("delta"), F.round(loo, 4).alias("delta_loo")).where("delta > 0 and delta_loo > 0")


def predict_next(events: DataFrame, context: list[str], top: int = 5, min_total: int = MIN_TRIGGER) -> DataFrame:
    """The likeliest next tools after ``context``, by the longest of its suffixes that recurs often enough."""
    orders = [markov(events, k).where(F.col("context") == F.array(*[F.lit(x) for x in context[-k:]])).withColumn("k", F.lit(k)) for k in (2, 1) if len(context) >= k]
    if not orders:
        return base_freq(events).limit(0).select(F.col("name").alias("next"), "n")
    seen = orders[0] if len(orders) == 1 else orders[0].unionByName(orders[1])
    seen = seen.withColumn("total", F.sum("n").over(W.partitionBy("k"))).where(F.col("total") >= min_total)
    seen = seen.withColumn("_best", F.max("k").over(W.partitionBy())).where("k = _best")
    base = base_freq(events).select(F.col("name").alias("next"), "share")
    pct = F.col("n") / F.col("total")
    out = seen.join(base, "next").select("next", "n", "total", F.round(100 * pct, 0).alias("pct"), F.round(pct / F.col("share"), 2).alias("lift"))
    return out.orderBy(F.desc("n"), "next").limit(top)


def suffixes(events: DataFrame, order: int = 2, top: int = 5, min_total: int = MIN_TRIGGER) -> DataFrame:
    """The back-off table: (context, total, options) for every context of up to ``order`` tools met ``min_total`` times.

    ``options`` are its ``top`` likeliest next tools, in order, each with n, pct and lift over the tool's usual share. The table
    is what a live predictor keeps: write it once, and join whatever contexts come.
    """
    model = markov(events, 1)
    for k in range(2, order + 1):
        model = model.unionByName(markov(events, k))
    base = base_freq(events).select(F.col("name").alias("next"), "share")
    w = W.partitionBy("context")
    counted = model.withColumn("total", F.sum("n").over(w)).withColumn("at", F.row_number().over(w.orderBy(F.desc("n"), "next")))
    kept = counted.where((F.col("total") >= min_total) & (F.col("at") <= top)).join(base, "next")
    pct = F.col("n") / F.col("total")
    option = F.struct(F.col("at").cast("long").alias("at"), "next", "n", F.round(100 * pct, 0).alias("pct"), F.round(pct / F.col("share"), 2).alias("lift"))
    return kept.groupBy("context").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(option)).alias("options"))


def last_contexts(events: DataFrame, order: int = 2) -> DataFrame:
    """(session, context): the last ``order`` tools of each session in their order, or fewer where it has fewer."""
    w = W.partitionBy("session").orderBy("pos")
    tail = F.filter(F.array(*[F.lag("name", k).over(w) for k in range(order - 1, 0, -1)], "name"), lambda x: x.isNotNull())
    return tools(events).select("session", "pos", tail.alias("context")).groupBy("session").agg(F.max_by("context", "pos").alias("context"))


def predict_all(table: DataFrame, contexts: DataFrame, order: int = 2) -> DataFrame:
    """``contexts`` (with an array ``context``) and what follows by the longest suffix in ``table``: matched, total, at, next, n, pct, lift.

    Contexts without a suffix in the table have no rows. Each different context is looked up once.
    """
    asked = contexts.select("context").where("size(context) > 0").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.size("context"))), lambda k: F.slice("context", -k, k))
    tried = asked.select("context", F.explode(cut).alias("suffix"))
    found = tried.join(table.select(F.col("context").alias("suffix"), "total", "options"), "suffix")
    best = found.groupBy("context").agg(F.max_by(F.struct("suffix", "total", "options"), F.size("suffix")).alias("b"))
    rows = best.select("context", F.size("b.suffix").cast("long").alias("matched"), F.col("b.total").alias("total"), F.inline("b.options"))
    return contexts.join(rows, "context")
