"""Nudges from mined sequences: what a log's owner may try, each with its numbers and its confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import sequences as Q
from . import rules

# Priority of each family; transitions in order of their triggers. Reversals are mined, not shown.
PRIORITY = {"determined": 90, "signature": 88, "trans_error": 80, "trans_correction": 79, "trans_dispatch": 77, "shape": 72, "novelty": 50}
MIN_SHAPE_DELTA = 2


def _row(family: Column | str, body: Column, n: Column) -> list[Column]:
    family = F.lit(family) if isinstance(family, str) else family
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), family)
    return [family.alias("family"), priority.alias("priority"), body.alias("body"), stats.confidence(n).alias("confidence")]


def build(events: DataFrame, min_lift: float = Q.MIN_LIFT, above_base: bool = True, early: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(family, priority, body, confidence) of everything that ``events`` gives rise to."""
    early = early or {"a plan": Q.PLAN, "a dispatch": Q.DISPATCH}
    lifted = Q.high_lift(events, min_lift=min_lift, above_base=above_base).orderBy(F.desc("rank_score"), "context").limit(1)
    parts = [lifted.select(*_row("determined", F.format_string("After %s comes %s in %.0f %% of %d cases, %.2f times its usual share.", "context", "next", "pct", "total", "lift"), F.col("total")))]
    chain = Q.signature(events)
    parts.append(chain.select(*_row("signature", F.format_string("The chain %s recurs %d times, %.1f times as often as its parts suggest.", "chain", "n", "lift"), F.col("n"))))
    post = Q.post_trigger(events)
    clear = Q.significance(post)
    usual = clear.join(post.select("trigger", F.col("next_tool").alias("usual"), "pct", "n"), ["trigger", "usual"])
    better = post.select("trigger", F.col("next_tool").alias("better"), F.col("rocky_pct").alias("better_rocky"), F.col("rocky_n").alias("better_n"))
    moved = usual.where("trigger <> 'reversal'").join(better, ["trigger", "better"], "left")
    tail = F.when(F.col("better").isNotNull(), F.format_string(" Where %s came instead (%d cases), trouble followed in %.0f %%: beyond the noise, yet no proof.", "better", "better_n", "better_rocky")).otherwise(" No other move does better beyond the noise.")
    body = F.concat(F.format_string("After %s, %s comes next in %.0f %% of cases (%d).", "trigger", "usual", "pct", "n"), tail)
    parts.append(moved.select(*_row(F.concat(F.lit("trans_"), "trigger"), body, F.coalesce("better_n", "n"))))
    for label, names in early.items():
        shape = Q.shape(events, names).withColumn("delta", F.round("rate_without", 1) - F.round("rate_with", 1)).where(F.abs("delta") >= MIN_SHAPE_DELTA)
        said = F.format_string(f"Sessions that open with {label} have %.1f corrections in 100 calls (%d sessions), others %.1f (%d).", "rate_with", "n_with", "rate_without", "n_without")
        parts.append(shape.select(*_row("shape", said, F.col("n_with") + F.col("n_without"))))
    rare = Q.novelty(events).orderBy(F.desc("delta"), "name").limit(1)
    said = F.format_string("The %d sessions with %s had %.1f corrections fewer in 100 calls; the best of several rare tools, so expect less.", "used_in", T.pretty_tool(F.col("name")), "delta")
    parts.append(rare.select(*_row("novelty", said, F.lit(0))))
    return reduce(DataFrame.unionByName, parts)


def ranked(events: DataFrame, **relaxed) -> DataFrame:
    """The nudges to show, in order: at most five, one for each family."""
    return rules.select_nudges(build(events, **relaxed).select("family", "priority", "body"))


FOOTER = (
    "All of this is read off the order of events alone: what tends to come next, and where trouble followed soon after. Nothing here "
    "knows whether the work was good. Take each line as a guess to try for a week, and drop it if it does not hold."
)


def next_moves(events: DataFrame, **relaxed) -> DataFrame:
    """One row, also for an empty log: kind, nudges (family, body, confidence, in order), footer, and meta with the number of sessions."""
    built = build(events, **relaxed)
    shown = rules.select_nudges(built.select("family", "priority", "body")).join(built.select("family", "body", "confidence").distinct(), ["family", "body"])
    nudges = F.transform(F.sort_array(F.collect_list(F.struct("at", "family", "body", "confidence"))), lambda n: F.struct(n["family"].alias("family"), n["body"].alias("body"), n["confidence"].alias("confidence")))
    said = shown.agg(F.lit("next_moves").alias("kind"), nudges.alias("nudges"), F.lit(FOOTER).alias("footer"))  # five rows at most
    return said.crossJoin(events.agg(F.struct(F.count_distinct("session").alias("sessions")).alias("meta")))
