"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of k in n, as percentages with one digit; (0, 100) without trials."""
    trials = F.greatest(n, F.lit(1)).cast("double")
    p = k / trials
    d = 1 + Z * Z / trials
    centre = (p + Z * Z / (2 * trials)) / d
    half = Z / d * F.sqrt(p * (1 - p) / trials + Z * Z / (4 * trials * trials))
    low = F.when(n <= 0, 0.0).otherwise(F.round(100 * F.greatest(F.lit(0.0), centre - half), 1))
    high = F.when(n <= 0, 100.0).otherwise(F.round(100 * F.least(F.lit(1.0), centre + half), 1))
    return low, high


def confidence(n: Column) -> Column:
    return F.when(n >= 40, "high").when(n >= 15, "medium").otherwise("low")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole; a whole of zero counts as one."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), digits)


def log_choose(n: Column, upto: Column) -> Column:
    """log of n over i for i = 0 .. upto, as an array: a running sum."""
    start = F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("all"))

    def step(state: Column, i: Column) -> Column:
        nxt = state["at"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(nxt.alias("at"), F.concat(state["all"], F.array(nxt)).alias("all"))

    steps = F.when(upto >= 1, F.sequence(F.lit(1), upto.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["all"])


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p at one half: all outcomes no likelier than k. 1 without trials."""
    logs = log_choose(n, n)
    own = F.element_at(logs, k.cast("int") + 1)
    total = F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.when(F.exp(x - own) <= 1 + 1e-9, F.exp(x - n * F.log(F.lit(2.0)))).otherwise(0.0))
    return F.when(n <= 0, 1.0).otherwise(F.least(total, F.lit(1.0)))


def verdict(decisive: Column, p: Column, engine: Column, baseline: Column) -> Column:
    return F.when(decisive == 0, "undecided").when(p >= 0.05, "inconclusive").when(engine > baseline, "engine").otherwise("baseline")
