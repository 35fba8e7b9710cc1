"""Blind comparison: for sampled concepts the obvious neighbour against a pick from a further band, each used once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats

BAND = (15, 49)


def nearest_baseline(near: DataFrame) -> DataFrame:
    """i, baseline, sim: the nearest other."""
    return near.where("rk = 1").select("i", F.col("j").alias("baseline"), F.round("sim", 4).alias("sim"))


def engine_band(near: DataFrame) -> DataFrame:
    """i, band_size, first_j, last_j: what the engine's pick is drawn from (ranks 16 to 50)."""
    rows = near.where(F.col("rk").between(BAND[0] + 1, BAND[1] + 1))
    return rows.groupBy("i").agg(F.count(F.lit(1)).alias("band_size"), F.min_by("j", "rk").alias("first_j"), F.max_by("j", "rk").alias("last_j"))


def sheet(near: DataFrame, n_rows: int, seed: int = 7) -> DataFrame:
    """source, baseline, engine: no concept stands anywhere twice.

    Sampled sources are reserved first and then served in turn, which is sequential; the sheet has ``n_rows`` rows, so
    only their candidates (``n_rows`` times the band) are gathered.
    """
    picked = near.select("i").distinct().orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(n_rows)
    rows = near.join(F.broadcast(picked), "i").where(F.col("rk") <= BAND[1] + 1).select("i", "j", "rk", F.xxhash64(F.lit(seed), "i", "j").alias("h")).collect()
    sources = sorted({r.i for r in rows})
    by: dict[int, list] = {i: [] for i in sources}
    for r in sorted(rows, key=lambda r: r.rk):
        by[r.i].append(r)
    used, out = set(sources), []
    for i in sources:
        baseline = next((r.j for r in by[i] if r.j not in used), None)
        band = [r for r in by[i] if r.rk > BAND[0] and r.j not in used and r.j != baseline]
        if baseline is None or not band:
            continue
        engine = min(band, key=lambda r: r.h).j
        used |= {baseline, engine}
        out.append((i, baseline, engine))
    return near.sparkSession.createDataFrame(out, "source long, baseline long, engine long")


def judge(votes: DataFrame) -> DataFrame:
    """``votes(name, engine, baseline)`` -> with decisive, p_value and verdict."""
    decisive = F.col("engine") + F.col("baseline")
    p = stats.binomial_two_sided(F.col("engine"), decisive)
    return votes.select("name", "engine", "baseline", decisive.alias("decisive"), F.round(p, 6).alias("p_value"), stats.verdict(decisive, p, F.col("engine"), F.col("baseline")).alias("verdict"))
