"""Connected components of a graph given as edges, without gathering edges or components anywhere.

Rounds of hooking and contraction: every node hooks to its least neighbour (by id in even rounds, by a hash of the id in
odd ones, which breaks long sorted chains), pointers are doubled, edges are rewritten to the hooked nodes, and loops and
repeats fall away. Each odd round leaves at most half of the nodes in expectation, so the rounds are logarithmic. Every
round is written to the shared folder: a lost executor costs a task, not the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage

MAX_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` for every node that has an edge to another node.

    Nulls and loops are ignored, repeated edges count once. The root is some node of the component, the same for all.
    """
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stage(left, "edges")
    hooks: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        key = (lambda c: F.struct(F.col(c).alias("o"), F.col(c).alias("id"))) if k % 2 == 0 else (lambda c, k=k: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("o"), F.col(c).alias("id")))
        to = both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least("m", key("u"))["id"].alias("m"))
        to = stage(to, "hooks")
        for _ in range(3):
            nxt = to.select(F.col("u").alias("m"), F.col("m").alias("mm"))
            to = to.join(nxt, "m").select("u", F.col("mm").alias("m"))
        to = stage(to, "hooks")
        hooks.append(to)
        ma = to.select(F.col("u").alias("a"), F.col("m").alias("ma"))
        mb = to.select(F.col("u").alias("b"), F.col("m").alias("mb"))
        left = left.join(ma, "a").join(mb, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        left = stage(left, "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for to in hooks[1:]:
        later = to.select(F.col("u").alias("root"), "m")
        out = out.join(later, "root", "left").select("node", F.coalesce("m", "root").alias("root"))
    return out


def fold_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a[i], b[i]) into ``labels``, which hold the least index of each set known so far."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        la, lb, a, b = la[apart], lb[apart], a[apart], b[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels = nxt
    return labels
