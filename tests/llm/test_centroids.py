from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroids

DDL = "vec_id long, embedding array<float>, label int, cluster int, q string"


def brute(rows, k, rounds, dims):
    """Plain Lloyd rounds over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    means = [list(v) for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for c, vs in groups.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(place(v))) for i, v in kept]
    return out, means


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_plain_rounds(spark, parts):
    r = random.Random(3)
    rows = as_floats([(i, [r.gauss(i % 5, 0.7 + d / 40) for d in range(64)]) for i in range(150)])
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [1.0] * 63), (205, [math.nan] * 64), (206, [math.inf] + [0.0] * 63), (207, [None] * 64), (1, rows[5][1]), (None, rows[9][1])]
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], DDL).repartition(parts)).collect()
    want, means = brute(rows, 8, 10, 64)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2])
    assert sorted(((g.vec_id, g.cluster, g.distance) for g in got), key=key) == sorted(want, key=key)
    assert {g.inertia for g in got} == {sum(d for _, _, d in want)}
    for g in got:
        assert g.cluster_inertia == sum(d for _, c, d in want if c == g.cluster)
        assert g.centroid_sha256 == hashlib.sha256(",".join(map(str, means[g.cluster])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = as_floats([(i, [float(i % 2)] * 64) for i in range(12)])
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], DDL)).collect()
    want, _ = brute(rows, 8, 10, 64)
    assert sorted((g.vec_id, g.cluster, g.distance) for g in got) == sorted(want)
    assert len({g.cluster for g in got}) == 2


def test_few_vectors_and_huge_components(spark):
    rows = as_floats([(0, [1e30] * 64), (1, [-1e30] * 64), (2, [0.0] * 64)])
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], DDL)).collect()
    assert len(got) == 3 and all(g.distance == 0 for g in got)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1, 1, "x")], [(1, [1.0], 1, 1, "x")]):
        got = centroids.cluster(spark.createDataFrame(rows, DDL))
        assert got.count() == 0 and "centroid_sha256" in got.columns


def test_search_is_exact_for_any_order_and_step():
    r = np.random.default_rng(1)
    x, c = r.integers(-50, 50, (300, 64)), r.integers(-50, 50, (8, 64))
    c[5] = c[2]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for step in (1, 8, 64):
        label, best = centroids.nearest(x, c, r.permutation(64), step)
        assert (label == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
