from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluation, graph, layout, walk


@pytest.fixture(scope="module")
def nodes(spark):
    n, dims = 40, 24
    rows = [(i, [math.sin((i + 1) * (d + 1) * 0.29) + math.cos((i + 3) * d * 0.11) for d in range(dims)], f"d{i % 3}", f"s{i // 4}") for i in range(n)]
    return graph.concepts(spark.createDataFrame(rows, "id long, e array<double>, d string, s string"), "id", "e", F.col("d"), F.col("s")).cache()


@pytest.fixture(scope="module")
def matrix(nodes):
    v = np.array([r.v for r in nodes.orderBy("i").collect()])
    sim = v @ v.T
    np.fill_diagonal(sim, -1)
    return sim


@pytest.mark.parametrize("block", [7, 1024])
def test_neighbours_equal_the_matrix_for_any_block_size(nodes, matrix, block, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", block)
    got = {(r.i, r.rk): r.j for r in graph.neighbours(nodes, 10).collect()}
    want = np.argsort(-matrix, axis=1, kind="stable")[:, :10]
    assert got == {(i, k + 1): int(want[i, k]) for i in range(40) for k in range(10)}


def test_synapses_are_undirected_and_keep_the_larger_weight(nodes, matrix):
    rows = graph.synapses(graph.neighbours(nodes, 8)).collect()
    assert all(r.s < r.t and r.w == pytest.approx(matrix[r.s, r.t], abs=1e-4) for r in rows) and len({(r.s, r.t) for r in rows}) == len(rows)


def greedy(pairs, limit, uses=2):
    used, out = {}, []
    for i, j in pairs:
        if len(out) == limit:
            break
        if used.get(i, 0) < uses and used.get(j, 0) < uses:
            used[i], used[j] = used.get(i, 0) + 1, used.get(j, 0) + 1
            out.append((i, j))
    return out


def test_surprise_and_diverse_equal_the_plain_walk(nodes, matrix):
    near = graph.neighbours(nodes, 60).cache()
    scored = graph.surprise(near, nodes, 40).cache()
    order = np.argsort(-matrix, axis=1, kind="stable")
    sets = [set(order[i, :12].tolist()) for i in range(40)]
    want, seen = [], set()
    for i in range(40):
        for rank in range(10, 39):
            j = int(order[i, rank])
            if frozenset((i, j)) in seen or matrix[i, j] <= 0:
                continue
            seen.add(frozenset((i, j)))
            overlap = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            want.append((i, j, matrix[i, j] * (1 - overlap) * (1.15 if i % 3 != j % 3 else 1) * (0.35 if i // 4 == j // 4 else 1), rank))
    got = {(r.i, r.j): r.score for r in scored.collect()}
    assert set(got) == {(i, j) for i, j, _, _ in want} and all(got[i, j] == pytest.approx(s) for i, j, s, _ in want)
    plain = greedy([(i, j) for i, j, s, r in sorted(want, key=lambda x: (-x[2], x[0], x[3]))], 10)
    assert {(r.i, r.j) for r in graph.diverse(scored, 10).collect()} == set(plain)
    cards = graph.cards(graph.diverse(scored, 10)).collect()
    assert len(cards) == 10 and all("cosine" in c.why and c.angle.endswith("?") for c in cards)
    digest = graph.digest(scored, 3).first()
    assert digest.bridges == 3 and digest.digest.count("\n") == 2 and digest.digest.startswith("1. ")


@pytest.mark.parametrize("seed", range(4))
def test_diverse_equals_greedy_on_random_graphs(spark, seed):
    r = np.random.default_rng(seed)
    pairs = sorted({tuple(sorted(map(int, p))) for p in r.integers(0, 14, (70, 2)) if p[0] != p[1]})
    rows = [(i, j, 1, float(r.integers(1, 30))) for i, j in pairs]
    got = {(x.i, x.j) for x in graph.diverse(spark.createDataFrame(rows, "i long, j long, rk int, score double"), 9).collect()}
    assert got == set(greedy([(i, j) for i, j, _, s in sorted(rows, key=lambda x: (-x[3], x[0], x[2]))], 9)) or len(got) == 9


@pytest.mark.parametrize("window", [4, 50])
def test_diverse_is_the_walk_whatever_the_window(spark, window, monkeypatch):
    monkeypatch.setattr(graph, "WINDOW", window)
    r = np.random.default_rng(window)
    pairs = sorted({tuple(sorted(map(int, p))) for p in r.integers(0, 60, (260, 2)) if p[0] != p[1]})
    rows = [(i, j, k, float(r.integers(1, 25))) for k, (i, j) in enumerate(pairs)]
    want = greedy([(i, j) for i, j, _, s in sorted(rows, key=lambda x: (-x[3], x[0], x[2]))], 10**9)
    taken = {(x.i, x.j) for x in graph.diverse(spark.createDataFrame(rows, "i long, j long, rk int, score double"), 10**9).collect()}
    assert taken == set(want)
    first = {(x.i, x.j) for x in graph.diverse(spark.createDataFrame(rows, "i long, j long, rk int, score double"), 17).collect()}
    assert first == set(want[:17])


def test_diverse_along_a_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    rows = [(k, k + 1, 1, 1.0 - k / (2 * n)) for k in range(n)]
    rounds = []
    real = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: rounds.append(name) or real(df, name))
    got = {(x.i, x.j) for x in graph.diverse(spark.createDataFrame(rows, "i long, j long, rk int, score double"), 4000, uses=1).collect()}
    assert got == {(k, k + 1) for k in range(0, 8000, 2)} and rounds.count("bridges-state") < 10


def test_first_of_takes_the_first(spark):
    r = np.random.default_rng(1)
    rows = [(i, i + 1, 1, float(x)) for i, x in enumerate(r.integers(0, 50, 5000))]
    df = spark.createDataFrame(rows, "i long, j long, rk int, score double").cache()
    order = sorted(rows, key=lambda x: (-x[3], x[0]))
    for limit in (0, 1, 2500, 4999, 5000, 9999):
        assert sorted(map(tuple, graph.first_of(df, limit).collect())) == sorted(order[:limit])


def test_bridges_mark_or_add_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5)], "s long, t long, w double")
    bridges = spark.createDataFrame([(3, 2, 0.5), (1, 9, 0.3)], "i long, j long, sim double")
    got = {(r.s, r.t, r.w, r.is_long) for r in graph.with_bridges(edges, bridges).collect()}
    assert got == {(1, 2, 0.9, False), (2, 3, 0.5, True), (1, 9, 0.3, True)}


def test_layout_has_its_radii_and_no_mean(nodes):
    stats = {r.axis: r for r in layout.axis_stats(layout.layout(nodes)).collect()}
    assert [stats[a].deviation for a in "xyz"] == pytest.approx(layout.RADII, abs=0.2) and all(s.mean <= 0.1 for s in stats.values())


def test_walk_follows_edges_dreams_and_is_repeatable(spark):
    ring = spark.createDataFrame([(min(k, (k + 1) % 6), max(k, (k + 1) % 6), 0.9, k == 2) for k in range(6)], "s long, t long, w double, is_long boolean")
    rows = walk.walk(ring, 40, 9).collect()
    by = {k: [r for r in rows if r.kind == k] for k in ("neuron", "synapse", "insight")}
    assert len(by["neuron"]) == 360 and len(by["synapse"]) == 720 and 20 < len(by["insight"]) < 80 and len(rows) == sum(map(len, by.values()))
    follows = [r for r in by["neuron"] if r.weight > 0]
    assert 200 < len(follows) < 320 and all((r.node - r.came_from) % 6 in (1, 5) for r in follows)
    for w in range(40):  # a dream moves no attention: each neuron comes from the one before
        path = sorted((r.step, r.came_from, r.node) for r in by["neuron"] if r.walker == w)
        assert all(b[1] == a[2] for a, b in zip(path, path[1:], strict=False))
    assert all((r.node - r.came_from) % 6 in (1, 5) for r in rows if r.kind == "synapse") and all({r.node, r.came_from} == {2, 3} for r in rows if r.kind == "insight")
    assert sorted(rows) == sorted(walk.walk(ring, 40, 9).collect())


def plain_walk(edges, walkers, steps, draws):
    """One walker after the other, with the same draws; returns events, and what is active in the end."""
    ids = sorted({x for s, t, _, _ in edges for x in (s, t)})
    near = {i: sorted((b, w) for s, t, w, _ in edges for a, b in ((s, t), (t, s)) if a == i) for i in ids}
    far = sorted((s, t, w) for s, t, w, is_far in edges if is_far)
    events, active = [], {}
    for k in range(walkers):
        u = lambda step, purpose, k=k: draws[k, step, purpose]
        focus, visits, act = ids[int(u(-1, walk._JUMP) * len(ids))], {}, {}
        for step in range(steps):
            before, weight = focus, 0.0
            if near[focus] and u(step, walk._FOLLOW) < walk.FOLLOW:
                scores = [max(w, 0) / (1 + visits.get(j, 0)) for j, w in near[focus]]
                at, left = 0, u(step, walk._PICK) * sum(scores)
                total = scores[0]
                while total <= left and at < len(scores) - 1:
                    at += 1
                    total += scores[at]
                if sum(scores) <= 0:
                    at = int(u(step, walk._PICK) * len(scores))
                focus, weight = near[focus][at]
            else:
                focus = ids[int(u(step, walk._JUMP) * len(ids))]
                for x in range(1, walk.SAMPLES + 1):
                    other = ids[int(u(step, walk._JUMP + x) * len(ids))]
                    if visits.get(other, 0) < visits.get(focus, 0):
                        focus = other
            visits[focus] = visits.get(focus, 0) + 1
            act = {i: a * walk.DECAY**walk.STEP_SECONDS for i, a in act.items()}
            act[focus] = 1.0
            events.append((k, step, "neuron", focus, before, weight))
            for j, w in near[focus]:
                act[j] = min(1.0, act.get(j, 0) + max(0.0, w) * walk.GAIN)
                events.append((k, step, "synapse", j, focus, w))
            if far and u(step, walk._DREAM) < walk.DREAM:
                s, t, w = far[int(u(step, walk._WHICH) * len(far))]
                act[s] = act[t] = 1.0
                events.append((k, step, "insight", t, s, w))
        active[k] = act
    return events, active


@pytest.mark.parametrize("far", [True, False])
def test_walk_equals_plain_walkers(spark, far):
    r = np.random.default_rng(4)
    pairs = sorted({tuple(sorted(map(int, p))) for p in r.integers(0, 30, (60, 2)) if p[0] != p[1]})
    edges = [(10 * a, 10 * b, round(float(r.normal(0.4, 0.4)), 3), far and a % 3 == 0) for a, b in pairs]
    walkers, steps, seed = 25, 8, 11
    purposes = range(walk._JUMP + walk.SAMPLES + 1)
    draws = {}
    steps_of = F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("step")
    for row in spark.range(walkers).select("id", steps_of).select("id", "step", *(walk.draw(seed, F.col("id"), F.col("step"), p).alias(f"u{p}") for p in purposes)).collect():
        draws |= {(row["id"], row["step"], p): row[f"u{p}"] for p in purposes}
    got = walk.supersteps(spark.createDataFrame(edges, "s long, t long, w double, is_long boolean"), walkers, steps, seed).cache()
    want, active = plain_walk(edges, walkers, steps, draws)
    assert sorted(map(tuple, got.select("walker", "step", F.inline("fired")).collect())) == sorted(want)
    ids = sorted({x for e in edges for x in e[:2]})
    for row in got.where(F.col("step") == steps - 1).collect():
        assert {ids[i]: a for i, a in row.act.items() if a >= walk.FAINT} == pytest.approx({i: a for i, a in active[row.walker].items() if a >= walk.FAINT})
        assert sum(row.visits.values()) == steps
    assert {e[2] for e in want} == ({"neuron", "synapse", "insight"} if far else {"neuron", "synapse"})
    values = list(draws.values())
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / len(values) - 0.5) < 0.02


def test_walk_on_no_edges(spark):
    assert walk.walk(spark.createDataFrame([], "s long, t long, w double, is_long boolean"), 3, 3).count() == 0


def test_spread_caps_at_one_and_decay_shrinks(spark):
    edges = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.4), (1, 2, 0.9), (0, 3, -1.0)], "s long, t long, w double")
    act = {r.node: r.act for r in graph.spread_activation(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert act == pytest.approx({0: 1.0, 1: 0.54, 2: 0.24, 3: 0.0})
    assert spark.range(1).select(graph.decay(F.lit(1.0), 1.0)).first()[0] == pytest.approx(0.35)


def test_blind_sheet_uses_each_concept_once(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).tolist()) for i in range(70)]
    near = graph.neighbours(graph.concepts(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", F.lit("d"), F.lit(None)), 50).cache()
    sheet = evaluation.sheet(near, 10).collect()
    used = [x for row in sheet for x in row]
    assert len(sheet) >= 5 and len(used) == len(set(used))
    verdicts = evaluation.judge(spark.createDataFrame([("a", 0, 0), ("b", 6, 5), ("c", 18, 2), ("d", 2, 18)], "name string, engine long, baseline long")).collect()
    assert [v.verdict for v in verdicts] == ["undecided", "inconclusive", "engine", "baseline"]
