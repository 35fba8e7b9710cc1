from __future__ import annotations

import json
import re
import time

import pytest

from sparkloom.operators import generate

CARDS = "i long, j long, li string, lj string, sim double, overlap double, cross boolean, same_source boolean, si string, di string, dj string"


@pytest.fixture(scope="module")
def bridges(spark):
    return spark.createDataFrame([(k, k + 100, f"left {k}", f"right {k}", 0.8, 0.0, True, False, "s", "a", "b") for k in range(40)], CARDS).repartition(3).cache()


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(k, f"text of {k} sk-{'a1' * 12}" if k == 3 else f"text of {k}") for k in range(150)], "i long, text string").cache()


def test_off_by_default(bridges, nodes):
    rows = generate.described(bridges, nodes).collect()
    assert len(rows) == 40 and not any(r.generated for r in rows) and all(r.error is None and "cosine" in r.why for r in rows)


def number(prompt):
    return int(re.search(r"left (\d+)", prompt)[1])


def moody(prompts):
    """Answers by number: raises for some, stays away from others, gives broken or partial JSON, and leaks a secret."""
    if any(number(p) == 39 for p in prompts) and len(prompts) > 1:
        raise ConnectionError("the whole batch")
    out = []
    for p in prompts:
        k = number(p)
        out.append(
            TimeoutError("too slow") if k % 10 == 1 else "{broken" if k % 10 == 2 else "[1]" if k % 10 == 4 else json.dumps({"why": f"because {k}", "angle": ""}) if k % 10 == 5
            else json.dumps({"why": "key sk-" + "b2" * 12, "angle": "x" * 500}) if k % 10 == 6 else json.dumps({"why": f"because {k}", "angle": f"what of {k}?"})
        )
    return out


def test_failures_cost_their_own_rows_only(bridges, nodes):
    rows = {r.i: r for r in generate.described(bridges.where("i < 39"), nodes, moody, tries=2, wait=0.0, at_once=7).collect()}
    assert len(rows) == 39
    for k, r in rows.items():
        kind = k % 10
        if kind in (1, 2, 4):
            assert not r.generated and "cosine" in r.why and r.error.split(":")[0] == {1: "TimeoutError", 2: "JSONDecodeError", 4: "ValueError"}[kind]
        elif kind == 5:
            assert r.generated and r.why == f"because {k}" and r.angle.startswith("How would")
        elif kind == 6:
            assert "b2b2" not in r.why and len(r.angle) <= generate.MOST_ANGLE + 1
        else:
            assert (r.generated, r.why, r.angle, r.error) == (True, f"because {k}", f"what of {k}?", None)


def test_a_generator_that_is_down(bridges, nodes):
    def down(prompts):
        raise OSError("refused")

    rows = generate.described(bridges, nodes, down, tries=1).collect()
    assert len(rows) == 40 and all(not r.generated and r.error == "OSError: refused" and "cosine" in r.why for r in rows)


def test_only_failures_are_asked_again_and_waits_grow(monkeypatch):
    asked, waits = [], []
    monkeypatch.setattr(time, "sleep", waits.append)

    def call(prompts):
        asked.append(list(prompts))
        return [json.dumps({"why": p}) if p == "a" or len(asked) > 2 else "no" for p in prompts][: 2 if len(asked) == 1 else None]

    got = generate.ask(call, ["a", "b", "c"], 4, 0.5)
    assert got == [("a", "", None), ("b", "", None), ("c", "", None)] and asked == [["a", "b", "c"], ["b", "c"], ["b", "c"]] and waits == [0.5, 1.0]


def test_prompts_hold_no_secret(bridges, nodes):
    rows = {r.i: r.prompt for r in generate.prompts(generate.graph.cards(bridges), nodes).collect()}
    assert "a1a1" not in rows[3] and "text of 5" in rows[5] and "text of 105" in rows[5]
