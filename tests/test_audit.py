from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import audit

LEAKS = ["/häuser/straße", "see /home/me", "jörg@müller.de", "x @ y, .+a@b.de", "a@b.рф", "\u2028/a/b", "(C:\\x", "C:\\x", "ö@ü.ß", "sk-" + "a1" * 12]
SAFE = ["read/write", "CI/CD", "an @mention", "a@b", "+@b.de", "a@b.--", "x/y/z", "/a", "a@.de", "häuser/straße", "", "1.2.3"]


@pytest.mark.parametrize("value", LEAKS + SAFE)
def test_leaks_of_any_script(spark, value):
    row = spark.createDataFrame([(value,)], "s string").select(T.leaks(F.col("s")), F.col("s").rlike(T.LEAK_EMAIL)).first()
    assert row[0] == (value in LEAKS)
    assert row[1] == ("@" in value and value in LEAKS)


def test_long_runs_are_read_once(spark):
    rows = [("a." * 100_000,), ("z" * 200_000,), ("a@" * 50_000,), ("." * 200_000,)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(T.leaks(F.col("s"))).collect()] == [False] * 4


NESTED = [
    {"a": {"b": ["ok", {"c": "/home/u/x"}]}}, {"/home/u/x": 1}, [1, [2, [{"k": ["me@x.org"]}]]], {"a": json.dumps({"b": json.dumps({"c": "\\/home\\/u"})}).replace("\\\\\\\\/", "\\\\\\/")},
    {"a": json.dumps({"b": json.dumps({"c": "/home/u"})})}, {"a": "quote \" and back\\slash", "b": ["/häuser/straße"]}, {"a": "tab\t\u2028 /a/b"},
]


@pytest.mark.parametrize("at", range(len(NESTED)))
@pytest.mark.parametrize("how", ["string", "variant", "in a map", "in an array"])
def test_json_without_a_schema_is_seen_through(spark, at, how):
    text = json.dumps(NESTED[at])
    df = spark.createDataFrame([("fine", text)], "a string, j string")
    if how == "variant":
        df = df.select("a", F.parse_json("j").alias("j"))
    elif how == "in a map":
        df = df.select("a", F.create_map(F.lit("k"), "j").alias("j"))
    elif how == "in an array":
        df = df.select("a", F.array(F.parse_json("j")).alias("j"))
    assert {r.field for r in audit.findings(df, T.leaks).collect()} == {"j"}
    with pytest.raises(audit.PrivacyError):
        audit.gate(df, T.leaks)


def test_escaped_slashes_under_three_levels(spark):
    raw = r'{"a": {"b": {"c": "\/home\/u\/x"}}}'
    assert audit.findings(spark.createDataFrame([(raw,)], "j string"), T.leaks).where("value = '/home/u/x'").count() == 1
    unicode = r'{"a": [{"b": "\u002fhome\u002fu"}]}'
    assert audit.findings(spark.createDataFrame([(unicode,)], "j string"), T.leaks).count() == 1


def test_safe_json_and_what_only_looks_like_it(spark):
    rows = [(x,) for x in ('{"a": [1, null, "read/write", {"b": "x @ y"}]}', "[not json", '{"open', "{}", "[]", None, '["a", ', '"/a"')]
    df = spark.createDataFrame(rows, "j string")
    assert audit.findings(df, T.leaks).count() == 0
    audit.gate(df, T.leaks)


def test_strings_of_json_equal_a_parser(spark):
    def walk(x):
        if isinstance(x, dict):
            return [s for k, v in x.items() for s in (k, *walk(v))]
        return [s for v in x for s in walk(v)] if isinstance(x, list) else [x] if isinstance(x, str) else []

    texts = [json.dumps(x) for x in NESTED] + [json.dumps({"q" * 50: ["\\" * 999, '"' * 999, "\n", "", "\U0001f600"]}), json.dumps(["\\\"" * 20_000])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", T.json_strings(F.col("j")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [walk(json.loads(t)) for t in texts]
