from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import audit
from sparkloom.plans import nudges
from sparkloom.sources import sinks


def written(path):
    return [json.loads(line) for p in sorted(path.glob("*.json")) for line in p.read_text().splitlines()]


def test_a_leak_in_any_task_leaves_no_output(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(0, 400, 1, 8).select("id", F.concat(F.lit("fine "), "id").alias("body"))
    sinks.publish(str(path), rows)
    assert sorted(r["id"] for r in written(path)) == list(range(400)) and [p.name for p in tmp_path.iterdir()] == ["out"]
    for at in (0, 250, 399):
        bad = rows.withColumn("body", F.when(F.col("id") == at, "see /home/me").otherwise(F.col("body")))
        with pytest.raises(audit.PrivacyError, match="'body'"):
            sinks.publish(str(path), bad)
        assert len(written(path)) == 400 and [p.name for p in tmp_path.iterdir()] == ["out"]
        with pytest.raises(audit.PrivacyError):
            sinks.publish(str(tmp_path / "new"), bad)
        assert not (tmp_path / "new").exists()


def test_other_errors_stay_what_they_are(spark, tmp_path):
    with pytest.raises(Exception, match="oh no") as e:
        sinks.publish(str(tmp_path / "out"), spark.range(3).select(F.raise_error(F.lit("oh no")).cast("string").alias("x")))
    assert not isinstance(e.value, audit.PrivacyError) and list(tmp_path.iterdir()) == []


def test_rows_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    sinks.publish(str(tmp_path / "out"), spark.range(50).mapInArrow(count, "id long").select(F.concat(F.lit("n"), "id").alias("s")))
    assert seen.value == 50


def test_guard_sees_nested_and_schemaless_values_and_keeps_nulls(spark):
    df = spark.createDataFrame([(None, None), ("ok", '{"a": 1}')], "s string, j string")
    assert audit.guarded(df).count() == 2
    with pytest.raises(Exception, match="unsafe value in field j"):
        audit.guarded(spark.createDataFrame([("ok", '{"a": ["x@y.org"]}')], "s string, j string")).collect()
    assert audit.guarded(spark.createDataFrame([("/a/b", 1)], "s string, n int"), exempt=("s",)).count() == 1


def test_next_moves_are_assembled_audited_and_written(spark, tmp_path):
    log = [(s, k, "tool", ["Plan", "Grep", "Edit", "Bash"][k % 4]) for s in range(8) for k in range(24)]
    ddl = "session long, seq long, kind string, name string"
    row = nudges.next_moves(spark.createDataFrame(log, ddl))
    sinks.write_next_moves(str(tmp_path / "moves"), row)
    (out,) = written(tmp_path / "moves")
    assert out["kind"] == "next_moves" and out["footer"] == nudges.FOOTER and out["meta"] == {"sessions": 8}
    shown = [r.body for r in nudges.ranked(spark.createDataFrame(log, ddl)).orderBy("at").collect()]
    assert [n["body"] for n in out["nudges"]] == shown and set(out["nudges"][0]) == {"family", "body", "confidence"}
    unsafe = [(s, k, kind, "/usr/bin" if name == "Grep" else name) for s, k, kind, name in log]
    with pytest.raises(audit.PrivacyError, match="'nudges'"):
        sinks.write_next_moves(str(tmp_path / "moves"), nudges.next_moves(spark.createDataFrame(unsafe, ddl)))
    assert written(tmp_path / "moves") == [out]
    empty = nudges.next_moves(spark.createDataFrame([], ddl)).first()
    assert empty.nudges == [] and empty.meta.sessions == 0


def test_sheet(spark, tmp_path):
    sinks.write_sheet(str(tmp_path / "s"), spark.createDataFrame([(1, 2, 3)], "source long, baseline long, engine long"))
    assert written(tmp_path / "s") == [{"source": 1, "baseline": 2, "engine": 3}]


@pytest.mark.parametrize(("master", "ok"), [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False), ("k8s://x", False)])
def test_staging_needs_a_shared_folder_on_a_cluster(master, ok):
    from types import SimpleNamespace

    from sparkloom import staging

    def session(folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"none-{master}", getConf=lambda: SimpleNamespace(get=lambda key: None)))

    assert staging.scratch_root(session("hdfs://shared/")) == "hdfs://shared"
    if ok:
        assert staging.scratch_root(session(None))
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.scratch_root(session(None))
