from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import audit, sessions
from sparkloom.plans import rules
from sparkloom.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """3 sessions of 30 prompts with 3 assistant turns each and 180 tool calls; 12 corrective prompts a session."""
    path = tmp_path_factory.mktemp("logs")
    script = ["Read"] * 40 + ["Hot"] * 15 + ["Edit"] * 45 + ["Write"] * 13 + ["Bash"] * 40 + ["Workflow"] * 7 + ["Agent"] * 10 + ["TodoWrite"] * 7 + ["mcp__chrome__click"] * 3
    for s in range(3):
        clock, lines, at = datetime(2026, 3, 2 + s, 9, tzinfo=UTC), [], 0

        def put(message, clock_step=5, **more):
            nonlocal clock
            lines.append(json.dumps({"timestamp": clock.isoformat().replace("+00:00", "Z"), "gitBranch": f"b{s}", "message": message, **more}))
            clock += timedelta(seconds=clock_step)

        put({"role": "user", "content": "<system-reminder>no wait stop</system-reminder>"})
        for p in range(30):
            put({"role": "user", "content": "no, actually do it again" if p < 12 else "please go on"})
            for _ in range(3):
                blocks = [{"type": "thinking", "thinking": "hmm"}]
                for _ in range(2):
                    name = script[at]
                    file = f"r{at % 26}" if name == "Read" else "hot.py" if name == "Hot" else f"m{at % 45}.py"
                    blocks.append({"type": "tool_use", "name": "Edit" if name == "Hot" else name, "input": {"file_path": f"/home/u/{file}"}})
                    at += 1
                put({"role": "assistant", "model": "claude-opus-x", "content": blocks, "usage": {"input_tokens": 10, "output_tokens": 2}})
            put({"role": "user", "content": [{"type": "tool_result", "is_error": p == 0}]}, toolUseResult={"interrupted": p == 1})
        (path / f"s{s}.jsonl").write_text("\n".join([*lines, "", "{broken"]))
    (path / "empty.jsonl").write_text("")
    (path / "other.txt").write_text("no")
    return str(path)


@pytest.fixture(scope="module")
def recs(spark, folder):
    return sessions.records(sessions.read(spark, folder)).cache()


@pytest.fixture(scope="module")
def row(spark, folder, recs):
    return sessions.metrics(recs, sessions.files(spark, folder)).cache()


def test_metrics(row):
    m = row.first()
    assert (m.sessions, m.assistant_turns, m.real_user_prompts, m.opus_pct, m.models) == (4, 270, 90, 100.0, {"opus": 270})
    assert (m.tool_calls, m.read, m.edit, m.write, m.bash, m.workflow_calls, m.agent_calls, m.todo_calls) == (540, 120, 180, 39, 120, 21, 30, 21)
    assert (m.corrections_caught, m.pounce_median_sec, m.reversal_count, m.reversal_rate_per_100) == (33, 10.0, 36, 40.0)
    assert (m.reread_events, m.reread_pct) == (42, 35.0) and m.top_mcp_servers == {"chrome": 9} and m.mcp_calls == 9
    assert (m.distinct_files_edited, m.most_churned_file_edits) == (46, 45)
    assert (m.tool_errors, m.bash_interrupted, m.git_branches, m.multi_tool_turns, m.max_parallel_tools, m.thinking_blocks, m.thinking_chars) == (3, 3, 3, 270, 2, 270, 810)
    assert m.tokens == {"input": 2700, "output": 540, "cache_read": 0, "cache_creation": 0} == m.tokens_by_model["opus"]
    assert m.peak_hour == 9 and m.night_owl_hour is None and sum(m.hour_histogram.values()) == sum(m.weekday_histogram.values()) == 453 and len(m.hour_histogram) == 24
    assert m.max_turns_in_session == 90 and m.longest_session_min == m.avg_session_min == 12.5
    assert len(row.columns) == 47


def test_events_follow_the_lines(recs):
    events = sessions.events(recs)
    kinds = {r.kind: r.n for r in events.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"tool": 540, "error": 3, "correction": 36}
    first = [(r.kind, r.name) for r in events.where("session = 's0.jsonl'").orderBy("seq").limit(9).collect()]
    assert first == [("correction", None), *[("tool", "Read")] * 6, ("error", None), ("correction", None)]


def test_no_path_or_text_leaves(row, tmp_path):
    sinks.write_metrics(str(tmp_path / "m"), row)
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("*.json"))
    assert "hot.py" not in text and "/home" not in text and "actually" not in text and json.loads(text)["sessions"] == 4


@pytest.mark.parametrize("value", ["/etc/x", "me@x.org", "sk-ant-api03-" + "A1b2" * 6, "C:\\x"])
def test_the_gate_finds_unsafe_text_in_any_nesting(spark, value):
    q = value.replace("\\", "\\\\")
    for shape in (f"'{q}' AS a", f"map('{q}', 1) AS a", f"map('k', named_struct('z', array('ok', '{q}'))) AS a", f"array(named_struct('x', 1, 'y', '{q}')) AS a"):
        with pytest.raises(audit.PrivacyError):
            audit.gate(spark.sql(f"SELECT 1 AS n, {shape}"))
    audit.gate(spark.sql(f"SELECT '{q}' AS a"), exempt=("a",))
    audit.gate(spark.sql("SELECT 'fine' AS a, array('x', NULL) AS b, map('k', 2) AS c"))


def test_rules_on_the_metrics(row):
    metrics = row.withColumn("profile", F.lit(1))
    assert rules.archetype(metrics).first().name == "The Pouncer"
    shown = rules.visible_cards(metrics).orderBy("at").collect()
    assert shown[0].what == "The Pouncer" and not {"corrections", "reversals", "latency", "read_edit"} & {r.family for r in shown[1:]}
    found = {(r.side, r.key): r for r in rules.edges_and_taxes(metrics).collect()}
    assert ("edge", "reflex") in found and ("tax", "steer") in found and ("edge", "dispatch") in found
    assert {r.key for r in rules.moves(rules.edges_and_taxes(metrics)).collect()} == {k for s, k in found if s == "tax"}
    report = rules.report(metrics).first()
    assert report.archetype.name == "The Pouncer" and len(report.edges) <= 4 and len(report.taxes) <= 3
    sinks.audit.gate(rules.report(metrics), exempt=("profile",))


def test_thin_data_has_no_archetype(row):
    thin = row.withColumn("profile", F.lit(1)).withColumn("assistant_turns", F.lit(10)).withColumn("sessions", F.lit(1))
    assert rules.guarded_archetype(thin).count() == 0


def test_nudges_are_one_a_family_with_novelty_last(spark):
    rows = [("novelty", 50, "n 1")] + [(f"f{k}", 90 - k, f"body {k}") for k in range(7)] + [("f0", 10, "other 1"), ("bare", 99, "no digits")]
    got = rules.select_nudges(spark.createDataFrame(rows, "family string, priority int, body string")).orderBy("at").collect()
    assert [r.family for r in got] == ["f0", "f1", "f2", "f3", "novelty"]


def test_manifest_upsert(spark):
    ddl = "name string, label string, count long, synapses long"
    old, new = spark.createDataFrame([("b", "B", 1, 1), ("a", "A", 1, 1)], ddl), spark.createDataFrame([("b", "B2", 5, 5), ("c", "C", 2, 2)], ddl)
    assert [(r.name, r.label) for r in sinks.upsert_manifest(old, new).collect()] == [("a", "A"), ("b", "B2"), ("c", "C")]


def test_teaser(row):
    metrics = row.withColumn("profile", F.lit(1))
    assert rules.teaser(rules.report(metrics)).first().teaser.startswith("The Pouncer: edge in reflex")
    empty = metrics.limit(1).withColumn("assistant_turns", F.lit(1)).withColumn("sessions", F.lit(0))
    for name in ("pounce_median_sec", "workflow_calls", "agent_calls", "bash", "reread_pct", "todo_calls", "distinct_files_edited", "corrections_caught", "max_turns_in_session", "tool_calls"):
        empty = empty.withColumn(name, F.lit(0))
    empty = empty.withColumn("top_tools", F.create_map().cast("map<string,bigint>"))
    assert rules.teaser(rules.report(empty)).first().teaser == "Not enough yet."


def test_metrics_by_profile_equal_those_of_each_folder(spark, folder, row, tmp_path):
    import shutil

    for name in ("ann", "bob"):
        shutil.copytree(folder, tmp_path / name)
    (tmp_path / "bob" / "s2.jsonl").unlink()
    (tmp_path / "cy").mkdir()
    (tmp_path / "cy" / "s0.jsonl").write_text('{"timestamp": "soon", "message": {"role": "user", "content": "hi"}}\n')
    lines = sessions.read_profiles(spark, str(tmp_path))
    files = spark.createDataFrame([(n, f.name) for n in ("ann", "bob", "cy") for f in (tmp_path / n).glob("*.jsonl")] + [("dee", "none.jsonl")], "profile string, session string")
    found = sessions.metrics(sessions.records(lines, ("profile",)), files, ("profile",)).cache()
    got = {r.profile: r.asDict() for r in found.collect()}
    assert set(got) == {"ann", "bob", "cy", "dee"}
    assert {k: v for k, v in got["ann"].items() if k != "profile"} == row.first().asDict()
    bob = sessions.metrics(sessions.records(sessions.read(spark, str(tmp_path / "bob"))), sessions.files(spark, str(tmp_path / "bob"))).first().asDict()
    assert {k: v for k, v in got["bob"].items() if k != "profile"} == bob and bob["sessions"] == 3
    assert (got["cy"]["user_turns"], got["cy"]["assistant_turns"], got["cy"]["peak_hour"], got["cy"]["pounce_median_sec"], got["cy"]["models"]) == (1, 0, None, None, {})
    assert got["dee"]["sessions"] == 1 and got["dee"]["user_turns"] == 0 and sum(got["dee"]["hour_histogram"].values()) == 0
    shown = rules.visible_cards(found).collect()
    assert {r.profile for r in shown} >= {"ann", "bob"} and [r.what for r in shown if r.profile == "ann" and r["at"] == 1] == ["The Pouncer"]


def test_metrics_read_their_records_once(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"message": {"role": "user", "content": "hi"}}\n')  # a folder that nothing has cached
    recs = sessions.records(sessions.read(spark, str(tmp_path)))
    plan = sessions.metrics(recs, sessions.files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_no_records_at_all_make_one_row_of_zeros(spark, folder):
    recs = sessions.records(sessions.read(spark, folder)).limit(0)
    m = sessions.metrics(recs, spark.createDataFrame([], "session string")).first()
    assert (m.sessions, m.user_turns, m.tool_calls, m.longest_session_min, m.top_tools, m.tokens["input"]) == (0, 0, 0, 0.0, {}, 0) and len(m.weekday_histogram) == 7


def test_a_stream_of_session_files_equals_one_reading(spark, folder, row, tmp_path):
    import shutil

    root, out, marks = tmp_path / "logs", str(tmp_path / "lines"), str(tmp_path / "marks")
    (root / "ann").mkdir(parents=True)
    shutil.copy(f"{folder}/s0.jsonl", root / "ann")
    sessions.follow(spark, str(root), out, marks)
    first = spark.read.parquet(out)
    assert {r.session for r in first.select("session").distinct().collect()} == {"s0.jsonl"}
    for name in ("s1.jsonl", "s2.jsonl", "empty.jsonl", "other.txt"):
        shutil.copy(f"{folder}/{name}", root / "ann")
    (root / "bob").mkdir()
    shutil.copy(f"{folder}/s1.jsonl", root / "bob")
    for _ in range(2):  # the second finds nothing new
        sessions.follow(spark, str(root), out, marks)
    lines = spark.read.parquet(out).select("profile", "session", "seq", "line")
    want = sessions.read_profiles(spark, str(root))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, want.collect()))
    files = spark.createDataFrame([("ann", f"s{k}.jsonl") for k in range(3)] + [("ann", "empty.jsonl"), ("bob", "s1.jsonl")], "profile string, session string")
    got = {r.profile: r.asDict() for r in sessions.metrics(sessions.records(lines, ("profile",)), files, ("profile",)).collect()}
    assert {k: v for k, v in got["ann"].items() if k != "profile"} == row.first().asDict() and got["bob"]["sessions"] == 1


def test_facts_are_summed_by_hash_and_not_sorted(recs):
    files = recs.select("session").distinct()
    plan = sessions.session_facts(recs, files)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_a_task_gets_no_more_records_of_a_longer_log(spark):
    assert [sessions.parts_of(n, 12) for n in (0, 300_000, 36_000_000)] == [12, 12, 1440]
    recs = sessions.records(spark.createDataFrame([("a", 0, "{}")], "session string, seq int, line string"))
    files = spark.createDataFrame([("a",)], "session string")
    plan = sessions.session_facts(recs, files, parts=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 7), REPARTITION_BY_NUM" in plan
