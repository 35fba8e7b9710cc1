"""Queries of session logs: ``events`` written as the JSON lines of an agent's sessions, read back by the operators.

A user is a session and an event a record: errors are tool results, sign-ups prompts (some corrective, some injected by the
system), the rest assistant turns with thoughts and tool calls. Ids decide what a record holds; some times are broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sessions as S
from ..staging import stage
from . import rules
from .rule_queries import CARDS_SQL, EDGES_SQL, REPORTS_SQL, RULES_SQL
from .sequence_queries import _keys_sql

#: Users whose numbers leave the same remainder share a profile, as if their sessions lay in one folder.
PROFILES = 20
PROMPTS = (
    "<system-reminder>wait</system-reminder> ", "No, that is wrong", "Go on please", "Please revert it", "Thank you wait a bit",
    "Fine, and scratch that<system-reminder>no, stop</system-reminder>",
)
MODELS = ("opus-a", "opus-b", "sonnet-a", "", "haiku-a")
BUYS = ("Write", "Agent", "TodoWrite", "mcp__one__go", "mcp__two__go", "Workflow", "")
MAPS = ("hour_histogram", "weekday_histogram", "models", "top_tools", "top_mcp_servers", "tokens")
_IN_BLOCKS = 4  # the prompt that comes as two blocks of text


def _pick(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values)).cast("int") + 1)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, line)"""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    e, kind = F.col("event_id"), F.col("event_type")
    path = lambda n: F.struct(F.concat(F.lit("/f/"), (e % n).cast("string")).alias("file_path"))
    none = F.struct(F.lit(None).cast("string").alias("file_path"))
    name = F.when(kind == "view", "Read").when(kind == "click", F.when(e % 2 == 0, "Edit").otherwise("Bash")).otherwise(_pick(BUYS))
    call = lambda n, p: F.struct(F.lit("tool_use").alias("type"), n.alias("name"), p.alias("input"))
    calls = F.slice(F.array(call(name, F.when(name.isin("Read", "Edit", "Write"), path(20)).otherwise(none)), call(F.lit("Read"), path(7)), call(F.lit("Bash"), none)), 1, (e % 4).cast("int"))
    thought = F.struct(F.lit("thinking").alias("type"), F.repeat(F.lit("x"), (e % 50).cast("int")).alias("thinking"))
    joined = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    turn = joined(F.concat(F.when(e % 3 == 0, F.array(F.to_json(thought))).otherwise(F.array().cast("array<string>")), F.transform(calls, lambda c: F.to_json(c))))
    result = lambda bad: F.to_json(F.struct(F.lit("tool_result").alias("type"), bad.alias("is_error")))
    results = joined(F.when(e % 5 == 0, F.array(result(e % 4 != 0), result(F.lit(True)))).otherwise(F.array(result(e % 4 != 0))))
    said = joined(F.transform(F.array(F.lit("Thank you"), F.lit("wait a bit")), lambda t: F.to_json(F.struct(F.lit("text").alias("type"), t.alias("text")))))
    prompt = F.when(e % len(PROMPTS) == _IN_BLOCKS, said).otherwise(_pick(PROMPTS))
    user = kind.isin("error", "signup")
    usage = F.struct((e % 1000).alias("input_tokens"), (e % 77).alias("output_tokens"), F.when(e % 3 > 0, e % 13).alias("cache_read_input_tokens"), F.lit(1).alias("cache_creation_input_tokens"))
    record = F.struct(
        F.when(e % 97 == 0, "soon").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).alias("timestamp"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("b"), (e % 4).cast("string"))).alias("gitBranch"),
        F.struct(
            F.when(user, "user").otherwise("assistant").alias("role"), F.when(~user, _pick(MODELS)).alias("model"),
            F.when(kind == "error", results).when(kind == "signup", prompt).otherwise(turn).alias("content"), F.when(~user, usage).alias("usage"),
        ).alias("message"),
        F.when(e % 50 == 0, F.struct(F.lit(True).alias("interrupted"))).alias("toolUseResult"),
    )
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select(F.format_string("s%d.jsonl", "user_id").alias("session"), seq.alias("seq"), F.to_json(record).alias("line"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    files = lines.select("session").distinct().unionByName(spark.range(1).select(F.lit("empty.jsonl").alias("session")))
    return S.metrics(stage(S.records(lines), "records"), files)


def _profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics for each profile; the first has an empty session besides."""
    number = F.regexp_extract("session", r"\d+", 0).cast("int") % PROFILES
    lines = _lines(spark, sf_dir).withColumn("profile", F.format_string("p%02d", number))
    files = lines.select("profile", "session").distinct().unionByName(spark.range(1).select(F.lit("p00").alias("profile"), F.lit("empty.jsonl").alias("session")))
    return S.metrics(S.records(lines, ("profile",)), files, ("profile",))


def profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that are one number, for every profile at once."""
    return _profile_metrics(spark, sf_dir).drop(*MAPS, "tokens_by_model")


def profile_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetype and cards of every profile, from the metrics of its session logs."""
    return rules.visible_cards(stage(_profile_metrics(spark, sf_dir), "profile-metrics"))


def profile_edges_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.edges_and_taxes(stage(_profile_metrics(spark, sf_dir), "profile-metrics"))
    return found.select("profile", "side", "key", "family", F.col("priority").cast("long").alias("priority"))


def profile_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetype and numbers of edges, taxes and moves of every profile, from the metrics of its session logs."""
    out = rules.report(stage(_profile_metrics(spark, sf_dir), "profile-metrics"))
    n = lambda side: F.coalesce(F.size(side), F.lit(0)).alias(f"n_{side}")
    return out.select("profile", F.col("archetype.name").alias("archetype"), n("edges"), n("taxes"), n("moves"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(S.records(_lines(spark, sf_dir))).withColumn("seq", F.col("seq").cast("long"))


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that are one number, over a log with an empty session besides."""
    return _metrics(spark, sf_dir).drop(*MAPS, "tokens_by_model")


def session_metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that are maps, a row for each key; models' tokens have both names in theirs."""
    row = _metrics(spark, sf_dir)
    flat = lambda name, m: F.transform(F.map_entries(m), lambda x: F.struct(F.lit(name).alias("metric"), x["key"].alias("key"), x["value"].cast("long").alias("n")))
    by_model = F.transform(F.map_entries("tokens_by_model"), lambda x: F.transform(F.map_entries(x["value"]), lambda y: F.struct(F.lit("tokens_by_model").alias("metric"), F.concat_ws(".", x["key"], y["key"]).alias("key"), y["value"].cast("long").alias("n"))))
    return row.select(F.inline(F.concat(*(flat(m, F.col(m)) for m in MAPS), F.flatten(by_model))))


def _array(values: tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[event_id % {len(values)} + 1]"


_STRIPPED = f"nullif(trim(regexp_replace({_array(PROMPTS)}, '(?s)<system-reminder>.*?</system-reminder>', '', 'g')), '')"
_LOG = f"""
    WITH rec AS (
        SELECT 's' || user_id || '.jsonl' AS session, 'p' || lpad(CAST(user_id % {PROFILES} AS VARCHAR), 2, '0') AS profile, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type,
               event_type NOT IN ('error', 'signup') AS bot, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, CASE WHEN event_type = 'signup' THEN {_STRIPPED} END AS prompt,
               CASE WHEN event_type = 'error' THEN CAST(event_id % 4 <> 0 AS INTEGER) + CAST(event_id % 5 = 0 AS INTEGER) ELSE 0 END AS n_errors,
               CASE WHEN event_type NOT IN ('error', 'signup') THEN nullif({_array(MODELS)}, '') END AS model
        FROM events
    ),
    said AS (SELECT *, coalesce({_keys_sql("left(lower(prompt), 70)", T.CORRECTION)}, false) AS corrects, coalesce({_keys_sql("lower(prompt)", T.REVERSAL)}, false) AS reverses,
        max(CASE WHEN bot THEN ts END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_bot FROM rec),
    firsts AS (SELECT profile, session, seq, event_id, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Edit' ELSE 'Bash' END ELSE coalesce(nullif({_array(BUYS)}, ''), '?') END AS name FROM rec WHERE bot),
    uses AS (
        SELECT profile, session, seq, 0 AS pos, name, CASE WHEN name IN ('Read', 'Edit', 'Write') THEN '/f/' || (event_id % 20) END AS path FROM firsts WHERE event_id % 4 >= 1
        UNION ALL SELECT profile, session, seq, 1, 'Read', '/f/' || (event_id % 7) FROM firsts WHERE event_id % 4 >= 2
        UNION ALL SELECT profile, session, seq, 2, 'Bash', NULL FROM firsts WHERE event_id % 4 = 3
    ),
    again AS (SELECT *, name = 'Read' AND row_number() OVER (PARTITION BY session, name, path ORDER BY seq, pos) > 1 AS again, CASE WHEN name LIKE 'mcp%' THEN split_part(name, '__', 2) END AS server FROM uses),
    timed AS (SELECT *, CAST(hour(ts) AS INTEGER) AS h, CAST(isodow(ts) - 1 AS INTEGER) AS d FROM rec WHERE ts IS NOT NULL),
    fam AS (SELECT *, CASE WHEN contains(model, 'opus') THEN 'opus' WHEN contains(model, 'sonnet') THEN 'sonnet' WHEN contains(model, 'haiku') THEN 'haiku' ELSE 'other' END AS family FROM rec WHERE model IS NOT NULL),
    tok AS (
        SELECT event_id, 'input' AS token, event_id % 1000 AS n FROM rec WHERE bot UNION ALL SELECT event_id, 'output', event_id % 77 FROM rec WHERE bot
        UNION ALL SELECT event_id, 'cache_read', CASE WHEN event_id % 3 > 0 THEN event_id % 13 ELSE 0 END FROM rec WHERE bot UNION ALL SELECT event_id, 'cache_creation', 1 FROM rec WHERE bot
    )
"""
_PCT = "round(100.0 * ({}) / greatest({}, 1)::DOUBLE, 1)"
_PER = "round(({}) / greatest({}, 1)::DOUBLE, {})"

_BY_PROFILE = f"""{_LOG}, waits AS (SELECT profile, epoch_us(ts - last_bot) / 1e6 AS w FROM said WHERE corrects AND ts > last_bot AND ts - last_bot < INTERVAL 1 HOUR),
    m1 AS (
        SELECT profile, count(*) FILTER (WHERE NOT bot) AS user_turns, count(prompt) AS real_user_prompts, count(*) FILTER (WHERE bot) AS assistant_turns, count(*) FILTER (WHERE reverses) AS reversal_count,
               sum(n_errors)::BIGINT AS tool_errors, count(*) FILTER (WHERE event_id % 50 = 0) AS bash_interrupted, count(*) FILTER (WHERE bot AND event_id % 3 = 0) AS thinking_blocks,
               coalesce(sum(event_id % 50) FILTER (WHERE bot AND event_id % 3 = 0), 0)::BIGINT AS thinking_chars, count(*) FILTER (WHERE bot AND event_id % 4 > 1) AS multi_tool_turns,
               CAST(coalesce(max(event_id % 4) FILTER (WHERE bot), 0) AS INTEGER) AS max_parallel_tools, count(DISTINCT nullif(event_id % 4, 0)) AS git_branches,
               CAST(min(CASE WHEN hour(ts) <= 4 THEN hour(ts) END) AS INTEGER) AS night_owl_hour, {_PCT.format("count(*) FILTER (WHERE contains(model, 'opus'))", "count(model)")} AS opus_pct
        FROM said GROUP BY profile
    ),
    c1 AS (SELECT profile, round(median(w), 1) AS pounce_median_sec, count(*) AS corrections_caught FROM waits GROUP BY profile),
    t1 AS (
        SELECT profile, count(*) AS tool_calls, count(*) FILTER (WHERE name = 'Read') AS "read", count(*) FILTER (WHERE name = 'Edit') AS edit, count(*) FILTER (WHERE name = 'Write') AS "write",
               count(*) FILTER (WHERE name = 'Bash') AS bash, count(*) FILTER (WHERE again) AS reread_events, count(*) FILTER (WHERE name = 'Workflow') AS workflow_calls,
               count(*) FILTER (WHERE name IN ('Agent', 'Task')) AS agent_calls, count(*) FILTER (WHERE name = 'TodoWrite') AS todo_calls, count(server) AS mcp_calls, count(DISTINCT server) AS mcp_servers_used
        FROM again GROUP BY profile
    ),
    f1 AS (SELECT profile, count(*) AS distinct_files_edited, max(n) AS most_churned_file_edits FROM (SELECT profile, path, count(*) AS n FROM uses WHERE name IN ('Edit', 'Write') GROUP BY profile, path) GROUP BY profile),
    p1 AS (SELECT profile, session, count(*) FILTER (WHERE bot) AS turns, epoch_us(max(ts) - min(ts)) / 60e6 AS minutes FROM rec GROUP BY profile, session),
    s1 AS (
        SELECT profile, count(*) + CASE WHEN profile = 'p00' THEN 1 ELSE 0 END AS sessions, coalesce(round(max(minutes), 1), 0) AS longest_session_min, coalesce(round(avg(minutes), 1), 0) AS avg_session_min,
               coalesce(round(sum(minutes) / 60, 1), 0) AS total_active_hours, max(turns) AS max_turns_in_session
        FROM p1 GROUP BY profile
    ),
    k1 AS (SELECT profile, h AS peak_hour FROM (SELECT profile, h, row_number() OVER (PARTITION BY profile ORDER BY count(*) DESC, min((session, seq))) AS place FROM timed GROUP BY profile, h) WHERE place = 1),
    pm AS (
        SELECT m1.*, pounce_median_sec, coalesce(corrections_caught, 0) AS corrections_caught, coalesce(tool_calls, 0) AS tool_calls, coalesce("read", 0) AS "read", coalesce(edit, 0) AS edit, coalesce("write", 0) AS "write",
               coalesce(bash, 0) AS bash, coalesce(reread_events, 0) AS reread_events, coalesce(workflow_calls, 0) AS workflow_calls, coalesce(agent_calls, 0) AS agent_calls, coalesce(todo_calls, 0) AS todo_calls,
               coalesce(mcp_calls, 0) AS mcp_calls, coalesce(mcp_servers_used, 0) AS mcp_servers_used, coalesce(distinct_files_edited, 0) AS distinct_files_edited, coalesce(most_churned_file_edits, 0) AS most_churned_file_edits,
               sessions, longest_session_min, avg_session_min, total_active_hours, max_turns_in_session, peak_hour
        FROM m1 LEFT JOIN c1 USING (profile) LEFT JOIN t1 USING (profile) LEFT JOIN f1 USING (profile) LEFT JOIN s1 USING (profile) LEFT JOIN k1 USING (profile)
    ),
    pr AS (
        SELECT *, {_PCT.format("reversal_count", "real_user_prompts")} AS reversal_rate_per_100, {_PER.format('"read"', "edit", 1)} AS read_to_edit_ratio, {_PER.format('"read"', '"write"', 1)} AS read_to_write_ratio,
               {_PCT.format("reread_events", '"read"')} AS reread_pct, {_PCT.format("tool_errors", "tool_calls")} AS tool_error_pct, {_PER.format("thinking_chars", "assistant_turns", 0)} AS avg_thinking_chars_per_turn
        FROM pm
    )
"""
#: The names that the rules' SQL has for metrics; the logs hold no browser, and no tools that track tasks but one.
_FOR_RULES = f"""{_BY_PROFILE},
    times AS (SELECT profile, count(*) FILTER (WHERE h BETWEEN 6 AND 12) AS morning, count(*) FILTER (WHERE h BETWEEN 2 AND 4) AS night, count(*) FILTER (WHERE d >= 5) * 100.0 / greatest(count(*), 1)::DOUBLE AS wk FROM timed GROUP BY profile),
    less AS (SELECT profile, count(*) FILTER (WHERE family IN ('haiku', 'sonnet')) AS smaller FROM fam GROUP BY profile),
    cached AS (SELECT rec.profile, sum(n)::BIGINT AS cache FROM tok JOIN rec USING (event_id) WHERE token = 'cache_read' GROUP BY rec.profile),
    m AS (
        SELECT profile, assistant_turns AS turns, greatest(tool_calls, 1) AS calls, corrections_caught AS corrections, reversal_rate_per_100 AS rev, read_to_edit_ratio AS r2e, reread_pct AS reread, distinct_files_edited AS files,
               most_churned_file_edits AS churn, workflow_calls + agent_calls AS dispatches, todo_calls AS planning, opus_pct AS opus, avg_session_min AS avg_min, bash, 0 AS browser,
               CASE WHEN distinct_files_edited > 0 THEN round(edit / distinct_files_edited::DOUBLE, 1) ELSE 0.0 END AS epf, CASE WHEN distinct_files_edited > 0 THEN round((edit + "write") / distinct_files_edited::DOUBLE, 1) ELSE 0.0 END AS tpf,
               mcp_servers_used AS servers, wk, morning, night, pounce_median_sec AS pounce, reversal_count AS reversals, coalesce(nullif(real_user_prompts, 0), greatest(assistant_turns, 1)) AS prompts, coalesce(cache, 0) AS cache,
               max_turns_in_session AS max_turns, coalesce(smaller, 0) AS smaller, sessions
        FROM pr LEFT JOIN times USING (profile) LEFT JOIN less USING (profile) LEFT JOIN cached USING (profile)
    ), {RULES_SQL}
"""

QUERIES = {f.__name__: f for f in (session_events, session_metrics, session_metric_maps, profile_metrics, profile_cards, profile_edges_taxes, profile_reports)}
ORACLES = {
    "profile_metrics": f"{_BY_PROFILE} SELECT * FROM pr",
    "profile_cards": f"{_FOR_RULES}, {CARDS_SQL}",
    "profile_reports": f"{_FOR_RULES}, {REPORTS_SQL}",
    "profile_edges_taxes": f"{_FOR_RULES} {EDGES_SQL}",
    "session_events": f"""{_LOG}, every AS (
            SELECT session, seq, pos, 'tool' AS kind, name FROM uses UNION ALL SELECT session, seq, 0, 'error', NULL FROM rec WHERE n_errors > 0
            UNION ALL SELECT session, seq, 0, CASE WHEN corrects THEN 'correction' ELSE 'reversal' END, NULL FROM said WHERE corrects OR reverses
        )
        SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq, pos) AS seq, kind, name FROM every""",
    "session_metrics": f"""{_LOG}, waits AS (SELECT epoch_us(ts - last_bot) / 1e6 AS w FROM said WHERE corrects AND ts > last_bot AND ts - last_bot < INTERVAL 1 HOUR),
        m AS (
            SELECT count(*) FILTER (WHERE NOT bot) AS user_turns, count(prompt) AS real_user_prompts, count(*) FILTER (WHERE bot) AS assistant_turns, count(*) FILTER (WHERE reverses) AS reversal_count,
                   sum(n_errors)::BIGINT AS tool_errors, count(*) FILTER (WHERE event_id % 50 = 0) AS bash_interrupted, count(*) FILTER (WHERE bot AND event_id % 3 = 0) AS thinking_blocks,
                   coalesce(sum(event_id % 50) FILTER (WHERE bot AND event_id % 3 = 0), 0)::BIGINT AS thinking_chars, count(*) FILTER (WHERE bot AND event_id % 4 > 1) AS multi_tool_turns,
                   CAST(coalesce(max(event_id % 4) FILTER (WHERE bot), 0) AS INTEGER) AS max_parallel_tools, count(DISTINCT nullif(event_id % 4, 0)) AS git_branches,
                   CAST(min(CASE WHEN hour(ts) <= 4 THEN hour(ts) END) AS INTEGER) AS night_owl_hour, {_PCT.format("count(*) FILTER (WHERE contains(model, 'opus'))", "count(model)")} AS opus_pct
            FROM said
        ),
        c AS (SELECT round(median(w), 1) AS pounce_median_sec, count(*) AS corrections_caught FROM waits),
        t AS (
            SELECT count(*) AS tool_calls, count(*) FILTER (WHERE name = 'Read') AS "read", count(*) FILTER (WHERE name = 'Edit') AS edit, count(*) FILTER (WHERE name = 'Write') AS "write",
                   count(*) FILTER (WHERE name = 'Bash') AS bash, count(*) FILTER (WHERE again) AS reread_events, count(*) FILTER (WHERE name = 'Workflow') AS workflow_calls,
                   count(*) FILTER (WHERE name IN ('Agent', 'Task')) AS agent_calls, count(*) FILTER (WHERE name = 'TodoWrite') AS todo_calls, count(server) AS mcp_calls, count(DISTINCT server) AS mcp_servers_used
            FROM again
        ),
        f AS (SELECT count(*) AS distinct_files_edited, coalesce(max(n), 0) AS most_churned_file_edits FROM (SELECT path, count(*) AS n FROM uses WHERE name IN ('Edit', 'Write') GROUP BY path)),
        p AS (SELECT session, count(*) FILTER (WHERE bot) AS turns, epoch_us(max(ts) - min(ts)) / 60e6 AS minutes FROM rec GROUP BY session),
        s AS (SELECT count(*) + 1 AS sessions, round(max(minutes), 1) AS longest_session_min, round(avg(minutes), 1) AS avg_session_min, round(sum(minutes) / 60, 1) AS total_active_hours, max(turns) AS max_turns_in_session FROM p),
        k AS (SELECT h AS peak_hour FROM timed GROUP BY h ORDER BY count(*) DESC, min((session, seq)) LIMIT 1)
        SELECT *, {_PCT.format("reversal_count", "real_user_prompts")} AS reversal_rate_per_100, {_PER.format('"read"', "edit", 1)} AS read_to_edit_ratio, {_PER.format('"read"', '"write"', 1)} AS read_to_write_ratio,
               {_PCT.format("reread_events", '"read"')} AS reread_pct, {_PCT.format("tool_errors", "tool_calls")} AS tool_error_pct, {_PER.format("thinking_chars", "assistant_turns", 0)} AS avg_thinking_chars_per_turn
        FROM m, c, t, f, s, k""",
    "session_metric_maps": f"""{_LOG}
        SELECT 'hour_histogram' AS metric, CAST(x AS VARCHAR) AS key, count(h) AS n FROM (SELECT unnest(range(24)) AS x) LEFT JOIN timed ON h = x GROUP BY x
        UNION ALL SELECT 'weekday_histogram', CAST(x AS VARCHAR), count(d) FROM (SELECT unnest(range(7)) AS x) LEFT JOIN timed ON d = x GROUP BY x
        UNION ALL SELECT 'models', family, count(*) FROM fam GROUP BY family
        UNION ALL SELECT 'top_tools', name, n FROM (SELECT name, count(*) AS n FROM uses GROUP BY name ORDER BY n DESC, name LIMIT 15)
        UNION ALL SELECT 'top_mcp_servers', server, n FROM (SELECT server, count(*) AS n FROM again WHERE server IS NOT NULL GROUP BY server ORDER BY n DESC, server LIMIT 10)
        UNION ALL SELECT 'tokens', token, sum(n)::BIGINT FROM tok GROUP BY token
        UNION ALL SELECT 'tokens_by_model', family || '.' || token, sum(n)::BIGINT FROM tok JOIN fam ON tok.event_id = fam.event_id GROUP BY ALL""",
}
