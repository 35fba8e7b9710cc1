"""Queries of sequence mining and of session metrics over ``events``: a user is a session, ``error`` events are errors.

The event types are nearly uniform here, so that the default thresholds leave nothing; the registered queries pass relaxed
ones, named in their docstrings, and tests cover the defaults on constructed logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import sequences as Q
from ..staging import stage


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    is_error = F.col("event_type") == "error"
    return _raw(spark, sf_dir).select(F.col("user_id").alias("session"), seq.alias("seq"), F.when(is_error, "error").otherwise("tool").alias("kind"), F.when(~is_error, F.col("event_type")).alias("name"))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.session_stats(_events(spark, sf_dir))


def base_tool_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.base_freq(_events(spark, sf_dir)).select("name", "n", F.round("share", 6).alias("share"))


def _markov(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    return Q.markov(_events(spark, sf_dir), order).select(F.array_join("context", ">").alias("context"), "next", "n")


def markov_order1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markov(spark, sf_dir, 1)


def markov_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markov(spark, sf_dir, 2)


def high_lift_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed: any lift from 1.0, without the interval test."""
    return Q.high_lift(_events(spark, sf_dir), min_lift=1.0, above_base=False)


def signature_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the ten most over-represented chains."""
    return Q.signature(_events(spark, sf_dir), top=10)


def post_trigger_rocky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.post_trigger(_events(spark, sf_dir))


def post_trigger_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.post_trigger(_events(spark, sf_dir)).select("trigger", "next_tool", "n", "pct")


def significance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.significance(Q.post_trigger(_events(spark, sf_dir)))


def _steered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors taken as corrections, so that sessions have correction rates."""
    return _events(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "error", "correction").otherwise(F.col("kind")))


def session_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed: purchases stand for plans."""
    return Q.shape(_steered(spark, sf_dir), ("purchase",))


def novelty_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed: a tool is an event type at an hour of the week, so that many tools are rare."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    is_error = F.col("event_type") == "error"
    rows = _raw(spark, sf_dir).select(F.col("user_id").alias("session"), seq.alias("seq"), F.when(is_error, "correction").otherwise("tool").alias("kind"), F.when(~is_error, F.concat_ws("-", "event_type", F.weekday("ts"), F.hour("ts"))).alias("name"))
    return Q.novelty(rows)


def predict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.predict_next(_events(spark, sf_dir), ["view", "click"])


def predict_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes next after every session's last two tools."""
    events = _events(spark, sf_dir)
    found = Q.predict_all(stage(Q.suffixes(events), "suffixes"), Q.last_contexts(events))
    return found.select("session", F.array_join("context", ">").alias("context"), "matched", "total", "at", "next", "n", "pct", "lift")


def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _raw(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _raw(spark, sf_dir).groupBy(F.weekday("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(7).select(F.col("id").cast("int").alias("day")).join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _raw(spark, sf_dir).groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return n.withColumn("at", at).where("at = 1").select("user_id", F.col("hour").alias("peak_hour"), "n")


def night_owl_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return _raw(spark, sf_dir).groupBy("user_id").agg(F.min(F.when(hour <= 4, hour)).alias("night_owl_hour"))


def session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _raw(spark, sf_dir).groupBy("user_id").agg(F.min_by("ts", F.struct("ts", "event_id")).alias("a"), F.max_by("ts", F.struct("ts", "event_id")).alias("b"), F.count(F.lit(1)).alias("turns"))
    minutes = F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 60.0
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.max(minutes), 1).alias("longest_min"), F.round(F.avg(minutes), 1).alias("avg_min"), F.max("turns").alias("max_turns"))


def tool_mix_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Q.tools(_events(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "name").limit(15)


def error_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.count_if(F.col("event_type") == "error")
    rows = _raw(spark, sf_dir).groupBy("user_id").agg(errors.alias("errors"), F.count(F.lit(1)).alias("calls"))
    return rows.select("user_id", "errors", "calls", stats.percent(F.col("errors"), F.col("calls")).alias("error_pct"))


def first_seen_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session, the events whose type and hour of day were met before."""
    at = F.row_number().over(W.partitionBy("user_id", "event_type", F.hour("ts")).orderBy("ts", "event_id"))
    rows = _raw(spark, sf_dir).withColumn("again", at > 1).groupBy("user_id").agg(F.count_if("again").alias("repeats"), F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "repeats", stats.percent(F.col("repeats"), F.col("n")).alias("repeat_pct"))


def lag_since_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "error", F.col("ts")), True).over(before)
    rows = _raw(spark, sf_dir).withColumn("last_error", last).where("event_type = 'purchase' and last_error is not null")
    wait = F.timestamp_diff("SECOND", F.col("last_error"), F.col("ts"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(wait), 1).alias("median_sec"))


def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("event_type", "k", "n", low.alias("low"), high.alias("high"), stats.confidence(F.col("k")).alias("confidence"))


def binomial_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, clicks against views, as if they were votes."""
    c = lambda t: F.count_if(F.col("event_type") == t)
    from ..operators import evaluation

    votes = _raw(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("name")).agg(c("click").alias("engine"), c("view").alias("baseline"))
    return evaluation.judge(votes)


def correction_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_correction(F.col("text"))).alias("corrections"), F.count_if(T.is_reversal(F.col("text"))).alias("reversals"))


def trigger_kind_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return rows.groupBy(F.coalesce(T.trigger_kind(F.col("text")), F.lit("none")).alias("trigger")).agg(F.count(F.lit(1)).alias("n"))


def reversal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    out = rows.agg(F.count(F.lit(1)).alias("prompts"), F.count_if(T.is_reversal(F.col("text"))).alias("reversals"))
    return out.select("prompts", "reversals", stats.percent(F.col("reversals"), F.col("prompts")).alias("per_100"))


_EV = """
    WITH ev AS (
        SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'tool' END AS kind, CASE WHEN event_type <> 'error' THEN event_type END AS name FROM events
    ),
    tools AS (SELECT session, seq, name, row_number() OVER (PARTITION BY session ORDER BY seq) AS pos FROM ev WHERE kind = 'tool'),
    base AS (SELECT name, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM tools GROUP BY name),
    lagged AS (SELECT session, pos, name AS next, lag(name, 1) OVER w AS p1, lag(name, 2) OVER w AS p2, lead(name, 1) OVER w AS n1, lead(name, 2) OVER w AS n2 FROM tools WINDOW w AS (PARTITION BY session ORDER BY pos)),
    model AS (
        SELECT p1 AS context, 1 AS k, next, count(*) AS n FROM lagged WHERE p1 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT p2 || '>' || p1, 2, next, count(*) FROM lagged WHERE p2 IS NOT NULL GROUP BY ALL
    )
"""


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    d = f"(1 + 1.96 * 1.96 / {n})"
    centre = f"(({k} / {n}::DOUBLE + 1.96 * 1.96 / (2 * {n})) / {d})"
    half = f"(1.96 / {d} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 1.96 * 1.96 / (4 * {n}::DOUBLE * {n})))"
    return f"round(100 * greatest(0.0, {centre} - {half}), 1)", f"round(100 * least(1.0, {centre} + {half}), 1)"


_LOW, _HIGH = _wilson_sql("rocky_hits", "rocky_n")
_POST = f"""{_EV}, steps AS (SELECT session, seq, name, lead(seq, 5) OVER (PARTITION BY session ORDER BY seq) AS fifth FROM tools),
    trig AS (SELECT e.session, e.seq, (SELECT min(s.seq) FROM tools s WHERE s.session = e.session AND s.seq > e.seq) AS nxt FROM ev e WHERE e.kind = 'error'),
    hits AS (
        SELECT 'error' AS trigger, s.name AS next_tool, s.fifth,
               (SELECT min(x.seq) FROM ev x WHERE x.session = t.session AND x.kind = 'error' AND x.seq > t.nxt) AS steer
        FROM trig t JOIN steps s ON s.session = t.session AND s.seq = t.nxt
    ),
    g AS (
        SELECT trigger, next_tool, count(*) AS n, count(*) FILTER (WHERE steer IS NOT NULL AND (fifth IS NULL OR steer < fifth)) AS rocky_hits,
               count(*) FILTER (WHERE (steer IS NOT NULL AND (fifth IS NULL OR steer < fifth)) OR fifth IS NOT NULL) AS rocky_n
        FROM hits GROUP BY ALL
    ),
    post AS (
        SELECT trigger, next_tool, n, round(100.0 * n / sum(n) OVER (PARTITION BY trigger)::DOUBLE, 0) AS pct, rocky_n, rocky_hits,
               CASE WHEN rocky_n > 0 THEN round(100.0 * rocky_hits / rocky_n::DOUBLE, 0) END AS rocky_pct, CASE WHEN rocky_n > 0 THEN {_LOW} END AS ci_low, CASE WHEN rocky_n > 0 THEN {_HIGH} END AS ci_high FROM g
    )"""
_W_LOW, _W_HIGH = _wilson_sql("k", "n")


def _keys_sql(column: str, keys: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{k.replace(chr(39), chr(39) * 2)}')" for k in keys) + ")"


_IS_CORRECTION = _keys_sql("left(lower(text), 70)", T.CORRECTION)
_IS_REVERSAL = _keys_sql("lower(text)", T.REVERSAL)

QUERIES = {f.__name__: f for f in (
    session_stats, base_tool_freq, markov_order1, markov_order2, high_lift_moves, signature_chain, post_trigger_rocky, post_trigger_dist, significance_gate, session_shape,
    novelty_tool, predict_next, predict_sessions, hour_histogram, weekday_histogram, peak_hour, night_owl_hour, session_durations, tool_mix_top15, error_pct, first_seen_repeats,
    lag_since_last_error, wilson_by_group, binomial_two_sided, correction_tells, trigger_kind_mix, reversal_rate,
)}

ORACLES = {
    "session_stats": f"""{_EV} SELECT session, count(*) AS n_events, count(*) FILTER (WHERE kind = 'tool') AS n_tools, 0::BIGINT AS n_corrections, count(*) FILTER (WHERE kind = 'error') AS n_errors,
        count(DISTINCT name) AS n_distinct, 0.0::DOUBLE AS correction_rate FROM ev GROUP BY session""",
    "base_tool_freq": f"{_EV} SELECT name, n, round(share, 6) AS share FROM base",
    "markov_order1": f"{_EV} SELECT context, next, n FROM model WHERE k = 1",
    "markov_order2": f"{_EV} SELECT context, next, n FROM model WHERE k = 2",
    "high_lift_moves": f"""{_EV}, m AS (SELECT *, sum(n) OVER (PARTITION BY context)::BIGINT AS total, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS r FROM model),
        x AS (SELECT m.context, m.next, m.n, m.total, m.n / m.total::DOUBLE / b.share AS raw FROM m JOIN base b ON m.next = b.name WHERE r = 1 AND total >= 12)
        SELECT context, next, n, total, round(100.0 * n / total::DOUBLE, 0) AS pct, round(raw, 2) AS lift, round(round(raw, 1) * round(100.0 * n / total::DOUBLE, 0) * ln(total), 3) AS rank_score FROM x WHERE raw >= 1.0""",
    "signature_chain": f"""{_EV}, c AS (SELECT next AS a, n1 AS b, n2 AS c, count(*) AS n FROM lagged WHERE n2 IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, n / sum(n) OVER ()::DOUBLE AS share FROM c), two AS (SELECT list(name) AS l FROM (SELECT name FROM base ORDER BY n DESC, name LIMIT 2)),
        x AS (
            SELECT s.a || '>' || s.b || '>' || s.c AS chain, s.n, s.share / (x.share * y.share * z.share) AS raw
            FROM s JOIN base x ON s.a = x.name JOIN base y ON s.b = y.name JOIN base z ON s.c = z.name, two
            WHERE s.n >= 8 AND NOT (s.a = s.b AND s.b = s.c) AND NOT (list_contains(two.l, s.a) AND list_contains(two.l, s.b) AND list_contains(two.l, s.c))
        )
        SELECT chain, n, round(raw, 3) AS lift, row_number() OVER (ORDER BY raw DESC, n DESC, chain) AS at FROM x ORDER BY raw DESC, n DESC, chain LIMIT 10""",
    "post_trigger_rocky": f"{_POST} SELECT * FROM post",
    "post_trigger_dist": f"{_POST} SELECT trigger, next_tool, n, pct FROM post",
    "significance_gate": f"""{_POST}, r AS (SELECT *, row_number() OVER (PARTITION BY trigger ORDER BY n DESC, next_tool) AS at FROM post)
        SELECT t.trigger, t.next_tool AS usual, (SELECT arg_min(a.next_tool, a.at) FROM r a WHERE a.trigger = t.trigger AND a.at > 1 AND a.n >= 15 AND a.ci_high < t.ci_low) AS better FROM r t WHERE t.at = 1""",
    "session_shape": f"""{_EV}, st AS (SELECT session, count(*) AS c, CASE WHEN count(*) FILTER (WHERE kind = 'tool') > 0 THEN round(100.0 * count(*) FILTER (WHERE kind = 'error') / count(*) FILTER (WHERE kind = 'tool')::DOUBLE, 1) ELSE 0.0 END AS rate FROM ev GROUP BY session),
        h AS (SELECT e.session, bool_or(coalesce(e.seq <= greatest(3, floor(st.c / 5)) AND e.name = 'purchase', false)) AS has FROM ev e JOIN st ON e.session = st.session GROUP BY e.session)
        SELECT count(*) AS sessions, count(*) FILTER (WHERE has) AS n_with, count(*) FILTER (WHERE NOT has) AS n_without, round(avg(rate) FILTER (WHERE has), 3) AS rate_with, round(avg(rate) FILTER (WHERE NOT has), 3) AS rate_without
        FROM st JOIN h ON st.session = h.session HAVING count(*) >= 6 AND count(*) FILTER (WHERE has) >= 3 AND count(*) FILTER (WHERE NOT has) >= 3""",
    "novelty_tool": """WITH ev AS (SELECT user_id AS session, event_type = 'error' AS bad, CASE WHEN event_type <> 'error' THEN event_type || '-' || (isodow(ts) - 1) || '-' || hour(ts) END AS name FROM events),
        r AS (SELECT session, CASE WHEN count(name) > 0 THEN round(100.0 * count(*) FILTER (WHERE bad) / count(name)::DOUBLE, 1) ELSE 0.0 END AS rate FROM ev GROUP BY session), t AS (SELECT count(*) AS m, sum(rate) AS all_sum FROM r),
        p AS (SELECT name, count(*) AS used_in, sum(rate) AS s, min(rate) AS low FROM (SELECT DISTINCT session, name FROM ev WHERE name IS NOT NULL) u JOIN r USING (session) GROUP BY name),
        d AS (SELECT name, used_in, (all_sum - s) / greatest(m - used_in, 1)::DOUBLE AS rest, s, low FROM p, t WHERE m >= 8 AND used_in BETWEEN 3 AND greatest(3, floor(m / 4))),
        o AS (SELECT name, used_in, round(rest - s / used_in, 4) AS delta, round(CASE WHEN used_in > 3 THEN rest - (s - low) / (used_in - 1) ELSE rest - s / used_in END, 4) AS delta_loo FROM d)
        SELECT * FROM o WHERE delta > 0 AND delta_loo > 0""",
    "predict_next": f"""{_EV}, m AS (SELECT *, sum(n) OVER (PARTITION BY k)::BIGINT AS total FROM model WHERE context IN ('view>click', 'click')),
        b AS (SELECT * FROM m WHERE total >= 8 AND k = (SELECT max(k) FROM m WHERE total >= 8))
        SELECT next, b.n, total, round(100 * b.n / total::DOUBLE, 0) AS pct, round(b.n / total::DOUBLE / share, 2) AS lift FROM b JOIN base ON next = name ORDER BY b.n DESC, next LIMIT 5""",
    "predict_sessions": f"""{_EV}, tail AS (
            SELECT session, string_agg(name, '>' ORDER BY place DESC) AS context, max(CASE WHEN place = 1 THEN name END) AS last
            FROM (SELECT session, name, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS place FROM ev WHERE kind = 'tool') WHERE place <= 2 GROUP BY session
        ),
        m AS (SELECT *, sum(n) OVER (PARTITION BY context)::BIGINT AS total, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS "at" FROM model),
        b AS (SELECT session, t.context, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.context = t.context AND total >= 8) THEN t.context ELSE last END AS used FROM tail t)
        SELECT session, b.context, CAST(len(string_split(used, '>')) AS BIGINT) AS matched, total, "at", next, m.n, round(100 * m.n / total::DOUBLE, 0) AS pct, round(m.n / total::DOUBLE / share, 2) AS lift
        FROM b JOIN m ON m.context = b.used JOIN base ON next = name WHERE total >= 8 AND "at" <= 5""",
    "hour_histogram": "SELECT h.hour, count(e.event_id) AS n FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h LEFT JOIN events e ON hour(e.ts) = h.hour GROUP BY h.hour",
    "weekday_histogram": "SELECT d.day, count(e.event_id) AS n FROM (SELECT CAST(range AS INTEGER) AS day FROM range(7)) d LEFT JOIN events e ON (isodow(e.ts) - 1) = d.day GROUP BY d.day",
    "peak_hour": """WITH c AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY ALL)
        SELECT user_id, hour AS peak_hour, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""",
    "night_owl_hour": "SELECT user_id, CAST(min(CASE WHEN hour(ts) <= 4 THEN hour(ts) END) AS INTEGER) AS night_owl_hour FROM events GROUP BY user_id",
    "session_durations": """WITH p AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS turns FROM events GROUP BY user_id)
        SELECT count(*) AS sessions, round(max(s), 1) AS longest_min, round(avg(s), 1) AS avg_min, max(turns) AS max_turns FROM (SELECT turns, floor(epoch(b - a)) / 60.0 AS s FROM p)""",
    "tool_mix_top15": f"{_EV} SELECT name, n FROM base ORDER BY n DESC, name LIMIT 15",
    "error_pct": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS calls, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 1) AS error_pct FROM events GROUP BY user_id",
    "first_seen_repeats": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type, hour(ts) ORDER BY ts, event_id) > 1 AS again FROM events)
        SELECT user_id, count(*) FILTER (WHERE again) AS repeats, round(100.0 * count(*) FILTER (WHERE again) / count(*)::DOUBLE, 1) AS repeat_pct FROM r GROUP BY user_id""",
    "lag_since_last_error": """WITH r AS (SELECT user_id, event_type, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events)
        SELECT user_id, count(*) AS n, round(median(floor(epoch(ts - last_error))), 1) AS median_sec FROM r WHERE event_type = 'purchase' AND last_error IS NOT NULL GROUP BY user_id""",
    "wilson_by_group": f"""WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 50) AS k, count(*) AS n FROM events GROUP BY event_type)
        SELECT event_type, k, n, {_W_LOW} AS low, {_W_HIGH} AS high, CASE WHEN k >= 40 THEN 'high' WHEN k >= 15 THEN 'medium' ELSE 'low' END AS confidence FROM g""",
    "correction_tells": f"SELECT role, count(*) AS n, count(*) FILTER (WHERE {_IS_CORRECTION}) AS corrections, count(*) FILTER (WHERE {_IS_REVERSAL}) AS reversals FROM conversations GROUP BY role",
    "trigger_kind_mix": f"SELECT CASE WHEN {_IS_CORRECTION} THEN 'correction' WHEN {_IS_REVERSAL} THEN 'reversal' ELSE 'none' END AS trigger, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "reversal_rate": f"SELECT count(*) AS prompts, count(*) FILTER (WHERE {_IS_REVERSAL}) AS reversals, round(100.0 * count(*) FILTER (WHERE {_IS_REVERSAL}) / greatest(count(*), 1)::DOUBLE, 1) AS per_100 FROM conversations WHERE role = 'user'",
    "binomial_two_sided": """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS name, count(*) FILTER (WHERE event_type = 'click') AS engine, count(*) FILTER (WHERE event_type = 'view') AS baseline FROM events GROUP BY user_id),
        l AS (SELECT name, engine, baseline, engine + baseline AS n, unnest(range(0, engine + baseline + 1)) AS i FROM v),
        p AS (SELECT name, engine, baseline, n, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS lc, lgamma(n + 1) - lgamma(engine + 1) - lgamma(n - engine + 1) AS own FROM l),
        t AS (SELECT name, engine, baseline, n, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, sum(CASE WHEN exp(lc - own) <= 1 + 1e-9 THEN exp(lc - n * ln(2.0)) ELSE 0.0 END)) END AS p FROM p GROUP BY name, engine, baseline, n)
        SELECT name, engine, baseline, n AS decisive, round(p, 6) AS p_value, CASE WHEN n = 0 THEN 'undecided' WHEN p >= 0.05 THEN 'inconclusive' WHEN engine > baseline THEN 'engine' ELSE 'baseline' END AS verdict FROM t""",
}
