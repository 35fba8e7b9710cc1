"""Session logs (JSON lines, one file a session) into records, ordered events and one row of metrics.

Lines are numbered by file and position, never by time. A record's ``content`` is read as text that may hold a JSON array
of blocks. Everything that leaves is a count, a rate or a coarse name; paths are hashed before they are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T

RECORD = (
    "timestamp string, gitBranch string, message struct<role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>, toolUseResult struct<interrupted:boolean>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,input:struct<file_path:string>,is_error:boolean>>"
TOKENS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(session, seq, line): the lines of ``*.jsonl`` directly in ``folder``, in their order."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    placed = raw.select(F.col("_metadata.file_name").alias("session"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    seq = F.row_number().over(W.partitionBy("session").orderBy("_block", "_id"))
    return placed.select("session", seq.alias("seq"), "line")


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """(profile, session, seq, line): the lines of ``*.jsonl`` in each folder directly in ``root``; the folder is the profile."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(f"{root.rstrip('/')}/*/")
    profile = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    placed = raw.select(profile.alias("profile"), F.col("_metadata.file_name").alias("session"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    seq = F.row_number().over(W.partitionBy("profile", "session").orderBy("_block", "_id"))
    return placed.select("profile", "session", seq.alias("seq"), "line")


def follow(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Appends the lines of session files that are new under ``root`` to the table ``out`` (profile, session, seq, line), and ends.

    Spark's file stream gives each file to one batch, whole, and remembers which it has seen; numbers are those that
    ``read_profiles`` gives. A batch that is repeated after a failure replaces what it had written.
    """
    raw = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(f"{root.rstrip('/')}/*/")
    named = raw.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("profile"), F.col("_metadata.file_name").alias("session"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"),
    )

    def put(batch: DataFrame, number: int) -> None:
        seq = F.row_number().over(W.partitionBy("profile", "session").orderBy("_block", "_id"))
        lines = batch.withColumn("_id", F.monotonically_increasing_id()).select("profile", "session", seq.alias("seq"), "line")
        lines.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file, empty ones too."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.jsonl")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return spark.createDataFrame([(f.getPath().getName(),) for f in found], "session string")


def records(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines that are JSON objects, with their parts; blank and broken lines are left out. Columns named in ``by`` stay."""
    o = F.from_json("line", RECORD)
    rows = lines.where(T.trim_ws(F.col("line")).startswith("{")).select(*by, "session", "seq", o.alias("o"))
    m = F.col("o.message")
    out = rows.select(
        *by, "session", "seq", F.col("o.timestamp").alias("at"), T.parse_ts(F.col("o.timestamp")).alias("ts"), F.nullif(F.col("o.gitBranch"), F.lit("")).alias("branch"),
        m["role"].alias("role"), F.nullif(m["model"], F.lit("")).alias("model"), m["content"].alias("content"), m["usage"].alias("usage"),
        F.coalesce(F.col("o.toolUseResult.interrupted") & m.isNotNull(), F.lit(False)).alias("interrupted"), F.when(F.ltrim(m["content"]).startswith("["), F.from_json(m["content"], BLOCKS)).alias("blocks"),
    )
    some = F.coalesce("blocks", F.array().cast(BLOCKS))
    texts = F.transform(F.filter(some, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    raw = F.when(F.col("blocks").isNull(), F.coalesce("content", F.lit(""))).otherwise(F.array_join(texts, " "))
    has_result = F.exists(some, lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False)))
    errors = F.size(F.filter(some, lambda b: (b["type"] == "tool_result") & b["is_error"]))
    is_user = F.col("role") == "user"
    prompt = F.when(is_user & ~has_result, F.nullif(T.strip_system(raw), F.lit("")))
    out = out.select("*", some.alias("_some"), (is_user & has_result).alias("is_result"), prompt.alias("prompt"), F.when(is_user & has_result, errors).otherwise(0).alias("n_errors"))
    return out.withColumn("blocks", F.col("_some")).drop("_some")


def tool_uses(recs: DataFrame) -> DataFrame:
    """(session, seq, at, name, path) of each tool call of assistant records."""
    rows = recs.where("role = 'assistant'").select("session", "seq", F.posexplode("blocks").alias("at", "b")).where("b.type = 'tool_use'")
    return rows.select("session", "seq", "at", F.coalesce(F.nullif(F.col("b.name"), F.lit("")), F.lit("?")).alias("name"), F.sha1(F.nullif(F.col("b.input.file_path"), F.lit(""))).alias("path"))


def events(recs: DataFrame) -> DataFrame:
    """Ordered events (session, seq, kind, name) for sequence mining: tools, one error a record, and triggers of prompts."""
    tool = tool_uses(recs).select("session", "seq", "at", F.lit("tool").alias("kind"), "name")
    none = F.lit(None).cast("string").alias("name")
    error = recs.where("n_errors > 0").select("session", "seq", F.lit(0).alias("at"), F.lit("error").alias("kind"), none)
    said = recs.where("prompt is not null").select("session", "seq", F.lit(0).alias("at"), T.trigger_kind(F.col("prompt")).alias("kind"), none).where("kind is not null")
    seq = F.row_number().over(W.partitionBy("session").orderBy("seq", "at"))
    return tool.unionByName(error).unionByName(said).select("session", seq.alias("seq"), "kind", "name")


#: Counted over records, summed by session first.
_SUMS = ("user_turns", "real_user_prompts", "assistant_turns", "reversal_count", "tool_errors", "bash_interrupted", "thinking_blocks", "thinking_chars", "multi_tool_turns", "_opus", "_with_model")
TOP = {"tool": 15, "server": 10}
#: Records of a partition.
PART_ROWS = 25_000


def parts_of(n: int, least: int) -> int:
    """How many partitions ``n`` records are dealt to: so many that a task's share of them doesn't grow with the log."""
    return max(least, -(-n // PART_ROWS))


def facts(recs: DataFrame, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(by, session, seq, ts, f struct<fact, key, x>, c, u): everything that the metrics count, as one stream.

    Each record names its session, branch, model, hour, day, wait before a correction, and its tools with their servers and
    paths. ``c`` are the record's own counts and ``u`` its tokens; they are taken where the fact is the session (or model).
    Sessions are dealt to ``parts`` partitions, or as Spark is set.
    """
    if parts:
        recs = recs.repartition(parts, *by, "session")
    before = W.partitionBy(*by, "session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    is_user, is_assistant = F.col("role") == "user", F.col("role") == "assistant"
    recs = recs.withColumn("_last", F.last(F.when(is_assistant, F.col("ts")), True).over(before))
    wait = (F.unix_micros("ts") - F.unix_micros("_last")) / 1e6
    caught = F.when(T.is_correction(F.col("prompt")) & (wait > 0) & (wait < 3600), wait)
    of_type = lambda kind: F.when(is_assistant, F.filter("blocks", lambda b: b["type"] == kind)).otherwise(F.slice("blocks", 1, 0))
    thinking, uses = of_type("thinking"), of_type("tool_use")
    clock = T.own_clock(F.col("at"))
    hour = F.when(F.col("ts").isNotNull(), F.hour(clock))
    model = F.when(is_assistant, F.col("model"))
    one = lambda holds: F.coalesce(holds, F.lit(False)).cast("long")
    chars = F.aggregate(thinking, F.lit(0), lambda s, b: s + F.coalesce(F.length(b["thinking"]), F.lit(0))).cast("long")
    counts = (
        one(is_user), one(F.col("prompt").isNotNull()), one(is_assistant), one(T.is_reversal(F.col("prompt"))), F.col("n_errors").cast("long"), one(F.col("interrupted")),
        F.size(thinking).cast("long"), chars, one(F.size(uses) > 1), one(model.contains("opus")), one(model.isNotNull()),
    )
    counted = F.struct(*(c.alias(n) for n, c in zip(_SUMS, counts, strict=True)), F.size(uses).alias("tools"), F.when(hour <= 4, hour).alias("night"))
    tokens = F.struct(*(F.when(is_assistant, F.col("usage")[c]).alias(k) for k, c in TOKENS.items()))
    fact = lambda name, key, x=None: F.struct(F.lit(name).alias("fact"), key.cast("string").alias("key"), (F.lit(None) if x is None else x).cast("double").alias("x"))

    def of_use(b: Column) -> Column:
        name, path = F.coalesce(F.nullif(b["name"], F.lit("")), F.lit("?")), F.sha1(F.nullif(b["input"]["file_path"], F.lit("")))
        return F.array(
            fact("tool", name), fact("server", T.mcp_server(name)), fact("path", F.when((name == "Read") & path.isNotNull(), F.concat_ws("/", "session", path))), fact("edited", F.when(name.isin("Edit", "Write"), path)),
        )

    own = F.array(fact("session", F.col("session")), fact("branch", F.col("branch")), fact("model", F.when(model.isNotNull(), T.model_family(model))), fact("hour", hour), fact("day", F.when(F.col("ts").isNotNull(), F.weekday(clock))), fact("wait", caught, caught))
    every = F.filter(F.concat(own, F.flatten(F.transform(uses, of_use))), lambda f: f["key"].isNotNull())
    return recs.select(*by, "session", "seq", "ts", counted.alias("c"), tokens.alias("u"), F.explode(every).alias("f"))


def session_facts(recs: DataFrame, sessions: DataFrame, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Facts summed by session, fact and key. All sums are numbers, so that they are hashed and no fact is sorted.

    A session's records stand together already, so that its facts are summed where they are made. Each of ``sessions``, empty
    ones too, has a fact of its own besides, without sums.
    """
    here = F.col("f.fact") == "session"
    timed = F.when(here & F.col("ts").isNotNull(), F.col("seq"))
    summed = facts(recs, by, parts).groupBy(*by, "session", F.col("f.fact").alias("fact"), F.col("f.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max("f.x").alias("x"), F.min("seq").alias("seq"), *(F.sum(F.when(here, F.col(f"c.{c}"))).alias(c) for c in _SUMS),
        F.max(F.when(here, F.col("c.tools"))).alias("_tools"), F.min(F.when(here, F.col("c.night"))).alias("_night"), *(F.sum(F.when(F.col("f.fact").isin("session", "model"), F.col(f"u.{k}"))).alias(f"_{k}") for k in TOKENS),
        F.min_by("ts", timed).alias("_from"), F.max_by("ts", timed).alias("_to"),
    )
    files = sessions.select(*by, "session", F.lit("session").alias("fact"), F.col("session").alias("key"), F.lit(1).cast("long").alias("n"))
    return summed.unionByName(files, allowMissingColumns=True)


def metrics(recs: DataFrame, sessions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of metrics over all sessions, or one for each value of ``by``; ``sessions(by, session)`` has a row for each file.

    Records are read once: facts are summed by session, fact and key first, into numbers alone, which needs a row in memory for
    each of these and no sorting of facts; these sums are added up by fact and key, and then by ``by``.
    """
    f = lambda name: F.col("fact") == name
    parts = parts_of(recs.count(), int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = session_facts(recs, sessions, by, parts).repartition(parts, *by, "fact", "key").groupBy(*by, "fact", "key").agg(
        F.sum("n").alias("n"), F.max("x").alias("x"), F.min(F.when(f("hour"), F.struct("session", "seq"))).alias("first"), *(F.sum(c).alias(c) for c in (*_SUMS, *(f"_{k}" for k in TOKENS))),
        F.max("_tools").alias("_tools"), F.min("_night").alias("_night"), F.max("_from").alias("_from"), F.max("_to").alias("_to"),  # a session has one row
    )
    place = F.row_number().over(W.partitionBy(*by, "fact", F.when(~F.col("fact").isin(*TOP), F.col("key"))).orderBy(F.desc("n"), "key"))
    summed = summed.withColumn("_place", place)
    minutes = (F.unix_micros("_to") - F.unix_micros("_from")) / 60e6
    total = lambda column: F.coalesce(F.sum(column), F.lit(0).cast("long"))
    number = lambda name: F.count_if(f(name))
    n = lambda *names: total(F.when(f("tool") & F.col("key").isin(*names), F.col("n")))
    pairs = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.when(f(name) & (F.col("_place") <= TOP.get(name, 1)), F.struct("key", "n")))))

    def histogram(name: str, size: int) -> Column:
        found = pairs(name)
        return F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(k.cast("string"), F.coalesce(F.try_element_at(found, k.cast("string")), F.lit(0).cast("long")))))

    own = f("session")
    tokens = {k: F.when(own, F.col(f"_{k}")) for k in TOKENS}
    of_model = F.struct(*(F.coalesce(F.col(f"_{k}"), F.lit(0).cast("long")).alias(k) for k in TOKENS))
    by_model = F.sort_array(F.collect_list(F.when(f("model"), F.struct("key", of_model.alias("t")))))
    by_model = F.map_from_entries(F.transform(by_model, lambda m: F.struct(m["key"], F.create_map(*[x for k in TOKENS for x in (F.lit(k), m["t"][k])]))))
    row = summed.groupBy(*by).agg(
        number("session").alias("sessions"), F.coalesce(F.round(F.max(minutes), 1), F.lit(0.0)).alias("longest_session_min"), F.coalesce(F.round(F.avg(minutes), 1), F.lit(0.0)).alias("avg_session_min"),
        F.coalesce(F.round(F.sum(minutes) / 60, 1), F.lit(0.0)).alias("total_active_hours"), F.coalesce(F.max(F.when(own, F.col("assistant_turns"))), F.lit(0).cast("long")).alias("max_turns_in_session"),
        *(total(F.col(c)).alias(c) for c in _SUMS), F.round(F.percentile(F.when(f("wait"), F.col("x")), 0.5, F.col("n")), 1).alias("pounce_median_sec"), total(F.when(f("wait"), F.col("n"))).alias("corrections_caught"),
        F.coalesce(F.max("_tools"), F.lit(0)).alias("max_parallel_tools"), F.create_map(*[x for k in TOKENS for x in (F.lit(k), total(tokens[k]))]).alias("tokens"),
        number("branch").alias("git_branches"), F.min("_night").alias("night_owl_hour"), total(F.when(f("tool"), F.col("n"))).alias("tool_calls"),
        n("Read").alias("read"), n("Edit").alias("edit"), n("Write").alias("write"), n("Bash").alias("bash"), total(F.when(f("path"), F.col("n") - 1)).alias("reread_events"),
        n("Workflow").alias("workflow_calls"), n("Agent", "Task").alias("agent_calls"), n("TodoWrite").alias("todo_calls"), total(F.when(f("server"), F.col("n"))).alias("mcp_calls"), number("server").alias("mcp_servers_used"),
        number("edited").alias("distinct_files_edited"), F.coalesce(F.max(F.when(f("edited"), F.col("n"))), F.lit(0).cast("long")).alias("most_churned_file_edits"),
        F.min_by(F.col("key").cast("int"), F.when(f("hour"), F.struct((-F.col("n")).alias("n"), "first"))).alias("peak_hour"), by_model.alias("tokens_by_model"), pairs("tool").alias("top_tools"),
        pairs("model").alias("models"), pairs("server").alias("top_mcp_servers"), histogram("hour", 24).alias("hour_histogram"), histogram("day", 7).alias("weekday_histogram"),
    )
    return row.select(
        "*", stats.percent(F.col("reversal_count"), F.col("real_user_prompts")).alias("reversal_rate_per_100"), stats.ratio(F.col("read"), F.col("edit")).alias("read_to_edit_ratio"),
        stats.ratio(F.col("read"), F.col("write")).alias("read_to_write_ratio"), stats.percent(F.col("reread_events"), F.col("read")).alias("reread_pct"),
        stats.percent(F.col("tool_errors"), F.col("tool_calls")).alias("tool_error_pct"), stats.ratio(F.col("thinking_chars"), F.col("assistant_turns"), 0).alias("avg_thinking_chars_per_turn"),
        stats.percent(F.col("_opus"), F.col("_with_model")).alias("opus_pct"),
    ).drop("_opus", "_with_model")
