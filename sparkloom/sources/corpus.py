"""Sources of text: folders of notes, JSON lines of agent traces, JSON arrays of records, pasted text; with diagnostics.

Files are read by Spark's own readers, so any store that Spark reaches will do. What can't be used is skipped and said so
in notes ``(file, level, message)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import passages
from ..staging import stage

# What is read, and folders that are not looked into.
TEXT_SUFFIXES = ("md", "markdown", "mdx", "txt", "text", "rst")
SKIP_DIRS = (".git", "node_modules", ".venv", "venv", "dist", "__pycache__", ".obsidian")
MIN_TRACE, MIN_RECORD, CAP = 30, 20, 600

TRACE = "role string, type string, entry string, text string, summary string, body string, content string, message struct<role:string,content:string>"
BLOCK = "array<struct<type:string,text:string,name:string,input:string,content:string>>"
RECORD = "label:string,name:string,domain:string,text:string,summary:string,body:string,description:string,content:string,message:struct<content:string>"


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """(doc_id, name, text) of all text files under ``folder``; bad bytes are left out.

    Numbers rise with the paths, and have gaps. Paths alone are sorted, over as many tasks as they need; texts only meet them.
    """
    glob = "*.{" + ",".join(sorted({v for s in suffixes for v in (s, s.upper())})) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    skipped = "/(" + "|".join(s.replace(".", r"\.") for s in SKIP_DIRS) + ")/"
    rows = raw.where(~F.col("path").rlike(skipped)).select(F.col("path").alias("name"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")).alias("text"))
    ordered = rows.select("name").repartitionByRange("name").sortWithinPartitions("name")
    numbers = stage(ordered.select("name", F.monotonically_increasing_id().alias("doc_id")), "file-numbers")
    return rows.join(numbers, "name").select("doc_id", "name", "text")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of concepts: id, label, domain, text."""
    return spark.read.schema("id string, label string, domain string, text string").json(path, multiLine=True)


def kind_of(name: Column) -> Column:
    """trace, records, text, or null for what can't be read."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin("jsonl", "ndjson"), "trace").when(suffix == "json", "records").when(suffix.isin(*TEXT_SUFFIXES), "text")


def _block_text(blocks: Column) -> Column:
    def one(b: Column) -> Column:
        used = F.concat(F.lit("used tool "), F.coalesce(b["name"], F.lit("?")), F.lit(": "), F.left(F.coalesce(b["input"], F.lit("{}")), F.lit(160)))
        return F.when(b["type"] == "tool_use", used).when(b["type"] == "tool_result", F.left(F.coalesce(b["content"], F.lit("")), F.lit(200))).otherwise(F.coalesce(b["text"], F.lit("")))

    return F.array_join(F.transform(blocks, one), " ")


def _entry_text(o: Column) -> Column:
    content = F.coalesce(o["content"], o["message"]["content"])
    blocks = F.from_json(content, BLOCK)
    said = F.when(content.startswith("[") & blocks.isNotNull(), _block_text(blocks)).otherwise(content)
    return T.collapse_ws(F.concat_ws(" ", o["text"], o["summary"], o["body"], said))


def _rows_of_traces(named: DataFrame) -> DataFrame:
    lines = named.select("name", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).where(T.trim_ws(F.col("line")) != "")
    o = F.from_json("line", TRACE)
    role = F.coalesce(F.col("o.role"), F.col("o.message.role"), F.col("o.type"), F.col("o.entry"))
    good = T.trim_ws(F.col("line")).startswith("{") & F.try_parse_json("line").isNotNull()
    rows = lines.withColumn("o", o).withColumn("ok", good).withColumn("body", F.when(F.col("ok"), _entry_text(F.col("o"))))
    return rows.select("name", "at", "ok", "body", F.coalesce(F.nullif(T.slug(role, 20, ""), F.lit("")), F.lit("trace")).alias("domain"), F.lit(None).cast("string").alias("own_label"), F.lit(MIN_TRACE).alias("least"))


def _rows_of_records(named: DataFrame) -> DataFrame:
    items = named.select("name", F.posexplode(F.from_json(F.when(F.ltrim("text").startswith("["), F.col("text")), f"array<struct<{RECORD}>>")).alias("at", "o"))
    body = F.coalesce(F.nullif(_entry_text(F.col("o")), F.lit("")), F.col("o.description"), F.lit(""))
    domain = F.when(F.col("o.domain").isNotNull(), T.slug(F.col("o.domain"), 20)).otherwise("item")
    return items.select("name", "at", F.lit(True).alias("ok"), body.alias("body"), domain.alias("domain"), F.coalesce("o.label", "o.name").alias("own_label"), F.lit(MIN_RECORD).alias("least"))


def _structured(rows: DataFrame) -> DataFrame:
    used = rows.where("ok").where(F.length("body") >= F.col("least"))
    label = F.left(F.coalesce("own_label", T.first_words(F.col("body"), 6)), F.lit(60))
    return used.select("name", "at", F.concat_ws("-", T.slug(F.col("name")), F.col("at")).alias("id"), T.redact_secrets(label).alias("label"), "domain", T.redact_secrets(F.left("body", F.lit(CAP))).alias("text"))


def ingest(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``named(name, text)`` of any mix of files -> concepts (id, label, domain, text, source) and notes."""
    routed = named.withColumn("kind", kind_of(F.col("name")))
    traces, arrays = _rows_of_traces(routed.where("kind = 'trace'")), _rows_of_records(routed.where("kind = 'records'"))
    texts = routed.where("kind = 'text'").select(F.xxhash64("name").alias("doc_id"), "name", "text")
    long_enough = texts.where(F.length(T.clean_markdown(F.col("text"))) >= passages.MIN)
    prose = passages.to_concepts(passages.split(long_enough)).select("name", F.col("passage_idx").alias("at"), "id", "label", "domain", "text", "source")
    rest = _structured(traces).unionByName(_structured(arrays)).withColumn("source", F.lit(None).cast("string"))
    first = F.row_number().over(W.partitionBy("id").orderBy("name", "at"))
    concepts = prose.unionByName(rest).withColumn("_at", first).where("_at = 1").select("id", "label", "domain", "text", "source")
    return concepts, notes(routed, traces, arrays)


def notes(routed: DataFrame, traces: DataFrame, arrays: DataFrame) -> DataFrame:
    """(file, level, message): what was read of each file and what was not, and why."""
    kept = F.count_if(F.coalesce(F.col("ok") & (F.length("body") >= F.col("least")), F.lit(False)))
    counts = traces.unionByName(arrays).groupBy("name").agg(F.count(F.lit(1)).alias("n"), kept.alias("kept"), F.count_if(~F.col("ok")).alias("broken"))
    every = routed.join(counts, "name", "left").withColumn("n_clean", F.when(F.col("kind") == "text", F.length(T.clean_markdown(F.coalesce("text", F.lit(""))))))
    n, k, b = F.coalesce("n", F.lit(0)), F.coalesce("kept", F.lit(0)), F.coalesce("broken", F.lit(0))
    is_array = T.trim_ws(F.col("text")).startswith("[")
    level = (
        F.when(F.col("kind").isNull(), "info").when(F.col("kind") == "text", F.when(F.col("n_clean") < passages.MIN, "warn").otherwise("info"))
        .when((n == 0) | (k == 0), "error").when(k < n, "warn").otherwise("info")
    )
    few = n - k - b
    message = (
        F.when(F.col("kind").isNull(), "type not supported")
        .when(F.col("kind") == "text", F.when(F.col("n_clean") < passages.MIN, F.format_string("%d characters of prose are too few", "n_clean")).otherwise("read as text"))
        .when((F.col("kind") == "records") & ~F.coalesce(is_array, F.lit(False)), "a JSON array of records is expected")
        .when(n == 0, "nothing in it").when(b == n, F.format_string("none of %d lines is JSON", n))
        .when(k == 0, F.format_string("no usable text in %d entries", n))
        .otherwise(F.format_string("%d of %d entries used, %d broken, %d too short", k, n, b, few))
    )
    return every.select(F.col("name").alias("file"), level.alias("level"), message.alias("message"))


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """Concepts of a pasted text: id, label, domain, text."""
    found = passages.split(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    whole = F.when(F.col("heading") != "", F.concat("heading", F.lit(". "), "text")).otherwise(F.col("text"))
    label = F.coalesce(F.nullif("heading", F.lit("")), T.first_words(F.col("text"), 6))
    return found.select(F.format_string("paste-%d", "passage_idx").alias("id"), T.redact_secrets(F.left(label, F.lit(60))).alias("label"), F.lit("note").alias("domain"), T.redact_secrets(F.left(whole, F.lit(passages.CAP))).alias("text"))
