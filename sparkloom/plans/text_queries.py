"""Queries of the text functions over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, passages
from ..sources import corpus


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slugify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


def first_words_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.first_words(F.col("text"), 6).alias("label"))


def trim_to_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.trim_to(F.col("text"), 140).alias("snippet"))


def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.clean_markdown(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(clean).alias("md5"), F.length(clean).cast("long").alias("n"))


def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = T.strip_markdown(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(plain).alias("md5"), F.length(plain).cast("long").alias("n"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.redact_secrets(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(clean).alias("md5"), (clean != F.col("text")).alias("changed"))


def leak_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON texts without a schema, two levels down in another JSON text: what the privacy gate finds inside."""
    rows = _docs(spark, sf_dir)
    inner = F.to_json(F.struct(F.col("lang").alias("tongue"), F.array(F.create_map(F.lit("body"), F.col("text"))).alias("parts")))
    outer = F.to_json(F.struct(F.struct(F.array(inner).alias("held")).alias("record")))
    strings = audit.seen_through(F.array(outer))
    seen = rows.select("doc_id", F.filter(strings, lambda x: ~x.rlike(r"^\s*[\[{]")).alias("s"))
    return seen.select("doc_id", F.size("s").cast("long").alias("n_strings"), F.exists("s", T.leaks).alias("real"))


def leak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.leaks_anything(text).alias("anything"), T.leaks(text).alias("real"), T.has_number(text).alias("has_number"))


def escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("md5"), T.path_hash(F.col("url")).alias("url_hash"))


def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("n")).select("source", T.short_number(F.col("n") * 10000).alias("shown"), T.short_number(F.col("n")).alias("plain"))


def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-name functions over names made of event types."""
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    each = names.select(F.explode(F.array(F.concat(F.lit("mcp__site__"), "event_type"), F.concat(F.lit("get_"), "event_type"), F.concat("event_type", F.lit("_list")), "event_type")).alias("tool"))
    t = F.col("tool")
    return each.select("tool", T.pretty_tool(t).alias("pretty"), T.mcp_server(t).alias("server"), T.is_probe(t).alias("probe"), T.model_family(F.concat(t, F.lit("-Opus"))).alias("family"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("md5"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(passages.chunk_sentences(T.strip_markdown(F.col("text")))).alias("at", "piece"))
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), F.length("piece").cast("long").alias("n"), F.md5("piece").alias("md5"))


def passage_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", F.lit("corpus"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return passages.to_concepts(passages.split(_docs(spark, sf_dir).select("doc_id", name.alias("name"), "text"))).select("doc_id", F.col("passage_idx").cast("long").alias("passage_idx"), "id", "label", "domain", F.md5("text").alias("md5"))


def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too short for a concept, and those just long enough, by length of prose."""
    n = F.length(T.clean_markdown(F.col("text")))
    return _docs(spark, sf_dir).groupBy((n < passages.MIN).alias("too_short"), (n > passages.TARGET).alias("wall")).agg(F.count(F.lit(1)).alias("n"))


def trace_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, one file a conversation, read back as concepts."""
    return corpus.ingest(_traces(spark, sf_dir))[0].select("id", "label", "domain", F.md5("text").alias("md5"))


def ingest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingest(_traces(spark, sf_dir))[1]


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("line"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return files.select(F.format_string("conv%d.jsonl", "conv_id").alias("name"), "text")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of three kinds, by number: JSON arrays of records, JSON lines, and a kind that can't be read.

    What was said comes as blocks: a text, a call of a tool, and a result.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    block = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in fields.items())))
    blocks = F.concat_ws(",", block("text", text=F.col("text")), block("tool_use", name=F.lit("Read"), input=F.struct(F.col("turn").alias("n"))), block("tool_result", content=F.col("text")))
    named = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("Turn "), F.col("turn")).alias("label"), F.col("role").alias("domain")))).otherwise(F.to_json(F.struct("role")))
    entry = F.concat(F.regexp_replace(named, r"\}$", ""), F.lit(',"content":['), blocks, F.lit("]}"))
    files = rows.select("conv_id", "turn", entry.alias("entry")).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "entry"))), lambda x: x["entry"]).alias("entries"))
    kind = F.col("conv_id") % 3
    suffix = F.when(kind == 0, "json").when(kind == 1, "jsonl").otherwise("pdf")
    text = F.when(kind == 0, F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]"))).otherwise(F.array_join("entries", "\n"))
    return files.select(F.format_string("conv%d.%s", "conv_id", suffix).alias("name"), text.alias("text"))


def mixed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingest(_mixed(spark, sf_dir))[0].select("id", "label", "domain", F.md5("text").alias("md5"))


def mixed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingest(_mixed(spark, sf_dir))[1]


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as brains: a manifest of English counts, upserted with those of all languages of a few sources."""
    from ..sources import sinks

    docs = _docs(spark, sf_dir)
    entry = lambda d: d.groupBy(F.col("source").alias("name")).agg(F.max("lang").alias("label"), F.count(F.lit(1)).alias("count"), F.sum("n_chars").alias("synapses"))
    return sinks.upsert_manifest(entry(docs.where("lang = 'en'")), entry(docs.where("source in ('src1', 'src2', 'src3')")))


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written with an offset, read back as instants and on their own clock."""
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", said.alias("said"))
    return rows.select(F.hour(T.own_clock(F.col("said"))).alias("own_hour")).groupBy("own_hour").agg(F.count(F.lit(1)).alias("n"))


def last_first_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with equal slugs, the first."""
    at = F.row_number().over(W.partitionBy("slug").orderBy("doc_id"))
    return slugify_labels(spark, sf_dir).withColumn("at", at).where("at = 1").select("slug", "doc_id")


_WS = r"[ \t\n\x0B\f\r]"
_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'c')"


def _collapse(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


_CODE = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
_CLEAN = _collapse(f"regexp_replace({_CODE}, '[#>*_~|-]', ' ', 'g')")
_STRIP = _collapse(rf"regexp_replace(regexp_replace({_CODE}, '(?m)^[ \t]{{0,3}}#{{1,6}}[ \t]+', ' ', 'g'), '[#>*_~|]', ' ', 'g')")


def _q(s: str) -> str:
    return s.replace("'", "''")


def _redacted(s: str = "text") -> str:
    for pattern, to in T.SECRETS:
        s = f"regexp_replace({s}, '{_q(pattern)}', '{to.replace('$1$2', chr(92) + '1' + chr(92) + '2')}', 'g')"
    return s


_RED = _redacted()
_SENT = rf"regexp_extract_all(text, '[^.!?]+[.!?]+(?:{_WS}|$)|[^.!?]+$')"
_TRIMMED = f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"


def _trim(s: str) -> str:
    return f"regexp_replace({s}, '^{_WS}+|{_WS}+$', '', 'g')"


def _slugged(s: str, limit: int, otherwise: str) -> str:
    return f"coalesce(nullif(left(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {limit}), ''), '{otherwise}')"


def _words(s: str, n: int) -> str:
    return f"array_to_string(list_slice(regexp_split_to_array({s}, '{_WS}+'), 1, {n}), ' ')"


def _pieces(s: str) -> str:
    """A list of sentences packed in order into pieces of at most 900 characters."""
    found = _SENT.replace("(text,", f"({s},")
    states = f"list_transform(CASE WHEN len({found}) = 0 THEN [{s}] ELSE {found} END, lambda x: {{'buf': x, 'out': []::VARCHAR[]}})"
    put = f"CASE WHEN length(a.buf) + length(b.buf) > {passages.TARGET} THEN {{'buf': b.buf, 'out': list_append(a.out, a.buf)}} ELSE {{'buf': a.buf || b.buf, 'out': a.out}} END"
    whole = f"[list_reduce({states}, lambda a, b: {put})]"
    return f"list_filter(list_transform(flatten(list_transform({whole}, lambda s: list_append(s.out, s.buf))), lambda x: {_trim('x')}), lambda x: x <> '')"


_LINE_HEAD = r"#{1,6}[ \t]"
_TITLE = f"regexp_extract(text, '(?m)^{_WS}*{_LINE_HEAD}+(.*)$', 1)"
_PASSAGES = f"""
    WITH RECURSIVE doc AS (SELECT doc_id, source, text, {_trim(_TITLE)} AS title FROM documents),
    cut AS (SELECT doc_id, title, unnest(s) AS section, generate_subscripts(s, 1) AS sat FROM (
        SELECT doc_id, title, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n([ \t\x0B\f\r]*{_LINE_HEAD})', chr(1) || '\1', 'g'), chr(1)) AS s FROM doc)),
    headed AS (SELECT doc_id, title, sat, section, split_part(section, chr(10), 1) AS line, regexp_matches(split_part(section, chr(10), 1), '^{_WS}*{_LINE_HEAD}') AS has FROM cut),
    body AS (SELECT doc_id, sat, CASE WHEN has THEN {_trim(f"regexp_extract(line, '^{_WS}*{_LINE_HEAD}+(.*)$', 1)")} ELSE title END AS heading,
        string_split_regex(CASE WHEN has THEN substr(section, length(line) + 2) ELSE section END, '\n{_WS}*\n') AS b FROM headed),
    raw AS (SELECT doc_id, sat, heading, unnest(b) AS text, generate_subscripts(b, 1) AS pat FROM body),
    plain AS (SELECT doc_id, sat, pat, heading, {_STRIP} AS text FROM raw),
    para AS MATERIALIZED (SELECT doc_id, heading, text, row_number() OVER w AS place, coalesce(heading <> lag(heading) OVER w, true) AS moved, length(text) > {passages.TARGET} AS wall,
        CASE WHEN length(text) > {passages.TARGET} THEN {_pieces("text")} END AS pieces FROM plain WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY sat, pat)),
    -- one step a paragraph: what it lets out in order, each as text that is a new passage or is glued to the last one of its heading
    fold AS (
        SELECT doc_id, 0::BIGINT AS place, '' AS heading, '' AS buf, []::STRUCT(h VARCHAR, t VARCHAR, short BOOLEAN)[] AS lets FROM doc
        UNION ALL
        SELECT p.doc_id, p.place, p.heading, CASE WHEN p.wall OR length(p.joined) >= {passages.MIN} THEN '' ELSE p.joined END,
            CASE WHEN p.old <> '' THEN [{{'h': p.old_heading, 't': p.old, 'short': length({_trim("p.old")}) < {passages.MIN}}}] ELSE []::STRUCT(h VARCHAR, t VARCHAR, short BOOLEAN)[] END
            || CASE WHEN p.wall THEN list_transform(p.pieces, lambda x: {{'h': p.heading, 't': x, 'short': false}})
                    WHEN length(p.joined) >= {passages.MIN} THEN [{{'h': p.heading, 't': p.joined, 'short': length({_trim("p.joined")}) < {passages.MIN}}}] ELSE []::STRUCT(h VARCHAR, t VARCHAR, short BOOLEAN)[] END
        FROM (
            SELECT q.*, f.heading AS old_heading, CASE WHEN q.moved OR q.wall THEN f.buf ELSE '' END AS old, CASE WHEN q.moved OR f.buf = '' THEN q.text ELSE f.buf || ' ' || q.text END AS joined
            FROM fold f JOIN para q ON q.doc_id = f.doc_id AND q.place = f.place + 1
        ) p
    ),
    ends AS (SELECT doc_id, place, lets FROM fold UNION ALL
        SELECT doc_id, max(place) + 1, [{{'h': arg_max(heading, place), 't': arg_max(buf, place), 'short': length({_trim("arg_max(buf, place)")}) < {passages.MIN}}}] FROM fold GROUP BY doc_id HAVING arg_max(buf, place) <> ''),
    flat AS (SELECT doc_id, place, unnest(lets) AS l, generate_subscripts(lets, 1) AS k FROM ends),
    let AS (SELECT doc_id, place, k, l.h AS h, {_trim("l.t")} AS t, l.short AS short, lag(l.h) OVER w AS before FROM flat WHERE {_trim("l.t")} <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place, k)),
    made AS (SELECT doc_id, h, t, place, k, count(*) FILTER (WHERE NOT (short AND before IS NOT DISTINCT FROM h AND before IS NOT NULL)) OVER (PARTITION BY doc_id ORDER BY place, k) AS g FROM let),
    glued AS (SELECT doc_id, g, min(h) AS heading, {_trim("string_agg(t, ' ' ORDER BY place, k)")} AS text FROM made GROUP BY doc_id, g),
    kept AS (SELECT doc_id, heading, text, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS passage_idx FROM glued WHERE length(text) >= {passages.MIN}),
    named AS (
        SELECT k.*, d.source AS folder, d.title, CAST(d.doc_id AS VARCHAR) AS stem, count(*) OVER (PARTITION BY k.doc_id) > 1 AS several, left(coalesce(nullif(d.title, ''), CAST(d.doc_id AS VARCHAR)), 60) AS doc_label
        FROM kept k JOIN doc d ON k.doc_id = d.doc_id WHERE passage_idx < {passages.PER_DOC}
    ),
    concept AS (
        SELECT doc_id, passage_idx, 'corpus/' || folder || '/' || stem || CASE WHEN several THEN '-' || passage_idx ELSE '' END AS name, folder,
            CASE WHEN heading <> '' AND heading <> title THEN heading WHEN several THEN doc_label || ' — ' || {_words("text", 5)} ELSE doc_label END AS label,
            CASE WHEN heading <> '' THEN heading || '. ' || text ELSE text END AS whole FROM named
    )
"""
_TRACE_WS = _trim(f"regexp_replace(text, '{_WS}+', ' ', 'g')")
_TRACE = f"""
    WITH body AS (SELECT 'conv' || conv_id || '.jsonl' AS file, role, {_TRACE_WS} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations)
"""

_MIXED_BODY = _trim(f"regexp_replace(coalesce(text, '') || ' used tool Read: {{\"n\":' || turn || '}} ' || left(coalesce(text, ''), 200), '{_WS}+', ' ', 'g')")
_MIXED = f"""
    WITH body AS (
        SELECT 'conv' || conv_id || CASE conv_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.jsonl' ELSE '.pdf' END AS file, conv_id % 3 AS kind, turn, role, {_MIXED_BODY} AS body,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS place, CASE conv_id % 3 WHEN 0 THEN {corpus.MIN_RECORD} ELSE {corpus.MIN_TRACE} END AS least
        FROM conversations
    )
"""

QUERIES = {f.__name__: f for f in (
    slugify_labels, first_words_label, trim_to_limit, clean_markdown, strip_markdown, redact_documents, leak_flags, leak_nested, escape_pages, short_numbers, tool_names,
    sentence_counts, sentence_chunks, passage_concepts, short_documents, trace_concepts, ingest_notes, mixed_concepts, mixed_notes, manifest, parsed_times, last_first_per_id,
)}

ORACLES = {
    "short_numbers": """WITH s AS (SELECT source, sum(n_chars)::BIGINT AS one, sum(n_chars)::BIGINT * 10000 AS n FROM documents GROUP BY source)
        SELECT source, CASE WHEN n >= 1000000000 THEN printf('%.1f', round(n / 1e9, 1)) || 'B' WHEN n >= 1000000 THEN printf('%.1f', round(n / 1e6, 1)) || 'M' ELSE format('{:,}', n) END AS shown,
               CASE WHEN one >= 1000000000 THEN printf('%.1f', round(one / 1e9, 1)) || 'B' WHEN one >= 1000000 THEN printf('%.1f', round(one / 1e6, 1)) || 'M' ELSE format('{:,}', one) END AS plain FROM s""",
    "sentence_chunks": f"""WITH p AS (SELECT doc_id, {_STRIP} AS text FROM documents), c AS (SELECT doc_id, {_pieces("text")} AS c FROM p), r AS (SELECT doc_id, unnest(c) AS piece, generate_subscripts(c, 1) - 1 AS place FROM c)
        SELECT doc_id, place AS "at", length(piece) AS n, md5(piece) AS md5 FROM r""",
    "passage_concepts": f"""{_PASSAGES} SELECT doc_id, passage_idx, {_slugged("name", 60, "c")} AS id, {_redacted("left(label, 60)")} AS label, {_slugged("folder", 20, "note")} AS domain,
        md5({_redacted(f"left(whole, {passages.CAP})")}) AS md5 FROM concept""",
    "trace_concepts": f"""{_TRACE} SELECT {_slugged("file", 60, "c")} || '-' || place AS id, {_redacted(f"left({_words('body', 6)}, 60)")} AS label, {_slugged("role", 20, "trace")} AS domain,
        md5({_redacted(f"left(body, {corpus.CAP})")}) AS md5 FROM body WHERE length(body) >= {corpus.MIN_TRACE}""",
    "mixed_concepts": f"""{_MIXED} SELECT {_slugged("file", 60, "c")} || '-' || place AS id, {_redacted(f"left(CASE WHEN kind = 0 THEN 'Turn ' || turn ELSE {_words('body', 6)} END, 60)")} AS label,
        CASE WHEN kind = 0 THEN {_slugged("role", 20, "c")} ELSE {_slugged("role", 20, "trace")} END AS domain, md5({_redacted(f"left(body, {corpus.CAP})")}) AS md5
        FROM body WHERE kind < 2 AND length(body) >= least""",
    "mixed_notes": f"""{_MIXED}, c AS (SELECT file, kind, count(*) AS n, count(*) FILTER (WHERE length(body) >= least) AS k FROM body GROUP BY file, kind)
        SELECT file, CASE WHEN kind = 2 THEN 'info' WHEN k = 0 THEN 'error' WHEN k < n THEN 'warn' ELSE 'info' END AS level,
               CASE WHEN kind = 2 THEN 'type not supported' WHEN k = 0 THEN 'no usable text in ' || n || ' entries' ELSE k || ' of ' || n || ' entries used, 0 broken, ' || (n - k) || ' too short' END AS message FROM c""",
    "ingest_notes": f"""{_TRACE}, c AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE length(body) >= {corpus.MIN_TRACE}) AS k FROM body GROUP BY file)
        SELECT file, CASE WHEN k = 0 THEN 'error' WHEN k < n THEN 'warn' ELSE 'info' END AS level,
               CASE WHEN k = 0 THEN 'no usable text in ' || n || ' entries' ELSE k || ' of ' || n || ' entries used, 0 broken, ' || (n - k) || ' too short' END AS message FROM c""",
    "slugify_labels": f"SELECT doc_id, {_SLUG} AS slug FROM documents",
    "last_first_per_id": f"SELECT {_SLUG} AS slug, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "first_words_label": f"SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(text, '{_WS}+'), 1, 6), ' ') AS label FROM documents",
    "trim_to_limit": f"""WITH t AS (SELECT doc_id, {_TRIMMED} AS w FROM documents), h AS (SELECT doc_id, w, left(w, 140) AS h, 140 - position(' ' IN reverse(left(w, 140))) AS p FROM t)
        SELECT doc_id, CASE WHEN length(w) <= 140 THEN w ELSE regexp_replace(CASE WHEN contains(h, ' ') AND p > 84 THEN left(h, p) ELSE h END, '[ ,;:]+$', '') || '…' END AS snippet FROM h""",
    "clean_markdown": f"SELECT doc_id, md5({_CLEAN}) AS md5, length({_CLEAN}) AS n FROM documents",
    "strip_markdown": f"SELECT doc_id, md5({_STRIP}) AS md5, length({_STRIP}) AS n FROM documents",
    "redact_documents": f"SELECT doc_id, md5({_RED}) AS md5, {_RED} <> text AS changed FROM documents",
    "leak_flags": f"""SELECT doc_id, regexp_matches(text, '[/\\\\@]') OR regexp_matches(text, '{_q(T.LEAK_SECRET)}') AS anything,
        regexp_matches(text, '{_q(T.LEAK_PATH)}') OR regexp_matches(text, '{_q(T.LEAK_EMAIL)}') OR regexp_matches(text, '{_q(T.LEAK_SECRET)}') AS real, regexp_matches(text, '[0-9]') AS has_number FROM documents""",
    "leak_nested": f"""SELECT doc_id, 5::BIGINT + (lang IS NOT NULL)::BIGINT + (text IS NOT NULL AND NOT regexp_matches(text, '^\\s*[\\[{{]'))::BIGINT AS n_strings,
        coalesce(regexp_matches(text, '{_q(T.LEAK_PATH)}') OR regexp_matches(text, '{_q(T.LEAK_EMAIL)}') OR regexp_matches(text, '{_q(T.LEAK_SECRET)}'), false) AS real FROM documents""",
    "escape_pages": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS md5, sha1(url) AS url_hash FROM pages""",
    "short_documents": f"SELECT length({_CLEAN}) < 30 AS too_short, length({_CLEAN}) > 900 AS wall, count(*) AS n FROM documents GROUP BY ALL",
    "sentence_counts": f"SELECT doc_id, len({_SENT}) AS n, md5(array_to_string({_SENT}, '|')) AS md5 FROM documents",
    "manifest": """WITH a AS (SELECT source AS name, max(lang) AS label, count(*) AS count, sum(n_chars)::BIGINT AS synapses FROM documents WHERE lang = 'en' GROUP BY source),
        b AS (SELECT source AS name, max(lang) AS label, count(*) AS count, sum(n_chars)::BIGINT AS synapses FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY source)
        SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)""",
    "parsed_times": "SELECT CAST(hour(ts) AS INTEGER) AS own_hour, count(*) AS n FROM events GROUP BY 1",
    "tool_names": """WITH n AS (SELECT DISTINCT event_type AS e FROM events), t AS (SELECT unnest(['mcp__site__' || e, 'get_' || e, e || '_list', e]) AS tool FROM n),
        p AS (SELECT tool, CASE WHEN tool LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN split_part(tool, '__', 3) ELSE tool END AS pretty FROM t)
        SELECT tool, pretty, CASE WHEN tool <> pretty THEN 'site' END AS server, regexp_matches(pretty, '(?i)^(list|get|read|search|find|fetch|show|quote|screenshot)_|_(list|get|status)$') AS probe, 'opus' AS family FROM p""",
}
