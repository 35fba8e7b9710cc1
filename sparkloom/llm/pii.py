"""Personal data: regular expressions propose, checksums confirm, context words score [native].

One pass over each row with SQL functions only; there is no shuffle. Positions come from splitting the text at the
matches: what lies between matches and the matches themselves, measured in code points, add up to where each begins.

The patterns are the given ones in a form that Java matches in one pass without recursion: repeats are possessive where
nothing that follows could use what they would give back, and a look-behind stops a match from being tried inside a run
that was already tried from its start (``\\G``: unless the previous match ended there). They match the same spans.

Kinds: email, ip, card, phone as given, always kept; ``iban`` is added where the length is its country's and mod-97 holds.
Every span has a score: a base by kind, raised where a checksum holds and where a word that goes with the kind stands
shortly before or after it. ``report`` counts the spans of at least ``CONFIDENT``; ``redact`` replaces spans by their kind,
those of at least ``min_score`` (by default all).

Defined cases: a null or empty text has no spans; very long texts are searched whole; equal rows get equal results; other
columns are ignored, or kept by ``redact`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

#: Code points before and after a span in which context words count.
CONTEXT, AFTER = 48, 24
#: Spans of this score have a checksum or a word nearby that speaks for them, or a form that hardly anything else has.
CONFIDENT = 0.7

# How many characters an account number (IBAN) has, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    score: float
    words: str


# The patterns of the contract, possessive, and the words that raise a score.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|host|server|address|addr|login|from"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|master|credit|amex|karte|carte|tarjeta|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "tel|phone|call|mobile|fax|contact|anruf|appel"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", "", 0.7, "iban|bank|account|konto|compte|cuenta"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number: the first four characters go last, letters count 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1)


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _located(text: Column, kind: Kind) -> Column:
    """All matches as structs (match, start), start in code points from 0."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<struct<match:string,start:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, z: Column) -> Column:
        begin = state["at"] + F.length(z["gap"])
        hit = F.struct(z["hit"].alias("match"), begin.alias("start"))
        return F.struct((begin + F.coalesce(F.length(z["hit"]), F.lit(0))).alias("at"), F.when(z["hit"].isNull() | ~_long_enough(kind, z["hit"]), state["out"]).otherwise(F.concat(state["out"], F.array(hit))).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    found = F.aggregate(zipped, start, step, lambda s: s["out"])
    return F.when(text.contains(kind.needs) if kind.needs else F.lit(True), found).otherwise(none)


def _long_enough(kind: Kind, match: Column) -> Column:
    """A cheap test that drops most proposals before they are kept: no other test could pass them."""
    return F.length(match) >= {"card": 13, "phone": 9, "iban": 15}.get(kind.name, 1)


def _scored(text: Column, kind: Kind, hits: Column) -> Column:
    def one(h: Column) -> Column:
        before = F.lower(F.substr(text, F.greatest(h["start"] - CONTEXT, F.lit(0)) + 1, F.least(h["start"], F.lit(CONTEXT))))
        checked = 0.2 if kind.name in ("card", "iban") else 0.0
        after = F.lower(F.substr(text, h["start"] + F.length(h["match"]) + 1, F.lit(AFTER)))
        near = F.when(before.rlike(kind.words) | after.rlike(kind.words), 0.1).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), h["start"].alias("start"), (h["start"] + F.length(h["match"])).alias("end"), (F.lit(kind.score + checked) + near).alias("score"))

    return F.transform(F.filter(hits, lambda h: _holds(kind.name, h["match"])), one).cast(_SPAN)


def with_spans(df: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``df`` and a column ``into`` of all its spans, by kind as listed and then by start."""
    plain, names = F.coalesce(df[text], F.lit("")), {k.name: fresh(df, f"hits_{k.name}") for k in KINDS}
    hits = df.select("*", *[_located(plain, k).alias(names[k.name]) for k in KINDS])
    spans = hits.withColumn(into, F.concat(*[_scored(F.coalesce(F.col(text), F.lit("")), k, F.col(names[k.name])) for k in KINDS]))
    return spans.drop(*names.values())


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score)."""
    return with_spans(docs.select(docs["doc_id"], docs["text"]), "spans").select("doc_id", "spans")


def _text_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each given kind, the hash of the given kinds' spans, all spans as text and with scores, and how many are confident."""
    found = spans(docs)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), F.col("spans").alias("scored"), F.size(F.filter("spans", lambda s: s["score"] >= CONFIDENT)).cast("long").alias("n_confident"))


def redact(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """``docs`` with each span of at least ``min_score`` replaced by ``[KIND]``. Overlapping spans are replaced as one.

    Null texts stay null; n_chars, where the table has it, follows the new text.
    """
    held = fresh(docs, "spans")
    found = with_spans(docs, held)
    wanted = F.array_sort(F.transform(F.filter(held, lambda s: s["score"] >= min_score), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        whole = F.concat(state["out"], F.substr("text", state["at"] + 1, s["start"] - state["at"]), label)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], whole).otherwise(state["out"]).alias("out"))

    def close(state: Column) -> Column:
        return F.concat(state["out"], F.substr("text", state["at"] + 1))

    cleaned = F.when(F.size(held) == 0, F.col("text")).otherwise(F.aggregate(wanted, start, step, close))
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), cleaned)).drop(held)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")))
    return out.select(*docs.columns)
