"""Scalar text functions as Column expressions. All run in the JVM and inside code generation where Spark has it.

``\\s`` in Java is ASCII white space; ``WS`` is the class used wherever white space matters, so that SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]"

# Phrases that mark a correction (looked for near the start) and a reversal (anywhere).
CORRECTION = (
    "no ", "no,", "wait", "stop", "actually", "don't", "dont", "not ", "instead", "revert", "go back", "undo", "nvm", "never mind",
    "hold on", "that's wrong", "thats wrong",
)
REVERSAL = ("actually", "revert", "go back", "nvm", "never mind", "undo", "on second thought", "scratch that")
CORRECTION_PREFIX = 70

# Shapes of secrets, each with what it is replaced by.
SECRETS = (
    (r"-----BEGIN[A-Z ]*PRIVATE KEY-----(?s:.*?)-----END[A-Z ]*PRIVATE KEY-----", "[REDACTED KEY]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}", "[REDACTED JWT]"),
    (r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED]"),
    (r"(?i)\b(?:sk|pk|rk)[-_](?:live|test|proj|ant)?[-_]?[A-Za-z0-9]{16,}\b", "[REDACTED]"),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._-]{16,}", "Bearer [REDACTED]"),
    (r"""(?i)\b(api[_-]?key|secret|token|password|passwd|authorization)\b(["']?\s*[:=]\s*["']?)[A-Za-z0-9._-]{12,}""", "$1$2[REDACTED]"),
)

# What must never leave the engine.
LEAK_SECRET = (
    r"sk-[A-Za-z0-9_-]{20,}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
    r"|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}"
    r"|-----BEGIN[A-Z ]*PRIVATE KEY-----|\bBearer\s+[A-Za-z0-9._-]{16,}"
)
# Letters, digits and spaces of any script, in a form that Java and RE2 both read.
_W, _S = r"\p{L}\p{N}_", r"\s\x0B\x1C-\x1F\x85\p{Z}"
LEAK_PATH = rf"""(^|[{_S}("'])[A-Za-z]:\\|(^|[{_S}("'])/[{_W}.\-]+/[{_W}.\-]+"""
#: A local part and a domain with a letter or digit in each; word boundaries differ between engines, and add nothing to this.
LEAK_EMAIL = rf"[{_W}][{_W}.+\-]*@[{_W}\-]+\.[.\-]*[{_W}]"
#: The same for Java, which starts at the beginning of a run only, and doesn't go back.
_LEAK_EMAIL_FAST = rf"(?<![{_W}.+\-])[.+\-]*+[{_W}][{_W}.+\-]*+@[{_W}\-]++\.[.\-]*+[{_W}]"

# Read-only probes among tool names.
PROBE = r"(?i)^(list|get|read|search|find|fetch|show|quote|screenshot)_|_(list|get|status)$"


def trim_ws(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{WS}+|{WS}+$", "")


def collapse_ws(s: Column) -> Column:
    return trim_ws(F.regexp_replace(s, rf"{WS}+", " "))


def slug(s: Column, limit: int = 60, fallback: str = "c") -> Column:
    """Lower case, runs of other characters as one dash, no dash at either end, cut to ``limit``."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(plain, F.lit(limit)), F.lit("")), F.lit(fallback))


def first_words(s: Column, n: int) -> Column:
    """The first n parts between white space, joined by spaces; a leading space makes the first part empty."""
    return F.array_join(F.slice(F.split(s, rf"{WS}+"), 1, n), " ")


def trim_to(s: Column, limit: int) -> Column:
    """Cut to ``limit`` at the last space, if that lies beyond 60 % of it, with an ellipsis."""
    whole = trim_ws(s)
    head = F.left(whole, F.lit(limit))
    last = F.length(head) - F.instr(F.reverse(head), " ")
    at_space = F.when((F.instr(head, " ") > 0) & (last > limit * 0.6), F.left(head, last)).otherwise(head)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(at_space, "[ ,;:]+$", ""), F.lit("…")))


def title(raw: Column) -> Column:
    """The first heading of a Markdown text, or an empty string."""
    return trim_ws(F.coalesce(F.regexp_extract(raw, rf"(?m)^{WS}*#{{1,6}}[ \t]+(.*)$", 1), F.lit("")))


def _no_code(s: Column) -> Column:
    fences = F.regexp_replace(s, r"(?s)```.*?```", " ")
    return F.regexp_replace(F.regexp_replace(fences, "`[^`]*`", " "), r"!?\[([^\]]*)\]\([^)]*\)", "$1")


def clean_markdown(s: Column) -> Column:
    """Prose of a whole Markdown text: code, links' targets and every mark, dashes too, are gone."""
    return collapse_ws(F.regexp_replace(_no_code(s), r"[#>*_~|-]", " "))


def strip_markdown(s: Column) -> Column:
    """Prose of a paragraph: like clean_markdown, but dashes stay and headings' marks go at line starts only."""
    heads = F.regexp_replace(_no_code(s), r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", " ")
    return collapse_ws(F.regexp_replace(heads, r"[#>*_~|]", " "))


def redact_secrets(s: Column) -> Column:
    for pattern, to in SECRETS:
        s = F.regexp_replace(s, pattern, to)
    return s


def has_any(s: Column, keys: tuple[str, ...]) -> Column:
    found = s.contains(keys[0])
    for k in keys[1:]:
        found = found | s.contains(k)
    return found


def is_correction(s: Column) -> Column:
    return F.coalesce(has_any(F.left(F.lower(s), F.lit(CORRECTION_PREFIX)), CORRECTION), F.lit(False))


def is_reversal(s: Column) -> Column:
    return F.coalesce(has_any(F.lower(s), REVERSAL), F.lit(False))


def trigger_kind(s: Column) -> Column:
    """correction, else reversal, else null: the first wins."""
    return F.when(is_correction(s), "correction").when(is_reversal(s), "reversal")


def strip_system(s: Column) -> Column:
    """User text without injected context; empty where the whole text was injected."""
    injected = s.contains("SYSTEM NOTIFICATION - NOT USER INPUT") | s.contains("<task-notification>")
    return trim_ws(F.when(injected, "").otherwise(F.regexp_replace(s, r"(?s)<system-reminder>.*?</system-reminder>", "")))


def model_family(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.contains("opus"), "opus").when(low.contains("sonnet"), "sonnet").when(low.contains("haiku"), "haiku").otherwise("other")


def path_hash(path: Column) -> Column:
    return F.sha1(path)


def mcp_server(tool: Column) -> Column:
    return F.when(tool.startswith("mcp__"), F.split_part(tool, F.lit("__"), F.lit(2)))


def pretty_tool(tool: Column) -> Column:
    last = F.element_at(F.split(tool, "__"), -1)
    return F.when(tool.startswith("mcp__") & (last != ""), last).otherwise(F.coalesce(F.nullif(tool, F.lit("")), F.lit("?")))


def is_probe(tool: Column) -> Column:
    return pretty_tool(tool).rlike(PROBE)


def parse_ts(s: Column) -> Column:
    """An instant, or null where the text isn't an ISO-8601 time."""
    return F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), s))


def own_clock(s: Column) -> Column:
    """The time on the record's own clock: the text without its offset."""
    return F.try_to_timestamp(F.regexp_replace(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), s), r"(Z|[+-]\d{2}:?\d{2})$", ""))


def leaks_anything(s: Column) -> Column:
    """For metrics: any slash, backslash or at sign counts, and every secret shape."""
    return s.rlike(r"[/\\@]") | s.rlike(LEAK_SECRET)


def leaks(s: Column) -> Column:
    """For prose: real paths, addresses and secrets only."""
    return s.rlike(LEAK_PATH) | s.rlike(_LEAK_EMAIL_FAST) | s.rlike(LEAK_SECRET)


def json_strings(s: Column) -> Column:
    """All strings of a JSON text, keys and values of any depth, unescaped; none where the text is no object or array.

    A quote opens or closes a string wherever it isn't escaped, so that one pass over the text finds them all.
    """
    literals = F.regexp_extract_all(s, F.lit(r'"(?:[^"\\]++|\\.)*+"'), F.lit(0))
    found = F.from_json(F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]")), "array<string>")
    return F.coalesce(F.when(s.rlike(r"^\s*[\[{]"), found), F.array().cast("array<string>"))


def short_number(n: Column) -> Column:
    whole = n.cast("bigint")
    tenth = lambda d: F.format_string("%.1f", F.round(whole / d, 1))
    return F.when(whole >= 1_000_000_000, F.concat(tenth(1e9), F.lit("B"))).when(whole >= 1_000_000, F.concat(tenth(1e6), F.lit("M"))).otherwise(F.format_number(whole, 0))


def has_number(s: Column) -> Column:
    return s.rlike("[0-9]")


def personalised(cites: Column) -> Column:
    """Whether an array of cited numbers has any and all are finite."""
    return (F.size(cites) > 0) & F.forall(cites, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def escape_html(s: Column) -> Column:
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(to))
    return s


def sentences(s: Column) -> Column:
    """Sentences with their closing marks and one following space."""
    return F.regexp_extract_all(s, F.lit(rf"[^.!?]+[.!?]+(?:{WS}|$)|[^.!?]+$"), F.lit(0))
