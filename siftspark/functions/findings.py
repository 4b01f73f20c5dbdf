"""Column functions over findings: identity, grouping keys, severities, classes, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that name no family of defects; fixed values.
GENERIC_CODES = ("misc", "unknown", "none", "-1", "-2")
#: First matching class wins; the tests are for substrings. Fixed values.
DEFECT_CLASSES = (
    ("interface", ("seam", "api", "schema", "architecture", "contract", "migration")),
    ("timing/serialization", ("concurrency", "async", "time", "random", "matrix")),
    ("build/package/merge", ("package", "build", "dependency", "ci-")),
    ("documentation", ("doc", "doctest")),
    ("algorithm", ("complexity", "performance", "benchmark", "memory")),
    ("checking", ("type", "coverage", "test", "validation", "lint", "static")),
)
#: Order, weight and health of severities and statuses; fixed values.
SEVERITY_RANKS = {"critical": 0, "high": 0, "error": 0, "warning": 1, "medium": 1, "note": 2, "low": 2, "info": 3}
#: The repair queue ranks by a map without critical and info.
QUEUE_RANKS = {k: v for k, v in SEVERITY_RANKS.items() if k not in ("critical", "info")}
SEVERITY_WEIGHTS = {"critical": 8, "high": 8, "error": 6, "warning": 3, "medium": 3, "note": 1, "low": 1, "info": 1}
HEALTH_WEIGHTS = {"PASS": 100, "FINDINGS": 65, "SKIPPED": 20, "ERROR": 0}

#: Name endings and the units they say; the first that fits wins. Fixed values.
UNIT_SUFFIXES = (
    ("_ms", "milliseconds"),
    ("_millis", "milliseconds"),
    ("_milliseconds", "milliseconds"),
    ("_us", "microseconds"),
    ("_ns", "nanoseconds"),
    ("_s", "seconds"),
    ("_sec", "seconds"),
    ("_secs", "seconds"),
    ("_seconds", "seconds"),
    ("_min", "minutes"),
    ("_mins", "minutes"),
    ("_minutes", "minutes"),
    ("_hours", "hours"),
    ("_b", "bytes"),
    ("_bytes", "bytes"),
    ("_kb", "kilobytes"),
    ("_mb", "megabytes"),
    ("_gb", "gigabytes"),
    ("_tb", "terabytes"),
    ("_percent", "percent"),
    ("_percentage", "percent"),
    ("_port", "TCP/UDP port"),
)


def _mapped(value: Column, table: dict[str, int], default: int) -> Column:
    low = F.lower(value)
    return reduce(lambda c, kv: c.when(low == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0)).otherwise(default)


def severity_rank(severity: Column) -> Column:
    return _mapped(severity, SEVERITY_RANKS, 1)


def queue_rank(severity: Column) -> Column:
    return _mapped(severity, QUEUE_RANKS, 1)


def severity_weight(severity: Column) -> Column:
    return _mapped(severity, SEVERITY_WEIGHTS, 3)


#: Severity words of analyzers; any other word gives the parser's default. Fixed values.
PARSED_SEVERITIES = (
    ("error", ("fatal", "critical", "high", "error")),
    ("warning", ("warn", "warning", "medium")),
    ("note", ("info", "information", "note", "low", "style")),
)


def parsed_severity(raw: Column, default: str = "error") -> Column:
    """Severity words of analyzers brought to the three in use; missing and unknown ones to the default."""
    low = F.lower(raw)
    return reduce(lambda c, kv: c.when(low.isin(*kv[1]), kv[0]), PARSED_SEVERITIES, F.when(F.lit(False), "")).otherwise(default)


def threshold_severity(value: Column, warn: float, error: float) -> Column:
    """error or warning strictly above the limits, else null."""
    return F.when(value > error, "error").when(value > warn, "warning")


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fingerprint(tool: Column, code: Column, path: Column, message: Column) -> Column:
    """16 hex digits that don't depend on line and column."""
    blank = F.lit("")
    return F.substring(F.sha2(F.concat_ws("|", tool, F.coalesce(code, blank), F.coalesce(path, blank), stripped(message)), 256), 1, 16)


def finding_id(mark: Column) -> Column:
    return F.concat(F.lit("BH-"), F.upper(mark))


def message_shape(tool: Column, message: Column) -> Column:
    """The message with what varies between repeats replaced."""
    low = F.lower(message)
    low = F.when(tool == "mutmut", F.regexp_replace(low, r"__mutmut_\d+.*$", "__mutmut_<n>")).otherwise(low)
    for pattern, shape in (
        (r"`[^`]+`", "`<symbol>`"),
        (r"(?U)(?:[A-Za-z]:)?[/\\][^\s:]+", "<path>"),
        (r"(?U)\b0x[0-9a-f]+\b", "<hex>"),
        (r"(?U)\b\d+(?:\.\d+)?\b", "<n>"),
        (r"(?U)\s+", " "),
    ):
        low = F.regexp_replace(low, pattern, shape)
    return F.trim(low)


def signal_key(tool: Column, code: Column, message: Column) -> Column:
    """Families of repeated findings: tool and code, or the shape of the message where the code says nothing."""
    has_code = F.coalesce(code, F.lit("")) != ""
    generic = ~has_code | F.lower(code).isin(*GENERIC_CODES)
    prefix = F.concat(tool, F.lit(":"), F.when(has_code, F.concat(code, F.lit(":"))).otherwise(""))
    return F.when(generic, F.concat(prefix, F.substring(message_shape(tool, message), 1, 180))).otherwise(F.concat(tool, F.lit(":"), code))


def signal_label(key: Column, width: int = 88) -> Column:
    return F.when(F.length(key) > width, F.concat(F.substring(key, 1, width - 1), F.lit("…"))).otherwise(key)


def defect_class(category: Column, code: Column) -> Column:
    text = F.lower(F.concat(category, F.lit(" "), F.coalesce(code, F.lit(""))))
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    return reduce(lambda c, kv: c.when(has(kv[1]), kv[0]), DEFECT_CLASSES, F.when(F.lit(False), "")).otherwise("function")


def unit_of(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda c, kv: c.when(F.endswith(low, F.lit(kv[0])), kv[1]), UNIT_SUFFIXES, F.when(F.lit(False), ""))


def plain_path(raw: Column, root: str) -> Column:
    """Without file://, relative to the root if inside it, without leading ./"""
    value = F.regexp_replace(raw, r"^file://", "")
    value = F.when(F.startswith(value, F.lit(root.rstrip("/") + "/")), F.substring(value, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(value)
    return F.regexp_replace(value, r"^(\./)+", "")


def is_local_url(url: Column) -> Column:
    return url.rlike(r"^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])(:\d+)?(/|$)")


#: Values that only hold a place; fixed values.
PLACEHOLDERS = (
    "",
    "changeme",
    "change-me",
    "example",
    "example-value",
    "placeholder",
    "your-value-here",
    "your_value_here",
    "todo",
    "unset",
    "none",
    "null",
    "<required>",
    "required",
    "replace-me",
    "replace_me",
)
#: Names of secrets, and shapes of tokens; fixed values.
SECRET_NAME = r"(?i)(?:secret|token|password|passwd|api[_-]?key|private[_-]?key|access[_-]?key|client[_-]?secret)"
TOKEN_SHAPE = r"^(?:sk-|ghp_|github_pat_|xox[baprs]-|AKIA)[A-Za-z0-9_\-]{12,}$"


def looks_secret(name: Column, value: Column) -> Column:
    """Values that look like live credentials: known token shapes, and long plain values under secret names."""
    low = F.lower(F.trim(value))
    harmless = low.isin(*PLACEHOLDERS) | low.rlike("^(example_|test_)") | F.contains(value, F.lit("${")) | value.rlike("^<.*>$")
    shaped = value.rlike(TOKEN_SHAPE) | F.contains(value, F.lit("PRIVATE KEY-----"))
    return ~harmless & (shaped | (name.rlike(SECRET_NAME) & value.rlike(r"^[A-Za-z0-9_./+=:@\-]{16,}$")))


def is_public(name: Column, column: Column, path: Column) -> Column:
    """Module-level names of the sources without a leading underscore."""
    return ~F.startswith(name, F.lit("_")) & (column == 0) & F.startswith(path, F.lit("src/"))


def name_without(name: Column, token: str) -> Column:
    """A name in snake case without one of its words; null if it doesn't have it."""
    words = F.split(name, "_")
    return F.when(F.array_contains(words, token), F.array_join(F.array_remove(words, F.lit(token)), "_"))


def name_with_swapped(name: Column, token: str, other: str) -> Column:
    """A name in snake case with one word exchanged; null if it doesn't have it."""
    words = F.split(name, "_")
    return F.when(F.array_contains(words, token), F.array_join(F.transform(words, lambda w: F.when(w == token, F.lit(other)).otherwise(w)), "_"))
