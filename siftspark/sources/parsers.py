"""Analyzer outputs to findings: a registry of parsers, each a function from runs to findings.

runs: run, tool, exit_code, stdout, stderr. findings: run, pos, tool, path, line, column, code, message, severity,
fixable, fix_safety, fix_preview. JSON is read as VARIANT, so a shape that is not as expected gives nulls, and
output that is no JSON falls back to the text parser, as does an empty result of a failed run where the tool does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import findings as fx

FIELDS = ("run", "pos", "tool", "path", "line", "column", "code", "message", "severity", "fixable", "fix_safety", "fix_preview")
Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {}

_PLACE = r"(?i)^(.+?):(\d+):(\d+):\s*(?:(error|warning|note):\s*)?(.+)$"
_LINE = r"(?i)^(.+?):(\d+):\s*(?:(error|warning|note):\s*)?(.+)$"
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CODE = r"\s+\[([A-Za-z0-9_.-]+)\]$"


def register(name: str, parser: Parser) -> None:
    """Add a parser, or replace one."""
    PARSERS[name] = parser


def _shaped(rows: DataFrame) -> DataFrame:
    defaults = {"column": "int", "code": "string", "path": "string", "line": "int", "fixable": "boolean", "fix_safety": "string", "fix_preview": "string"}
    for name, kind in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(False if name == "fixable" else None).cast(kind))
    return rows.select(*FIELDS)


def lines_of(runs: DataFrame) -> DataFrame:
    """run, tool, exit_code, pos, raw: every line of both streams, stdout first."""
    text = F.concat("stdout", F.lit("\n"), F.coalesce("stderr", F.lit("")))
    return runs.select("run", "tool", "exit_code", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("pos", "raw"))


def _placed(s: Column, p: Column | None = None) -> Column:
    """A line with what a pattern finds in it as one string, tried only where a number stands between colons; p: what the first pattern gave, for the second."""
    if p is None:
        return F.when(s.rlike(r":\d+:"), F.regexp_replace(s, _PLACE, "$1\x01$2\x01$3\x01$4\x01$5"))
    return F.when(p != s, p).when(p.isNotNull(), F.regexp_replace(s, _LINE, "$1\x01$2\x01\x01$3\x01$4"))


def _parts(s: Column, p: Column) -> Column:
    return F.when(p != s, F.split(p, "\x01", 5))


def _told(g: Column) -> list[Column]:
    """path, line, column, code, message and severity of a line's parts."""
    part = lambda i: F.get(g, F.lit(i))
    message = F.trim(part(4))
    return [
        part(0).alias("path"),
        part(1).try_cast("int").alias("line"),
        part(2).try_cast("int").alias("column"),
        F.nullif(F.regexp_extract(message, _CODE, 1), F.lit("")).alias("code"),
        F.regexp_replace(message, _CODE, "").alias("message"),
        F.lower(F.coalesce(F.nullif(part(3), F.lit("")), F.lit("error"))).alias("severity"),
    ]


def text(runs: DataFrame) -> DataFrame:
    """`path:line[:column]: [severity:] message [code]` lines of failed runs; without any, the last line that says something."""
    rows = lines_of(runs.where("exit_code <> 0")).withColumn("s", F.btrim("raw", F.lit(_WHITE))).where("s <> ''")
    # each pattern is tried once, and only where a number stands between colons: its groups come back as one string
    rows = rows.withColumn("p", _placed(F.col("s"))).withColumn("p", _placed(F.col("s"), F.col("p")))
    rows = rows.withColumn("g", _parts(F.col("s"), F.col("p"))).drop("p")
    found = rows.where("g IS NOT NULL").select("run", "pos", "tool", *_told(F.col("g")))
    last = rows.groupBy("run", "tool").agg(F.max_by("s", "pos").alias("s"), F.max("pos").alias("pos"), F.bool_or(F.col("g").isNotNull()).alias("any"))
    rest = last.where("NOT any").select("run", "pos", "tool", F.substring("s", 1, 1000).alias("message"), F.lit("error").alias("severity"))
    return _shaped(found).unionByName(_shaped(rest))


#: What text() finds in a run, but for what it never fills.
_SAID = "struct<pos:int,path:string,line:int,column:int,code:string,message:string,severity:string>"


def _said() -> Column:
    """What text() finds in a failed run, as an array of _SAID: no join or group, so that it costs nothing beside what else is read from the run."""
    lines = F.split(F.concat("stdout", F.lit("\n"), F.coalesce("stderr", F.lit(""))), "\r\n|\n|\r")
    lines = F.filter(F.transform(lines, lambda raw, i: F.struct(i.alias("pos"), F.btrim(raw, F.lit(_WHITE)).alias("s"))), lambda x: x["s"] != "")
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), _placed(x["s"]).alias("p")))
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), _placed(x["s"], x["p"]).alias("p")))
    lines = F.transform(lines, lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), _parts(x["s"], x["p"]).alias("g")))
    null = lambda kind: F.lit(None).cast(kind)

    def found(all_: Column) -> Column:
        hits = F.transform(F.filter(all_, lambda x: x["g"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), *_told(x["g"])))
        last = F.transform(F.slice(all_, -1, 1), lambda x: F.struct(x["pos"].alias("pos"), null("string").alias("path"), null("int").alias("line"), null("int").alias("column"), null("string").alias("code"), F.substring(x["s"], 1, 1000).alias("message"), F.lit("error").alias("severity")))
        return F.when(F.exists(all_, lambda x: x["g"].isNotNull()), hits).otherwise(last)

    return F.when(F.col("exit_code") != 0, F.get(F.transform(F.array(lines), found), F.lit(0)))


def _lines_or_text(runs: DataFrame, found: DataFrame, quiet_codes: tuple[int, ...] = ()) -> DataFrame:
    """found, and the text parser's findings for runs that gave none and whose exit code is not quiet."""
    none = runs.where(~F.col("exit_code").isin(*quiet_codes)) if quiet_codes else runs
    return _shaped(found).unionByName(text(none.join(found.select("run").distinct(), "run", "left_anti")))


def headed(runs: DataFrame) -> DataFrame:
    """File names on lines of their own, then `line: CODE: message` rows that belong to the last name."""
    rows = lines_of(runs).withColumn("s", F.trim("raw"))
    header = F.when(F.col("s").rlike(r"^\S.*\.py$") & ~F.contains("s", F.lit(":")), F.col("s"))
    rows = rows.withColumn("path", F.last(header, ignorenulls=True).over(W.partitionBy("run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    pattern = r"^(\d+):\s*(DOC\d{3}):\s*(.+)$"
    hit = rows.where(F.col("s").rlike(pattern) & F.col("path").isNotNull())
    return _lines_or_text(runs, hit.select("run", "pos", "tool", "path", F.regexp_extract("s", pattern, 1).cast("int").alias("line"), F.regexp_extract("s", pattern, 2).alias("code"), F.regexp_extract("s", pattern, 3).alias("message"), F.lit("error").alias("severity")))


def _get(path: str, kind: str = "string", of: str = "item") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _json(empty: str | None = "[]") -> Column:
    """stdout as VARIANT, null where it is no JSON. empty: what an output without a word stands for; None if that is no JSON either."""
    said = F.nullif(F.trim("stdout"), F.lit(""))
    return F.try_parse_json(said if empty is None else F.coalesce(said, F.lit(empty)))


def _items(runs: DataFrame, *paths: str) -> DataFrame:
    """One row for each item of the first of the arrays that is there."""
    parsed = runs.withColumn("doc", _json())
    array = F.coalesce(*(F.try_variant_get("doc", p, "array<variant>") for p in (*paths, "$")))
    return parsed.select("run", "tool", "exit_code", F.posexplode(array).alias("pos", "item"))


def _items_or_text(runs: DataFrame, *paths: str) -> DataFrame:
    """Like _items(), with a row for each of text()'s findings, in `said`, of runs whose output is no JSON: one pass, where a union would make and parse the outputs again for each of its sides."""
    parsed = runs.withColumn("doc", _json())
    array = F.coalesce(*(F.try_variant_get("doc", p, "array<variant>") for p in (*paths, "$")))
    items = F.transform(array, lambda x: F.struct(x.alias("item"), F.lit(None).cast(_SAID).alias("said")))
    lines = F.transform(_said(), lambda x: F.struct(F.lit(None).cast("variant").alias("item"), x.cast(_SAID).alias("said")))
    rows = parsed.select("run", "tool", "exit_code", F.posexplode(F.when(F.col("doc").isNotNull(), items).otherwise(lines)).alias("pos", "x"))
    return rows.select("run", "tool", "exit_code", F.coalesce("x.said.pos", "pos").alias("pos"), "x.item", "x.said")


def _either(rows: DataFrame, *columns: Column) -> DataFrame:
    """columns: named ones of FIELDS over items. Findings of the items and, as they are, those that were said."""
    found = rows.select("run", "pos", "tool", "said", *columns)
    names = [c for c in found.columns if c not in ("run", "pos", "tool", "said")]
    told = set(found.schema["said"].dataType.names)
    other = lambda c: F.col("said")[c] if c in told else F.lit(False if c == "fixable" else None)
    return _shaped(found.select("run", "pos", "tool", *(F.when(F.col("said").isNull(), F.col(c)).otherwise(other(c)).alias(c) for c in names)))


def _nested(runs: DataFrame, paths: tuple[str, ...], inner: tuple[str, ...], place: tuple[str, ...], alone: bool = False) -> DataFrame:
    """One row for each inner item of all items, numbered through; place is the outer item's. alone: an item without inner ones is one itself."""
    at = lambda of, names, kind: F.coalesce(*(F.try_variant_get(of, p, kind) for p in names)) if names else F.lit(None).cast(kind)
    array = F.coalesce(*(F.try_variant_get("doc", p, "array<variant>") for p in (*paths, "$")))
    within = lambda i: F.coalesce(at(i, inner, "array<variant>"), *([F.array(i)] if alone else []))
    flat = F.flatten(F.transform(array, lambda i: F.coalesce(F.transform(within(i), lambda x: F.struct(at(i, place, "string").alias("place"), x.alias("item"))), F.array())))
    parsed = runs.withColumn("doc", _json())
    return parsed.select("run", "tool", "exit_code", F.posexplode(flat).alias("pos", "x")).select("run", "tool", "exit_code", "pos", "x.*")


def _with_fallback(runs: DataFrame, found: DataFrame, when_empty: bool = False, empty: str | None = "[]") -> DataFrame:
    """found, and the text parser's findings for runs whose output is no JSON (or, if asked, that gave nothing)."""
    bad = runs.where(_json(empty).isNull())
    if when_empty:
        bad = bad.unionByName(runs.where(_json(empty).isNotNull()).join(found.select("run").distinct(), "run", "left_anti"))
    return _shaped(found).unionByName(text(bad))


#: Presentation rules by prefix or in full; fixed values.
STYLE_PREFIXES = ("D", "COM", "Q", "I", "N", "PTH", "T20", "TD", "FIX", "ERA", "EM")
STYLE_CODES = ("E501", "W505")


def ruff(runs: DataFrame) -> DataFrame:
    rows = _items_or_text(runs).withColumn("code", _get("$.code")).withColumn("fix", _get("$.fix", "variant"))
    rows = rows.withColumn("has_fix", F.col("fix").isNotNull() & (F.schema_of_variant("fix") != "VOID"))
    style = F.col("code").rlike("^(" + "|".join(STYLE_PREFIXES) + ")") | F.col("code").isin(*STYLE_CODES)
    return _either(
        rows, _get("$.filename").alias("path"), _get("$.location.row", "int").alias("line"), _get("$.location.column", "int").alias("column"), F.col("code"),
        F.coalesce(_get("$.message"), F.lit("Ruff finding")).alias("message"), F.when(style, "note").otherwise("error").alias("severity"), F.coalesce("has_fix", F.lit(False)).alias("fixable"),
        F.when(F.col("has_fix"), F.lower(F.coalesce(_get("$.fix.applicability"), F.lit("unknown")))).alias("fix_safety"), _get("$.fix.message").alias("fix_preview"),
    )


def pylint(runs: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce(_get("$.type"), _get("$.category"), F.lit("error")))
    severity = F.when(kind.isin("fatal", "error"), "error").when(kind.isin("refactor", "convention", "info"), "note").otherwise("warning")
    found = _items(runs, "$.messages", "$.results").select(
        "run", "pos", "tool", F.coalesce(_get("$.path"), _get("$.abspath"), _get("$.module")).alias("path"), _get("$.line", "int").alias("line"), _get("$.column", "int").alias("column"),
        F.coalesce(_get("$.symbol"), _get('$["message-id"]'), _get("$.messageId")).alias("code"), F.coalesce(_get("$.message"), F.lit("Pylint finding")).alias("message"), severity.alias("severity"),
    )
    return _with_fallback(runs, found, when_empty=True)


def semgrep(runs: DataFrame) -> DataFrame:
    """A start without its runtime is one error, not a clean scan."""
    banner = F.concat("stdout", F.lit("\n"), F.coalesce("stderr", F.lit(""))).rlike("No module named '?pkg_resources")
    broken = runs.where(banner).select("run", F.lit(0).alias("pos"), "tool", F.lit("semgrep cannot start: pkg_resources is missing").alias("message"), F.lit("error").alias("severity"))
    runs = runs.where(~banner)
    fix = _get("$.extra.fix")
    found = _items(runs, "$.results").select(
        "run", "pos", "tool", _get("$.path").alias("path"), _get("$.start.line", "int").alias("line"), _get("$.start.col", "int").alias("column"), _get("$.check_id").alias("code"),
        F.coalesce(_get("$.extra.message"), F.lit("Semgrep finding")).alias("message"), F.lower(F.coalesce(_get("$.extra.severity"), F.lit("error"))).alias("severity"),
        F.coalesce(fix != "", F.lit(False)).alias("fixable"), F.when(fix != "", "rule").alias("fix_safety"), F.substring(F.nullif(fix, F.lit("")), 1, 500).alias("fix_preview"),
    )
    return _with_fallback(runs, found, empty=None).unionByName(_shaped(broken))


def basedpyright(runs: DataFrame) -> DataFrame:
    """Lines and columns come counted from zero."""
    found = _items(runs, "$.generalDiagnostics").select(
        "run", "pos", "tool", _get("$.file").alias("path"), (_get("$.range.start.line", "int") + 1).alias("line"), (_get("$.range.start.character", "int") + 1).alias("column"), _get("$.rule").alias("code"),
        F.coalesce(_get("$.message"), F.lit("type error")).alias("message"), F.coalesce(_get("$.severity"), F.lit("error")).alias("severity"),
    )
    return _with_fallback(runs, found, empty=None)


def json_list(runs: DataFrame) -> DataFrame:
    """Any list of diagnostics, under the names that such fields usually have."""
    first = lambda *paths, kind="string": F.coalesce(*(_get(p, kind) for p in paths))
    found = _items(runs, "$.results", "$.errors", "$.issues", "$.diagnostics", "$.messages").select(
        "run", "pos", "tool", first("$.path", "$.file", "$.filename", "$.location.path", "$.location.file").alias("path"),
        first("$.line", "$.row", "$.lineno", "$.start.line", "$.location.line", "$.location.row", kind="int").alias("line"),
        first("$.column", "$.col", "$.start.col", "$.start.column", "$.location.column", kind="int").alias("column"),
        first("$.code", "$.rule", "$.check_id", "$.ruleId", "$.id").alias("code"), F.coalesce(first("$.message", "$.msg", "$.description"), F.concat("tool", F.lit(" finding"))).alias("message"),
        F.lower(F.coalesce(first("$.severity", "$.level"), F.lit("error"))).alias("severity"),
    )
    return _with_fallback(runs, found, when_empty=True)


def sarif(runs: DataFrame) -> DataFrame:
    outer = _items(runs, "$.runs").select("run", "tool", "exit_code", F.posexplode(_get("$.results", "array<variant>")).alias("pos", "item"))
    level = F.lower(F.coalesce(_get("$.level"), F.lit("warning")))
    at = "$.locations[0].physicalLocation"
    found = outer.select(
        "run", "pos", "tool", _get(f"{at}.artifactLocation.uri").alias("path"), _get(f"{at}.region.startLine", "int").alias("line"), _get(f"{at}.region.startColumn", "int").alias("column"),
        _get("$.ruleId").alias("code"), F.coalesce(_get("$.message.text"), _get("$.message.markdown"), F.lit("SARIF finding")).alias("message"), level.alias("severity"),
    )
    return _with_fallback(runs, found)


def helper(runs: DataFrame) -> DataFrame:
    """The scanners' own output."""
    found = _items(runs, "$.findings").select(
        "run", "pos", F.coalesce(_get("$.tool"), F.col("tool")).alias("tool"), _get("$.path").alias("path"), _get("$.line", "int").alias("line"), _get("$.column", "int").alias("column"), _get("$.code").alias("code"),
        F.coalesce(_get("$.message"), F.lit("finding")).alias("message"), F.coalesce(_get("$.severity"), F.lit("warning")).alias("severity"),
    )
    return _with_fallback(runs, found)


def json_lines(path=("$.path", "$.filepath"), line=("$.line", "$.start_line"), column=("$.column", "$.start_column"), code=("$.type", "$.code"), message=("$.message",), default: str = "finding") -> Parser:
    """A parser for one JSON object a line; bad lines are left out."""

    def parser(runs: DataFrame) -> DataFrame:
        rows = lines_of(runs.withColumn("stderr", F.lit(""))).withColumn("item", F.try_parse_json("raw")).where("item IS NOT NULL AND trim(raw) LIKE '{%'")
        found = rows.select("run", "pos", "tool", _first(path).alias("path"), _first(line, "int").alias("line"), _first(column, "int").alias("column"), _first(code).alias("code"), F.coalesce(_first(message), F.lit(default)).alias("message"), F.lit("error").alias("severity"))
        return _lines_or_text(runs, found)

    return parser


def matched(pattern: str, path: int = 1, line: int | None = None, column: int | None = None, code=None, message=None, severity=None, quiet_codes: tuple[int, ...] = ()) -> Parser:
    """A parser for lines that fit the pattern. path, line, column: groups; code, message, severity: columns of the group function it hands them."""

    def parser(runs: DataFrame) -> DataFrame:
        group = lambda i: F.nullif(F.regexp_extract("s", pattern, i), F.lit(""))
        rows = lines_of(runs).withColumn("s", fx.stripped(F.col("raw"))).where(F.col("s").rlike(pattern))
        number = lambda i: group(i).cast("int") if i else F.lit(None).cast("int")
        found = rows.select("run", "pos", "tool", group(path).alias("path"), number(line).alias("line"), number(column).alias("column"), code(group).alias("code"), message(group).alias("message"), severity(group).alias("severity"))
        return _lines_or_text(runs, found, quiet_codes)

    return parser


def surviving(runs: DataFrame) -> DataFrame:
    """Lines that name a mutant that survived."""
    rows = lines_of(runs).where(F.lower("raw").rlike("survived|suspicious"))
    return _shaped(rows.select("run", "pos", "tool", F.trim("raw").alias("message"), F.lit("warning").alias("severity")))


def import_times(runs: DataFrame, budget_ms: int = 1000) -> DataFrame:
    """The cumulative microseconds of the last row of an import-time table, where over budget; a failed import with what it said beside the table."""
    timed = r"^import time:\s*\d+ \|\s*\d+ \|"
    rows = lines_of(runs.where("exit_code = 0")).where(F.col("raw").rlike(timed))
    last = rows.groupBy("run", "tool").agg(F.max_by("raw", "pos").alias("raw"), F.max("pos").alias("pos"))
    parts = F.split("raw", r"\|")
    ms = F.floor(F.trim(parts[1]).try_cast("long") / 1000)
    message = F.concat(F.lit("importing "), F.trim(parts[2]), F.lit(" takes "), ms.cast("string"), F.lit(" ms"))
    slow = last.where(ms > budget_ms).select("run", "pos", "tool", F.lit("BHPERF001").alias("code"), message.alias("message"), F.lit("warning").alias("severity"))
    said = F.filter(F.split(F.coalesce("stderr", F.lit("")), "\r\n|\n|\r"), lambda line: ~F.startswith(line, F.lit("import time:")))
    detail = F.coalesce(F.nullif(F.btrim(F.array_join(said, "\n"), F.lit(_WHITE)), F.lit("")), F.btrim("stderr", F.lit(_WHITE)), F.lit(""))
    failed = runs.where("exit_code <> 0").select("run", F.lit(0).alias("pos"), "tool", F.lit("BHPERF001").alias("code"), F.concat(F.lit("import failed: "), F.right(detail, F.lit(1000))).alias("message"), F.lit("warning").alias("severity"))
    return _shaped(slow).unionByName(_shaped(failed))


for _name, _parser in {"text": text, "pydoclint": headed, "ruff": ruff, "pylint": pylint, "semgrep": semgrep, "basedpyright": basedpyright, "json": json_list, "sarif": sarif, "helper": helper, "mutmut": surviving, "importtime": import_times}.items():
    register(_name, _parser)


def parse(runs: DataFrame, parser: str) -> DataFrame:
    return PARSERS[parser](runs)


# ---------------------------------------------------------------- parsers told by where their fields are


def _first(paths: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*(_get(p, kind) for p in paths)) if paths else F.lit(None).cast(kind)


def spec(items: tuple[str, ...], message: tuple[str, ...], default: str, path=(), line=(), column=(), code=(), severity=(), level: str = "error", raw: bool = False, inner: tuple[str, ...] = (), outer_path=(), code_prefix: str = "", when_empty: bool = True, quiet: str | None = None, base: int = 0, empty: str | None = "[]") -> Parser:
    """A parser for JSON whose fields are at the given paths, the first that is there.

    items: where the list is; inner: a list inside each item, whose path may be the outer item's (outer_path).
    quiet: output with this text means that nothing was in scope. base: added to lines and columns. raw: severities
    stay as they are, in lower case. empty: what an output without a word stands for.
    """
    words = lambda: F.lower(F.coalesce(_first(severity), F.lit(level))) if raw else fx.parsed_severity(_first(severity), level)

    def parser(runs: DataFrame) -> DataFrame:
        if quiet:
            runs = runs.where(~F.contains(F.concat("stdout", F.coalesce("stderr", F.lit(""))), F.lit(quiet)))
        rows = _nested(runs, items, inner, outer_path) if inner else _items(runs, *items).withColumn("place", _first(outer_path))
        found = rows.select(
            "run",
            F.col("pos").cast("int").alias("pos"),
            "tool",
            F.coalesce(F.col("place"), _first(path)).alias("path"),
            (_first(line, "int") + base).alias("line"),
            (_first(column, "int") + base).alias("column"),
            F.concat(F.lit(code_prefix), _first(code)).alias("code"),
            F.coalesce(_first(message), F.lit(default)).alias("message"),
            words().alias("severity") if severity else F.lit(level).alias("severity"),
        )
        return _with_fallback(runs, found, when_empty, empty)

    return parser


register("shellcheck", spec(("$.comments",), ("$.message",), "ShellCheck finding", path=("$.file",), line=("$.line",), column=("$.column",), code=("$.code",), severity=("$.level",), level="warning", code_prefix="SC"))
register("hadolint", spec((), ("$.message",), "Hadolint finding", path=("$.file",), line=("$.line",), column=("$.column",), code=("$.code",), severity=("$.level",), level="warning"))
register("sqlfluff", spec((), ("$.description", "$.message"), "SQLFluff finding", line=("$.start_line_no", "$.line_no"), column=("$.start_line_pos", "$.line_pos"), code=("$.code",), inner=("$.violations",), outer_path=("$.filepath", "$.path")))
register("golangci-lint", spec(("$.Issues", "$.issues"), ("$.Text", "$.text"), "Go correctness finding", path=("$.Pos.Filename", "$.pos.filename"), line=("$.Pos.Line", "$.pos.line"), column=("$.Pos.Column", "$.pos.column"), code=("$.FromLinter", "$.fromLinter", "$.linter")))
register("bandit", spec(("$.results",), ("$.issue_text",), "Bandit finding", path=("$.filename",), line=("$.line_number",), column=("$.col_offset",), code=("$.test_id",), severity=("$.issue_severity",), raw=True, when_empty=False, empty=None))


def phpstan(runs: DataFrame) -> DataFrame:
    """Messages by file, then errors without a place, numbered through."""
    parsed = runs.withColumn("doc", _json("{}")).where("doc IS NOT NULL")
    files = F.coalesce(F.map_entries(F.try_variant_get("doc", "$.files", "map<string,variant>")), F.array())
    of_file = lambda f: F.coalesce(F.transform(F.try_variant_get(f["value"], "$.messages", "array<variant>"), lambda m: F.struct(f["key"].alias("path"), m.alias("item"), F.lit(None).cast("string").alias("loose"))), F.array())
    loose = F.transform(F.coalesce(F.try_variant_get("doc", "$.errors", "array<string>"), F.array()), lambda e: F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("variant").alias("item"), e.alias("loose")))
    rows = parsed.select("run", "tool", F.posexplode(F.concat(F.flatten(F.transform(files, of_file)), loose)).alias("pos", "x")).select("run", "tool", "pos", "x.*")
    found = rows.select("run", "pos", "tool", "path", _get("$.line", "int").alias("line"), _get("$.identifier").alias("code"), F.coalesce("loose", _get("$.message"), F.lit("PHPStan finding")).alias("message"), F.lit("error").alias("severity"))
    return _with_fallback(runs, found, when_empty=True, empty="{}")


def clippy(runs: DataFrame) -> DataFrame:
    """Compiler messages among JSON lines, at their primary span; a failed run without any speaks for itself."""
    rows = lines_of(runs.withColumn("stderr", F.lit(""))).withColumn("item", F.try_parse_json("raw")).where(F.try_variant_get("item", "$.reason", "string") == "compiler-message")
    spans = F.filter(_get("$.message.spans", "array<variant>"), lambda s: F.try_variant_get(s, "$.is_primary", "boolean"))
    rows = rows.withColumn("span", F.get(spans, F.lit(0))).where(_get("$.message.level").isin("error", "warning"))
    at = lambda p, k="string": F.try_variant_get("span", p, k)
    message = F.coalesce(F.nullif(_get("$.message.message"), F.lit("")), F.lit("Clippy finding"))
    return _lines_or_text(runs, rows.select("run", "pos", "tool", at("$.file_name").alias("path"), at("$.line_start", "int").alias("line"), at("$.column_start", "int").alias("column"), _get("$.message.code.code").alias("code"), message.alias("message"), _get("$.message.level").alias("severity")))


def cppcheck(runs: DataFrame) -> DataFrame:
    """XML on stderr: each error at its first location. What is no XML there is read as text."""
    place = "struct<_file: string, _line: string, _column: string>"
    schema = f"struct<errors: struct<error: array<struct<_id: string, _severity: string, _msg: string, _verbose: string, location: array<{place}>>>>, broken: string>"
    parsed = runs.withColumn("x", F.from_xml(F.trim("stderr"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    whole = F.coalesce(F.trim("stderr").like("<%") & F.col("x").isNotNull() & F.col("x.broken").isNull(), F.lit(False))
    rows = parsed.where(whole).select("run", "tool", F.posexplode("x.errors.error").alias("pos", "e"))
    first = F.get("e.location", F.lit(0))
    number = lambda f: F.when(first.getField(f).rlike("^[0-9]+$"), first.getField(f).try_cast("int"))
    severity = fx.parsed_severity(F.col("e._severity"), "warning")
    message = F.coalesce(F.nullif("e._verbose", F.lit("")), F.nullif("e._msg", F.lit("")), F.lit("Cppcheck finding"))
    found = rows.select("run", "pos", "tool", first.getField("_file").alias("path"), number("_line").alias("line"), number("_column").alias("column"), F.col("e._id").alias("code"), message.alias("message"), severity.alias("severity"))
    return _shaped(found).unionByName(text(parsed.where(~whole).drop("x")))


def eslint(runs: DataFrame) -> DataFrame:
    """Messages by file, or a plain list of diagnostics; severity 2 is an error, and a fix wants review."""
    rows = _nested(runs, ("$.results", "$.diagnostics"), ("$.messages", "$.diagnostics"), ("$.filePath", "$.path", "$.filename"), alone=True)
    fix = _get("$.fix", "variant").isNotNull() & (F.schema_of_variant(_get("$.fix", "variant")) != "VOID")
    found = rows.select(
        "run", "pos", "tool", F.coalesce("place", _first(("$.filePath", "$.path", "$.filename"))).alias("path"), _first(("$.line", "$.start_line"), "int").alias("line"), _first(("$.column", "$.start_column"), "int").alias("column"),
        _first(("$.ruleId", "$.rule_id", "$.code")).alias("code"), F.coalesce(_first(("$.message", "$.description")), F.concat("tool", F.lit(" finding"))).alias("message"), F.when(_get("$.severity").isin("2", "error"), "error").otherwise("warning").alias("severity"),
        F.coalesce(fix, F.lit(False)).alias("fixable"), F.when(fix, "review").alias("fix_safety"),
    )
    return _with_fallback(runs, found, when_empty=True)


def oxlint(runs: DataFrame) -> DataFrame:
    return eslint(runs.where(~F.contains("stdout", F.lit("No files found to lint"))))


def radon(runs: DataFrame) -> DataFrame:
    """Maintainability by file; up to 19 is reported, up to 9 as an error."""
    parsed = runs.withColumn("doc", F.try_parse_json(F.coalesce(F.nullif(F.trim("stdout"), F.lit("")), F.lit("{}"))))
    files = parsed.where("doc IS NOT NULL").select("run", "tool", F.posexplode(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))).alias("pos", "f"))
    value = F.try_variant_get(F.col("f.value"), "$.mi", "double")
    rank = F.coalesce(F.nullif(F.try_variant_get(F.col("f.value"), "$.rank", "string"), F.lit("")), F.lit("?"))
    message = F.concat(F.lit("maintainability index is "), F.format_string("%.1f", value), F.lit(" (rank "), rank, F.lit(")"))
    found = files.where(value <= 19).select("run", "pos", "tool", F.col("f.key").alias("path"), F.lit("RADON_MI").alias("code"), message.alias("message"), F.when(value <= 9, "error").otherwise("warning").alias("severity"))
    return _with_fallback(runs, found)


def nox(runs: DataFrame) -> DataFrame:
    """A finding for each failed session, in order of name, with the last line that tells why."""
    rows = runs.where("exit_code <> 0").withColumn("all", F.concat("stdout", F.lit("\n"), F.coalesce("stderr", F.lit(""))))
    names = lambda p: F.array_distinct(F.regexp_extract_all("all", F.lit(p), F.lit(1)))
    first, second = names(r"Session\s+(\S+?)\s+failed\."), names(r"\*\s+(\S+?):\s+failed")
    why = r"unrecognized arguments|^FAILED|^(ERROR|error|E\s)|^=+.*(?i:fail|error)|^\d+\s+(failed|passed|error)"
    lines = F.filter(F.transform(F.split("all", "\r\n|\n|\r"), fx.stripped), lambda x: x.rlike(why))
    rows = rows.withColumn("failed", F.array_sort(F.when(F.size(first) > 0, first).otherwise(second)))
    cause = F.coalesce(F.substring(F.get(lines, F.size(lines) - 1), 1, 300), F.lit("no failure detail captured"))
    rows = rows.withColumn("cause", F.when(F.size(lines) > 0, cause).otherwise("no failure detail captured"))
    found = rows.select("run", F.lit("python-matrix").alias("tool"), F.posexplode("failed").alias("pos", "session"), "cause")
    found = found.select("run", "pos", "tool", F.concat(F.lit("nox session "), "session", F.lit(" failed: "), "cause").alias("message"), F.lit("error").alias("severity"))
    return _shaped(found).unionByName(text(rows.where(F.size("failed") == 0).withColumn("tool", F.lit("python-matrix"))))


def corpus(runs: DataFrame) -> DataFrame:
    """Hits of detectors of past bugs; a scan that failed or can't be read is an error, never clean."""
    parsed = runs.withColumn("doc", F.try_parse_json(F.coalesce(F.nullif(F.trim("stdout"), F.lit("")), F.lit("{}"))))
    items = F.coalesce(F.try_variant_get("doc", "$.findings", "array<variant>"), F.array().cast("array<variant>"))
    rows = parsed.where("doc IS NOT NULL").select("run", "tool", "exit_code", items.alias("items"))
    hits = rows.select("run", "tool", F.posexplode("items").alias("pos", "item"))
    detector, family = F.coalesce(_get("$.detector_id"), F.lit("?")), F.coalesce(_get("$.bug_family"), F.lit("?"))
    message = F.concat(F.lit("["), family, F.lit("/"), detector, F.lit("] bug "), F.coalesce(_get("$.bug_cases[0]"), F.lit("?")), F.lit(": "), F.coalesce(_get("$.message"), F.lit("hit of a detector of past bugs")))
    found = hits.select("run", "pos", "tool", _get("$.path").alias("path"), _get("$.start_line", "int").alias("line"), F.when(detector == "?", "BHBUGC002").otherwise(detector).alias("code"), message.alias("message"), F.coalesce(_get("$.severity"), F.lit("warning")).alias("severity"))
    failed = rows.where("exit_code <> 0 AND size(items) = 0").select("run", F.lit(0).alias("pos"), "tool", F.lit("BHBUGC001").alias("code"), F.concat(F.lit("corpus scan failed (exit "), F.col("exit_code").cast("string"), F.lit(")")).alias("message"), F.lit("error").alias("severity"))
    unread = parsed.where("doc IS NULL").select("run", F.lit(0).alias("pos"), "tool", F.lit("BHBUGC001").alias("code"), F.concat(F.lit("corpus scan gave no JSON: "), F.right("stdout", F.lit(500))).alias("message"), F.lit("error").alias("severity"))
    return _shaped(found).unionByName(_shaped(failed)).unionByName(_shaped(unread))


def traces(runs: DataFrame) -> DataFrame:
    """Diagnostics of trace verification; exit codes but 0 and 1, and output that can't be read, are errors."""
    parsed = runs.withColumn("doc", F.try_parse_json(F.coalesce(F.nullif(F.trim("stdout"), F.lit("")), F.lit("{}"))))
    ran = F.col("exit_code").isin(0, 1)
    hits = parsed.where(ran & F.col("doc").isNotNull()).select("run", "tool", F.posexplode(F.try_variant_get("doc", "$.diagnostics", "array<variant>")).alias("pos", "item"))
    rule = F.coalesce(_get("$.rule"), F.lit("unknown"))
    message = F.concat(F.lit("["), rule, F.lit("] "), F.coalesce(_get("$.message"), F.lit("trace diagnostic")), F.coalesce(F.concat(F.lit(" (trace_id="), F.nullif(_get("$.trace_id"), F.lit("")), F.lit(")")), F.lit("")))
    found = hits.select("run", "pos", "tool", _get("$.path").alias("path"), _get("$.line", "int").alias("line"), F.concat(F.lit("trace:"), rule).alias("code"), message.alias("message"), F.lower(F.coalesce(_get("$.severity"), F.lit("error"))).alias("severity"))
    why = F.when(~ran, F.concat(F.lit("trace verification failed to run (exit "), F.col("exit_code").cast("string"), F.lit(")"))).otherwise("trace verification gave no JSON")
    broken = parsed.where(~ran | F.col("doc").isNull()).select("run", F.lit(0).alias("pos"), "tool", F.lit("BHVERIFY002").alias("code"), why.alias("message"), F.lit("error").alias("severity"))
    return _shaped(found).unionByName(_shaped(broken))


def trace_health(runs: DataFrame) -> DataFrame:
    """Counts of broken and stale references, where there are any."""
    rows = runs.where("exit_code = 0").withColumn("item", F.try_parse_json(F.coalesce(F.nullif(F.trim("stdout"), F.lit("")), F.lit("{}"))))
    count = lambda p: F.coalesce(_get(p, "int"), F.lit(0))
    of = lambda p, what: F.when(count(p) > 0, F.concat(F.lit("trace graph has "), count(p).cast("string"), F.lit(what)))
    each = rows.select("run", "tool", F.posexplode(F.array(of("$.broken_refs", " broken reference(s)"), of("$.blocking_stale", " blocking stale trace(s)"))).alias("pos", "message"))
    return _shaped(each.where("message IS NOT NULL").select("run", "pos", "tool", F.lit("BHVERIFY003").alias("code"), "message", F.lit("error").alias("severity")))


def drift(runs: DataFrame) -> DataFrame:
    """Structural drift of a graph; a failed run is an error."""
    rows = _items(runs.where("exit_code = 0"))
    message = F.concat(F.lit("[scc/"), F.coalesce(_get("$.id"), F.lit("?")), F.lit("] "), F.coalesce(_get("$.message"), F.lit("structural drift")))
    found = rows.where(F.startswith(F.schema_of_variant(F.col("item")), F.lit("OBJECT"))).select("run", "pos", F.lit("scc").alias("tool"), F.concat(F.lit("scc:"), F.coalesce(_get("$.kind"), F.lit("drift"))).alias("code"), message.alias("message"), F.coalesce(_get("$.severity"), F.lit("warning")).alias("severity"))
    failed = F.concat(F.lit("scc drift failed (exit "), F.col("exit_code").cast("string"), F.lit("): "), F.right(F.coalesce("stderr", F.lit("")), F.lit(500)))
    return _shaped(found).unionByName(_shaped(runs.where("exit_code <> 0").select("run", F.lit(0).alias("pos"), F.lit("scc").alias("tool"), F.lit("BHGRAPH001").alias("code"), failed.alias("message"), F.lit("error").alias("severity"))))


def invariants(runs: DataFrame) -> DataFrame:
    """Each line of a failed check of declared invariants."""
    rows = lines_of(runs.where("exit_code <> 0")).withColumn("s", fx.stripped(F.col("raw"))).where("s <> ''")
    return _shaped(rows.select("run", "pos", F.lit("scc").alias("tool"), F.lit("BHGRAPH002").alias("code"), F.concat(F.lit("[scc/invariant] "), "s").alias("message"), F.lit("error").alias("severity")))


def nothing(runs: DataFrame) -> DataFrame:
    """For checks whose findings come from a second step."""
    return _shaped(runs.limit(0).select("run", F.lit(0).alias("pos"), "tool", F.lit("").alias("message"), F.lit("error").alias("severity")))


def _complexity(group) -> Column:
    return F.concat(F.lit("`"), group(2), F.lit("` cognitive complexity is "), group(3).cast("int").cast("string"), F.lit(" (budget 10)"))


_own = {"phpstan": phpstan, "clippy": clippy, "cppcheck": cppcheck, "eslint": eslint, "oxlint": oxlint, "radon": radon, "nox": nox, "corpus": corpus, "traces": traces, "trace-health": trace_health, "drift": drift, "invariants": invariants, "none": nothing}
_own |= {
    "pyrefly": spec(("$.errors", "$.diagnostics", "$.results", "$.messages"), ("$.message", "$.description", "$.name"), "Pyrefly finding", path=("$.path.path", "$.path.uri", "$.path", "$.file", "$.filename"), line=("$.line", "$.start.start.line", "$.start.line", "$.location.start.line", "$.location.line"), column=("$.column", "$.start.start.column", "$.start.column", "$.location.start.column", "$.location.column"), code=("$.name", "$.rule", "$.check_id", "$.code"), severity=("$.severity", "$.type"), raw=True),
    "ast-grep": spec((), ("$.message", "$.text"), "ast-grep finding", path=("$.file",), line=("$.range.start.line",), column=("$.range.start.column",), code=("$.ruleId",), when_empty=False, base=1),
    "tflint": spec(("$.issues",), ("$.message",), "TFLint finding", path=("$.range.filename", "$.filename"), line=("$.range.start.line",), column=("$.range.start.column",), code=("$.rule.name",), severity=("$.rule.severity",), level="warning"),
    "squawk": json_list,
    "json-lines": json_lines(),
    "deal": json_lines(path=("$.filename", "$.path"), line=("$.row", "$.line"), column=("$.col", "$.column"), code=("$.code",), message=("$.text", "$.message", "$.value"), default="Deal contract finding"),
    "actionlint": json_lines(path=("$.filepath", "$.file"), line=("$.line",), column=("$.column", "$.col"), code=("$.kind", "$.code"), default="GitHub Actions workflow problem"),
    "buf": json_lines(path=("$.path", "$.filename"), line=("$.start_line", "$.line"), column=("$.start_column", "$.column"), code=("$.rule_id", "$.rule"), default="Buf schema finding"),
    "complexipy": matched(r"^(.+?\.py)\s+(\S+)\s+(\d+)$", code=lambda g: F.lit("COG001"), message=_complexity, severity=lambda g: F.when(g(3).cast("int") <= 20, "warning").otherwise("error"), quiet_codes=(0, 1)),
    "lizard": matched(r"(?i)^(.+?):(\d+):\s*warning:\s*(.+)$", line=2, code=lambda g: F.when(F.contains(g(3), F.lit("CCN")), "LIZARD_CCN").when(F.contains(g(3), F.lit("NLOC")), "LIZARD_NLOC").otherwise("LIZARD"), message=lambda g: g(3), severity=lambda g: F.lit("warning"), quiet_codes=(0, 1)),
    "deptry": matched(r"^(.+?)(?::(\d+):(\d+))?:\s+(DEP\d{3})\s+(.+)$", line=2, column=3, code=lambda g: g(4), message=lambda g: g(5), severity=lambda g: F.lit("error")),
}
for _name, _parser in _own.items():
    register(_name, _parser)
