"""Report views: one function for each, from findings (and results) to a DataFrame.

findings: seq, result_name, category, tool, message, path, line, code, severity, fixable, fix_safety, accepted.
Accepted findings leave every ranked view. Order of arrival is `seq`; wherever it shows in a result, it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import findings as fx
from siftspark.operators import ordered


def live(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("accepted"))


def _located() -> Column:
    return (F.coalesce("path", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) != 0)


def _mark() -> Column:
    return fx.fingerprint(F.col("tool"), F.col("code"), F.col("path"), F.col("message"))


def _class() -> Column:
    return fx.defect_class(F.col("category"), F.col("code"))


def _codes() -> Column:
    return F.array_sort(F.collect_set(F.nullif("code", F.lit(""))))


def signal_groups(findings: DataFrame, shown: int = 8) -> DataFrame:
    """Findings by signal key: count, the first one's fields, the first `shown` locations.

    Only the first `shown` findings of a key are gathered; the rest are counted.
    """
    keyed = live(findings).withColumn("key", fx.signal_key(F.col("tool"), F.col("code"), F.col("message")))
    total = keyed.groupBy("key").agg(F.count("*").alias("count"))
    ranked = keyed.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("seq"))).where(F.col("nth") <= shown)
    place = F.when(F.coalesce("path", F.lit("")) != "", F.concat("path", F.lit(":"), F.coalesce(F.nullif("line", F.lit(0)).cast("string"), F.lit("?"))))
    first = lambda c: F.max(F.when(F.col("nth") == 1, F.col(c))).alias(c)
    locations = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("nth", place.alias("place")))), lambda x: x.place))
    shown_ = ranked.groupBy("key").agg(*(first(c) for c in ("tool", "code", "message", "severity")), locations.alias("locations"))
    return total.join(shown_, "key")


def signal_order() -> list[Column]:
    return [fx.severity_rank(F.col("severity")).asc(), F.desc("count"), F.asc("tool"), F.coalesce(F.nullif("code", F.lit("")), "message").asc()]


def correlated_locations(findings: DataFrame) -> DataFrame:
    """Places that two tools or more report."""
    worst = F.min_by("severity", F.struct(fx.severity_rank(F.col("severity")), "seq"))
    groups = live(findings).where(_located()).groupBy("path", "line").agg(
        F.array_sort(F.collect_set("tool")).alias("tools"), F.count("*").alias("finding_count"), _codes().alias("codes"), worst.alias("severity")
    )
    return groups.withColumn("tool_count", F.size("tools")).where("tool_count >= 2")


CORRELATION_ORDER = ("tool_count DESC", "finding_count DESC", "path", "line")


def logical_issues(findings: DataFrame) -> DataFrame:
    """One issue for each place and defect class; findings without a place stay alone by fingerprint."""
    rows = live(findings).withColumn("odc_class", _class()).withColumn("mark", _mark())
    where = F.when(_located(), F.col("path")).otherwise(F.concat(F.lit("<unlocated:"), "mark", F.lit(">")))
    rows = rows.withColumn("where", where).withColumn("at", F.when(_located(), F.col("line")).otherwise(0))
    order = F.struct(fx.severity_rank(F.col("severity")), F.when(F.startswith("code", F.lit("BH")), 0).otherwise(1), "tool", "seq")
    primary = F.min_by(F.struct("severity", "message"), order)
    groups = rows.groupBy("where", "at", "odc_class").agg(
        F.count("*").alias("finding_count"), F.array_sort(F.collect_set("tool")).alias("tools"), _codes().alias("codes"), primary.alias("p")
    )
    digest = F.upper(F.substring(F.sha2(F.concat_ws("|", "where", F.col("at").cast("string"), "odc_class"), 256), 1, 12))
    return groups.select(
        F.concat(F.lit("LOG-"), digest).alias("id"),
        F.when(~F.startswith("where", F.lit("<unlocated:")), F.col("where")).alias("path"),
        F.nullif("at", F.lit(0)).alias("line"),
        "odc_class",
        "finding_count",
        F.size("tools").alias("tool_count"),
        "tools",
        "codes",
        F.col("p.severity").alias("severity"),
        F.col("p.message").alias("primary_message"),
    )


def hotspots(findings: DataFrame, top: int = 20) -> DataFrame:
    counts = live(findings).where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.count("*").alias("count"), F.min("seq").alias("first_seen"))
    return counts.orderBy(F.desc("count"), "first_seen").limit(top)


def autofix_summary(findings: DataFrame) -> DataFrame:
    """Fixable findings by tool, with how safe their fixes are."""
    safety = F.lower(F.coalesce("fix_safety", F.lit("")))
    return live(findings).where("fixable").groupBy("tool").agg(
        F.count("*").alias("total"), F.count_if(safety == "safe").alias("safe"), F.count_if(safety == "unsafe").alias("unsafe"), F.count_if(~safety.isin("safe", "unsafe")).alias("review")
    )


def class_histogram(findings: DataFrame) -> DataFrame:
    return live(findings).groupBy(_class().alias("odc_class")).agg(F.count("*").alias("count"))


def risk_map(findings: DataFrame) -> DataFrame:
    """Attention score of every file: severities, coverage gaps, complexity, and how many tools agree."""
    complex_ = F.contains("category", F.lit("complex")) | F.coalesce(F.startswith("code", F.lit("BHCX")), F.lit(False))
    gap, branch = F.count_if(F.col("code") == "BHCOV001"), F.count_if(F.col("code") == "BHCOV002")
    rows = live(findings).where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(
        F.count("*").alias("findings"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.sum(fx.severity_weight(F.col("severity"))).alias("base"),
        gap.alias("coverage_gaps"),
        branch.alias("branch_gaps"),
        F.count_if(complex_).alias("complexity_signals"),
    )
    score = F.col("base") + 12 * F.col("coverage_gaps") + 16 * F.col("branch_gaps") + 5 * F.col("complexity_signals") + 8 * (F.size("tools") - 1)
    return rows.select("path", score.cast("long").alias("score"), "findings", F.size("tools").alias("tool_count"), "tools", "coverage_gaps", "branch_gaps", "complexity_signals")


RISK_ORDER = ("score DESC", "tool_count DESC", "path")


def risk_classes(findings: DataFrame) -> DataFrame:
    """How many findings of each class every file has."""
    return live(findings).where(F.coalesce("path", F.lit("")) != "").groupBy("path", _class().alias("odc_class")).agg(F.count("*").alias("count"))


def run_summary(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Counts over a whole run; accepted findings are in the raw total alone."""
    totals = findings.agg(F.count("*").alias("raw_findings"), F.count_if("accepted").alias("accepted_findings"))
    issues = logical_issues(findings).agg(F.count("*").alias("logical_issues"))
    status = results.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FINDINGS", "with_findings"), ("ERROR", "errors"), ("SKIPPED", "skipped"), ("N/A", "not_applicable"))))
    ratio = F.coalesce(F.try_divide(F.col("raw_findings") - F.col("accepted_findings"), F.col("logical_issues")), F.lit(0.0))
    return totals.crossJoin(issues).crossJoin(status).withColumn("raw_per_issue", F.round(ratio, 6))


def defense_health(results: DataFrame, by: str | None = None) -> DataFrame:
    """0 to 100 over the applicable checks, half-even; 100 where none applies. One row, or one for each value of `by`."""
    weight = F.when(F.lit(False), 0)
    for status, points in fx.HEALTH_WEIGHTS.items():
        weight = weight.when(F.col("status") == status, points)
    applies = F.col("status") != "N/A"
    score = F.coalesce(F.bround(F.try_divide(F.sum(F.when(applies, weight)), F.count_if(applies)), 0).cast("int"), F.lit(100))
    return (results.groupBy(by) if by else results.groupBy()).agg(score.alias("score"), F.count_if(applies).alias("applicable"))


def repair_queue(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Live findings in repair order, with the id of their correlated place and the command that verifies them.

    Commands are looked up by result name, the last one of a name winning, else by tool; a tool is also known by
    what stands before the colon of a result's name, where the first one wins unless the full name is taken.
    """
    ranked = ordered.numbered(correlated_locations(findings).select("path", "line", "tool_count", "finding_count"), [F.desc("tool_count"), F.desc("finding_count"), F.asc("path"), F.asc("line")], "rank")
    places = ranked.select("path", "line", F.format_string("CORR-%04d", "rank").alias("correlation_id"))
    exact = results.groupBy("name").agg(F.max_by("command", "seq").alias("exact_command"))
    prefix = results.select(F.split_part("name", F.lit(":"), F.lit(1)).alias("prefix"), "command", "seq").groupBy("prefix").agg(F.min_by("command", "seq").alias("prefix_command"))
    known = exact.join(prefix, exact.name == prefix.prefix, "full").select(F.coalesce("name", "prefix").alias("key"), F.coalesce("exact_command", "prefix_command").alias("verify"))
    rows = live(findings).join(places, ["path", "line"], "left")
    by_name = known.select(F.col("key").alias("result_name"), F.col("verify").alias("by_name"))
    by_tool = known.select(F.col("key").alias("tool"), F.col("verify").alias("by_tool"))
    rows = rows.join(by_name, "result_name", "left").join(by_tool, "tool", "left")
    return rows.select(
        "seq",
        fx.finding_id(_mark()).alias("id"),
        "tool",
        _class().alias("odc_class"),
        fx.signal_key(F.col("tool"), F.col("code"), F.col("message")).alias("signal_key"),
        "severity",
        "path",
        "line",
        "correlation_id",
        F.coalesce("by_name", "by_tool").alias("verification"),
        fx.queue_rank(F.col("severity")).alias("rank"),
    )


QUEUE_ORDER = ("rank", "coalesce(path, '')", "coalesce(line, 0)", "tool", "seq")


def disagreements(findings: DataFrame, results: DataFrame, checkers: tuple[str, ...] = ("mypy", "basedpyright", "pyrefly", "ty")) -> DataFrame:
    """Places that some of the type checkers present report and others don't; nothing with fewer than two present.

    A checker that failed is not present, but what it found still counts as a report.
    """
    present = results.where(F.col("name").isin(*checkers) & ~F.col("status").isin("SKIPPED", "N/A", "ERROR")).agg(F.array_sort(F.collect_set("name")).alias("present"))
    loud = live(findings).where(_located() & F.col("result_name").isin(*checkers)).groupBy("path", "line").agg(F.array_sort(F.collect_set("result_name")).alias("loud"))
    both = loud.crossJoin(F.broadcast(present)).where((F.size("present") >= 2) & (F.col("loud") != F.col("present")))
    silent = F.array_sort(F.array_except("present", "loud"))
    return both.select("path", "line", F.array_join("loud", ", ").alias("loud"), F.array_join(silent, ", ").alias("silent"))


def asset_budgets(assets: DataFrame, limits_kib: dict[str, float], bundle_kib: float) -> DataFrame:
    """assets: root, path, bytes. Files over the limit of their suffix, and roots over the limit of all together."""
    limit = F.lit(None).cast("double")
    for suffix, kib in limits_kib.items():
        limit = F.when(F.endswith("path", F.lit(suffix)), float(kib)).otherwise(limit)
    kib = F.col("bytes") / 1024
    files = assets.where(kib > limit).select(F.lit("BHCX005").alias("code"), "path", F.round(kib, 1).alias("kib"))
    roots = assets.groupBy("root").agg(F.sum("bytes").alias("bytes")).where(kib > bundle_kib).select(F.lit("BHCX006").alias("code"), F.col("root").alias("path"), F.round(kib, 1).alias("kib"))
    return files.unionByName(roots)


def missing_evidence(sites: DataFrame, evidence: DataFrame) -> DataFrame:
    """sites: path, line; evidence: any rows. One row, the first site and how many there are, unless there is evidence anywhere."""
    first = sites.agg(F.min(F.struct("path", "line")).alias("f"), F.count("*").alias("sites")).where("sites > 0")
    return first.join(evidence.limit(1).select(F.lit(1).alias("found")), F.lit(True), "left_anti").select("f.path", "f.line", "sites")


def numeric_ranges(comparisons: DataFrame, most: int = 4) -> DataFrame:
    """comparisons: name, pos, text. The first different comparisons of each name, joined by `and`."""
    first = comparisons.groupBy("name", "text").agg(F.min("pos").alias("pos"))
    rows = first.withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy("pos", "text"))).where(F.col("nth") <= most)
    return rows.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x.text), " and ").alias("accepted_range"))


def first_seen_union(*parts: DataFrame) -> DataFrame:
    """name, in the order in which the parts, one after another, first have it."""
    rows = None
    for i, part in enumerate(parts):
        part = part.select("name", "pos").withColumn("part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name").agg(F.min(F.struct("part", "pos")).alias("o")).select("name", "o.part", "o.pos")


def signal_members(findings: DataFrame) -> DataFrame:
    """key, seq and id of each finding of a signal group."""
    return live(findings).select(fx.signal_key(F.col("tool"), F.col("code"), F.col("message")).alias("key"), "seq", fx.finding_id(_mark()).alias("id"))


def autofix_members(findings: DataFrame) -> DataFrame:
    """tool, seq and id of each finding that can be fixed."""
    return live(findings).where("fixable").select("tool", "seq", fx.finding_id(_mark()).alias("id"))


def task_groups(queue: DataFrame, most: int = 500) -> DataFrame:
    """queue: as of repair_queue(). The first signals, by their most urgent finding, then by number, with the queue rows of each."""
    top = queue.groupBy("signal_key").agg(F.min("rank").alias("first_rank"), F.count("*").alias("findings")).orderBy("first_rank", F.desc("findings"), "signal_key").limit(most)
    return queue.join(top, "signal_key").withColumn("task", F.substring(F.sha2("signal_key", 256), 1, 12))
