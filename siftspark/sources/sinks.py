"""What a run leaves behind: a report bundle, registries, the ledger, cached tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators import report

REPORT_VERSION = 3
QUEUE_VERSION = 3
RISK_VERSION = 1


def markdown_rows(df: DataFrame, columns: list[str], order: list[Column], limit: int) -> DataFrame:
    """A Markdown table of the first rows, one line a row, with their numbers."""
    cells = F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns))
    return df.orderBy(*order).limit(limit).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))


def write_report(findings: DataFrame, results: DataFrame, path: str) -> dict[str, str]:
    """All views below one folder, as JSON with a version each; the ranked ones also as Markdown. Returns their places."""
    findings = findings.persist()
    views = {
        "findings": (findings, REPORT_VERSION),
        "signals": (report.signal_groups(findings), REPORT_VERSION),
        "correlations": (report.correlated_locations(findings), REPORT_VERSION),
        "issues": (report.logical_issues(findings), REPORT_VERSION),
        "queue": (report.repair_queue(findings, results), QUEUE_VERSION),
        "risk": (report.risk_map(findings), RISK_VERSION),
        "summary": (report.run_summary(findings, results), REPORT_VERSION),
        "autofix": (report.autofix_summary(findings), REPORT_VERSION),
    }
    places = {}
    for name, (view, version) in views.items():
        places[name] = f"{path}/{name}"
        view.withColumn("schema_version", F.lit(version)).write.mode("overwrite").json(places[name])
    pages = {
        "signals_md": markdown_rows(report.signal_groups(findings), ["key", "count", "severity"], report.signal_order(), 100),
        "risk_md": markdown_rows(report.risk_map(findings), ["path", "score", "tool_count"], [F.desc("score"), F.desc("tool_count"), F.asc("path")], 200),
    }
    for name, lines in pages.items():
        places[name] = f"{path}/{name}"
        lines.coalesce(1).write.mode("overwrite").text(places[name])
    findings.unpersist()
    return places


def write_tasks(queue: DataFrame, path: str, most: int = 500) -> None:
    """One folder for each of the first signals, with its queue rows."""
    rows = report.task_groups(queue, most).drop("first_rank", "findings")
    rows.write.mode("overwrite").partitionBy("task").json(path)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """df as written under the key before, or written now."""
    spark = df.sparkSession
    path = f"{folder}/{key}"
    try:
        return spark.read.schema(df.schema).parquet(path)
    except Exception as missing:  # the reader raises AnalysisException where there is no such folder
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def registry(rows: DataFrame, version: int = 2) -> DataFrame:
    """Targets, capabilities, settings or models as one JSON value a row, with the version of their form."""
    return rows.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), *rows.columns)).alias("value"))


def write_registry(rows: DataFrame, path: str, order: list[str], version: int = 2) -> None:
    """registry(), in order, as JSON lines."""
    registry(rows.orderBy(*order), version).write.mode("overwrite").text(path)
