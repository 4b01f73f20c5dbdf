"""Status of a check from its outcome, and of a run from its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_marker(markers: str) -> Column:
    return F.exists(F.coalesce(F.col(markers), F.array().cast("array<string>")), lambda m: F.contains("stdout", m) | F.contains(F.coalesce("stderr", F.lit("")), m))


def status(runs: DataFrame) -> DataFrame:
    """runs: name, exit_code, stdout, stderr, timed_out, n_findings, parse_error, findings_exit_codes, skip_exit_codes,
    error_markers, empty_scope_markers. Adds status, and whether findings are dropped or one is made up; the first
    rule that holds decides.
    """
    found = F.array_contains("findings_exit_codes", F.col("exit_code"))
    crashed = found & _any_marker("error_markers")
    state = (
        F.when(F.col("timed_out"), "ERROR")
        .when(F.col("parse_error").isNotNull(), "ERROR")
        .when(crashed, "ERROR")
        .when((F.col("n_findings") == 0) & _any_marker("empty_scope_markers"), "SKIPPED")
        .when(F.col("exit_code") == 0, F.when(F.col("n_findings") > 0, "FINDINGS").otherwise("PASS"))
        .when(found, "FINDINGS")
        .when(F.array_contains("skip_exit_codes", F.col("exit_code")), "SKIPPED")
        .otherwise("ERROR")
    )
    out = runs.withColumn("status", state)
    dropped = F.coalesce(crashed, F.lit(False)) & (F.col("status") == "ERROR") & F.col("parse_error").isNull() & ~F.col("timed_out")
    return out.withColumn("findings_dropped", dropped).withColumn("made_up", found & (F.col("status") == "FINDINGS") & (F.col("n_findings") == 0) & (F.col("exit_code") != 0))


def first_note(findings: DataFrame) -> DataFrame:
    """For each result, the place and message of its first finding, as the note of an error."""
    first = findings.groupBy("result_name").agg(F.min_by(F.struct("path", "line", "message"), "seq").alias("f")).where(F.coalesce("f.message", F.lit("")) != "")
    path, line = F.coalesce("f.path", F.lit("")), F.coalesce("f.line", F.lit(0))
    place = F.when(path != "", F.concat(path, F.when(line != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise(""), F.lit(" — "))).otherwise("")
    return first.select("result_name", F.substring(F.trim(F.concat(place, "f.message")), 1, 500).alias("note"))


def exit_code(results: DataFrame, policy: str = "findings", interrupted: bool = False) -> DataFrame:
    """2 with an error, 1 with findings where those count, else 0; 130 for a run that was stopped."""
    if interrupted:
        return results.agg(F.lit(130).alias("exit_code"))
    if policy == "never":
        return results.agg(F.lit(0).alias("exit_code"))
    code = F.when(F.col("status") == "ERROR", 2).when((F.col("status") == "FINDINGS") & F.lit(policy == "findings"), 1).otherwise(0)
    return results.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def registered(checks: DataFrame, wanted: DataFrame, has_python: bool) -> DataFrame:
    """checks: name, python_only, command. What becomes of each wanted check before it runs."""
    state = F.when(F.col("python_only") & F.lit(not has_python), "N/A").when(F.coalesce("command", F.lit("")) == "", "SKIPPED").otherwise("PLANNED")
    return checks.join(wanted.select("name").distinct(), "name", "left_semi").select("name", state.alias("status"))


def with_failed_installs(results: DataFrame, installs: DataFrame) -> DataFrame:
    """results with a row for each install that failed."""
    failed = installs.where("status = 'ERROR'").select(F.concat(F.lit("install:"), "name").alias("name"), "status")
    return results.select("name", "status").unionByName(failed)


def replaced(results: DataFrame, newer: DataFrame) -> DataFrame:
    """results with those of the same name replaced, new ones last."""
    return results.join(newer.select("name").distinct(), "name", "left_anti").unionByName(newer)
