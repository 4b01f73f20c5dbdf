"""What to leave out: path components, prefixes, ignored files, marked lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Checks run from the lightest profile to the fullest; fixed values.
PROFILES = ("fast", "pr", "deep", "all")


def without_components(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows: path. Rows go if any part of the path is a name."""
    hit = rows.select("path", F.explode(F.array_distinct(F.split("path", "/"))).alias("name")).join(names.select("name"), "name", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_anti")


def without_prefixes(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows go if the path is a prefix or lies under it: every ancestor is looked up, so the join is by equality."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = rows.select("path", F.explode(ancestors).alias("prefix")).join(prefixes.select(F.rtrim("prefix", F.lit("/")).alias("prefix")), "prefix", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_anti")


def without_ignored(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    return rows.join(ignored.select("path").distinct(), "path", "left_anti")


def without_marked_lines(findings: DataFrame, lines: DataFrame, marker: str) -> DataFrame:
    """lines: path, line, text. Findings on a line with the marker go; findings without a line of the file stay."""
    marked = lines.where(F.col("text").rlike(marker)).select("path", "line").distinct()
    return findings.join(marked, ["path", "line"], "left_anti")


def wanted(configured: DataFrame, excluded: DataFrame) -> DataFrame:
    """name, and whether it runs or is skipped."""
    hit = excluded.select("name").distinct().withColumn("skip", F.lit(True))
    return configured.join(hit, "name", "left").select("name", F.when(F.col("skip"), "SKIPPED").otherwise("RUN").alias("decision"))


def capability_gate(engines: DataFrame, capabilities: DataFrame) -> DataFrame:
    """engines: name, capability. One N/A row for each engine without any of its capabilities."""
    have = capabilities.where("detected").select("capability").distinct().withColumn("have", F.lit(True))
    seen = engines.join(have, "capability", "left").groupBy("name").agg(F.bool_or(F.coalesce("have", F.lit(False))).alias("have"))
    return seen.where("NOT have").select("name", F.lit("N/A").alias("status"))


def confident(confidence: Column, tokens: Column) -> Column:
    return (confidence >= 0.70) | ((confidence >= 0.45) & (tokens >= 2))


def profile_allows(run: Column, required: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, PROFILES)), c)
    return rank(run) >= rank(F.coalesce(required, F.lit("deep")))


def existing_paths(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings: path, plain (see functions.findings.plain_path). A path that is no file becomes src/ and the path where that is one."""
    here = files.select("path").distinct()
    rows = findings.join(here.withColumn("as_is", F.lit(True)), "path", "left")
    below = here.where(F.startswith("path", F.lit("src/"))).select(F.substring("path", 5, 1 << 20).alias("path"), F.lit(True).alias("in_src"))
    rows = rows.join(below, "path", "left")
    path = F.when(F.col("as_is").isNull() & F.col("in_src") & ~F.startswith("path", F.lit("/")), F.concat(F.lit("src/"), "path")).otherwise(F.col("path"))
    return rows.withColumn("path", path).drop("as_is", "in_src")
