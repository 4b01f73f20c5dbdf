"""Accepted debt: which findings a ledger covers, and how it has moved.

ledger: entry_ord, signal, paths, count. findings carry key, the signal key, and path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_paths(ledger: DataFrame) -> DataFrame:
    return ledger.select("entry_ord", "signal", F.explode(F.array_distinct("paths")).alias("path"))


def accept(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """findings with accepted, and entry_ord of the first entry that matches, in the ledger's order.

    Entries are reduced to the first one of each (signal, path) before the join, so a finding meets one row.
    """
    first = entry_paths(ledger).groupBy(F.col("signal").alias("key"), "path").agg(F.min("entry_ord").alias("entry_ord"))
    return findings.join(first, ["key", "path"], "left").withColumn("accepted", F.col("accepted") | F.col("entry_ord").isNotNull())


def report(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many accepted findings each entry covers; overlapping entries all count."""
    counts = findings.groupBy("key", "path").agg(F.count("*").alias("n"))
    hits = entry_paths(ledger).join(counts.withColumnRenamed("key", "signal"), ["signal", "path"], "left")
    live = hits.groupBy("entry_ord").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("live"))
    return ledger.select("entry_ord", "signal", F.col("count").alias("accepted_count")).join(live, "entry_ord")


def review(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each path of each entry against what is found now: delta is live minus the whole entry's count."""
    counts = findings.groupBy(F.col("key").alias("signal"), "path").agg(F.count("*").alias("n"))
    rows = entry_paths(ledger).join(ledger.select("entry_ord", "count"), "entry_ord").join(counts, ["signal", "path"], "left")
    delta = F.coalesce("n", F.lit(0)) - F.col("count")
    verdict = F.when(delta > 0, "GREW").when(delta < 0, "SHRANK").otherwise("OK")
    return rows.select("entry_ord", "signal", "path", F.coalesce("n", F.lit(0)).alias("live"), delta.alias("delta"), verdict.alias("verdict"))


def snapshot(findings: DataFrame, path_prefix: str | None = None) -> DataFrame:
    """Counts for a new ledger, by signal and path; the prefix is compared as text, without a slash guard."""
    rows = findings.where(F.coalesce("path", F.lit("")) != "")
    if path_prefix:
        rows = rows.where(F.startswith("path", F.lit(path_prefix)))
    return rows.groupBy(F.col("key").alias("signal"), "path").agg(F.count("*").alias("count"))


def rewritten(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """The ledger after a snapshot: entries of the snapshot's signals go, one entry for each of its rows is added."""
    kept = ledger.join(counts.select("signal").distinct(), "signal", "left_anti").select("signal", F.array_join("paths", ",").alias("paths"), "count")
    return kept.unionByName(counts.select("signal", F.col("path").alias("paths"), F.col("count").cast("int").alias("count")))
