"""The report bundle as a table of lines (file, nth, line) and a data source that writes it whole or not at all.

Tasks write pieces of files into a folder of their own write; the commit names the pieces that count, gives files of
one piece their plain name, moves the folder to `versions` and then turns LATEST to it in one step. A write that fails
is taken away and leaves the former bundle as it was; a task that ran twice counts once. Files over several tasks stay
in pieces `<file>.part-00000`, in order. The folder is one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from siftspark.operators import ordered, report
from siftspark.session import importable, stored
from siftspark.sources.sinks import QUEUE_VERSION, REPORT_VERSION, RISK_VERSION

#: How many rows the Markdown pages show; JSON pages hold all. Fixed values.
RISKS, ISSUES, SIGNALS, QUEUED, TASKS = 200, 2000, 100, 2000, 500
#: Places of a document's sections in the order of its lines.
SECTION = 1 << 40


@dataclass
class Pieces(WriterCommitMessage):
    partition: int
    names: list[tuple[str, str]]


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.version = folder, uuid.uuid4().hex
        self.staging = os.path.join(folder, f"_{self.version}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        """Lines of a task come sorted by file and place."""
        task = TaskContext.get()
        names, open_file, here = [], None, None
        try:
            for batch in iterator:
                for name, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist()):
                    if name != here:
                        if open_file:
                            open_file.close()
                        piece = f"{name}.part-{task.partitionId():05d}.{task.taskAttemptId()}"
                        os.makedirs(os.path.dirname(os.path.join(self.staging, piece)), exist_ok=True)
                        open_file, here = open(os.path.join(self.staging, piece), "w", encoding="utf-8", newline="\n"), name
                        names.append((name, piece))
                    open_file.write((line or "") + "\n")
        finally:
            if open_file:
                open_file.close()
        return Pieces(task.partitionId(), names)

    def commit(self, messages: list[Pieces | None]) -> None:
        pieces: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, piece in message.names:
                pieces.setdefault(name, []).append(piece)
        os.makedirs(self.staging, exist_ok=True)
        manifest = {}
        for name, parts in pieces.items():
            manifest[name] = [name] if len(parts) == 1 else [f"{name}.part-{i:05d}" for i in range(len(parts))]
            for piece, plain in zip(parts, manifest[name]):
                os.replace(os.path.join(self.staging, piece), os.path.join(self.staging, plain))
        with open(os.path.join(self.staging, "MANIFEST.json"), "w", encoding="utf-8") as file:
            json.dump(manifest, file)
        os.makedirs(os.path.join(self.folder, "versions"), exist_ok=True)
        os.replace(self.staging, os.path.join(self.folder, "versions", self.version))
        pointer = os.path.join(self.folder, f"_LATEST.{self.version}")
        with open(pointer, "w", encoding="utf-8") as file:
            file.write(self.version)
        os.replace(pointer, os.path.join(self.folder, "LATEST"))

    def abort(self, messages: list[Pieces | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ReportBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_bundle"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(self.options["path"])


def save(lines: DataFrame, folder: str) -> None:
    """lines: file, nth, line. Written as the folder's latest bundle; equal places of a file come in any order."""
    importable(lines.sparkSession).dataSource.register(ReportBundle)
    rows = lines.select("file", "nth", "line").repartitionByRange("file", "nth").sortWithinPartitions("file", "nth")
    rows.write.format("report_bundle").mode("overwrite").save(folder)


def latest(folder: str) -> dict[str, list[str]]:
    """file -> the paths of its pieces in the latest bundle; nothing where none was ever written."""
    try:
        with open(os.path.join(folder, "LATEST"), encoding="utf-8") as file:
            at = os.path.join(folder, "versions", file.read())
    except FileNotFoundError:
        return {}
    with open(os.path.join(at, "MANIFEST.json"), encoding="utf-8") as file:
        return {name: [os.path.join(at, p) for p in parts] for name, parts in json.load(file).items()}


def _fixed(spark: SparkSession, file: str, lines: list[str], at: int = 0) -> DataFrame:
    return spark.createDataFrame([(file, at + i, line) for i, line in enumerate(lines)], "file string, nth long, line string")


def _json(df: DataFrame, n: Column, columns: list[str] | None = None) -> DataFrame:
    return df.select(n.alias("n"), F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def document(spark: SparkSession, file: str, version: int, sections: dict[str, DataFrame]) -> list[DataFrame]:
    """Lines of one JSON document: its version, and an array for each section (n from 1, value: JSON), one value a line."""
    parts = [_fixed(spark, file, [f'{{"schema_version": {version}'])]
    for i, (name, rows) in enumerate(sections.items(), 1):
        comma = F.when(F.col("n") > 1, ",").otherwise("")
        parts += [_fixed(spark, file, [f', "{name}": ['], i * SECTION), rows.select(F.lit(file).alias("file"), (F.col("n") + i * SECTION).alias("nth"), F.concat(comma, "value").alias("line")), _fixed(spark, file, ["]"], (i + 1) * SECTION - 1)]
    return [*parts, _fixed(spark, file, ["}"], (len(sections) + 1) * SECTION)]


def page(spark: SparkSession, file: str, head: list[str], rows: DataFrame, line: Column) -> list[DataFrame]:
    """Lines of a Markdown page: the head, then one for each row in the order of n (from 1)."""
    return [_fixed(spark, file, head), rows.select(F.lit(file).alias("file"), (F.col("n") + len(head)).cast("long").alias("nth"), line.alias("line"))]


def _cell(name: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"[|\n]", " ")


def _place() -> Column:
    return F.concat(F.coalesce("path", F.lit("<unknown>")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")))


def lines_of(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Every line of the bundle. findings and results as in operators.report; results may have category and note. Ranks are over ranges of the order, never in one task."""
    spark = findings.sparkSession
    findings = stored(findings, "bundle-findings")
    for name in ("category", "note"):
        results = results if name in results.columns else results.withColumn(name, F.lit(None).cast("string"))
    more = findings.select("seq", "code", "message", "fixable", "fix_safety")
    queue = stored(ordered.numbered(report.repair_queue(findings, results).join(more, "seq"), [F.expr(o) for o in report.QUEUE_ORDER], "n"), "bundle-queue")
    risks = stored(ordered.numbered(report.risk_map(findings), [F.desc("score"), F.desc("tool_count"), F.asc("path")], "n"), "bundle-risks")
    issues = stored(ordered.numbered(report.logical_issues(findings), [F.desc("tool_count"), F.desc("finding_count"), F.asc("id")], "n"), "bundle-issues")
    signals = stored(ordered.numbered(report.signal_groups(findings), report.signal_order(), "n"), "bundle-signals")
    places = ordered.numbered(report.correlated_locations(findings), [F.desc("tool_count"), F.desc("finding_count"), F.asc("path"), F.asc("line")], "n")
    fixes = stored(ordered.numbered(report.autofix_summary(findings), [F.asc("tool")], "n"), "bundle-fixes")
    blind = ordered.numbered(results.where("status IN ('ERROR', 'SKIPPED')"), [F.asc("seq")], "n")
    one = F.lit(1).cast("long")
    n, items = F.col("n").cast("long"), _json(queue, F.col("n").cast("long"))
    summary = report.run_summary(findings, results).crossJoin(report.defense_health(results))

    parts = [items.select(F.lit("findings.jsonl").alias("file"), F.col("n").alias("nth"), F.col("value").alias("line"))]
    sections = {"correlated_issues": _json(places, n), "logical_issues": _json(issues, n), "risk_map": _json(risks, n), "autofix": _json(fixes, n), "agent_queue": items}
    hot = ordered.numbered(report.hotspots(findings), [F.desc("count"), F.asc("first_seen")], "n")
    classes = ordered.numbered(report.class_histogram(findings), [F.desc("count"), F.asc("odc_class")], "n")
    parts += document(spark, "report.json", REPORT_VERSION, {"summary": _json(summary, one), **sections, "top_signals": _json(signals, n), "hotspots": _json(hot, n), "odc_taxonomy": _json(classes, n), "results": _json(ordered.numbered(results, [F.asc("seq")], "n"), n)})
    parts += document(spark, "agent/queue.json", QUEUE_VERSION, {k: sections[k] for k in ("autofix", "correlated_issues", "risk_map")} | {"items": items})
    parts += document(spark, "agent/risk-map.json", RISK_VERSION, {"files": sections["risk_map"]})

    counted = F.concat_ws(" | ", F.lit(""), "raw_findings", "accepted_findings", "logical_issues", "passed", "with_findings", "errors", "skipped", "score", F.lit(""))
    parts += page(spark, "report.md", ["# Report", "", "| Findings | Accepted | Issues | Passed | With findings | Errors | Skipped | Health |", "|---:|---:|---:|---:|---:|---:|---:|---:|"], summary.withColumn("n", one), F.trim(counted))
    parts += page(spark, "agent/RISK_MAP.md", ["# Files by risk", "", "Order of attention, not a likelihood.", "", "| Rank | Score | File | Tools | Findings | Coverage | Branch |", "|---:|---:|---|---:|---:|---:|---:|"], risks.where(F.col("n") <= RISKS), F.concat(F.lit("| "), F.concat_ws(" | ", "n", "score", F.concat(F.lit("`"), _cell("path"), F.lit("`")), "tool_count", "findings", "coverage_gaps", "branch_gaps"), F.lit(" |")))
    parts.append(_fixed(spark, "agent/AGENT_INSTRUCTIONS.md", ["# How to use this bundle", "", "`queue.json` holds every open finding in order of repair; the other pages are views of it.", "Checks that failed or were skipped (`BLIND_SPOTS.md`) come first, since nothing is known where they didn't run.", "Each finding names the command that verifies its repair."]))
    parts.append(_fixed(spark, "agent/CHECKLIST.md", ["# Before a repair counts as done", "", "- [ ] The cause is removed, not the message.", "- [ ] Only fixes that are safe were applied unread.", "- [ ] The verifying command passes.", "- [ ] Files at the top of `RISK_MAP.md` were looked at.", "- [ ] No check in `BLIND_SPOTS.md` was weakened to become quiet."]))
    safety = F.when(F.lower("fix_safety").isin("safe", "unsafe"), F.lower("fix_safety")).otherwise("review")
    parts += page(spark, "agent/AUTOFIX.md", ["# Findings that a tool can fix", ""], queue.where("fixable"), F.concat(F.lit("- `"), "id", F.lit("` "), "tool", F.lit(" "), _cell("code"), F.lit(" `"), _place(), F.lit("` "), safety))
    parts += page(spark, "agent/BLIND_SPOTS.md", ["# Checks without a result to trust", ""], blind, F.concat(F.lit("- "), "status", F.lit(" "), "name", F.lit(" ("), _cell("category"), F.lit("): "), F.coalesce(F.nullif("note", F.lit("")), F.lit("no result")), F.coalesce(F.concat(F.lit(" `"), F.col("command").cast("string"), F.lit("`")), F.lit(""))))
    parts += page(spark, "agent/DEDUPLICATED_QUEUE.md", ["# Issues, one for each place and class", ""], issues.where(F.col("n") <= ISSUES), F.concat(F.lit("- [ ] "), "n", F.lit(". `"), "id", F.lit("` `"), _place(), F.lit("` "), "odc_class", F.lit(", "), F.array_join("tools", ", "), F.lit(": "), _cell("primary_message")))
    parts += page(spark, "agent/FIX_QUEUE.md", ["# Signals that repeat, then findings in order", ""], signals.where(F.col("n") <= SIGNALS), F.concat(F.lit("- "), "count", F.lit(" x "), "tool", F.lit(" "), _cell("code"), F.lit(": "), F.substring(_cell("message"), 1, 180)))
    parts += [queue.where(F.col("n") <= QUEUED).select(F.lit("agent/FIX_QUEUE.md").alias("file"), (F.col("n") + SECTION).alias("nth"), F.concat(F.lit("- [ ] "), "n", F.lit(". `"), "id", F.lit("` "), "tool", F.lit(" "), _cell("code"), F.lit(" `"), _place(), F.lit("` "), _cell("message")).alias("line"))]

    slug = F.coalesce(F.nullif(F.regexp_replace(F.substring(F.regexp_replace(F.coalesce(F.nullif("code", F.lit("")), "tool"), "[^A-Za-z0-9_.-]+", "-"), 1, 60), "^-+|-+$", ""), F.lit("")), F.lit("signal"))
    tasks = stored(signals.where(F.col("n") <= TASKS).select("key", "count", "severity", "message", "tool", F.format_string("agent/tasks/%04d-%s.md", F.col("n").cast("int"), slug).alias("file")), "bundle-tasks")
    heads = F.array(F.concat(F.lit("# "), "tool", F.lit(": "), _cell("message")), F.concat("count", F.lit(" findings, "), "severity", F.lit(", `"), "key", F.lit("`")), F.lit(""))
    parts.append(tasks.select("file", F.posexplode(heads).alias("nth", "line")).select("file", F.col("nth").cast("long"), "line"))
    verify = F.coalesce(F.concat(F.lit(" verify: `"), F.col("verification").cast("string"), F.lit("`")), F.lit(""))
    parts.append(queue.join(tasks.select(F.col("key").alias("signal_key"), "file"), "signal_key").select("file", (F.col("n") + 10).alias("nth"), F.concat(F.lit("- `"), "id", F.lit("` `"), _place(), F.lit("`"), verify).alias("line")))
    return reduce(DataFrame.unionByName, (p.select("file", F.col("nth").cast("long").alias("nth"), "line") for p in parts))


def write(findings: DataFrame, results: DataFrame, folder: str) -> dict[str, list[str]]:
    """All pages of a run as the folder's latest bundle; returns where their pieces are."""
    save(stored(lines_of(findings, results), "bundle-lines"), folder)
    return latest(folder)
