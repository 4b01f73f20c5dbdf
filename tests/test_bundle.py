"""The report bundle: all pages, whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siftspark.sources import bundle

FINDINGS = "seq long, result_name string, category string, tool string, message string, path string, line int, code string, severity string, fixable boolean, fix_safety string, accepted boolean"
PAGES = {"report.json", "findings.jsonl", "report.md", *(f"agent/{p}" for p in ("queue.json", "risk-map.json", "RISK_MAP.md", "AGENT_INSTRUCTIONS.md", "AUTOFIX.md", "BLIND_SPOTS.md", "CHECKLIST.md", "DEDUPLICATED_QUEUE.md", "FIX_QUEUE.md"))}


def text(pieces):
    return "".join(open(p, encoding="utf-8").read() for p in pieces)


def test_pages_of_a_run(spark, tmp_path):
    rows = [(i, "ruff", "lint", "ruff", f"m|x\n{i % 3}", f"a{i % 7}.py", i % 5 + 1, "F40" + str(i % 3), ["error", "warning"][i % 2], i % 4 == 0, "safe", i == 11) for i in range(40)]
    rows += [(40, "mypy", "types", "mypy", "bad é", "a1.py", 2, None, "warning", False, None, False), (41, "mypy", "types", "mypy", "nowhere", None, None, "", "info", True, None, False)]
    findings = spark.createDataFrame(rows, FINDINGS).repartition(5)
    results = spark.createDataFrame([(0, "ruff", "FINDINGS", "ruff check", "lint", None), (1, "mypy:deep", "ERROR", "mypy .", "types", "crashed"), (2, "skip", "SKIPPED", None, "x", "")], "seq int, name string, status string, command string, category string, note string")
    folder = str(tmp_path / "out")
    pages = bundle.write(findings, results, folder)
    assert {p for p in pages if not p.startswith("agent/tasks/")} == PAGES
    queue = [json.loads(x) for x in text(pages["findings.jsonl"]).splitlines()]
    assert len(queue) == 41 and [q["n"] for q in queue] == list(range(1, 42)) and [q["rank"] for q in queue] == sorted(q["rank"] for q in queue)
    whole = json.loads(text(pages["report.json"]))
    assert whole["schema_version"] == 3 and whole["summary"][0]["raw_findings"] == 42 and whole["agent_queue"] == queue and len(whole["results"]) == 3 and whole["odc_taxonomy"]
    assert json.loads(text(pages["agent/queue.json"]))["items"] == queue
    assert {r["path"] for r in json.loads(text(pages["agent/risk-map.json"]))["files"]} == {f"a{i}.py" for i in range(7)}
    assert text(pages["agent/BLIND_SPOTS.md"]).splitlines()[2:] == ["- ERROR mypy:deep (types): crashed `mypy .`", "- SKIPPED skip (x): no result"]
    assert len(text(pages["agent/AUTOFIX.md"]).splitlines()) == 2 + 11 and "é" in text(pages["agent/FIX_QUEUE.md"])
    tasks = [text(v).splitlines() for k, v in sorted(pages.items()) if k.startswith("agent/tasks/")]
    assert sum(len(t) - 3 for t in tasks) == 41 and tasks[0][0].startswith("# ruff: m x ") and all("verify: `" in x for t in tasks for x in t[3:])
    # empty tables
    pages = bundle.write(findings.limit(0), results.limit(0), str(tmp_path / "none"))
    assert set(pages) == PAGES - {"findings.jsonl"} and json.loads(text(pages["report.json"]))["agent_queue"] == []


def test_a_failed_write_leaves_the_former_bundle(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert bundle.latest(folder) == {}
    lines = spark.range(20_000).select(F.concat(F.lit("d/f"), F.col("id") % 2).alias("file"), F.col("id").alias("nth"), F.concat(F.lit("line "), "id").alias("line"))
    bundle.save(lines, folder)
    first = bundle.latest(folder)
    assert set(first) == {"d/f0", "d/f1"} and text(first["d/f1"]).splitlines() == [f"line {i}" for i in range(1, 20_000, 2)]
    # sorted lines of which one, late in the last file, can't be made
    late = F.when((F.col("file") == "d/f1") & (F.col("nth") == 19_001), F.raise_error(F.lit("no such line"))).otherwise(F.lit("new"))
    broken = spark.createDataFrame(lines.select("file", "nth").toPandas()).repartition(1).sortWithinPartitions("file", "nth").select("file", "nth", late.cast("string").alias("line"))
    spark.dataSource.register(bundle.ReportBundle)
    with pytest.raises(Exception, match="no such line"):
        broken.write.format("report_bundle").mode("overwrite").save(folder)
    assert bundle.latest(folder) == first and text(first["d/f0"]).startswith("line 0\n")
    assert sorted(os.listdir(folder)) == ["LATEST", "versions"]  # nothing half-written is left
    bundle.save(lines.where("nth < 3"), folder)
    assert {k: text(v) for k, v in bundle.latest(folder).items()} == {"d/f0": "line 0\nline 2\n", "d/f1": "line 1\n"} and os.path.exists(first["d/f0"][0])
