"""Registered queries over the ranked views where part of the findings is accepted debt, and over the bundle made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import ledger, report
from siftspark.plans import adapters as a
from siftspark.plans.queries import FS, LS, ORACLES, QUERIES, keyed, query
from siftspark.sources import bundle


def _judged(spark, d):
    """Findings of which those that the ledger names are accepted."""
    return ledger.accept(keyed(spark, d), a.ledger(spark, d)).drop("key")


#: What is left of the findings without those that the ledger names.
OPEN_SQL = f"{LS}, {FS.replace('f AS (', 'every AS (', 1)}, f AS (SELECT every.* FROM every WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.signal = {a.KEY_SQL} AND list_contains(l.paths, path)))"

for _name, _view in {
    "risk_map": report.risk_map, "risk_classes": report.risk_classes, "signal_groups": report.signal_groups, "correlated_locations": report.correlated_locations, "logical_issues": report.logical_issues,
    "autofix_summary": report.autofix_summary, "defect_class_histogram": report.class_histogram,
}.items():
    QUERIES[f"open_{_name}"] = lambda spark, d, view=_view: view(_judged(spark, d))
    ORACLES[f"open_{_name}"] = ORACLES[_name].replace(FS, OPEN_SQL)


@query(ORACLES["repair_queue"].replace(FS, OPEN_SQL))
def open_repair_queue(spark, d):
    return report.repair_queue(_judged(spark, d), a.results(spark, d))


_COUNTS = ", ".join(f"(SELECT count(*) FROM ({ORACLES[f'open_{n}']})) AS {c}" for n, c in (("correlated_locations", "places"), ("logical_issues", "issues"), ("risk_map", "risks"), ("autofix_summary", "fixes"), ("repair_queue", "queue"), ("signal_groups", "signals"), ("defect_class_histogram", "classes")))
_TASKS = f"(SELECT sum(3 + count) FROM (SELECT count FROM ({ORACLES['open_signal_groups']}) ORDER BY {a.RANK_SQL}, count DESC, tool, coalesce(nullif(code, ''), message) LIMIT 500))"


@query(f"""WITH {a.RESULTS_SQL}, c AS (SELECT {_COUNTS}, (SELECT sum(total) FROM ({ORACLES['open_autofix_summary']})) AS fixable, {_TASKS} AS tasks, (SELECT count(*) FROM r) AS results, (SELECT count(*) FROM r WHERE status IN ('ERROR', 'SKIPPED')) AS blind),
p AS (
  SELECT unnest([{{'file': 'findings.jsonl', 'lines': queue}}, {{'file': 'report.json', 'lines': 23 + places + issues + risks + fixes + queue + signals + least(20, risks) + classes + results}}, {{'file': 'report.md', 'lines': 5}},
    {{'file': 'agent/queue.json', 'lines': 10 + fixes + places + risks + queue}}, {{'file': 'agent/risk-map.json', 'lines': 4 + risks}}, {{'file': 'agent/RISK_MAP.md', 'lines': 6 + least(200, risks)}}, {{'file': 'agent/AGENT_INSTRUCTIONS.md', 'lines': 5}},
    {{'file': 'agent/CHECKLIST.md', 'lines': 7}}, {{'file': 'agent/AUTOFIX.md', 'lines': 2 + fixable}}, {{'file': 'agent/BLIND_SPOTS.md', 'lines': 2 + blind}}, {{'file': 'agent/DEDUPLICATED_QUEUE.md', 'lines': 2 + least(2000, issues)}},
    {{'file': 'agent/FIX_QUEUE.md', 'lines': 2 + least(100, signals) + least(2000, queue)}}, {{'file': 'agent/tasks', 'lines': tasks}}]) AS u FROM c)
SELECT u.file AS file, CAST(u.lines AS BIGINT) AS lines FROM p""")
def report_pages(spark, d):
    """How many lines each page of the bundle has, the tasks' pages together; accepted findings are on none."""
    lines = bundle.lines_of(_judged(spark, d), a.results(spark, d))
    return lines.groupBy(F.when(F.startswith("file", F.lit("agent/tasks/")), "agent/tasks").otherwise(F.col("file")).alias("file")).agg(F.count("*").alias("lines"))
