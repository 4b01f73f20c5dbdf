"""What the fourth round of findings named."""

import itertools

import pytest
from pyspark.sql import functions as F

from siftspark.functions import semantic as sem
from siftspark.operators import compare

FACT = "nominal string, frame string, unit string, shape array<string>, provenance string, confidence double"
FACTS = list(
    itertools.product((None, "id", "instant", "duration"), ("world", "camera", None), ("percent", "fraction", None), (None, ["n"], ["?", "1"], ["n", "2"], ["n", None]), ("name:x", "guess", None), (0.95, 0.7, 0.5, 0.3, None))
)


def told(site, actual, wanted):
    """Site, code and severity as the SQL of semantic_clashes has them; None without a clash."""
    (*a, shape, proven, sure), (*b, other, evidence, surely) = actual, wanted
    unlike = [None not in (x, y) and x != y for x, y in zip(a, b)]
    shapes = shape is not None and other is not None and (len(shape) != len(other) or any(None not in (x, y) and "?" not in (x, y) and x != y for x, y in zip(shape, other)))
    code = ("BHSEM002" if {a[0], b[0]} == {"instant", "duration"} else "BHSEM001") if unlike[0] else "BHSEM008" if unlike[1] else "BHSEM007" if unlike[2] else "BHSEM006" if shapes else None
    least = min(x for x in (sure, surely, 2) if x is not None)
    enough = least >= 0.7 or least >= 0.45 and None not in (proven, evidence) and [proven, evidence].count("name:x") >= 2
    return (site, code, "error" if least >= 0.9 else "warning") if code and least < 2 and enough else None


@pytest.mark.parametrize("most, pairs", [(compare.MOST_WANTED, compare.PAIRS), (compare.MOST_WANTED, 1000), (0, compare.PAIRS)])
def test_clashes_are_the_same_whether_wants_go_to_every_task_or_are_exchanged_and_dealt_out_or_not(spark, most, pairs):
    actual, wanted = FACTS[::7], FACTS[3::41] * 5
    arguments = spark.createDataFrame([(k, k % 2, 0, f) for k, f in enumerate(actual)], f"site long, callee int, position int, actual struct<{FACT.replace(' ', ':').replace(',:', ',')}>")
    parameters = spark.createDataFrame([(k % 2, 0, f) for k, f in enumerate(wanted)], f"callee int, position int, wanted struct<{FACT.replace(' ', ':').replace(',:', ',')}>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clashes = compare.semantic_clashes(arguments, parameters, most, 2, pairs)
        plan = clashes._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, clashes.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("BroadcastHashJoin" in plan, "REPARTITION_BY_NUM" in plan) == (most > 0, pairs == 1000)
    due = [told(k, f, w) for k, f in enumerate(actual) for n, w in enumerate(wanted) if k % 2 == n % 2]
    assert got == sorted(t for t in due if t) and {c for _, c, _ in got} == {"BHSEM001", "BHSEM002", "BHSEM006", "BHSEM007", "BHSEM008"}


def test_what_a_pair_costs_holds_no_count_of_evidence_and_tells_its_code_once(spark):
    facts = spark.createDataFrame([(1, 0, FACTS[0])], f"callee int, position int, wanted struct<{FACT.replace(' ', ':').replace(',:', ',')}>")
    plan = compare.semantic_clashes(facts.selectExpr("1L AS site", "callee", "position", "wanted AS actual"), facts)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join " in line)
    assert "zip_with" not in join and "regexp" not in join and "split" not in join
    assert plan.count("THEN BHSEM006") == 1


def test_evidence_is_counted_by_whole_tokens(spark):
    texts = {"name:x": 1, "name:x+schema:y": 2, "name/name name": 3, "guess": 0, "names": 0, "a-name": 0, ":name": 0, "api-contract::+docstring": 2, " comment\n": 1, "": 0, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r[0]: r[1] for r in rows.select("text", sem.source_count(F.col("text"))).collect()} == texts
