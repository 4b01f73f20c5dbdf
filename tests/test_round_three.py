"""What the third round of findings named."""

from pyspark.sql import functions as F

from siftspark.operators import compare, values
from siftspark.plans import value_sources
from siftspark.session import by_path, joined_in_place, stored_wide
from siftspark.sources import inventory, parsers, syntax


def test_sources_of_one_partition_are_parsed_by_several_tasks(spark):
    sources = spark.range(400).coalesce(1).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("x = "), "id").alias("source"))
    nodes = syntax.nodes(sources)
    assert nodes.groupBy(F.spark_partition_id()).count().count() > 1
    assert nodes.count() == 4 * 400
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, spark.sql("SELECT n.* FROM {s} s, LATERAL syntax_nodes(s.path, s.source) n", s=sources).collect()))


def test_files_of_one_path_count_each_and_show_once(spark):
    files = spark.createDataFrame([("a.py",), ("a.py",), ("b.py",)], "path string")
    got = inventory.classify(files, {"python": F.endswith("path", F.lit(".py"))}).collect()
    assert [tuple(r) for r in got] == [("python", 3, ["a.py", "b.py"])]


def test_parameters_that_want_the_same_are_compared_once_and_all_reported(spark):
    fact = "nominal string, frame string, unit string, shape array<string>, provenance string, confidence double"
    arguments = spark.createDataFrame([(s, 1, 0, ("id" if s % 2 else "url", None, None, None, "a+b", 0.95)) for s in range(4)], f"site long, callee int, position int, actual struct<{fact.replace(' ', ':').replace(',:', ',')}>")
    parameters = spark.range(2501).crossJoin(arguments.where("site = 0").select("callee", "position", F.col("actual").alias("wanted"))).drop("id")
    clashes = compare.semantic_clashes(arguments, parameters)
    assert sorted(map(tuple, clashes.groupBy("site", "code", "severity").count().collect())) == [(1, "BHSEM001", "error", 2501), (3, "BHSEM001", "error", 2501)]
    join = clashes._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "Aggregate" in join


def test_joins_of_stored_nodes_collect_neither_side(spark):
    nodes = stored_wide(syntax.nodes(spark.range(3).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("f(x)").alias("source"))), "nodes")
    calls = nodes.where("kind = 'Call'").select("path", F.col("lo").alias("parent"))
    joined = calls.join(nodes.where("field = 'args'").groupBy("path", "parent").count(), ["path", "parent"])
    assert joined.count() == 3
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_tables_dealt_out_by_path_join_in_place(spark):
    nodes = by_path(syntax.nodes(spark.range(3).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("f(x)").alias("source"))), "nodes")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with joined_in_place(spark):
        joined = nodes.where("kind = 'Call'").select("path", F.col("lo").alias("parent")).join(nodes.where("field = 'args'").groupBy("path", "parent").count(), ["path", "parent"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_later_passes_derive_only_functions_whose_inputs_changed(spark, monkeypatch):
    case = lambda k: value_sources.CASES[k][0]
    sources = spark.createDataFrame([("src/a.py", case(14)), ("src/b.py", case(0)), ("src/c.py", case(17))], "path string, source string")
    derived, seen = values.derived, []
    monkeypatch.setattr(values, "derived", lambda s, alone, params, returns, some=None: (seen.append(some and sorted(map(tuple, some.select("path").distinct().collect()))), derived(s, alone, params, returns, some))[1])
    found = values.contradictions(syntax.nodes(sources)).select("code", "path", "line", "name").collect()
    assert sorted(map(tuple, found)) == [("BHUNIT004", "src/a.py", 11, "time.sleep"), ("BHUNIT004", "src/b.py", 3, "time.sleep"), ("BHUNIT004", "src/c.py", 7, "time.sleep")]
    assert seen[0] is None and len(seen) > 1
    assert all(paths and ("src/b.py",) not in paths for paths in seen[1:])


def test_outputs_of_ruff_are_parsed_once_and_those_that_are_no_json_are_read_as_text(spark):
    item = '{"code": "D100", "filename": "a.py", "location": {"row": 3, "column": 4}, "message": "m", "fix": {"applicability": "Safe", "message": "f"}}'
    outputs = [(1, f'[{item}, {{"code": "F401", "fix": null}}]', ""), (1, "", "b.py:7: note: see [x-1]"), (1, "b.py:7: note: see [x-1]\nc.py:1:2: odd", None), (2, "went\n \nwrong", ""), (0, "c.py:1:2: odd", ""), (2, " \n", "")]
    runs = spark.createDataFrame([(k, "ruff", *o) for k, o in enumerate(outputs)], "run long, tool string, exit_code int, stdout string, stderr string")
    found = parsers.parse(runs, "ruff")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "Union" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, found.drop("tool").collect())) == [
        (0, 0, "a.py", 3, 4, "D100", "m", "note", True, "safe", "f"),
        (0, 1, None, None, None, "F401", "Ruff finding", "error", False, None, None),
        (2, 0, "b.py", 7, None, "x-1", "see", "note", False, None, None),
        (2, 1, "c.py", 1, 2, None, "odd", "error", False, None, None),
        (3, 2, None, None, None, None, "wrong", "error", False, None, None),
    ]
