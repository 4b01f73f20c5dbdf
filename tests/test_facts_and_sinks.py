import json
import random

from pyspark.sql import functions as F

from siftspark.functions import evidence, symbols
from siftspark.functions import semantic as sem
from siftspark.operators import compare, graph, lattice, patterns, report
from siftspark.sources import inventory, parsers, sinks
from siftspark.streaming import live


def test_dimension_algebra(spark):
    df = spark.sql("SELECT map('time', 1) AS t, map('time', -1, 'length', 2) AS u, map_from_arrays(array(), array()) AS e").select(F.col("t"), F.col("u"), F.col("e").cast("map<string,int>"))
    row = df.select(sem.dimension_text(sem.product(F.col("t"), F.col("u"))), sem.dimension_text(sem.quotient(F.col("t"), F.col("u"))), sem.compatible(F.col("t"), F.col("u")), sem.compatible(F.col("t"), F.col("e"))).first()
    assert tuple(row) == ("length:2", "length:-2,time:2", False, True)
    units = df.select(*(sem.converted_unit(F.lit(u), F.col("t"), F.lit(f)) for u, f in (("ms", 1000.0), ("ms", 60.0), ("percent", 100.0))), sem.bad_divisor(F.lit("ms"), F.col("t"), F.lit(60.0))).first()
    assert tuple(units) == ("s", "ms", "fraction", True)


def test_number_types(spark):
    df = spark.createDataFrame([("np.float64", "int32"), ("'int32'", "numpy.int64"), ("uint64", "int64"), ("odd", "int8")], "a string, b string")
    a, b = sem.dtype_name(F.col("a")), sem.dtype_name(F.col("b"))
    assert [tuple(r) for r in df.select(a, sem.narrower(a, b), sem.promotion_risk(a, b)).collect()] == [("float64", True, True), ("int32", False, False), ("uint64", True, True), (None, None, False)]


def test_combined_keeps_what_agrees(spark):
    fact = lambda unit, deps, conf: f"named_struct('dimension', map('time', 1), 'unit', '{unit}', 'dtype', cast(null AS STRING), 'timezone', 'aware', 'nominal', 'instant', 'dependencies', array({deps}), 'nullable', false, 'provenance', 'name:{unit}', 'confidence', {conf}D)"
    r = spark.sql(f"SELECT {fact('ms', repr('x'), 0.05)} AS a, {fact('s', repr('x'), 0.9)} AS b").select(sem.combined(F.col("a"), F.col("b")).alias("c")).first().c
    assert (r.unit, r.timezone, r.dimension, r.dependencies, r.confidence, r.provenance) == (None, "aware", {"time": 1}, ["x"], 0.1, "name:ms+name:s")


def test_evidence(spark):
    df = spark.createDataFrame([(0.5, "name:x+schema:y"), (0.5, "name:x"), (0.7, "guess")], "c double, p string")
    assert [r[0] for r in df.select(sem.reportable(F.col("c"), F.col("p"))).collect()] == [True, False, True]


def test_report_bundle(spark, tmp_path):
    findings = spark.createDataFrame(
        [(0, "ruff", "lint", "ruff", "m|x", "a.py", 1, "F401", "error", True, "safe", False), (1, "mypy", "types", "mypy", "m", "a.py", 1, None, "warning", False, None, False)],
        "seq long, result_name string, category string, tool string, message string, path string, line int, code string, severity string, fixable boolean, fix_safety string, accepted boolean",
    )
    results = spark.createDataFrame([(0, "ruff", "FINDINGS", "ruff check"), (1, "mypy:deep", "FINDINGS", "mypy .")], "seq int, name string, status string, command string")
    places = sinks.write_report(findings, results, str(tmp_path / "report"))
    queue = spark.read.json(places["queue"])
    assert {(r.tool, r.verification, r.correlation_id) for r in queue.collect()} == {("ruff", "ruff check", "CORR-0001"), ("mypy", "mypy .", "CORR-0001")}
    assert {r.schema_version for r in spark.read.json(places["risk"]).collect()} == {1}
    assert spark.read.text(places["risk_md"]).first().value == "| a.py | 17 | 2 |"
    sinks.write_tasks(report.repair_queue(findings, results), str(tmp_path / "tasks"))
    assert spark.read.json(str(tmp_path / "tasks")).count() == 2
    assert spark.read.text(places["signals"]).where(F.col("value").contains("F401")).count() == 1
    assert json.loads(spark.read.text(places["summary"]).first().value)["raw_findings"] == 2


def test_cached_table(spark, tmp_path):
    key = spark.range(1).select(sinks.cache_key(F.lit("root"), F.lit(None), F.lit(3))).first()[0]
    assert sinks.cached(spark.range(3), str(tmp_path), key).count() == 3
    assert sinks.cached(spark.range(9), str(tmp_path), key).count() == 3


def test_joins_and_aggregates(spark):
    rows = lambda schema, *data: spark.createDataFrame(list(data), schema)
    pairs = rows("a string, b string", ("x", "y"), ("x", "z"))
    calls = rows("test string, name string", ("t", "x"), ("t", "y"), ("u", "z"))
    assert [tuple(r) for r in compare.uncovered_pairs(pairs, calls).collect()] == [("x", "z")]
    bodies = rows("body string", ("raises open here",), ("socket fine",))
    assert [r[0] for r in compare.untested_boundaries(rows("boundary string", ("open",), ("socket",)), bodies, "raises").collect()] == ["socket"]
    sites = rows("path string, line int", ("b", 1), ("a", 2))
    assert [tuple(r) for r in report.missing_evidence(sites, sites.limit(0)).collect()] == [("a", 2, 2)]
    assert report.missing_evidence(sites, sites).count() == 0
    log = rows("run string, text string", ("a", "nodes: 3\ncalls: resolved=12 open=1\nlikely_internal_unresolved=4\n"), ("b", "likely_internal_unresolved=0"), ("c", "fine, unresolved=3"), ("d", "likely_internal_unresolved=2"), ("e", None))
    assert sorted(tuple(r) for r in graph.unresolved_summary(log).collect()) == [("a", 4, "12"), ("d", 2, "unknown")]


def test_correlation_ids_stay_distinct_beyond_four_digits(spark):
    columns = "concat('m', id div 7, '.py') AS path", "cast(id % 7 + 1 AS INT) AS line", "'E1' AS code", "'error' AS severity", "'lint' AS category", "concat('odd ', id) AS message", "false AS accepted"
    places = spark.range(12_000)
    findings = places.selectExpr("id * 2 AS seq", "'ruff' AS tool", "'ruff' AS result_name", *columns).unionByName(places.selectExpr("id * 2 + 1 AS seq", "'mypy' AS tool", "'mypy' AS result_name", *columns))
    results = spark.createDataFrame([(0, "ruff", "x")], "seq int, name string, command string")
    queue = report.repair_queue(findings, results)
    ids = [r.correlation_id for r in queue.where("tool = 'ruff'").select("correlation_id").collect()]
    assert len(set(ids)) == len(ids) == 12_000
    assert {"CORR-0001", "CORR-9999", "CORR-12000"} <= set(ids)
    assert queue.where("path = 'm0.py' AND line = 1").select("correlation_id").distinct().first()[0] == "CORR-0001"


def test_registry_and_stopped_runs(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    sinks.write_registry(rows, str(tmp_path / "registry"), ["name"])
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "registry")).collect()] == [{"schema_version": 2, "name": "a", "n": 1}, {"schema_version": 2, "name": "b", "n": 2}]
    done = spark.createDataFrame([("ERROR",)], "status string")
    assert [lattice.exit_code(done, **kw).first()[0] for kw in ({}, {"policy": "never"}, {"interrupted": True})] == [2, 0, 130]


def test_lines_of_pieces_in_a_stream(spark, tmp_path):
    pieces = [[("a", 1, "one\ntw"), ("b", 1, "x")], [("a", 2, "o\nthree"), ("b", 2, "y\n")], [("a", 3, None), ("b", 3, "z")]]
    schema = "name string, seq int, chunk string"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = live.whole_lines(source).writeStream.format("memory").queryName("lines_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("lines_seen").collect())) == [("a", "one"), ("a", "three"), ("a", "two"), ("b", "xy")]
    batch = spark.createDataFrame(sum(pieces, []), schema)
    assert sorted(map(tuple, live.whole_lines(batch).collect())) == [("a", "one"), ("a", "three"), ("a", "two"), ("b", "xy"), ("b", "z")]


def test_boundaries_inside_words_count_as_named(spark):
    calls = spark.createDataFrame([("open",), ("socket",), ("a.b(",)], "boundary string")
    bodies = spark.createDataFrame([("raises reOpened",), ("socket but no marker",), ("Raises a.b(c)",), (None,)], "body string")
    for most in (100, 0):
        assert [r[0] for r in compare.unnamed_boundaries(calls, bodies, "raises", most).collect()] == ["socket"]


def test_names_in_texts_both_ways(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcé.") for _ in range(n))
    names = sorted({word(rnd.randint(1, 9)) for _ in range(300)})
    texts = [word(rnd.randint(0, 60)) for _ in range(40)] + ["a", "", None] + ["abc" * 40] * 3
    n, t = spark.createDataFrame([*((x,) for x in names), (None,), ("",), (names[0],)], "name string"), spark.createDataFrame([(x,) for x in texts], "text string")
    want = [x for x in names if any(x in t for t in texts if t)]
    assert 20 < len(want) < len(names) - 20
    for most in (1000, 0):
        assert sorted(r.name for r in patterns.occurring(n, t, most).collect()) == want
        assert patterns.occurring(n.limit(0), t, most).collect() == [] and patterns.occurring(n, t.limit(0), most).collect() == []


def test_sizes_stay_where_heads_are_missing(spark):
    files = spark.createDataFrame([("./a/x.py", 5_000_000, None), ("a//x.py", 3, "h"), ("b/y.py", 7_000_000, None), ("a/.git/z.py", 1, "z"), ("a/w.txt", 1, "w")], "path string, size long, head string")
    assert [tuple(r) for r in inventory.in_scope(files, ["."], (".py",), (".git",)).collect()] == [("a/x.py", 5_000_000, "h"), ("b/y.py", 7_000_000, None)]


def test_more_than_ten_thousand_messages_of_a_file_keep_their_places(spark):
    out = json.dumps({"files": {f: {"messages": [{"line": i, "message": f"m{i}"} for i in range(10_002)]} for f in ("a.php", "b.php")}, "errors": ["loose"]})
    runs = spark.createDataFrame([("r", "phpstan", 1, out, "")], "run string, tool string, exit_code int, stdout string, stderr string")
    rows = parsers.parse(runs, "phpstan").collect()
    assert len(rows) == 20_005 == len({r.pos for r in rows})


def test_broken_xml_is_read_as_text(spark):
    runs = spark.createDataFrame([("r", "cppcheck", 1, "a.c:3: error: bad", "<results><errors><error id="), ("s", "cppcheck", 0, "", "<results><errors/></results>"), ("t", "cppcheck", 1, "", None)], "run string, tool string, exit_code int, stdout string, stderr string")
    rows = {(r.run, r.path, r.line, r.message) for r in parsers.parse(runs, "cppcheck").collect()}
    assert ("r", "a.c", 3, "bad") in rows and not [r for r in rows if r[0] == "s"]


def test_name_and_annotation_evidence(spark):
    df = spark.createDataFrame([("user_id",), ("id",), ("rate_Pct",), ("begin_x",), ("x_begin",), ("quiet",)], "n string")
    got = {r.n: r.e and (r.e.facet, r.e.value) for r in df.select("n", evidence.name_evidence(F.col("n")).alias("e")).collect()}
    assert got == {"user_id": ("nominal", "user"), "id": None, "rate_Pct": ("unit", "percent"), "begin_x": None, "x_begin": ("interval_alignment", "leading"), "quiet": None}


def test_strategies():
    assert symbols.strategy("None | list[int]") == "st.one_of(st.none(), st.lists(st.integers(), max_size=32))"
    assert [symbols.strategy(x) for x in (None, "", "int | str", "dict[int, Foo]", "list[")] == [None] * 5
