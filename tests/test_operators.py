import json
import random

from pyspark.sql import functions as F

from siftspark.functions import findings as fx
from siftspark.operators import compare, filters, graph, lattice, ledger, ordered, report
from siftspark.sources import inventory, parsers
from siftspark.streaming import live

FINDING = "seq long, result_name string, category string, tool string, message string, path string, line int, code string, severity string, fixable boolean, fix_safety string, accepted boolean"


def finding(spark, *rows):
    base = {"result_name": "ruff", "category": "lint", "tool": "ruff", "message": "m", "path": "a.py", "line": 1, "code": "F401", "severity": "error", "fixable": False, "fix_safety": None, "accepted": False}
    return spark.createDataFrame([{"seq": i, **base, **r} for i, r in enumerate(rows)], FINDING)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_identity_ignores_lines_and_generic_codes_group_by_shape(spark):
    df = finding(spark, {"line": 1}, {"line": 9}, {"code": "misc", "message": "Name `x` at /tmp/a 12"}, {"code": "misc", "message": "name `y`  at /etc/b 7"}, {"tool": "mutmut", "code": None, "message": "f__mutmut_12 survived"}, {"tool": "mutmut", "code": None, "message": "f__mutmut_3"}, {"message": "\tm\n"})
    mark = fx.fingerprint(F.col("tool"), F.col("code"), F.col("path"), F.col("message"))
    marks = [r[0] for r in df.orderBy("seq").select(mark).collect()]
    assert marks[0] == marks[1] == marks[6] and len(marks[0]) == 16
    keys = [r[0] for r in df.orderBy("seq").select(fx.signal_key(F.col("tool"), F.col("code"), F.col("message"))).collect()]
    assert keys[0] == "ruff:F401" and keys[2] == keys[3] == "ruff:misc:name `<symbol>` at <path> <n>"
    assert keys[4] == keys[5] == "mutmut:f__mutmut_<n>"


def test_class_ladder_and_severities(spark):
    df = spark.createDataFrame([("runtime-validation", None), ("lint", "BHTIME001"), ("api-time", "x"), ("other", "x"), ("types", None)], "category string, code string")
    got = [r[0] for r in df.select(fx.defect_class(F.col("category"), F.col("code"))).collect()]
    assert got == ["timing/serialization", "timing/serialization", "interface", "function", "checking"]
    s = spark.createDataFrame([("critical",), ("info",), ("odd",), ("note",)], "s string")
    assert [tuple(r) for r in s.select(fx.severity_rank(F.col("s")), fx.queue_rank(F.col("s")), fx.severity_weight(F.col("s"))).collect()] == [(0, 1, 8), (3, 1, 1), (1, 1, 3), (2, 2, 1)]


def test_views_leave_accepted_out_and_need_two_tools(spark):
    df = finding(spark, {}, {"tool": "mypy"}, {"accepted": True, "tool": "ty"}, {"line": 0, "tool": "mypy"}, {"path": "", "tool": "mypy"}, {"path": "b.py", "line": 3})
    assert values(report.correlated_locations(df), "path", "line", "tool_count") == [("a.py", 1, 2)]
    assert values(report.hotspots(df), "path", "count") == [("a.py", 3), ("b.py", 1)]
    risk = {r.path: r for r in report.risk_map(df).collect()}
    assert risk["a.py"].score == 18 + 8 and risk["b.py"].score == 6
    issues = report.logical_issues(df).collect()
    assert len(issues) == 4 and sum(i.path is None for i in issues) == 2


def test_health(spark):
    r = spark.createDataFrame([("a", "PASS"), ("b", "FINDINGS"), ("c", "N/A")], "name string, status string")
    assert report.defense_health(r).first().score == 82
    assert report.defense_health(r.where("status = 'N/A'")).first().score == 100


def test_overlapping_entries_accept_once_and_count_each(spark):
    entries = spark.createDataFrame([(0, "ruff:F401", ["a.py", "b.py"], 1), (1, "ruff:F401", ["a.py"], 5)], "entry_ord int, signal string, paths array<string>, count int")
    df = finding(spark, {}, {}, {"path": "c.py"}).withColumn("key", F.lit("ruff:F401"))
    assert values(ledger.accept(df, entries), "seq", "accepted", "entry_ord") == [(0, True, 0), (1, True, 0), (2, False, None)]
    assert values(ledger.report(df, entries), "entry_ord", "live") == [(0, 2), (1, 2)]
    assert values(ledger.review(df, entries), "entry_ord", "path", "delta", "verdict") == [(0, "a.py", 1, "GREW"), (0, "b.py", -1, "SHRANK"), (1, "a.py", -3, "SHRANK")]
    assert values(ledger.rewritten(entries, ledger.snapshot(df, "c")), "paths", "count") == [("c.py", 1)]


def test_runs_flatten_back(spark):
    rnd = random.Random(1)
    rows = [(f, rnd.randint(1, 60)) for f in "ab" for _ in range(rnd.randint(0, 60))]
    got = ordered.runs(spark.createDataFrame(rows, "file string, line int")).collect()
    assert sorted((r.file, x) for r in got for x in range(r.first_line, r.last_line + 1)) == sorted(set(rows))


def ops(spark, text):
    rows = [("k", i, w.split(":")[0], (w.split(":") + ["n"])[1]) for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "key string, pos int, op string, name string")


def test_ordered_state_fires_and_is_quiet(spark):
    assert values(ordered.stale_derived(ops(spark, "d m x x"), "d", "m", "x"), "pos") == [(2,)]
    assert values(ordered.stale_derived(ops(spark, "m x d x"), "d", "m", "x"), "pos") == []
    assert values(ordered.use_after_close(ops(spark, "o c u o u"), "o", "c", "u"), "pos") == [(2,)]
    assert values(ordered.dead_stores(ops(spark, "s:a s:b s:a r:a s:a"), "s", "r"), "name", "pos") == [("a", 0)]
    assert values(ordered.read_before_check(ops(spark, "r r c r"), "c", "r"), "pos") == [(0,)]
    assert values(ordered.read_before_check(ops(spark, "c r"), "c", "r"), "pos") == []


def test_filters(spark):
    paths = spark.createDataFrame([("a/b/c",), ("ab/c",), ("a",), ("x/b",)], "path string")
    assert values(filters.without_prefixes(paths, spark.createDataFrame([("a/",)], "prefix string")), "path") == [("ab/c",), ("x/b",)]
    assert values(filters.without_components(paths, spark.createDataFrame([("b",)], "name string")), "path") == [("a",), ("ab/c",)]
    df = finding(spark, {"line": 1}, {"line": 2}, {"path": "z.py"})
    lines = spark.createDataFrame([("a.py", 1, "x  # nosec"), ("a.py", 2, "y")], "path string, line int, text string")
    assert values(filters.without_marked_lines(df, lines, "#.*nosec"), "seq") == [(1,), (2,)]
    engines = spark.createDataFrame([("go", "go"), ("lint", "py"), ("lint", "js")], "name string, capability string")
    have = spark.createDataFrame([("js", True), ("go", False)], "capability string, detected boolean")
    assert values(filters.capability_gate(engines, have), "name", "status") == [("go", "N/A")]
    c = spark.createDataFrame([("fast", "pr"), ("all", None), ("deep", None), ("pr", None)], "run string, need string")
    assert [r[0] for r in c.select(filters.profile_allows(F.col("run"), F.col("need"))).collect()] == [False, True, True, False]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (3, 1)], "caller int, callee int")
    got = graph.reachable(edges, spark.createDataFrame([(1,)], "root int"))
    assert values(got, "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    ends = graph.chain_ends(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string"))
    assert values(ends, "name", "terminal", "steps") == [("a", "c", 2), ("b", "c", 1)]
    facts = spark.createDataFrame([("a", "ms", 0.9), ("c", "s", 0.8)], "name string, value string, confidence double")
    flows = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 1.0), ("c", "d", 0.5)], "source string, target string, factor double")
    assert values(graph.strengthened(facts, flows), "name", "value", "confidence") == [("a", "ms", 0.9), ("b", "ms", 0.81), ("c", "ms", 0.81), ("d", "ms", 0.405)]


def test_lattice(spark):
    base = dict(exit_code=0, stdout="", stderr="", timed_out=False, n_findings=0, parse_error=None, findings_exit_codes=[1], skip_exit_codes=[5], error_markers=["Traceback"], empty_scope_markers=["no files"])
    cases = {"pass": {}, "found": {"n_findings": 1}, "crash": {"exit_code": 1, "n_findings": 2, "stderr": "Traceback"}, "empty": {"exit_code": 1, "stdout": "no files"}, "made": {"exit_code": 1}, "skip": {"exit_code": 5}, "bad": {"exit_code": 3}, "late": {"timed_out": True}, "parse": {"parse_error": "x"}}
    schema = "name string, exit_code int, stdout string, stderr string, timed_out boolean, n_findings int, parse_error string, findings_exit_codes array<int>, skip_exit_codes array<int>, error_markers array<string>, empty_scope_markers array<string>"
    got = {r.name: (r.status, r.findings_dropped, r.made_up) for r in lattice.status(spark.createDataFrame([{"name": k, **base, **v} for k, v in cases.items()], schema)).collect()}
    assert got == {"pass": ("PASS", False, False), "found": ("FINDINGS", False, False), "crash": ("ERROR", True, False), "empty": ("SKIPPED", False, False), "made": ("FINDINGS", False, True), "skip": ("SKIPPED", False, False), "bad": ("ERROR", False, False), "late": ("ERROR", False, False), "parse": ("ERROR", False, False)}
    results = spark.createDataFrame([("a", "FINDINGS")], "name string, status string")
    assert [lattice.exit_code(results, p).first()[0] for p in ("findings", "error", "never")] == [1, 0, 0]


def runs(spark, stdout, exit_code=1, tool="t"):
    return spark.createDataFrame([(1, tool, exit_code, stdout, "")], "run int, tool string, exit_code int, stdout string, stderr string")


def test_text_parser(spark):
    out = "a.py:3:4: warning: odd [E1]\nb.py:7: note: fine\nnoise\n"
    assert values(parsers.parse(runs(spark, out), "text"), "path", "line", "column", "code", "severity", "message") == [("a.py", 3, 4, "E1", "warning", "odd"), ("b.py", 7, None, None, "note", "fine")]
    assert values(parsers.parse(runs(spark, "x\nlast word\n\n"), "text"), "message", "path") == [("last word", None)]
    assert parsers.parse(runs(spark, out, 0), "text").count() == 0


def test_json_parsers_and_fallback(spark):
    ruff = json.dumps([{"filename": "a.py", "code": "D100", "message": "doc", "location": {"row": 1, "column": 2}, "fix": None}, {"filename": "a.py", "code": "F401", "message": "unused", "location": {"row": 3}, "fix": {"applicability": "Safe", "message": "rm"}}])
    assert values(parsers.parse(runs(spark, ruff), "ruff"), "code", "severity", "fixable", "fix_safety", "line") == [("D100", "note", False, None, 1), ("F401", "error", True, "safe", 3)]
    assert values(parsers.parse(runs(spark, "a.py:1: broken"), "ruff"), "message") == [("broken",)]
    pyright = json.dumps({"generalDiagnostics": [{"file": "a.py", "rule": "r", "message": "m", "severity": "error", "range": {"start": {"line": 0, "character": 4}}}]})
    assert values(parsers.parse(runs(spark, pyright), "basedpyright"), "line", "column") == [(1, 5)]
    semgrep = json.dumps({"results": [{"path": "p", "check_id": "c", "start": {"line": 2, "col": 1}, "extra": {"message": "m", "severity": "WARNING", "fix": "x"}}]})
    assert values(parsers.parse(runs(spark, semgrep), "semgrep"), "severity", "fix_safety", "fix_preview") == [("warning", "rule", "x")]
    sarif = json.dumps({"runs": [{"results": [{"ruleId": "R", "level": "note", "message": {"text": "t"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "u"}, "region": {"startLine": 5}}}]}]}]})
    assert values(parsers.parse(runs(spark, sarif), "sarif"), "code", "path", "line", "severity") == [("R", "u", 5, "note")]
    pylint = json.dumps({"messages": [{"type": "convention", "path": "p", "line": 1, "symbol": "s", "message": "m"}]})
    assert values(parsers.parse(runs(spark, pylint), "pylint"), "code", "severity") == [("s", "note")]
    assert values(parsers.parse(runs(spark, json.dumps({"issues": [{"file": "f", "lineno": 4, "msg": "m"}]})), "json"), "path", "line", "message") == [("f", 4, "m")]
    assert values(parsers.parse(runs(spark, '{"path": "p", "message": "ok"}\nbad\n'), "json-lines"), "path", "message") == [("p", "ok")]
    assert values(parsers.parse(runs(spark, json.dumps({"findings": [{"code": "C", "message": "m"}]})), "helper"), "code", "severity") == [("C", "warning")]
    assert values(parsers.parse(runs(spark, "src/a.py\n 12: DOC101: bad\nsrc/b.py\n 3: DOC202: worse\n"), "pydoclint"), "path", "line", "code") == [("src/a.py", 12, "DOC101"), ("src/b.py", 3, "DOC202")]
    assert values(parsers.parse(runs(spark, "import time: 5 | 10 | a\nimport time: 5 | 2500000 | pkg\n", 0), "importtime"), "code", "message") == [("BHPERF001", "importing pkg takes 2500 ms")]
    assert values(parsers.parse(runs(spark, "m1 survived\nm2 killed"), "mutmut"), "message") == [("m1 survived",)]


def test_own_parser(spark):
    parsers.register("own", lambda r: parsers._shaped(r.select("run", F.lit(0).alias("pos"), "tool", F.col("stdout").alias("message"), F.lit("note").alias("severity"))))
    assert values(parsers.parse(runs(spark, "hello"), "own"), "message") == [("hello",)]
    del parsers.PARSERS["own"]


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "package.json").write_text(json.dumps({"dependencies": {"React": "1"}, "devDependencies": {"vite": "2"}}))
    (tmp_path / "app.env").write_text("# x\nA = '1'\n1BAD=2\nA=\"2\"\nno line\n")
    files = inventory.read_files(spark, str(tmp_path))
    assert {r.name for r in inventory.manifest_dependencies(files).collect()} == {"react", "vite"}
    lines = files.where("path LIKE '%.env'").select("path", F.posexplode(F.split("head", "\n")).alias("line", "raw"))
    assert values(inventory.env_values(lines), "name", "value") == [("A", "2")]
    texts = spark.createDataFrame([("a", "CREATE TABLE x AUTO_INCREMENT"), ("b", "uses psycopg and mysql"), ("c", "plain")], "k string, text string")
    assert values(inventory.first_dialect(texts, "k"), "k", "dialect") == [("a", "mysql"), ("b", "postgres"), ("c", "ansi")]
    export = json.dumps({"system_ir": {"relationships": [{"predicate": "calls", "subject": "a", "object": "b", "confidence": "0.5"}, {"predicate": "calls", "subject": "a", "object": "c", "confidence": "high"}, 7, {"predicate": "x"}]}})
    assert values(inventory.call_graph(spark.createDataFrame([(export,)], "text string")), "object", "confidence") == [("b", 0.5)]
    cov = json.dumps({"files": {"a.py": {"missing_lines": [1, 2, 5]}}})
    assert values(inventory.coverage_lines(spark.createDataFrame([(cov,)], "text string")), "file", "line") == [("a.py", 1), ("a.py", 2), ("a.py", 5)]
    secrets = spark.createDataFrame([("API_TOKEN", "abcdefgh12345678"), ("API_TOKEN", "changeme"), ("X", "ghp_abcdefghijklmnop"), ("NAME", "abcdefgh12345678"), ("K", "${VALUE_FROM_ENV_NOW}")], "n string, v string")
    assert [r[0] for r in secrets.select(fx.looks_secret(F.col("n"), F.col("v"))).collect()] == [True, False, True, False, False]


def test_compare(spark):
    a = spark.createDataFrame([("x", "f"), ("x", "g"), ("only", "h")], "name string, field string")
    b = spark.createDataFrame([("x", "f"), ("x", "k")], "name string, field string")
    assert values(compare.schema_drift(a, b), "field", "only_in") == [("g", "schema"), ("k", "model")]
    names = spark.createDataFrame([("o", "encode_x"), ("o", "decode_x"), ("o", "open_y")], "owner string, name string")
    inverse = {"encode": "decode", "decode": "encode", "open": "close"}
    assert values(compare.inverse_pairs(names, inverse), "name", "partner") == [("decode_x", "encode_x"), ("encode_x", "decode_x"), ("open_y", None)]
    cases = spark.createDataFrame([("f", 1, 1.0, 1.0), ("f", 2, 1.0, None), ("f", 3, 1.0, 2.0), ("g", 1, None, None)], "fn string, case_no int, old double, new double")
    assert values(compare.first_differences(cases), "fn", "differences", "case_no") == [("f", 2, 2)]
    assert compare.first_differences(cases, most=1).count() == 0


def test_stream_of_heartbeats(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, name string").parquet(str(tmp_path / "in"))
    q = live.heartbeats(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("beats").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("beats"), "beat", "name", "lines") == values(live.heartbeats(events, "1 day"), "beat", "name", "lines")
    late = live.heartbeats(stream, "1 day", late="2 days")
    assert late.isStreaming


def test_liveness(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS now, timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:59:00' AS z")
    got = lambda t, z="z": df.select(live.liveness(F.col("now"), F.col("a"), F.expr(z), F.lit(t))).first()[0]
    assert [got(3600), got(90_000), got(90_000, "a"), got(90_000, "now")] == ["near timeout", "slowing", "quiet", "active"]
    planned = spark.createDataFrame([("a",), ("b",)], "name string")
    assert values(live.interrupted(planned, planned.where("name = 'a'")), "name", "status") == [("b", "ERROR")]


def test_technology_inventory(spark):
    rows = [("src/a.py", "import asyncio\n"), ("b/x.ts", "process.env.A"), ("api/openapi.yaml", "openapi: 3.0\n"), ("api/swagger.yaml", "nothing"), ("db/migrations/0001_x.sql", "CREATE TABLE t (id serial)"), ("Dockerfile.dev", ""), ("run", "#!/bin/bash\n"), ("readme", "text"), (".github/workflows/ci.yml", ""), ("t.py", "def test_a(benchmark): ...")]
    files = spark.createDataFrame([(p, len(h), h) for p, h in rows], "path string, size int, head string")
    deps = spark.createDataFrame([("React",), ("left-pad",)], "name string")
    got = {r.capability: r.evidence for r in inventory.inventory(files, deps).collect()}
    assert got["python"] == ["src/a.py", "t.py"] and got["asyncio"] == ["src/a.py"] and got["dotenv"] == ["b/x.ts"]
    assert got["openapi"] == ["api/openapi.yaml"] and got["docker"] == ["Dockerfile.dev"] and got["shell"] == ["run"]
    assert got["postgres-migrations"] == ["db/migrations/0001_x.sql"] and got["react"] == ["dependencies"]
    assert got["github-actions"] == [".github/workflows/ci.yml"] and got["benchmark-tests"] == ["t.py"]
    assert "terraform" not in got and "php" not in got


def test_more_parsers(spark):
    def got(parser, out, *cols, stderr=""):
        df = spark.createDataFrame([(1, parser, 1, out if isinstance(out, str) else json.dumps(out), stderr)], "run int, tool string, exit_code int, stdout string, stderr string")
        return values(parsers.parse(df, parser), *cols)

    assert got("shellcheck", [{"file": "a.sh", "line": 1, "column": 2, "code": 2086, "message": "m", "level": "info"}], "path", "code", "severity") == [("a.sh", "SC2086", "note")]
    assert got("shellcheck", {"comments": [{"file": "b.sh", "code": 1}]}, "path", "code", "message") == [("b.sh", "SC1", "ShellCheck finding")]
    assert got("hadolint", [{"file": "D", "line": 3, "code": "DL1", "message": "m", "level": "error"}], "path", "line", "severity") == [("D", 3, "error")]
    assert got("sqlfluff", [{"filepath": "q.sql", "violations": [{"start_line_no": 2, "code": "LT01", "description": "d"}, {"line_no": 5, "code": "L2"}]}], "path", "line", "code") == [("q.sql", 2, "LT01"), ("q.sql", 5, "L2")]
    assert got("golangci-lint", {"Issues": [{"FromLinter": "vet", "Text": "t", "Pos": {"Filename": "m.go", "Line": 4}}]}, "path", "line", "code", "message") == [("m.go", 4, "vet", "t")]
    assert got("bandit", {"results": [{"filename": "a.py", "line_number": 7, "test_id": "B1", "issue_text": "t", "issue_severity": "HIGH"}]}, "line", "code", "severity") == [(7, "B1", "high")]
    assert got("eslint", [{"filePath": "x.js", "messages": [{"line": 1, "ruleId": "r", "message": "m", "severity": 2}, {"line": 2, "ruleId": "s", "message": "n", "severity": 1}]}], "path", "code", "severity") == [("x.js", "r", "error"), ("x.js", "s", "warning")]
    assert got("phpstan", {"files": {"a.php": {"messages": [{"message": "m", "line": 3}]}}, "errors": ["loose"]}, "path", "line", "message") == [("a.php", 3, "m"), (None, None, "loose")]
    clippy = json.dumps({"reason": "compiler-message", "message": {"level": "warning", "message": "m", "code": {"code": "c"}, "spans": [{"is_primary": False, "file_name": "z"}, {"is_primary": True, "file_name": "m.rs", "line_start": 9}]}})
    assert got("clippy", clippy + "\n" + json.dumps({"reason": "build-finished"}), "path", "line", "code") == [("m.rs", 9, "c")]
    xml = '<?xml version="1.0"?><results version="2"><errors><error id="nullPointer" severity="error" msg="m"><location file="a.c" line="3" column="4"/><location file="b.c" line="9"/></error></errors></results>'
    assert got("cppcheck", "", "path", "line", "code", "severity", stderr=xml) == [("a.c", 3, "nullPointer", "error")]
    assert got("eslint", "x.js:1:2: error: plain", "path", "line") == [("x.js", 1)]
