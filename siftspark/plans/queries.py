"""Registered queries of the finding analytics, each with its SQL twin over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import findings as fx
from siftspark.operators import compare, emit, filters, graph, lattice, ledger, ordered, report
from siftspark.plans import adapters as a
from siftspark.plans import parser_runs, rule_sources
from siftspark.sources import parsers
from siftspark.streaming import live

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FS, RS, LS = a.FINDINGS_SQL, a.RESULTS_SQL, a.LEDGER_SQL
KEYED_SQL = f"k AS (SELECT *, {a.KEY_SQL} AS key FROM f)"


def keyed(spark, d) -> DataFrame:
    return a.findings(spark, d).withColumn("key", fx.signal_key(F.col("tool"), F.col("code"), F.col("message")))


# ---------------------------------------------------------------- report views


@query(f"""WITH {FS}, g AS (
  SELECT path, count(*) AS findings, list_sort(list(DISTINCT tool)) AS tools, sum({a.WEIGHT_SQL}) AS base,
         count(*) FILTER (code = 'BHCOV001') AS coverage_gaps, count(*) FILTER (code = 'BHCOV002') AS branch_gaps,
         count(*) FILTER (contains(category, 'complex') OR coalesce(code LIKE 'BHCX%', false)) AS complexity_signals
  FROM f GROUP BY path)
SELECT path, CAST(base + 12 * coverage_gaps + 16 * branch_gaps + 5 * complexity_signals + 8 * (len(tools) - 1) AS BIGINT) AS score,
       findings, CAST(len(tools) AS INTEGER) AS tool_count, tools, coverage_gaps, branch_gaps, complexity_signals FROM g""")
def risk_map(spark, d):
    return report.risk_map(a.findings(spark, d)).orderBy(*map(F.expr, ("-score", "-tool_count", "path")))


@query(f"WITH {FS} SELECT path, {a.CLASS_SQL} AS odc_class, count(*) AS count FROM f GROUP BY 1, 2")
def risk_classes(spark, d):
    return report.risk_classes(a.findings(spark, d))


@query(f"""WITH {FS}, {KEYED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth, count(*) OVER (PARTITION BY key) AS c FROM k)
SELECT key, any_value(c) AS count, max(tool) FILTER (nth = 1) AS tool, max(code) FILTER (nth = 1) AS code, max(message) FILTER (nth = 1) AS message,
       max(severity) FILTER (nth = 1) AS severity, list(path || ':' || coalesce(CAST(nullif(line, 0) AS VARCHAR), '?') ORDER BY nth) AS locations
FROM n WHERE nth <= 8 GROUP BY key""")
def signal_groups(spark, d):
    return report.signal_groups(a.findings(spark, d)).orderBy(*report.signal_order())


@query(f"""WITH {FS} SELECT path, line, list_sort(list(DISTINCT tool)) AS tools, count(*) AS finding_count,
       coalesce(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), []) AS codes, arg_min(severity, ({a.RANK_SQL}) * 100000000 + seq) AS severity,
       CAST(count(DISTINCT tool) AS INTEGER) AS tool_count FROM f WHERE line <> 0 GROUP BY path, line HAVING count(DISTINCT tool) >= 2""")
def correlated_locations(spark, d):
    return report.correlated_locations(a.findings(spark, d)).orderBy(*map(F.expr, ("-tool_count", "-finding_count", "path", "line")))


@query(f"""WITH {FS}, m AS (SELECT *, {a.CLASS_SQL} AS odc_class, {a.MARK_SQL} AS mark FROM f),
w AS (SELECT *, CASE WHEN line <> 0 THEN path ELSE '<unlocated:' || mark || '>' END AS place, row_number() OVER (
        PARTITION BY CASE WHEN line <> 0 THEN path ELSE '<unlocated:' || mark || '>' END, line, odc_class
        ORDER BY {a.RANK_SQL}, CASE WHEN code LIKE 'BH%' THEN 0 ELSE 1 END, tool, seq) AS nth FROM m)
SELECT 'LOG-' || upper(substr(sha256(place || '|' || line || '|' || odc_class), 1, 12)) AS id, CASE WHEN place NOT LIKE '<unlocated:%' THEN place END AS path,
       nullif(line, 0) AS line, odc_class, count(*) AS finding_count, CAST(count(DISTINCT tool) AS INTEGER) AS tool_count, list_sort(list(DISTINCT tool)) AS tools,
       coalesce(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), []) AS codes, max(severity) FILTER (nth = 1) AS severity, max(message) FILTER (nth = 1) AS primary_message
FROM w GROUP BY place, line, odc_class""")
def logical_issues(spark, d):
    return report.logical_issues(a.findings(spark, d))


@query(f"WITH {FS} SELECT path, count(*) AS count, min(seq) AS first_seen FROM f GROUP BY path ORDER BY count DESC, first_seen LIMIT 20")
def hotspots(spark, d):
    return report.hotspots(a.findings(spark, d))


@query(f"""WITH {FS} SELECT tool, count(*) AS total, count(*) FILTER (fix_safety = 'safe') AS safe, count(*) FILTER (fix_safety = 'unsafe') AS unsafe,
       count(*) FILTER (coalesce(fix_safety, '') NOT IN ('safe', 'unsafe')) AS review FROM f WHERE fixable GROUP BY tool""")
def autofix_summary(spark, d):
    return report.autofix_summary(a.findings(spark, d))


@query(f"WITH {FS} SELECT {a.CLASS_SQL} AS odc_class, count(*) AS count FROM f GROUP BY 1")
def defect_class_histogram(spark, d):
    return report.class_histogram(a.findings(spark, d))


@query(f"""WITH {FS}, {RS}, {LS}, {KEYED_SQL}, m AS (SELECT k.*, {a.CLASS_SQL} AS odc_class, {a.MARK_SQL} AS mark,
  EXISTS (SELECT 1 FROM l WHERE l.signal = k.key AND list_contains(l.paths, k.path)) AS accepted FROM k),
i AS (SELECT count(*) AS logical_issues FROM (SELECT DISTINCT CASE WHEN line <> 0 THEN path ELSE mark END, line, odc_class FROM m WHERE NOT accepted))
SELECT t.*, i.*, s.*, round(coalesce((raw_findings - accepted_findings) / nullif(logical_issues, 0), 0.0), 6) AS raw_per_issue
FROM (SELECT count(*) AS raw_findings, count(*) FILTER (accepted) AS accepted_findings FROM m) t, i,
     (SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FINDINGS') AS with_findings, count(*) FILTER (status = 'ERROR') AS errors,
             count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'N/A') AS not_applicable FROM r) s""")
def run_summary(spark, d):
    accepted = ledger.accept(keyed(spark, d), a.ledger(spark, d))
    return report.run_summary(accepted, a.results(spark, d))


_HEALTH = "round_even(sum(CASE status WHEN 'PASS' THEN 100 WHEN 'FINDINGS' THEN 65 WHEN 'SKIPPED' THEN 20 WHEN 'ERROR' THEN 0 END) FILTER (status <> 'N/A') / nullif(count(*) FILTER (status <> 'N/A'), 0), 0)"


@query(f"WITH {RS} SELECT category, CAST(coalesce({_HEALTH}, 100) AS INTEGER) AS score, count(*) FILTER (status <> 'N/A') AS applicable FROM r GROUP BY category")
def defense_health(spark, d):
    return report.defense_health(a.results(spark, d), "category")


@query(f"""WITH {FS}, {RS}, {KEYED_SQL},
c AS (SELECT path, line, count(DISTINCT tool) AS t, count(*) AS n FROM f WHERE line <> 0 GROUP BY path, line HAVING count(DISTINCT tool) >= 2),
i AS (SELECT path AS ip, line AS il, printf('CORR-%04d', row_number() OVER (ORDER BY t DESC, n DESC, path, line)) AS correlation_id FROM c),
x AS (SELECT name, arg_max(command, seq) AS c FROM r GROUP BY name),
y AS (SELECT split_part(name, ':', 1) AS name, arg_min(command, seq) AS c FROM r GROUP BY 1),
v AS (SELECT coalesce(x.name, y.name) AS name, coalesce(x.c, y.c) AS c FROM x FULL JOIN y ON x.name = y.name)
SELECT seq, 'BH-' || upper({a.MARK_SQL}) AS id, tool, {a.CLASS_SQL} AS odc_class, key AS signal_key, severity, path, line, correlation_id,
       coalesce(p.c, q.c) AS verification, CASE severity WHEN 'error' THEN 0 WHEN 'note' THEN 2 ELSE 1 END AS rank
FROM k LEFT JOIN i ON path = ip AND line = il LEFT JOIN v p ON p.name = k.result_name LEFT JOIN v q ON q.name = k.tool""")
def repair_queue(spark, d):
    return report.repair_queue(a.findings(spark, d), a.results(spark, d))


@query(f"""WITH {FS}, p AS (SELECT ['basedpyright', 'mypy', 'ty'] AS present),
g AS (SELECT path, line, list_sort(list(DISTINCT tool)) AS loud FROM f WHERE line <> 0 AND tool IN ('mypy', 'basedpyright', 'pyrefly', 'ty') GROUP BY path, line)
SELECT path, line, array_to_string(loud, ', ') AS loud, array_to_string(list_sort(list_filter(present, lambda x: NOT list_contains(loud, x))), ', ') AS silent
FROM g, p WHERE loud <> present""")
def checker_disagreement(spark, d):
    return report.disagreements(a.findings(spark, d), a.checkers(spark, d))


@query(f"WITH {FS} SELECT seq, {a.MARK_SQL} AS fingerprint, 'BH-' || upper({a.MARK_SQL}) AS finding_id FROM f")
def finding_identity(spark, d):
    mark = fx.fingerprint(F.col("tool"), F.col("code"), F.col("path"), F.col("message"))
    return a.findings(spark, d).select("seq", mark.alias("fingerprint"), fx.finding_id(mark).alias("finding_id"))


@query(f"WITH {FS}, {KEYED_SQL} SELECT DISTINCT key, CASE WHEN length(key) > 24 THEN substr(key, 1, 23) || '…' ELSE key END AS label FROM k")
def signal_keys(spark, d):
    return keyed(spark, d).select("key", fx.signal_label(F.col("key"), 24).alias("label")).distinct()


@query(f"WITH {FS}, n AS (SELECT path, severity, seq, row_number() OVER (PARTITION BY path, severity ORDER BY seq) AS nth FROM f) SELECT path, severity, seq, nth FROM n WHERE nth <= 8")
def first_locations(spark, d):
    return ordered.first_per_group(a.findings(spark, d).select("path", "severity", "seq"), ["path", "severity"], ["seq"], 8).withColumn("nth", F.col("nth").cast("long"))


# ---------------------------------------------------------------- accepted debt


@query(f"""WITH {FS}, {LS}, {KEYED_SQL}, e AS (SELECT entry_ord, signal, unnest(paths) AS path FROM l),
m AS (SELECT signal, path, min(entry_ord) AS entry_ord FROM e GROUP BY 1, 2)
SELECT seq, key, k.path, entry_ord IS NOT NULL AS accepted, entry_ord FROM k LEFT JOIN m ON m.signal = k.key AND m.path = k.path""")
def accept_first_match(spark, d):
    return ledger.accept(keyed(spark, d), a.ledger(spark, d)).select("seq", "key", "path", "accepted", "entry_ord")


@query(f"""WITH {FS}, {LS}, {KEYED_SQL}, e AS (SELECT DISTINCT entry_ord, signal, unnest(paths) AS path FROM l)
SELECT e.entry_ord, e.signal, 5 AS accepted_count, count(k.seq) AS live FROM e LEFT JOIN k ON k.key = e.signal AND k.path = e.path GROUP BY 1, 2""")
def debt_report(spark, d):
    return ledger.report(keyed(spark, d), a.ledger(spark, d))


@query(f"""WITH {FS}, {LS}, {KEYED_SQL}, e AS (SELECT DISTINCT entry_ord, signal, unnest(paths) AS path FROM l),
c AS (SELECT e.entry_ord, e.signal, e.path, count(k.seq) AS live FROM e LEFT JOIN k ON k.key = e.signal AND k.path = e.path GROUP BY 1, 2, 3)
SELECT *, live - 5 AS delta, CASE WHEN live > 5 THEN 'GREW' WHEN live < 5 THEN 'SHRANK' ELSE 'OK' END AS verdict FROM c""")
def debt_review(spark, d):
    return ledger.review(keyed(spark, d), a.ledger(spark, d))


@query(f"WITH {FS}, {KEYED_SQL} SELECT key AS signal, path, count(*) AS count FROM k WHERE path LIKE 'src/m1%' GROUP BY 1, 2")
def debt_snapshot(spark, d):
    return ledger.snapshot(keyed(spark, d), "src/m1")


@query(f"""WITH {FS}, {LS}, {KEYED_SQL}, s AS (SELECT key AS signal, path AS paths, count(*) AS count FROM k WHERE path LIKE 'src/m1%' AND key LIKE 'ruff:%' GROUP BY 1, 2)
SELECT signal, array_to_string(paths, ',') AS paths, CAST(count AS INTEGER) AS count FROM l WHERE signal NOT IN (SELECT signal FROM s)
UNION ALL SELECT signal, paths, CAST(count AS INTEGER) FROM s""")
def debt_rewrite(spark, d):
    return ledger.rewritten(a.ledger(spark, d), ledger.snapshot(keyed(spark, d).where(F.startswith("key", F.lit("ruff:"))), "src/m1"))


# ---------------------------------------------------------------- runs and ordered state


@query(f"""WITH {a.COVERED_SQL}, x AS (SELECT DISTINCT file, line FROM c), g AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM x)
SELECT file, min(line) AS first_line, max(line) AS last_line, count(*) AS n_lines FROM g GROUP BY file, g""")
def coverage_ranges(spark, d):
    return ordered.runs(a.covered_lines(spark, d))


@query(f"""WITH {a.COVERED_SQL}, x AS (SELECT DISTINCT file, line FROM c), g AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM x),
s AS (SELECT file, min(line) AS p, max(line) AS q, count(*) AS n FROM g GROUP BY file, g), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p) AS nth FROM s)
SELECT 'BHCOV001' AS code, file AS path, p AS line, CASE WHEN n >= 25 THEN 'error' ELSE 'warning' END AS severity,
       n || ' executable line(s) are never exercised by the test suite (missing range ' || CASE WHEN p = q THEN CAST(p AS VARCHAR) ELSE p || '-' || q END || ')' AS message
FROM o WHERE nth <= 50""")
def coverage_gaps(spark, d):
    return ordered.coverage_gaps(a.covered_lines(spark, d))


@query(f"WITH {a.OPS_SQL} SELECT key, pos, last_value(CASE WHEN op = 'signup' THEN name END IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos) AS carried FROM o")
def header_carry_forward(spark, d):
    return ordered.carried_header(a.operations(spark, d), ["key"], "pos", F.when(F.col("op") == "signup", F.col("name"))).select("key", "pos", "carried")


@query(f"""WITH {a.OPS_SQL}, s AS (SELECT *, max(CASE WHEN op = 'click' THEN pos END) OVER w AS d, max(CASE WHEN op = 'error' THEN pos END) OVER w AS m FROM o WINDOW w AS (PARTITION BY key ORDER BY pos))
SELECT key, min(pos) AS pos FROM s WHERE op = 'view' AND m > d GROUP BY key""")
def stale_derived(spark, d):
    return ordered.stale_derived(a.operations(spark, d), "click", "error", "view")


_STATE = "last_value(CASE WHEN op IN ('click', 'error') THEN op END IGNORE NULLS) OVER (PARTITION BY key, name ORDER BY pos)"


@query(f"WITH {a.OPS_SQL}, s AS (SELECT *, {_STATE} AS state FROM o) SELECT key, name, pos FROM s WHERE op = 'view' AND state = 'error'")
def use_after_close(spark, d):
    return ordered.use_after_close(a.operations(spark, d), "click", "error", "view")


@query(f"""WITH {a.OPS_SQL}, s AS (SELECT *, last_value(CASE op WHEN 'signup' THEN 'r' WHEN 'purchase' THEN 'w' END IGNORE NULLS) OVER (PARTITION BY key, name ORDER BY pos) AS mode FROM o)
SELECT key, name, pos FROM s WHERE op = 'view' AND mode = 'w'""")
def mode_mismatch(spark, d):
    return ordered.mode_mismatch(a.operations(spark, d), "signup", "purchase", "view")


@query(f"""WITH {a.OPS_SQL}, s AS (SELECT *, lag(op) OVER w AS b, lag(pos) OVER w AS p FROM o WHERE op IN ('click', 'view') WINDOW w AS (PARTITION BY key, name ORDER BY pos))
SELECT key, name, p AS pos, pos AS next_pos FROM s WHERE op = 'click' AND b = 'click'""")
def dead_store(spark, d):
    return ordered.dead_stores(a.operations(spark, d), "click", "view")


@query(f"WITH {a.OPS_SQL} SELECT key, min(pos) AS pos FROM o x WHERE op = 'view' AND NOT EXISTS (SELECT 1 FROM o y WHERE y.key = x.key AND y.pos < x.pos AND y.op = 'signup') GROUP BY key")
def read_before_check(spark, d):
    return ordered.read_before_check(a.operations(spark, d), "signup", "view")


@query(f"WITH {a.OPS_SQL} SELECT key, name, arg_max(op, pos) AS op, min(pos) AS pos FROM o GROUP BY key, name")
def stable_dedup(spark, d):
    return ordered.last_kept_first_placed(a.operations(spark, d), ["key", "name"], "pos", "op").select("key", "name", "op", "pos")


# ---------------------------------------------------------------- filters


@query(f"WITH {a.FILES_SQL} SELECT DISTINCT path FROM p WHERE NOT list_has_any(string_split(path, '/'), ['en', 'therha.example.com'])")
def exclude_component(spark, d):
    names = spark.createDataFrame([("en",), ("therha.example.com",)], "name string")
    return filters.without_components(a.files(spark, d), names).select("path").distinct()


@query(f"WITH {a.FILES_SQL}, x AS (SELECT DISTINCT regexp_extract(path, '^[^/]*/[a-z]+') AS prefix FROM p WHERE size % 5 = 0) SELECT DISTINCT path FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE path = prefix OR starts_with(path, prefix || '/'))")
def exclude_prefix(spark, d):
    files = a.files(spark, d)
    prefixes = files.where("size % 5 = 0").select(F.regexp_extract("path", "^[^/]*/[a-z]+", 0).alias("prefix")).distinct()
    return filters.without_prefixes(files, prefixes).select("path").distinct()


@query(f"WITH {FS} SELECT seq FROM f WHERE path NOT IN (SELECT DISTINCT 'src/m' || n_nationkey || '.py' FROM nation WHERE n_regionkey = 1)")
def exclude_ignored(spark, d):
    ignored = a.table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src/m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"))
    return filters.without_ignored(a.findings(spark, d), ignored).select("seq")


@query(f"WITH {FS}, x AS (SELECT DISTINCT 'src/m' || (o_orderkey % 20) || '.py' AS path, CAST(o_custkey % 50 AS INTEGER) AS line FROM orders WHERE o_orderpriority LIKE '1%') SELECT seq FROM f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = f.path AND x.line = f.line)")
def exclude_marked_lines(spark, d):
    lines = a.table(spark, d, "orders").select(F.expr("concat('src/m', o_orderkey % 20, '.py')").alias("path"), F.expr("cast(o_custkey % 50 AS INT)").alias("line"), F.col("o_orderpriority").alias("text"))
    return filters.without_marked_lines(a.findings(spark, d), lines, "^1").select("seq")


@query(f"WITH {RS} SELECT DISTINCT name, CASE WHEN name IN (SELECT 'd' || (n_nationkey * 3) FROM nation) THEN 'SKIPPED' ELSE 'RUN' END AS decision FROM r")
def wanted_defenses(spark, d):
    excluded = a.table(spark, d, "nation").select(F.concat(F.lit("d"), (F.col("n_nationkey") * 3).cast("string")).alias("name"))
    return filters.wanted(a.results(spark, d).select("name").distinct(), excluded)


# ---------------------------------------------------------------- graph


@query(f"""WITH RECURSIVE {a.CHAINED_SQL}, x(root, node, depth) AS (
  SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT root, callee, depth + 1 FROM x JOIN e ON e.caller = x.node WHERE depth < 3)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM x GROUP BY root, node""")
def reachable_depth3(spark, d):
    return graph.reachable(a.chained_edges(spark, d), a.table(spark, d, "part").select(F.col("p_partkey").alias("root")))


@query(f"WITH {a.EDGES_SQL} SELECT caller, min(callee) AS callee FROM e WHERE confidence >= 0.5 GROUP BY caller HAVING count(DISTINCT callee) = 1")
def unique_callee(spark, d):
    return graph.unique_callees(a.call_edges(spark, d))


@query("""WITH n AS (SELECT 'n' || (p_partkey % 700) AS name, CASE WHEN p_size % 10 = 0 THEN p_brand ELSE 't' || (p_partkey % 350) END AS target FROM part)
SELECT name, min(target) AS target FROM n GROUP BY name HAVING count(DISTINCT target) = 1""")
def unique_target(spark, d):
    return graph.unambiguous(a.table(spark, d, "part").selectExpr("concat('n', p_partkey % 700) AS name", "if(p_size % 10 = 0, p_brand, concat('t', p_partkey % 350)) AS target"))


@query("""WITH w AS (SELECT 'f' || (l_suppkey % 25) AS file, l_partkey % 200 AS target, 'w' || l_linenumber AS function, l_orderkey AS line, l_returnflag = 'R' AS synchronized FROM lineitem)
SELECT file, target, list_sort(list(DISTINCT function)) AS functions, min(line) AS line FROM w WHERE NOT synchronized GROUP BY 1, 2 HAVING count(DISTINCT function) >= 2""")
def multi_writer(spark, d):
    return graph.multi_writers(a.table(spark, d, "lineitem").selectExpr("concat('f', l_suppkey % 25) AS file", "l_partkey % 200 AS target", "concat('w', l_linenumber) AS function", "l_orderkey AS line", "l_returnflag = 'R' AS synchronized"))


@query(f"""WITH {a.CHAINED_SQL}, t AS (SELECT p_partkey AS symbol FROM part WHERE p_size > 20),
g AS (SELECT p_partkey AS symbol, callee, row_number() OVER (PARTITION BY p_partkey ORDER BY callee) AS nth FROM part JOIN e ON caller = p_partkey WHERE p_partkey NOT IN (FROM t) AND callee IN (FROM t))
SELECT symbol, count(*) AS tested_callees, list(callee ORDER BY callee) FILTER (nth <= 5) AS shown FROM g GROUP BY symbol""")
def verification_gap(spark, d):
    p = a.table(spark, d, "part")
    return graph.verification_gaps(p.select(F.col("p_partkey").alias("symbol")), p.where("p_size > 20").select(F.col("p_partkey").alias("symbol")), a.chained_edges(spark, d))


@query("""SELECT DISTINCT l_suppkey AS symbol, 'b' || (l_partkey % 50) AS boundary FROM lineitem WHERE 'b' || (l_partkey % 50) NOT IN (SELECT 'b' || (p_partkey % 25) FROM part)""")
def boundary_gap(spark, d):
    calls = a.table(spark, d, "lineitem").selectExpr("l_suppkey AS symbol", "concat('b', l_partkey % 50) AS boundary")
    return graph.boundary_gaps(calls, a.table(spark, d, "part").selectExpr("concat('b', p_partkey % 25) AS boundary"))


@query("""WITH RECURSIVE w AS (SELECT s_suppkey AS name, s_suppkey + 1 + s_nationkey % 4 AS target FROM supplier WHERE s_nationkey % 3 <> 0),
x(name, target, steps) AS (SELECT name, target, 1 FROM w UNION ALL SELECT x.name, w.target, steps + 1 FROM x JOIN w ON w.name = x.target WHERE steps < 64)
SELECT name, target AS terminal, CAST(steps AS INTEGER) AS steps FROM x WHERE target NOT IN (SELECT name FROM w)""")
def chain_terminal(spark, d):
    forwards = a.table(spark, d, "supplier").where("s_nationkey % 3 <> 0").selectExpr("s_suppkey AS name", "s_suppkey + 1 + s_nationkey % 4 AS target")
    return graph.chain_ends(forwards)


_PASS = """c{i} AS (SELECT e.callee AS name, max(struct_pack(c := round(confidence * 0.8, 9), v := value)) AS b FROM v{p} JOIN e ON e.caller = v{p}.name GROUP BY 1),
v{i} AS (SELECT coalesce(v{p}.name, c{i}.name) AS name, CASE WHEN c{i}.b IS NOT NULL AND (confidence IS NULL OR c{i}.b.c > confidence) THEN c{i}.b.v ELSE value END AS value,
  CASE WHEN c{i}.b IS NOT NULL AND (confidence IS NULL OR c{i}.b.c > confidence) THEN c{i}.b.c ELSE confidence END AS confidence FROM v{p} FULL JOIN c{i} ON v{p}.name = c{i}.name)"""


@query(f"""WITH {a.CHAINED_SQL}, v0 AS (SELECT p_partkey AS name, 'unit' || (p_size % 3) AS value, CAST(0.95 AS DOUBLE) AS confidence FROM part WHERE p_brand LIKE '%1'),
{", ".join(_PASS.format(i=i + 1, p=i) for i in range(5))} SELECT * FROM v5""")
def value_propagation(spark, d):
    values = a.table(spark, d, "part").where("p_brand LIKE '%1'").selectExpr("p_partkey AS name", "concat('unit', p_size % 3) AS value", "0.95D AS confidence")
    return graph.strengthened(values, a.chained_edges(spark, d).selectExpr("caller AS source", "callee AS target", "0.8D AS factor"))


# ---------------------------------------------------------------- comparison


_SCHEMA = "s AS (SELECT DISTINCT 'c' || o_custkey AS name, o_orderpriority AS field FROM orders), m AS (SELECT DISTINCT 'c' || o_custkey AS name, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'x' || o_orderstatus END AS field FROM orders)"


@query(f"""WITH {_SCHEMA} SELECT coalesce(s.name, m.name) AS name, coalesce(s.field, m.field) AS field, CASE WHEN m.name IS NULL THEN 'schema' ELSE 'model' END AS only_in
FROM s FULL JOIN m ON s.name = m.name AND s.field = m.field WHERE (s.name IS NULL OR m.name IS NULL)
  AND coalesce(s.name, m.name) IN (SELECT name FROM s) AND coalesce(s.name, m.name) IN (SELECT name FROM m)""")
def schema_drift(spark, d):
    o = a.table(spark, d, "orders")
    return compare.schema_drift(o.selectExpr("concat('c', o_custkey) AS name", "o_orderpriority AS field"), o.selectExpr("concat('c', o_custkey) AS name", "if(o_orderstatus = 'O', o_orderpriority, concat('x', o_orderstatus)) AS field"))


@query("""WITH p AS (SELECT 'p' || (o_custkey % 400) AS producer, o_orderstatus AS variant, o_orderpriority AS key FROM orders),
v AS (SELECT producer, variant, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM p GROUP BY 1, 2), s AS (SELECT producer FROM v GROUP BY 1 HAVING count(DISTINCT keys) = 1),
r AS (SELECT DISTINCT 'p' || (o_custkey % 400) AS producer, 'c' || (o_orderkey % 10) AS consumer, CASE WHEN o_totalprice > 200000 THEN 'extra' ELSE o_orderpriority END AS key FROM orders)
SELECT * FROM r WHERE producer IN (FROM s) AND NOT EXISTS (SELECT 1 FROM p WHERE p.producer = r.producer AND p.key = r.key)""")
def producer_consumer_drift(spark, d):
    o = a.table(spark, d, "orders")
    return compare.unmet_reads(
        o.selectExpr("concat('p', o_custkey % 400) AS producer", "o_orderstatus AS variant", "o_orderpriority AS key"),
        o.selectExpr("concat('p', o_custkey % 400) AS producer", "concat('c', o_orderkey % 10) AS consumer", "if(o_totalprice > 200000, 'extra', o_orderpriority) AS key"),
    )


@query("""WITH u AS (SELECT 'V' || (l_partkey % 977) AS name, 'f' || l_suppkey AS path, CAST(l_linenumber AS INTEGER) AS line FROM lineitem)
SELECT name, (arg_min(struct_pack(p := path, l := line), struct_pack(p := path, l := line))).p AS path, (arg_min(struct_pack(p := path, l := line), struct_pack(p := path, l := line))).l AS line
FROM u WHERE name NOT IN (SELECT 'V' || (p_partkey % 700) FROM part) GROUP BY name""")
def env_missing(spark, d):
    used = a.table(spark, d, "lineitem").selectExpr("concat('V', l_partkey % 977) AS name", "concat('f', l_suppkey) AS path", "cast(l_linenumber AS INT) AS line")
    return compare.missing_names(used, a.table(spark, d, "part").selectExpr("concat('V', p_partkey % 700) AS name"))


@query("""WITH u AS (SELECT 'V' || (l_partkey % 500) AS name, l_orderkey * 10 + l_linenumber AS seq, l_returnflag = 'R' AS required,
  CASE WHEN l_quantity < 5 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS default_value, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS unit FROM lineitem)
SELECT name, bool_or(required) AS required, arg_min(default_value, seq) FILTER (default_value IS NOT NULL) AS default_value, arg_min(unit, seq) FILTER (unit IS NOT NULL) AS unit, count(*) AS uses FROM u GROUP BY name""")
def env_merge(spark, d):
    return compare.merged_uses(a.table(spark, d, "lineitem").selectExpr("concat('V', l_partkey % 500) AS name", "l_orderkey * 10 + l_linenumber AS seq", "l_returnflag = 'R' AS required", "if(l_quantity < 5, cast(cast(l_quantity AS INT) AS STRING), null) AS default_value", "if(l_linestatus = 'F', l_returnflag, null) AS unit"))


@query(f"WITH {RS} SELECT 'd' || n_nationkey AS a, 'd' || (n_nationkey + n_regionkey) AS b FROM nation WHERE 'd' || n_nationkey IN (SELECT name FROM r WHERE status <> 'SKIPPED') AND 'd' || (n_nationkey + n_regionkey) IN (SELECT name FROM r WHERE status <> 'SKIPPED')")
def contradictory_checks(spark, d):
    pairs = a.table(spark, d, "nation").selectExpr("concat('d', n_nationkey) AS a", "concat('d', n_nationkey + n_regionkey) AS b")
    return compare.both_enabled(a.results(spark, d).where("status <> 'SKIPPED'"), pairs)


@query("""WITH c AS (SELECT 'fn' || (l_suppkey % 40) AS fn, l_orderkey * 10 + l_linenumber AS case_no, round(l_extendedprice * (1 - l_discount), 2) AS old,
  round(CASE WHEN l_discount = 0.1 THEN NULL WHEN l_suppkey % 4 = 0 AND l_tax > 0.07 THEN l_extendedprice ELSE l_extendedprice * (1 - l_discount) END, 2) AS new FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY case_no) AS nth FROM c), x AS (SELECT * FROM n WHERE nth <= 256 AND old IS DISTINCT FROM new)
SELECT fn, count(*) AS differences, min(case_no) AS case_no, arg_min(old, case_no) AS old, (arg_min(struct_pack(v := new), case_no)).v AS new FROM x GROUP BY fn""")
def version_diff(spark, d):
    return compare.first_differences(a.table(spark, d, "lineitem").selectExpr(
        "concat('fn', l_suppkey % 40) AS fn", "l_orderkey * 10 + l_linenumber AS case_no", "round(l_extendedprice * (1 - l_discount), 2) AS old",
        "round(CASE WHEN l_discount = 0.1 THEN NULL WHEN l_suppkey % 4 = 0 AND l_tax > 0.07 THEN l_extendedprice ELSE l_extendedprice * (1 - l_discount) END, 2) AS new",
    ))


@query("""WITH f AS (SELECT 'm' || (p_size % 10) AS module, 'g' || (p_partkey // 2 % 300) || CASE WHEN p_partkey % 2 = 0 THEN '_reference' ELSE '_optimized' END AS name, p_brand AS args, p_partkey AS seq FROM part),
l AS (SELECT module, name, arg_max(args, seq) AS args FROM f GROUP BY 1, 2)
SELECT x.module, replace(x.name, '_reference', '') AS base FROM l x JOIN l y ON x.module = y.module AND x.name LIKE '%\\_reference' ESCAPE '\\' AND y.name = replace(x.name, '_reference', '_optimized') AND x.args = y.args""")
def reference_pairs(spark, d):
    return compare.same_signature_pairs(a.table(spark, d, "part").selectExpr("concat('m', p_size % 10) AS module", "concat('g', p_partkey div 2 % 300, if(p_partkey % 2 = 0, '_reference', '_optimized')) AS name", "p_brand AS args", "p_partkey AS seq"))


_NAMES = "n AS (SELECT DISTINCT 'o' || (l_suppkey % 50) AS owner, ['encode', 'decode', 'open', 'close', 'run'][l_linenumber % 5 + 1] || '_' || (l_partkey % 400) AS name FROM lineitem)"


@query(f"""WITH {_NAMES}, w AS (SELECT *, CASE split_part(name, '_', 1) WHEN 'encode' THEN 'decode' WHEN 'decode' THEN 'encode' WHEN 'open' THEN 'close' WHEN 'close' THEN 'open' END || '_' || split_part(name, '_', 2) AS other FROM n)
SELECT w.owner, w.name, n.name AS partner FROM w LEFT JOIN n ON n.owner = w.owner AND n.name = w.other WHERE other IS NOT NULL""")
def naming_pairs(spark, d):
    names = a.table(spark, d, "lineitem").selectExpr("concat('o', l_suppkey % 50) AS owner", "concat(element_at(array('encode', 'decode', 'open', 'close', 'run'), cast(l_linenumber % 5 + 1 AS INT)), '_', l_partkey % 400) AS name")
    return compare.inverse_pairs(names, {"encode": "decode", "decode": "encode", "open": "close", "close": "open"})


@query(f"WITH {RS} SELECT name, CASE WHEN name = 'd4' AND status = 'PASS' THEN 'ERROR' ELSE status END AS status, CASE WHEN name = 'd4' THEN concat_ws('; ', command, 'd3 failed') ELSE command END AS note FROM r")
def provider_reconcile(spark, d):
    return compare.reconciled(a.results(spark, d).select("name", "status", F.col("command").alias("note")), "d3", "d4")


@query("""WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_suppkey AS callee, l_linenumber % 3 AS position, l_returnflag AS unit, 1 - l_tax AS confidence FROM lineitem),
c AS (SELECT s_suppkey AS callee, s_nationkey % 3 AS position, ['A', 'N', 'R'][s_nationkey % 3 + 1] AS wanted FROM supplier)
SELECT site, g.callee, CAST(g.position AS INTEGER) AS position, unit, wanted, CASE WHEN confidence >= 0.9 THEN 'error' ELSE 'warning' END AS severity FROM g JOIN c ON g.callee = c.callee AND g.position = c.position WHERE unit <> wanted""")
def contract_clash(spark, d):
    arguments = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS site", "l_suppkey AS callee", "cast(l_linenumber % 3 AS INT) AS position", "l_returnflag AS unit", "1 - l_tax AS confidence")
    contracts = a.table(spark, d, "supplier").selectExpr("s_suppkey AS callee", "cast(s_nationkey % 3 AS INT) AS position", "element_at(array('A', 'N', 'R'), s_nationkey % 3 + 1) AS unit")
    return compare.contract_clashes(arguments, contracts)


# ---------------------------------------------------------------- names and paths


@query(r"""WITH n AS (SELECT DISTINCT 'field' || (p_size % 9) || ['_ms', '_seconds', '_bytes', '_percent', '_port', '_name', '_s'][p_partkey % 7 + 1] AS name FROM part)
SELECT name, CASE WHEN name LIKE '%\_ms' ESCAPE '\' THEN 'milliseconds' WHEN name LIKE '%\_s' ESCAPE '\' OR name LIKE '%\_seconds' ESCAPE '\' THEN 'seconds' WHEN name LIKE '%\_bytes' ESCAPE '\' THEN 'bytes'
  WHEN name LIKE '%\_percent' ESCAPE '\' THEN 'percent' WHEN name LIKE '%\_port' ESCAPE '\' THEN 'TCP/UDP port' END AS unit FROM n""")
def name_units(spark, d):
    names = a.table(spark, d, "part").selectExpr("concat('field', p_size % 9, element_at(array('_ms', '_seconds', '_bytes', '_percent', '_port', '_name', '_s'), cast(p_partkey % 7 + 1 AS INT))) AS name").distinct()
    return names.select("name", fx.unit_of(F.col("name")).alias("unit"))


@query("SELECT page_id, regexp_replace(regexp_replace(CASE page_id % 3 WHEN 0 THEN './' || '././' || url WHEN 1 THEN 'file:///work/tree/' || url ELSE url END, '^file:///work/tree/', ''), '^(\\./)+', '') AS path FROM pages")
def canonical_path(spark, d):
    raw = F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("./././"), "url")).when(F.expr("page_id % 3 = 1"), F.concat(F.lit("file:///work/tree/"), "url")).otherwise(F.col("url"))
    return a.table(spark, d, "pages").select("page_id", fx.plain_path(raw, "/work/tree").alias("path"))


# ---------------------------------------------------------------- ingest


_LINES = r"""x AS (SELECT doc_id AS run, doc_id % 4 AS exit_code, source AS tool, unnest(string_split(text || chr(10) || 'src/a' || doc_id || '.py:' || (doc_id % 90) || ':3: warning: odd thing [E' || (doc_id % 7) || ']' || chr(10), chr(10))) AS raw,
  generate_subscripts(string_split(text || chr(10) || 'src/a' || doc_id || '.py:' || (doc_id % 90) || ':3: warning: odd thing [E' || (doc_id % 7) || ']' || chr(10), chr(10)), 1) - 1 AS pos FROM documents),
y AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s, regexp_extract(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '(?i)^(.+?):(\d+):(\d+):\s*(?:(error|warning|note):\s*)?(.+)$', ['p', 'l', 'c', 'v', 'm']) AS h FROM x WHERE exit_code <> 0)"""


@query(f"""WITH {_LINES}
SELECT run, CAST(pos AS INTEGER) AS pos, tool, h.p AS path, CAST(h.l AS INTEGER) AS line, CAST(h.c AS INTEGER) AS "column", nullif(regexp_extract(h.m, '\\s+\\[([A-Za-z0-9_.-]+)\\]$', 1), '') AS code,
       regexp_replace(h.m, '\\s+\\[([A-Za-z0-9_.-]+)\\]$', '') AS message, lower(coalesce(nullif(h.v, ''), 'error')) AS severity FROM y WHERE h.p <> ''""")
def text_findings(spark, d):
    runs = a.raw_runs(spark, d).withColumn("stdout", F.concat("stdout", F.expr(r"concat('\nsrc/a', run, '.py:', run % 90, ':3: warning: odd thing [E', run % 7, ']')"))).withColumn("stderr", F.lit(""))
    return parsers.parse(runs, "text").select("run", "pos", "tool", "path", "line", "column", "code", "message", "severity")


_RUFF_STYLE = "regexp_matches(p_brand, '^(D|COM|Q|I|N|PTH|T20|TD|FIX|ERA|EM)') OR p_brand IN ('E501', 'W505')"


@query("""WITH i AS (SELECT o_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'm' || l_suppkey || '.py', ['F401', 'D100', 'E501', 'PTH12', 'B008'][l_partkey % 5 + 1], l_returnflag = 'R') - 1 AS pos, 'm' || l_suppkey || '.py' AS path, CAST(l_linenumber AS INTEGER) AS line, ['F401', 'D100', 'E501', 'PTH12', 'B008'][l_partkey % 5 + 1] AS code, l_returnflag = 'R' AS fixable FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT run, CAST(pos AS INTEGER) AS pos, path, line, code, 'found ' || code AS message, CASE WHEN code IN ('D100', 'E501', 'PTH12') THEN 'note' ELSE 'error' END AS severity, fixable, CASE WHEN fixable THEN 'safe' END AS fix_safety FROM i""")
def ruff_findings(spark, d):
    li = a.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS run", "l_linenumber AS n", "concat('m', l_suppkey, '.py') AS filename", "element_at(array('F401', 'D100', 'E501', 'PTH12', 'B008'), cast(l_partkey % 5 + 1 AS INT)) AS code", "if(l_returnflag = 'R', named_struct('applicability', 'Safe', 'message', 'fix it'), null) AS fix"
    )
    item = F.struct("n", "filename", "code", F.concat(F.lit("found "), "code").alias("message"), F.struct(F.col("n").cast("int").alias("row"), F.lit(1).alias("column")).alias("location"), "fix")
    runs = li.groupBy("run").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("stdout"))
    runs = runs.select("run", F.lit("ruff").alias("tool"), F.lit(1).alias("exit_code"), "stdout", F.lit("").alias("stderr"))
    return parsers.parse(runs, "ruff").select("run", "pos", "path", "line", "code", "message", "severity", "fixable", "fix_safety")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events")
def json_properties(spark, d):
    parsed = F.from_json("props", "map<string,string>")
    return a.table(spark, d, "events").select("event_id", F.element_at(F.map_values(parsed), 1).alias("first_value"))


@query(f"""WITH {a.FILES_SQL}, c AS (SELECT path, unnest(list_filter([
  CASE WHEN regexp_matches(path, '/en/') THEN 'english' END, CASE WHEN contains(head, '<script>') THEN 'javascript' END, CASE WHEN size < 2000 THEN 'small' END, CASE WHEN contains(path, '?') THEN 'query' END], lambda x: x IS NOT NULL)) AS capability FROM p)
SELECT capability, count(*) AS files, list_sort(list(DISTINCT path))[1:100] AS evidence FROM c GROUP BY capability""")
def tech_inventory(spark, d):
    from siftspark.sources import inventory

    rules = {"english": F.contains("path", F.lit("/en/")), "javascript": F.contains("head", F.lit("<script>")), "small": F.col("size") < 2000, "query": F.contains("path", F.lit("?"))}
    return inventory.classify(a.files(spark, d), rules)


@query(f"""WITH {a.FILES_SQL}, g AS (SELECT split_part(path, '/', 1) AS host, bool_or(contains(lower(head), 'tion')) AS a, bool_or(contains(lower(head), 'ment')) AS b FROM p GROUP BY 1)
SELECT host, CASE WHEN b THEN 'mysql' WHEN a THEN 'postgres' ELSE 'ansi' END AS dialect FROM g""")
def dialect_inference(spark, d):
    from siftspark.sources import inventory

    rows = a.files(spark, d).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("host"), F.col("head").alias("text"))
    return inventory.first_dialect(rows, "host", (("mysql", ("ment",)), ("postgres", ("tion",))))


@query("""SELECT 'K' || (p_partkey % 100) AS name, arg_max(p_brand, p_partkey) AS value FROM part WHERE p_size % 3 <> 0 GROUP BY 1""")
def env_file(spark, d):
    from siftspark.sources import inventory

    line = F.when(F.expr("p_size % 3 = 0"), F.concat(F.lit("# K"), F.col("p_partkey").cast("string"), F.lit("=off"))).otherwise(F.concat(F.lit(" K"), F.expr("p_partkey % 100").cast("string"), F.lit(" = \""), "p_brand", F.lit("\" ")))
    return inventory.env_values(a.table(spark, d, "part").select(F.lit(".env").alias("path"), F.col("p_partkey").alias("line"), line.alias("raw"))).select("name", "value")


# ---------------------------------------------------------------- status, streams


@query("""WITH r AS (SELECT doc_id, doc_id % 4 AS c, contains(text, 'tion') AS crash, contains(text, 'Qu') AS empty, doc_id % 3 AS n FROM documents)
SELECT doc_id AS name, CASE WHEN doc_id % 11 = 0 THEN 'ERROR' WHEN c = 1 AND crash THEN 'ERROR' WHEN n = 0 AND empty THEN 'SKIPPED' WHEN c = 0 THEN CASE WHEN n > 0 THEN 'FINDINGS' ELSE 'PASS' END
  WHEN c = 1 THEN 'FINDINGS' WHEN c = 2 THEN 'SKIPPED' ELSE 'ERROR' END AS status, doc_id % 11 <> 0 AND c = 1 AND crash AS findings_dropped,
  doc_id % 11 <> 0 AND c = 1 AND NOT crash AND n = 0 AND NOT (n = 0 AND empty) AS made_up FROM r""")
def status_lattice(spark, d):
    runs = a.table(spark, d, "documents").selectExpr("doc_id AS name", "cast(doc_id % 4 AS INT) AS exit_code", "coalesce(text, '') AS stdout", "'' AS stderr", "doc_id % 11 = 0 AS timed_out", "doc_id % 3 AS n_findings", "cast(null AS STRING) AS parse_error", "array(1) AS findings_exit_codes", "array(2) AS skip_exit_codes", "array('tion') AS error_markers", "array('Qu') AS empty_scope_markers")
    return lattice.status(runs).select("name", "status", "findings_dropped", "made_up")


@query(f"WITH {FS} SELECT path AS result_name, substr(arg_min(path || CASE WHEN line <> 0 THEN ':' || line ELSE '' END || ' — ' || message, seq), 1, 500) AS note FROM f GROUP BY path")
def first_note(spark, d):
    return lattice.first_note(a.findings(spark, d).withColumn("result_name", F.col("path")))


@query(f"WITH {RS} SELECT max(CASE status WHEN 'ERROR' THEN 2 WHEN 'FINDINGS' THEN 1 ELSE 0 END) AS exit_code FROM r")
def exit_code(spark, d):
    return lattice.exit_code(a.results(spark, d))


@query("SELECT time_bucket(INTERVAL 60 SECOND, ts) AS beat, event_type AS name, count(*) AS lines, max(ts) AS last_activity FROM events GROUP BY 1, 2")
def heartbeat_windows(spark, d):
    events = a.table(spark, d, "events").select("ts", F.col("event_type").alias("name"))
    return live.heartbeats(events)


@query("SELECT 'u' || user_id AS name, min(ts) AS started, max(ts) AS last_activity, count(*) AS lines, (max(struct_pack(t := ts, l := event_type))).l AS last_line FROM events GROUP BY 1")
def run_progress(spark, d):
    return live.progress(a.table(spark, d, "events").select(F.expr("concat('u', user_id)").alias("name"), "ts", F.col("event_type").alias("line")))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
SELECT user_id AS name, CASE WHEN epoch_us(now) - epoch_us(a) >= 0.9 * 2500000 * 1000000.0 THEN 'near timeout' WHEN epoch_us(now) - epoch_us(z) >= 120 * 1000000 THEN 'quiet' WHEN epoch_us(now) - epoch_us(z) >= 30 * 1000000 THEN 'slowing' ELSE 'active' END AS liveness FROM s, n""")
def liveness_class(spark, d):
    events = a.table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    rows = events.groupBy(F.col("user_id").alias("name")).agg(F.min("ts").alias("a"), F.max("ts").alias("z")).crossJoin(F.broadcast(now))
    return rows.select("name", live.liveness(F.col("now"), F.col("a"), F.col("z"), F.lit(2_500_000)).alias("liveness"))


@query(f"WITH {RS} SELECT DISTINCT name, 'ERROR' AS status, 'stopped before it finished' AS note FROM r WHERE name NOT IN (SELECT name FROM r WHERE status IN ('PASS', 'FINDINGS'))")
def interrupted_checks(spark, d):
    r = a.results(spark, d)
    return live.interrupted(r, r.where("status IN ('PASS', 'FINDINGS')")).distinct()


# ---------------------------------------------------------------- facts about values


def _dims(d, spark) -> DataFrame:
    """Line items as values with a dimension over three axes, made from their columns."""
    power = lambda c, k: F.expr(f"cast({c} % {k} AS INT) - 1")
    full = F.create_map(F.lit("length"), power("l_partkey", 3), F.lit("mass"), power("l_suppkey", 3), F.lit("time"), power("l_linenumber", 3))
    return a.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey", F.map_filter(full, lambda _, v: v != 0).alias("a"), F.create_map(F.lit("time"), F.lit(1)).alias("b"))


_AXES = "CAST(l_partkey % 3 AS INTEGER) - 1 AS x, CAST(l_suppkey % 3 AS INTEGER) - 1 AS y, CAST(l_linenumber % 3 AS INTEGER) - 1 AS z"
_TEXT = lambda x, y, z: f"array_to_string(list_filter([CASE WHEN {x} <> 0 THEN 'length:' || ({x}) END, CASE WHEN {y} <> 0 THEN 'mass:' || ({y}) END, CASE WHEN {z} <> 0 THEN 'time:' || ({z}) END], lambda v: v IS NOT NULL), ',')"


@query(f"""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_AXES} FROM lineitem)
SELECT id, {_TEXT('x', 'y', 'z')} AS own, {_TEXT('x', 'y', 'z + 1')} AS times, {_TEXT('x', 'y', 'z - 1')} AS per, (x = 0 AND y = 0 AND z IN (0, 1)) AS compatible FROM v""")
def dimension_algebra(spark, d):
    from siftspark.functions import semantic as sem

    v = _dims(d, spark)
    p, q = F.col("a"), F.col("b")
    return v.select("id", sem.dimension_text(p).alias("own"), sem.dimension_text(sem.product(p, q)).alias("times"), sem.dimension_text(sem.quotient(p, q)).alias("per"), sem.compatible(p, q).alias("compatible"))


_DT = "['int8', 'uint8', 'int32', 'uint32', 'int64', 'uint64', 'float32', 'float64']"
_W = lambda c: f"CAST(regexp_extract({c}, '[0-9]+') AS INTEGER)"


@query(f"""WITH v AS (SELECT DISTINCT {_DT}[l_partkey % 8 + 1] AS source, {_DT}[l_suppkey % 8 + 1] AS target FROM lineitem)
SELECT source, target, source <> target AND CASE WHEN source LIKE 'float%' AND target NOT LIKE 'float%' THEN true WHEN source LIKE 'float%' THEN {_W('target')} < {_W('source')}
  WHEN target LIKE 'float%' THEN false ELSE {_W('target')} < {_W('source')} OR (source LIKE 'uint%' AND target LIKE 'int%' AND {_W('target')} <= {_W('source')}) END AS narrows,
  source <> target AND ((source LIKE 'float%') <> (target LIKE 'float%') OR (source = 'uint64' AND (target LIKE 'int%' OR target LIKE 'float%')) OR (target = 'uint64' AND (source LIKE 'int%' OR source LIKE 'float%'))) AS risky FROM v""")
def dtype_rules(spark, d):
    from siftspark.functions import semantic as sem

    names = "array('int8', 'uint8', 'int32', 'uint32', 'int64', 'uint64', 'float32', 'float64')"
    v = a.table(spark, d, "lineitem").selectExpr(f"concat('np.', element_at({names}, cast(l_partkey % 8 + 1 AS INT))) AS s", f"element_at({names}, cast(l_suppkey % 8 + 1 AS INT)) AS t").distinct()
    v = v.select(sem.dtype_name(F.col("s")).alias("source"), sem.dtype_name(F.col("t")).alias("target"))
    return v.select("source", "target", sem.narrower(F.col("source"), F.col("target")).alias("narrows"), sem.promotion_risk(F.col("source"), F.col("target")).alias("risky"))


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, round(1 - 6 * l_tax, 6) AS c, CASE l_linenumber % 3 WHEN 0 THEN 'name:x' WHEN 1 THEN 'name:x+schema:y' ELSE 'flow/guess+name' END AS p, l_linenumber % 3 = 1 AS two FROM lineitem)
SELECT id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS sources, c >= 0.7 OR (c >= 0.45 AND two) AS reportable, CASE WHEN c >= 0.9 THEN 'error' ELSE 'warning' END AS severity FROM v""")
def evidence_gate(spark, d):
    from siftspark.functions import semantic as sem

    v = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "round(1 - 6 * l_tax, 6) AS c", "CASE l_linenumber % 3 WHEN 0 THEN 'name:x' WHEN 1 THEN 'name:x+schema:y' ELSE 'flow/guess+name' END AS p")
    return v.select("id", sem.source_count(F.col("p")).alias("sources"), sem.reportable(F.col("c"), F.col("p")).alias("reportable"), sem.severity(F.col("c")).alias("severity"))


# ---------------------------------------------------------------- rules over source code


def _rules(name: str, *prefixes: str) -> None:
    def found(spark, d):
        from siftspark.operators import rules
        from siftspark.sources import syntax

        codes = [c for c in rules.RULES if c.startswith(prefixes) and c not in rules.PROJECT_RULES]
        return rules.run(syntax.nodes(rule_sources.sources(a.table(spark, d, "part"))), codes).select("code", "path", "line", "severity")

    QUERIES[name], ORACLES[name] = found, rule_sources.findings_sql(*prefixes)


for _name, _prefixes in {
    "protocol_rules": ("BHPRT",),
    "policy_rules": ("BHCTRL", "BHCFG", "BHPERS", "BHARCH", "BHIMPL"),
    "unit_rules": ("BHUNIT", "BHCX"),
    "test_rules": ("BHTEST",),
    "seam_rules": ("BHSEAM", "BHDB", "BHEVID"),
    "data_rules": ("BHMISS", "BHMETA", "BHDF", "BHINT", "BHART", "BHTIME"),
}.items():
    _rules(_name, *_prefixes)


@query("""WITH p AS (SELECT 'src/t' || p_partkey || '.py' AS path FROM part)
SELECT code, (SELECT min(path) FROM p) AS path, CAST(line AS INTEGER) AS line, 'warning' AS severity, (SELECT count(*) FROM p) || message AS message
FROM (VALUES ('BHTIME001', 1, ' wall-clock calls, none under control in tests'), ('BHSEAM006', 2, ' HTTP calls without recorded payloads in tests')) v(code, line, message)""")
def project_rules(spark, d):
    from siftspark.operators import rules
    from siftspark.sources import syntax

    key = F.col("p_partkey").cast("string")
    made = a.table(spark, d, "part").select(F.concat(F.lit("src/t"), key, F.lit(".py")).alias("path"), F.concat(F.lit("t = time.time()\nrequests.get(u"), key, F.lit(")\n")).alias("source"))
    return rules.run(syntax.nodes(made), list(rules.PROJECT_RULES))


@query("""WITH p AS (SELECT 'gen/p' || p_partkey || '.py' AS path, p_size, p_partkey FROM part)
SELECT 'BHCTRL001' AS code, path, CAST(5 AS INTEGER) AS line, 'error' AS severity FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 'BHUNIT001', path, 6, 'warning' FROM p WHERE p_size % 2 = 0
UNION ALL SELECT 'BHDB001', path, 9, 'warning' FROM p WHERE p_partkey % 5 = 1""")
def syntax_rules(spark, d):
    """Sources made from the parts table, one a part, read by the node table and its rules."""
    from siftspark.operators import rules
    from siftspark.sources import syntax

    source = F.concat_ws(
        "\n",
        F.lit("def f(ids):"),
        F.lit("    try:"),
        F.lit("        g()"),
        F.lit("    finally:"),
        F.when(F.expr("p_partkey % 3 = 0"), "        return 1").otherwise("        h()"),
        F.when(F.expr("p_size % 2 = 0"), F.concat(F.lit("wait_ms = "), F.col("p_size").cast("string"))).otherwise("wait = f(1)"),
        F.lit("def k(items, cur, q):"),
        F.when(F.expr("p_partkey % 5 = 1"), "    for i in items:").otherwise("    if items:"),
        F.lit("        cur.execute(q, wait)"),
    )
    nodes = syntax.nodes(a.table(spark, d, "part").select(F.concat(F.lit("gen/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), source.alias("source")))
    return rules.run(nodes, ["BHCTRL001", "BHUNIT001", "BHDB001"]).select("code", "path", "line", "severity")


def _parser(name: str) -> None:
    def found(spark, d):
        made = parser_runs.runs(a.table(spark, d, "part"), name)
        return parsers.parse(made, name).select(*parser_runs.OUTPUT)

    key = "parse_" + name.replace("-", "_")
    QUERIES[key], ORACLES[key] = found, parser_runs.findings_sql(name)


for _name in parser_runs.SAMPLES:
    _parser(_name)


# ---------------------------------------------------------------- further joins and aggregates


@query("""WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_suppkey % 40 AS callee, CAST(l_linenumber % 4 AS INTEGER) AS position, CASE WHEN l_returnflag = 'R' THEN 'p' || (l_partkey % 9) END AS keyword FROM lineitem),
q AS (SELECT DISTINCT s_suppkey % 40 AS callee, CAST(s_nationkey % 4 AS INTEGER) AS position, 'p' || (s_suppkey % 9) AS name FROM supplier)
SELECT site, g.callee, g.position, name FROM g JOIN q ON g.callee = q.callee AND ((keyword IS NULL AND g.position = q.position) OR keyword = q.name)""")
def argument_bindings(spark, d):
    arguments = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS site", "l_suppkey % 40 AS callee", "cast(l_linenumber % 4 AS INT) AS position", "if(l_returnflag = 'R', concat('p', l_partkey % 9), null) AS keyword")
    parameters = a.table(spark, d, "supplier").selectExpr("s_suppkey % 40 AS callee", "cast(s_nationkey % 4 AS INT) AS position", "concat('p', s_suppkey % 9) AS name").distinct()
    return compare.argument_bindings(arguments, parameters)


@query("""WITH p AS (SELECT DISTINCT 'f' || (l_suppkey % 50) AS name, 't' || (l_suppkey % 10) AS terminal, 'k' || (l_partkey % 30) AS key FROM lineitem),
t AS (SELECT DISTINCT 't' || (s_suppkey % 7) AS terminal, 'k' || (s_suppkey % 30) AS key FROM supplier)
SELECT name, terminal, key FROM p WHERE terminal IN (SELECT terminal FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.terminal = p.terminal AND t.key = p.key)""")
def forwarding_mismatch(spark, d):
    li = a.table(spark, d, "lineitem")
    forwards = li.selectExpr("concat('f', l_suppkey % 50) AS name", "concat('t', l_suppkey % 10) AS terminal").distinct()
    accepted = a.table(spark, d, "supplier").selectExpr("concat('t', s_suppkey % 7) AS terminal", "concat('k', s_suppkey % 30) AS key")
    return compare.rejected_forwards(forwards, li.selectExpr("concat('f', l_suppkey % 50) AS name", "concat('k', l_partkey % 30) AS key"), accepted)


@query("""WITH c AS (SELECT DISTINCT o_orderkey AS test, 'n' || (l_partkey % 60) AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT 'n' || x AS a, 'n' || (x + 1) AS b FROM (SELECT DISTINCT p_partkey % 80 AS x FROM part))
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM c x JOIN c y ON x.test = y.test WHERE x.name = a AND y.name = b)""")
def uncovered_pairs(spark, d):
    calls = a.table(spark, d, "lineitem").selectExpr("l_orderkey AS test", "concat('n', l_partkey % 60) AS name")
    pairs = a.table(spark, d, "part").selectExpr("p_partkey % 80 AS x").distinct().selectExpr("concat('n', x) AS a", "concat('n', x + 1) AS b")
    return compare.uncovered_pairs(pairs, calls)


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS word FROM documents WHERE regexp_matches(text, 'that')), n AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS word FROM benchmark)
SELECT word AS boundary FROM n WHERE word NOT IN (SELECT word FROM w)""")
def untested_boundaries(spark, d):
    words = a.table(spark, d, "benchmark").select(F.explode(F.split("text", r"\W+")).alias("boundary"))
    return compare.untested_boundaries(words, a.table(spark, d, "documents").select(F.col("text").alias("body")), "that")


@query("""WITH s AS (SELECT 'v' || o_custkey AS variable, o_orderstatus AS place, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS accepted FROM orders GROUP BY 1, 2)
SELECT variable, count(DISTINCT accepted) AS variants, count(*) AS places FROM s GROUP BY variable HAVING count(DISTINCT accepted) > 1""")
def predicate_consistency(spark, d):
    return compare.inconsistent_predicates(a.table(spark, d, "orders").selectExpr("concat('v', o_custkey) AS variable", "o_orderstatus AS place", "o_orderpriority AS value"))


@query("""WITH f AS (SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS root, url || CASE WHEN page_id % 2 = 0 THEN '.js' ELSE '.css' END AS path, length(html) AS bytes FROM pages)
SELECT 'BHCX005' AS code, path, round(bytes / 1024, 1) AS kib FROM f WHERE bytes / 1024 > CASE WHEN path LIKE '%.js' THEN 3.0 ELSE 5.0 END
UNION ALL SELECT 'BHCX006', root, round(sum(bytes) / 1024, 1) FROM f GROUP BY root HAVING sum(bytes) / 1024 > 20""")
def asset_budgets(spark, d):
    assets = a.table(spark, d, "pages").select(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)).alias("root"), F.concat("url", F.expr("if(page_id % 2 = 0, '.js', '.css')")).alias("path"), F.length("html").alias("bytes"))
    return report.asset_budgets(assets, {".js": 3.0, ".css": 5.0}, 20)


@query(f"WITH {FS} SELECT (min(struct_pack(p := path, l := line))).p AS path, (min(struct_pack(p := path, l := line))).l AS line, count(*) AS sites FROM f WHERE code = 'BHCOV002' HAVING count(*) > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE code = 'BHTIME009')")
def evidence_missing(spark, d):
    rows = a.findings(spark, d)
    return report.missing_evidence(rows.where("code = 'BHCOV002'"), rows.where("code = 'BHTIME009'"))


@query("""WITH c AS (SELECT 'v' || (l_partkey % 100) AS name, l_linenumber || ' < ' || CAST(l_quantity AS INTEGER) AS text, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos, text) AS nth FROM c)
SELECT name, string_agg(text, ' and ' ORDER BY nth) AS accepted_range FROM n WHERE nth <= 4 GROUP BY name""")
def numeric_ranges(spark, d):
    return report.numeric_ranges(a.table(spark, d, "lineitem").selectExpr("concat('v', l_partkey % 100) AS name", "l_orderkey * 10 + l_linenumber AS pos", "concat(l_linenumber, ' < ', cast(l_quantity AS INT)) AS text"))


@query("""WITH u AS (SELECT 't' || (s_suppkey % 30) AS name, 0 AS part, s_suppkey AS pos FROM supplier UNION ALL SELECT 't' || (p_partkey % 70), 1, p_partkey FROM part)
SELECT name, (min(struct_pack(a := part, b := pos))).a AS part, (min(struct_pack(a := part, b := pos))).b AS pos FROM u GROUP BY name""")
def profile_tools(spark, d):
    configured = a.table(spark, d, "supplier").selectExpr("concat('t', s_suppkey % 30) AS name", "s_suppkey AS pos")
    return report.first_seen_union(configured, a.table(spark, d, "part").selectExpr("concat('t', p_partkey % 70) AS name", "p_partkey AS pos"))


@query("SELECT doc_id % 5 AS grp, (max(struct_pack(m := n_chars, p := source || '/' || doc_id))).p AS path FROM documents GROUP BY 1")
def latest_report(spark, d):
    from siftspark.sources import inventory

    return inventory.latest(a.table(spark, d, "documents").selectExpr("doc_id % 5 AS grp", "concat(source, '/', doc_id) AS path", "n_chars AS mtime"), "grp")


@query("SELECT url || '#' || page_id AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size, CASE WHEN octet_length(encode(html)) < 3000 THEN substr(html, 1, 64) END AS head FROM pages")
def limited_read(spark, d):
    from siftspark.sources import inventory

    raw = a.table(spark, d, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.octet_length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return inventory.heads(raw, 3000, 64)


@query(f"WITH {RS}, n AS (SELECT * FROM r WHERE seq % 4 = 0) SELECT name, 'PASS' AS status FROM n UNION ALL SELECT name, status FROM r WHERE name NOT IN (SELECT name FROM n)")
def replaced_results(spark, d):
    r = a.results(spark, d)
    return lattice.replaced(r.select("name", "status"), r.where("seq % 4 = 0").select("name", F.lit("PASS").alias("status")))


@query(f"WITH {RS} SELECT name, CASE WHEN seq % 3 = 0 THEN 'N/A' WHEN seq % 7 = 0 THEN 'SKIPPED' ELSE 'PLANNED' END AS status FROM r WHERE name LIKE 'd%'")
def registration(spark, d):
    r = a.results(spark, d)
    checks = r.select("name", (F.col("seq") % 3 == 0).alias("python_only"), F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("command")).alias("command"))
    return lattice.registered(checks, r.where("name LIKE 'd%'"), has_python=False)


@query(f"WITH {RS} SELECT name, status FROM r UNION ALL SELECT 'install:' || name, status FROM r WHERE status = 'ERROR'")
def failed_installs(spark, d):
    r = a.results(spark, d)
    return lattice.with_failed_installs(r, r)


@query("SELECT event_id AS name, ts AS ended FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def recent_completions(spark, d):
    return live.recent(a.table(spark, d, "events").select(F.col("event_id").alias("name"), F.col("ts").alias("ended")))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 AND event_id % 2 = 1 THEN 'ERROR' WHEN event_id % 3 > 0 THEN 'FINDINGS' ELSE 'PASS' END AS status FROM events")
def timeout_outcome(spark, d):
    return a.table(spark, d, "events").select("event_id", live.outcome(F.expr("event_id % 9 = 0"), F.expr("event_id % 2 = 0"), F.expr("event_id % 3")).alias("status"))


@query("SELECT page_id, regexp_matches('http://' || CASE WHEN page_id % 3 = 0 THEN 'localhost:80/' WHEN page_id % 3 = 1 THEN '127.0.0.1' ELSE '' END || url, '^https?://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|\\[::1\\])(:\\d+)?(/|$)') AS local FROM pages")
def local_urls(spark, d):
    url = F.concat(F.lit("http://"), F.expr("CASE WHEN page_id % 3 = 0 THEN 'localhost:80/' WHEN page_id % 3 = 1 THEN '127.0.0.1' ELSE '' END"), "url")
    return a.table(spark, d, "pages").select("page_id", fx.is_local_url(url).alias("local"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || (l_suppkey % 30) AS path, 'f' || (l_partkey % 50) AS function, round(1 - 4 * l_discount, 6) AS confidence FROM lineitem),
w AS (SELECT DISTINCT 'p' || (p_size % 30) AS path, 'f' || (p_partkey % 50) AS function FROM part)
SELECT id, c.path, c.function, CASE WHEN w.path IS NOT NULL THEN greatest(confidence, 0.9) ELSE confidence END AS confidence, w.path IS NOT NULL AS witnessed FROM c LEFT JOIN w ON w.path = c.path AND w.function = c.function""")
def witness_upgrade(spark, d):
    rows = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "concat('p', l_suppkey % 30) AS path", "concat('f', l_partkey % 50) AS function", "round(1 - 4 * l_discount, 6) AS confidence")
    seen = a.table(spark, d, "part").selectExpr("concat('p', p_size % 30) AS path", "concat('f', p_partkey % 50) AS function")
    return compare.witnessed(rows, seen).select("id", "path", "function", "confidence", "witnessed")


@query(f"WITH {a.OPS_SQL} SELECT key AS scope, name, min(pos) AS pos FROM o u WHERE op = 'view' AND NOT EXISTS (SELECT 1 FROM o g WHERE g.key = u.key AND g.name = u.name AND g.op = 'click' AND g.pos <= u.pos) GROUP BY 1, 2")
def nullable_dereference(spark, d):
    ops = a.operations(spark, d).withColumnRenamed("key", "scope")
    return compare.unguarded_uses(ops.where("op = 'view'"), ops.where("op = 'click'"))


@query("""WITH n AS (SELECT p_partkey, ['load', '_load', 'fast_load', 'load_fast_all', 'import'][p_partkey % 5 + 1] AS name, CAST(p_size % 2 AS INTEGER) * 4 AS col, CASE WHEN p_size % 3 = 0 THEN 'tests/a.py' ELSE 'src/a.py' END AS path FROM part)
SELECT p_partkey, name NOT LIKE '\\_%' ESCAPE '\\' AND col = 0 AND path LIKE 'src/%' AS public, CASE name WHEN 'fast_load' THEN 'load' WHEN 'load_fast_all' THEN 'load_all' END AS plain,
       CASE name WHEN 'load' THEN 'dump' WHEN '_load' THEN '_dump' WHEN 'fast_load' THEN 'fast_dump' WHEN 'load_fast_all' THEN 'dump_fast_all' END AS inverse FROM n""")
def naming_variants(spark, d):
    n = a.table(spark, d, "part").selectExpr("p_partkey", "element_at(array('load', '_load', 'fast_load', 'load_fast_all', 'import'), cast(p_partkey % 5 + 1 AS INT)) AS name", "cast(p_size % 2 AS INT) * 4 AS col", "if(p_size % 3 = 0, 'tests/a.py', 'src/a.py') AS path")
    return n.select("p_partkey", fx.is_public(F.col("name"), F.col("col"), F.col("path")).alias("public"), fx.name_without(F.col("name"), "fast").alias("plain"), fx.name_with_swapped(F.col("name"), "load", "dump").alias("inverse"))


# ---------------------------------------------------------------- settings, coverage reports, meanings


_ENV = """v AS (SELECT p_partkey AS line, ['API_KEY', 'DB_PASSWORD', 'timeout', 'AUTH_TOKEN'][p_partkey % 4 + 1] AS name, p_size % 6 AS k FROM part)"""


@query(f"WITH {_ENV} SELECT name, '.env.example' AS path, CAST(line AS INTEGER) AS line FROM v WHERE k = 1 OR k = 2 AND name <> 'timeout'")
def secret_values(spark, d):
    """Only token shapes, and long plain values under names of secrets, look live."""
    shown = "element_at(array('changeme', concat('sk-abcdefghijkl', p_partkey), concat('longplainvalue', lpad(p_partkey, 6, '0')), concat('$', '{HOME}/long/plain/value'), 'test_abcdefghijklmnopq', 'short'), cast(p_size % 6 AS INT) + 1)"
    v = a.table(spark, d, "part").selectExpr("cast(p_partkey AS INT) AS line", "element_at(array('API_KEY', 'DB_PASSWORD', 'timeout', 'AUTH_TOKEN'), cast(p_partkey % 4 AS INT) + 1) AS name", f"{shown} AS value")
    return v.where(fx.looks_secret(F.col("name"), F.col("value"))).select("name", F.lit(".env.example").alias("path"), "line")


def _coverage_reports(spark, d):
    """A coverage report for each order: its line items are missing lines and branch edges of one file."""
    li = a.table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("n"), F.expr("cast(l_suppkey % 50 AS INT)").alias("t")).alias("e"))
    edges = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("e"))
    file = F.struct(F.transform("e", lambda x: x.n).alias("missing_lines"), F.transform("e", lambda x: F.array(x.n, x.t)).alias("missing_branches"))
    return edges.select(F.concat(F.lit('{"files": {"src/o'), F.col("l_orderkey").cast("string"), F.lit('.py": '), F.to_json(file), F.lit("}}")).alias("text"))


@query("SELECT 'src/o' || l_orderkey || '.py' AS file, CAST(l_linenumber AS INTEGER) AS line FROM lineitem")
def coverage_json(spark, d):
    from siftspark.sources import inventory

    return inventory.coverage_lines(_coverage_reports(spark, d))


@query("""WITH b AS (SELECT 'src/o' || l_orderkey || '.py' AS file, CAST(l_linenumber AS INTEGER) AS line, CAST(l_suppkey % 50 AS INTEGER) AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 50) AS nth FROM lineitem)
SELECT file, line, target FROM b WHERE nth <= 3""")
def branch_gaps(spark, d):
    from siftspark.sources import inventory

    return ordered.branch_gaps(inventory.coverage_branches(_coverage_reports(spark, d)), 3)


@query("""WITH r AS (SELECT s_suppkey AS run, s_nationkey % 5 = 0 AS failed, s_nationkey % 7 <> 0 AS measured FROM supplier),
g AS (SELECT l_suppkey AS run, 'src/o' || l_orderkey || '.py' AS path, CAST(l_linenumber AS INTEGER) AS line FROM lineitem)
SELECT run, 'BHCOV001' AS code, path, line, 'warning' AS severity, 'never run' AS message FROM g
UNION ALL SELECT run, CASE WHEN measured THEN 'BHCOV003' ELSE 'BHCOV002' END, NULL, NULL, 'error', CASE WHEN measured THEN 'coverage was measured over a failing suite' ELSE 'coverage could not be measured' END FROM r WHERE failed OR NOT measured""")
def measured_coverage(spark, d):
    gaps = a.table(spark, d, "lineitem").selectExpr("l_suppkey AS run", "'BHCOV001' AS code", "concat('src/o', l_orderkey, '.py') AS path", "cast(l_linenumber AS INT) AS line", "'warning' AS severity", "'never run' AS message")
    return emit.measured(gaps, a.table(spark, d, "supplier").selectExpr("s_suppkey AS run", "s_nationkey % 5 = 0 AS suite_failed", "s_nationkey % 7 <> 0 AS measured"))


@query("""WITH u AS (SELECT 'V' || (l_partkey % 500) AS name, 'f' || l_suppkey AS path, CAST(l_linenumber AS INTEGER) AS line FROM lineitem)
SELECT 'BHCFG001' AS code, (min(struct_pack(p := path, l := line))).p AS path, (min(struct_pack(p := path, l := line))).l AS line, 'warning' AS severity, count(DISTINCT name) || ' environment variable(s) are used and there is no .env.example' AS message
FROM u HAVING count(*) > 0 AND NOT EXISTS (SELECT 1 FROM pages WHERE url LIKE '%/.env.example')""")
def missing_example(spark, d):
    uses = a.table(spark, d, "lineitem").selectExpr("concat('V', l_partkey % 500) AS name", "concat('f', l_suppkey) AS path", "cast(l_linenumber AS INT) AS line")
    return emit.missing_example(uses, a.files(spark, d))


_NOMINAL, _FRAME, _SCALE = "[NULL, 'user-id', 'instant', 'duration']", "[NULL, 'world', 'camera']", "['percent', 'fraction', 'ms']"
_PROVEN = "['name:x', 'name:x+schema:y', 'guess']"


def _sparked(values: str) -> str:
    return values.replace("[", "array(").replace("]", ")")


@query(f"""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_suppkey % 40 AS callee, l_linenumber % 3 AS position, {_NOMINAL}[l_partkey % 4 + 1] AS nominal, {_FRAME}[l_suppkey % 3 + 1] AS frame, {_SCALE}[l_orderkey % 3 + 1] AS unit,
    CASE WHEN l_quantity < 25 THEN ['n', CAST(l_linenumber % 3 AS VARCHAR)] END AS shape, {_PROVEN}[l_partkey % 3 + 1] AS provenance, round(1 - 6 * l_tax, 6) AS confidence FROM lineitem),
y AS (SELECT s_suppkey % 40 AS callee, s_nationkey % 3 AS position, {_NOMINAL}[s_suppkey % 4 + 1] AS nominal, {_FRAME}[s_nationkey % 3 + 1] AS frame, {_SCALE}[s_suppkey % 3 + 1] AS unit,
    CASE s_suppkey % 4 WHEN 0 THEN ['?', '1'] WHEN 1 THEN ['n'] END AS shape, {_PROVEN}[s_suppkey % 3 + 1] AS provenance, CAST(0.8 AS DOUBLE) AS confidence FROM supplier),
c AS (SELECT site, least(x.confidence, y.confidence) AS sure, len(list_filter(string_split(x.provenance, '+') || string_split(y.provenance, '+'), lambda t: t <> 'guess')) AS sources, CASE
    WHEN x.nominal <> y.nominal THEN CASE WHEN x.nominal IN ('instant', 'duration') AND y.nominal IN ('instant', 'duration') THEN 'BHSEM002' ELSE 'BHSEM001' END
    WHEN x.frame <> y.frame THEN 'BHSEM008' WHEN x.unit <> y.unit AND x.unit <> 'ms' AND y.unit <> 'ms' THEN 'BHSEM007'
    WHEN len(x.shape) <> len(y.shape) OR x.shape[1] <> y.shape[1] AND x.shape[1] <> '?' AND y.shape[1] <> '?' OR x.shape[2] <> y.shape[2] THEN 'BHSEM006' END AS code FROM x JOIN y USING (callee, position))
SELECT site, code, CASE WHEN sure >= 0.9 THEN 'error' ELSE 'warning' END AS severity FROM c WHERE code IS NOT NULL AND (sure >= 0.7 OR sure >= 0.45 AND sources >= 2)""")
def semantic_clashes(spark, d):
    pick = lambda values, i: f"element_at({_sparked(values)}, cast({i} AS INT) + 1)"
    x = a.table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS site", "l_suppkey % 40 AS callee", "cast(l_linenumber % 3 AS INT) AS position",
        f"named_struct('nominal', {pick(_NOMINAL, 'l_partkey % 4')}, 'frame', {pick(_FRAME, 'l_suppkey % 3')}, 'unit', {pick(_SCALE, 'l_orderkey % 3')}, 'shape', if(l_quantity < 25, array('n', cast(l_linenumber % 3 AS STRING)), null), 'provenance', {pick(_PROVEN, 'l_partkey % 3')}, 'confidence', round(1 - 6 * l_tax, 6)) AS actual",
    )
    y = a.table(spark, d, "supplier").selectExpr(
        "s_suppkey % 40 AS callee", "cast(s_nationkey % 3 AS INT) AS position",
        f"named_struct('nominal', {pick(_NOMINAL, 's_suppkey % 4')}, 'frame', {pick(_FRAME, 's_nationkey % 3')}, 'unit', {pick(_SCALE, 's_suppkey % 3')}, 'shape', CASE s_suppkey % 4 WHEN 0 THEN array('?', '1') WHEN 1 THEN array('n') END, 'provenance', {pick(_PROVEN, 's_suppkey % 3')}, 'confidence', 0.8D) AS wanted",
    )
    return compare.semantic_clashes(x, y)


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS site, 'f' || (l_suppkey % 25) AS short, CASE l_partkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'latin-1' END AS encoding, l_linenumber % 3 - 1 AS time, ['ms', 's'][l_suppkey % 2 + 1] AS unit,
    CASE WHEN l_partkey % 50 = 7 THEN 'bad-divisor:x' ELSE 'name:x' END AS provenance, round(1 - 6 * l_tax, 6) AS confidence FROM lineitem),
y AS (SELECT 'f' || n_nationkey AS short, CASE WHEN n_regionkey = 1 THEN 'utf-8' END AS encoding, n_regionkey % 3 - 1 AS time, 's' AS unit FROM nation),
c AS (SELECT site, least(confidence, 0.98) AS sure, CASE WHEN x.encoding <> y.encoding THEN 'BHSEM009' WHEN x.time <> 0 AND y.time <> 0 AND (provenance LIKE 'bad%' OR x.time <> y.time OR x.unit <> y.unit) THEN 'BHUNIT004' END AS code FROM x JOIN y USING (short))
SELECT site, code, CASE WHEN sure >= 0.9 THEN 'error' ELSE 'warning' END AS severity FROM c WHERE code IS NOT NULL AND sure >= 0.7""")
def sink_clashes(spark, d):
    dimension = lambda power: f"if({power} = 0, map_from_arrays(cast(array() AS ARRAY<STRING>), cast(array() AS ARRAY<INT>)), map('time', cast({power} AS INT)))"
    x = a.table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS site", "concat('mod.sub.f', l_suppkey % 25) AS callee",
        f"named_struct('encoding', CASE l_partkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'latin-1' END, 'dimension', {dimension('(l_linenumber % 3 - 1)')}, 'unit', if(l_suppkey % 2 = 0, 'ms', 's'), 'provenance', if(l_partkey % 50 = 7, 'bad-divisor:x', 'name:x'), 'confidence', round(1 - 6 * l_tax, 6)) AS actual",
    )
    y = a.table(spark, d, "nation").selectExpr("concat('lib.f', n_nationkey) AS callee", f"named_struct('encoding', if(n_regionkey = 1, 'utf-8', null), 'dimension', {dimension('(n_regionkey % 3 - 1)')}, 'unit', 's', 'confidence', 0.98D) AS wanted")
    return compare.sink_clashes(x, y)


@query("""WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS name, ['dimension-clash:a+name:b', 'instant-clash:', 'tz-clash:x', 'narrow:f', 'promotion-risk:', 'shape-clash:', 'name:x'][l_partkey % 7 + 1] AS p, round(1 - 6 * l_tax, 6) AS c FROM lineitem)
SELECT name, CASE split_part(p, ':', 1) WHEN 'dimension-clash' THEN 'BHUNIT004' WHEN 'instant-clash' THEN 'BHSEM002' WHEN 'tz-clash' THEN 'BHSEM003' WHEN 'narrow' THEN 'BHSEM004' WHEN 'promotion-risk' THEN 'BHSEM005' ELSE 'BHSEM006' END AS code,
       CASE WHEN c >= 0.9 THEN 'error' ELSE 'warning' END AS severity FROM v WHERE p <> 'name:x' AND c >= 0.7""")
def tagged_contradictions(spark, d):
    tags = "array('dimension-clash:a+name:b', 'instant-clash:', 'tz-clash:x', 'narrow:f', 'promotion-risk:', 'shape-clash:', 'name:x')"
    return compare.tagged_contradictions(a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS name", f"element_at({tags}, cast(l_partkey % 7 AS INT) + 1) AS provenance", "round(1 - 6 * l_tax, 6) AS confidence"))


# ---------------------------------------------------------------- technologies


#: Files by what they show: path (@ for a number), text, technologies.
_FILES = (
    ("src/a@.py", "x = 1", "python"),
    ("src/b@.py", "async def f(): pass", "python asyncio"),
    ("src/c@.py", "os.getenv('X')", "python dotenv"),
    ("src/django_@.py", "x", "python django"),
    ("bin/run@", "#!/bin/bash\ntrue", "shell"),
    ("bin/run@.zsh", "", "shell"),
    ("api/p@.proto", "", "protobuf"),
    ("db/q@.sql", "select 1", "sql"),
    ("db/migrations/r@.sql", "select '{}'::jsonb", "sql"),
    ("infra/m@.tf", "", "terraform"),
    ("go/g@.go", "", "go"),
    ("rs/r@.rs", "", "rust"),
    ("c/x@.hpp", "", "cpp"),
    ("php/x@.php", "", "php"),
    ("web/x@.jsx", "", "javascript-typescript"),
    ("web/y@.tsx", "process.env.X", "javascript-typescript typescript dotenv"),
    ("etc/t@.toml", "", "toml"),
    ("etc/y@.yaml", "$schema: x", "yaml schema-ref"),
    ("api/openapi@.json", '{"openapi": "3.1"}', "openapi"),
    ("pact_@.json", "{}", "pact"),
    ("docs/readme@.md", "nothing", ""),
)


@query(f"""WITH f AS (SELECT replace(path, '@', CAST(p_partkey AS VARCHAR)) AS path, caps FROM part JOIN (VALUES {", ".join(str((k, f[0], f[2])) for k, f in enumerate(_FILES))}) v(k, path, caps) ON p_partkey % {len(_FILES)} = k),
c AS (SELECT path, unnest(string_split(caps, ' ')) AS capability FROM f WHERE caps <> '' UNION ALL SELECT path, 'postgres-migrations' FROM f WHERE path LIKE '%/migrations/%')
SELECT capability, count(*) AS files, list_sort(list(DISTINCT path))[1:100] AS evidence FROM c GROUP BY capability
UNION ALL SELECT 'react', 1, ['dependencies']""")
def technologies(spark, d):
    from siftspark.sources import inventory

    samples = F.broadcast(spark.createDataFrame([(k, *f[:2]) for k, f in enumerate(_FILES)], "k int, path string, head string"))
    parts = a.table(spark, d, "part")
    files = parts.select(F.col("p_partkey").cast("string").alias("key"), (F.col("p_partkey") % len(_FILES)).cast("int").alias("k")).join(samples, "k").select(F.replace("path", F.lit("@"), "key").alias("path"), "head", F.length("head").alias("size"))
    names = parts.select(F.expr("element_at(array('React', 'left-pad', 'Django', 'lodash'), cast(p_size % 4 AS INT) + 1)").alias("name"))
    return inventory.inventory(files, names)


_DIALECTS = "['PsycoPG pool', 'ENGINE=InnoDB', 'import aiosqlite', 'google.cloud.bigquery', 'Snowflake', 'duckdb', 'select 1', 'select 2']"


@query(f"""WITH t AS (SELECT p_partkey // 3 AS grp, list(p_size % 8) AS ks FROM part GROUP BY 1)
SELECT grp, CASE WHEN list_contains(ks, 0) THEN 'postgres' WHEN list_contains(ks, 1) THEN 'mysql' WHEN list_contains(ks, 2) THEN 'sqlite' WHEN list_contains(ks, 3) THEN 'bigquery' WHEN list_contains(ks, 4) THEN 'snowflake' WHEN list_contains(ks, 5) THEN 'duckdb' ELSE 'ansi' END AS dialect FROM t""")
def sql_dialects(spark, d):
    from siftspark.sources import inventory

    return inventory.first_dialect(a.table(spark, d, "part").selectExpr("p_partkey div 3 AS grp", f"element_at({_sparked(_DIALECTS)}, cast(p_size % 8 AS INT) + 1) AS text"), "grp")


@query("""SELECT DISTINCT 'pkg/' || p_partkey || '/package.json' AS path, lower(n) AS name FROM part, unnest(['React' || (p_size % 3), 'Jest', 'peer' || p_size]) x(n)""")
def manifest_dependencies(spark, d):
    from siftspark.sources import inventory

    text = "concat('{\"dependencies\": {\"React', p_size % 3, '\": \"1\"}, \"devDependencies\": {\"Jest\": \"2\"}, \"peerDependencies\": {\"peer', p_size, '\": \"*\"}, \"scripts\": {\"no\": \"x\"}}')"
    return inventory.manifest_dependencies(a.table(spark, d, "part").selectExpr("concat('pkg/', p_partkey, '/package.json') AS path", f"{text} AS head"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, ['calls', 'tested_by'][l_linenumber % 2 + 1] AS predicate, 's' || l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'p' || l_partkey END AS object,
  CASE l_linestatus WHEN 'F' THEN NULL ELSE round(1 - l_tax, 2) END AS confidence, l_quantity = 7 AS odd FROM lineitem)
SELECT predicate, subject, object, coalesce(confidence, 1.0) AS confidence FROM c WHERE object IS NOT NULL AND NOT odd""")
def graph_export(spark, d):
    """An export for each order, with relationships that lack a name or have a confidence that is no number."""
    from siftspark.sources import inventory

    text = """concat('{"predicate": "', element_at(array('calls', 'tested_by'), cast(l_linenumber % 2 AS INT) + 1), '", "subject": "s', l_suppkey, '"', if(l_returnflag = 'R', '', concat(', "object": "p', l_partkey, '"')),
      CASE WHEN l_quantity = 7 THEN ', "confidence": "odd"' WHEN l_linestatus = 'F' THEN '' ELSE concat(', "confidence": ', cast(round(1 - l_tax, 2) AS STRING)) END, '}')"""
    edges = a.table(spark, d, "lineitem").selectExpr("l_orderkey", f"{text} AS r").groupBy("l_orderkey").agg(F.array_join(F.collect_list("r"), ", ").alias("rs"))
    return inventory.call_graph(edges.select(F.concat(F.lit('{"relationships": ['), "rs", F.lit("]}")).alias("text")))


# ---------------------------------------------------------------- symbols, evidence, documents


@query("""SELECT DISTINCT 'code://function/main/src/pkg' || (l_partkey % 40) || '/m' || l_linenumber || '.py/f' || l_suppkey AS uri, 'src/pkg' || (l_partkey % 40) || '/m' || l_linenumber || '.py' AS file, 'f' || l_suppkey AS name,
  'pkg' || (l_partkey % 40) || '.m' || l_linenumber AS module FROM lineitem UNION ALL SELECT 's://short/' || s_suppkey, '', 's://short/' || s_suppkey, '' FROM supplier""")
def symbol_parts(spark, d):
    from siftspark.functions import symbols

    uris = a.table(spark, d, "lineitem").selectExpr("concat('code://function/main/src/pkg', l_partkey % 40, '/m', l_linenumber, '.py/f', l_suppkey) AS uri").distinct().unionByName(a.table(spark, d, "supplier").selectExpr("concat('s://short/', s_suppkey) AS uri"))
    file = symbols.symbol_file(F.col("uri"))
    return uris.select("uri", file.alias("file"), symbols.symbol_name(F.col("uri")).alias("name"), symbols.module_of(file).alias("module"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 5 < 3 THEN 'mod' || (l_suppkey % 5) || '.real' ELSE 'a' || (l_suppkey % 5) END || CASE WHEN l_linenumber % 2 = 0 THEN '.sub.f' || l_partkey ELSE '' END AS name FROM lineitem""")
def alias_expansion(spark, d):
    from siftspark.functions import symbols

    aliases = a.table(spark, d, "nation").where("n_nationkey % 5 < 3").selectExpr("concat('a', n_nationkey % 5) AS head", "concat('mod', n_nationkey % 5, '.real') AS target").distinct()
    names = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "concat('a', l_suppkey % 5, if(l_linenumber % 2 = 0, concat('.sub.f', l_partkey), '')) AS dotted").withColumn("head", F.split_part("dotted", F.lit("."), F.lit(1)))
    return names.join(F.broadcast(aliases), "head", "left").select("id", symbols.expanded(F.col("dotted"), F.col("target")).alias("name"))


#: Name endings or whole names, and what they say.
_SAYS = (
    ("wait@_ms", "unit", "ms", "time:1"), ("turn@_deg", "unit", "deg", "angle:1"), ("load@_pct", "unit", "percent", ""), ("start@_at", "nominal", "instant", ""), ("net@_delay", "nominal", "duration", ""), ("x@_user_id", "nominal", "user", ""), ("pos@_camera", "frame", "camera", ""),
    ("hit@_ratio", "unit", "fraction", ""), ("wall@x", "time_basis", "local_wall", ""), ("utc@x", "time_basis", "utc", ""), ("trailing@x", "interval_alignment", "trailing", ""), ("best_@", "interval_alignment", "leading", ""), ("dose@x", "missingness", "unknown", ""), ("plain@", None, None, None), ("_id", None, None, None),
)


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


def _made(spark, d, texts) -> DataFrame:
    """key and text, one a part: the texts in turn, with the key in place of @."""
    samples = F.broadcast(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    return a.table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % len(texts)).cast("int").alias("k")).join(samples, "k").select("key", F.replace("text", F.lit("@"), F.col("key").cast("string")).alias("text"))


@query(f"""SELECT p_partkey AS key, facet, value, dimension, CASE WHEN facet IS NOT NULL THEN 'name:' || replace(name, '@', CAST(p_partkey AS VARCHAR)) END AS provenance, CASE WHEN facet IS NOT NULL THEN CAST(0.8 AS DOUBLE) END AS confidence
FROM part JOIN (VALUES {_sql_rows([(k, *r) for k, r in enumerate(_SAYS)])}) v(k, name, facet, value, dimension) ON p_partkey % {len(_SAYS)} = k""")
def name_evidence(spark, d):
    from siftspark.functions import evidence

    return _made(spark, d, [r[0] for r in _SAYS]).select("key", evidence.name_evidence(F.col("text")).alias("e")).select("key", "e.*")


_ANNOTATIONS = (("datetime.timedelta", "nominal", "duration", "time:1"), ("datetime", "nominal", "instant", ""), ("bytes", "encoding", "bytes", ""), ("str", "encoding", "utf8", ""), ('Float[Tensor, "batch c@"]', "shape", "batch c@", ""), ("'Int[Array, \"n@\"]'", "shape", "n@", ""), ("list[str]", None, None, None), ("Other@", None, None, None))


@query(f"""SELECT p_partkey AS key, facet, replace(value, '@', CAST(p_partkey AS VARCHAR)) AS value, dimension, CASE WHEN facet IS NOT NULL THEN 'annotation:' || replace(text, '@', CAST(p_partkey AS VARCHAR)) END AS provenance, CASE WHEN facet IS NOT NULL THEN CAST(1 AS DOUBLE) END AS confidence
FROM part JOIN (VALUES {_sql_rows([(k, *r) for k, r in enumerate(_ANNOTATIONS)])}) v(k, text, facet, value, dimension) ON p_partkey % {len(_ANNOTATIONS)} = k""")
def annotation_evidence(spark, d):
    from siftspark.functions import evidence

    return _made(spark, d, [r[0] for r in _ANNOTATIONS]).select("key", evidence.annotation_evidence(F.col("text")).alias("e")).select("key", "e.*")


@query("""WITH n AS (SELECT p_partkey AS key, 'q' || p_partkey AS base, ['_complete', '_coverage_fraction', '_Version', '_source', '_other', ''][p_partkey % 6 + 1] AS e FROM part)
SELECT key, CASE WHEN e NOT IN ('_other', '') THEN base END AS base FROM n""")
def quality_bases(spark, d):
    from siftspark.functions import evidence

    return _made(spark, d, ["q@_complete", "q@_coverage_fraction", "q@_Version", "q@_source", "q@_other", "q@"]).select("key", evidence.quality_base(F.col("text")).alias("base"))


_TYPES = (
    ("int", "st.integers()"), ("str | None", "st.one_of(st.none(), st.text())"), ("Optional[bytes]", "st.one_of(st.none(), st.binary())"), ("list[set[int]]", "st.lists(st.sets(st.integers(), max_size=32), max_size=32)"), ("dict[str, bool]", "st.dictionaries(st.text(), st.booleans(), max_size=32)"),
    ("tuple[int, float]", "st.tuples(st.integers(), st.floats(allow_nan=False, allow_infinity=False))"), ("tuple[int]", None), ("list[Thing@]", None), ("Thing@", None), ("not a type", None),
)


@query(f"SELECT p_partkey AS key, strategy FROM part JOIN (VALUES {_sql_rows([(k, r[1]) for k, r in enumerate(_TYPES)])}) v(k, strategy) ON p_partkey % {len(_TYPES)} = k")
def type_strategies(spark, d):
    from siftspark.functions import symbols
    from siftspark.session import importable

    importable(spark)
    return _made(spark, d, [r[0] for r in _TYPES]).select("key", symbols.strategy_of("text").alias("strategy"))


_DOCUMENTS = (
    ("s/@.json", '{"title": "T@", "properties": {"a": {}, "b@": {}}, "$defs": {"D": {"properties": {"x": {}}}}, "definitions": {"No": {"properties": {"no": {}}}}}'),
    ("s/@.json", '{"components": {"schemas": {"C@": {"properties": {"c": {}}}, "Empty": {}}}, "definitions": {"E": {"properties": {"y": {}}}}}'),
    ("s/@.json", '{"consumer": {"name": "a@"}, "provider": {"name": "b"}, "interactions": []}'),
    ("s/@.json", '{"consumer": "a", "provider": {"name": "b"}, "interactions": []}'),
    ("s/@.json", '{"$schema": "../base/one.json"}'),
    ("s/@.json", '{"$schema": "https://example.org/x.json"}'),
    ("s/@.json", "no json @"),
    ("s/@.yaml", "$schema: ./none@.json"),
    ("base/one.json", "{}"),
    ("s/deep/@.yaml", "  $schema : '../../base/one.json'  # here"),
    ("s/@.json", '{"$schema": "../../../out.json"}'),
)


def _documents(spark, d) -> DataFrame:
    paths, texts = _made(spark, d, [p for p, _ in _DOCUMENTS]), _made(spark, d, [t for _, t in _DOCUMENTS])
    return paths.withColumnRenamed("text", "path").join(texts, "key").select("path", "text")


_DOC_SQL = f"k AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % {len(_DOCUMENTS)} AS k FROM part)"


@query(f"""WITH {_DOC_SQL} SELECT 's/' || key || '.json' AS path, replace(name, '@', key) AS name, replace(field, '@', key) AS field FROM k JOIN (VALUES (0, 'T@', 'a'), (0, 'T@', 'b@'), (0, 'D', 'x'), (1, 'C@', 'c'), (1, 'E', 'y')) v(k, name, field) USING (k)""")
def schema_fields(spark, d):
    from siftspark.sources import documents

    return documents.schema_fields(_documents(spark, d))


@query(f"WITH {_DOC_SQL} SELECT 's/' || key || '.json' AS path FROM k WHERE k = 2")
def pact_files(spark, d):
    from siftspark.sources import documents

    return documents.pact_files(_documents(spark, d))


@query(f"WITH {_DOC_SQL} SELECT CASE k WHEN 4 THEN 's/' || key || '.json' ELSE 's/deep/' || key || '.yaml' END AS path, 'base/one.json' AS schema FROM k WHERE k IN (4, 9)")
def local_schemas(spark, d):
    from siftspark.sources import documents

    return documents.local_schemas(_documents(spark, d))


@query("""WITH n AS (SELECT p_partkey, 'debt' || p_partkey || '.toml' AS path FROM part WHERE p_partkey % 5 <> 4)
SELECT path, CAST(0 AS BIGINT) AS entry_ord, 'ruff:F' || p_partkey AS signal, ['src/a.py', 'src/b.py'] AS paths, CAST(p_partkey % 7 AS INTEGER) AS count FROM n
UNION ALL SELECT path, 2, 'mypy:misc', ['src/c.py'], 1 FROM n""")
def ledger_files(spark, d):
    """Ledgers whose second entry lacks its paths; every fifth one is no TOML."""
    from siftspark.sources import documents

    key = F.col("p_partkey").cast("string")
    good = F.concat(F.lit('[[debt]]\nsignal = "ruff:F'), key, F.lit('"\npaths = ["src/a.py", "src/b.py"]\ncount = '), (F.col("p_partkey") % 7).cast("string"), F.lit('\n[[debt]]\nsignal = "x"\ncount = 2\n[[debt]]\nsignal = "mypy:misc"\npaths = ["src/c.py"]\ncount = 1\n'))
    files = a.table(spark, d, "part").select(F.concat(F.lit("debt"), key, F.lit(".toml")).alias("path"), F.when(F.expr("p_partkey % 5 = 4"), "[[debt\nbroken").otherwise(good).alias("text"))
    return documents.ledger_entries(files)


@query("""WITH b AS (SELECT 's' || s_suppkey || '.limit' AS key, 'base' AS value FROM supplier UNION ALL SELECT 's' || s_suppkey || '.table.a', 'base' FROM supplier UNION ALL SELECT 's' || s_suppkey || '.plain', 'base' FROM supplier),
o AS (SELECT 's' || s_suppkey || CASE s_nationkey % 3 WHEN 0 THEN '.limit' WHEN 1 THEN '.table' ELSE '.plain.deep' END AS key, 'own' AS value FROM supplier)
SELECT key, value FROM o UNION ALL SELECT key, value FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.key = b.key OR starts_with(b.key, o.key || '.') OR starts_with(o.key, b.key || '.'))""")
def settings_overlay(spark, d):
    from siftspark.sources import documents

    sup = a.table(spark, d, "supplier")
    base = sup.select(F.explode(F.array(*(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(e)) for e in (".limit", ".table.a", ".plain")))).alias("key"), F.lit("base").alias("value"))
    own = sup.select(F.expr("concat('s', s_suppkey, element_at(array('.limit', '.table', '.plain.deep'), s_nationkey % 3 + 1))").alias("key"), F.lit("own").alias("value"))
    return documents.overlaid(base, own)


@query("""WITH p AS (SELECT regexp_replace(url, '^https?://', '') || '.html' AS path, CAST(length(html) AS BIGINT) AS size, md5(html) AS head FROM pages),
f AS (SELECT path, size, CASE WHEN size % 3 > 0 THEN head END AS head FROM p UNION ALL SELECT path, size + 1, NULL FROM p)
SELECT path, max(size) AS size, min(head) AS head FROM f WHERE path LIKE '%/en/%' GROUP BY path""")
def scoped_files(spark, d):
    from siftspark.sources import inventory

    pages = a.table(spark, d, "pages").select(F.concat(F.lit("./"), F.regexp_replace("url", "^https?://", ""), F.lit(".html")).alias("path"), F.length("html").cast("long").alias("size"), F.md5("html").alias("head"))
    # large files have no head, and each path comes twice
    files = pages.withColumn("head", F.when(F.col("size") % 3 > 0, F.col("head"))).unionByName(pages.select("path", (F.col("size") + 1).alias("size"), F.lit(None).cast("string").alias("head")))
    return inventory.in_scope(files, ["."], (".html",)).where(F.contains("path", F.lit("/en/"))).select("path", "size", "head")


# ---------------------------------------------------------------- revisions, cases, gates


@query("""WITH h AS (SELECT s_suppkey AS repo, 'c' || (s_suppkey % 7) AS commit, CASE WHEN s_nationkey % 4 > 0 THEN 'p' || s_suppkey END AS parent FROM supplier),
r AS (SELECT DISTINCT l_suppkey AS repo, l_linenumber AS place, 'c' || (l_partkey % 7) AS base FROM lineitem WHERE l_linenumber <= 4),
g AS (SELECT r.repo, place, max(base) AS base FROM r GROUP BY 1, 2)
SELECT h.repo, coalesce((SELECT arg_min(base, place) FROM g WHERE g.repo = h.repo AND base <> commit), parent) AS revision FROM h WHERE coalesce((SELECT arg_min(base, place) FROM g WHERE g.repo = h.repo AND base <> commit), parent) IS NOT NULL""")
def baselines(spark, d):
    from siftspark.sources import revisions

    heads = a.table(spark, d, "supplier").selectExpr("s_suppkey AS repo", "concat('c', s_suppkey % 7) AS commit", "if(s_nationkey % 4 > 0, concat('p', s_suppkey), null) AS parent")
    names = "array('origin/main', 'origin/master', 'main', 'master', 'topic', 'topic', 'topic')"
    refs = a.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("repo"), F.expr(f"element_at({names}, cast(l_linenumber AS INT))").alias("ref")).agg(F.max(F.expr("concat('c', l_partkey % 7)")).alias("merge_base"))
    return revisions.baseline(refs, heads, "repo")


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS revision, 'f' || (p_partkey // 2) AS path, p_size % 3 AS content FROM part)
SELECT x.path FROM f x JOIN f y ON x.path = y.path AND x.revision = 'old' AND y.revision = 'new' AND x.content <> y.content""")
def changed_files(spark, d):
    from siftspark.sources import revisions

    return revisions.changed(a.table(spark, d, "part").selectExpr("if(p_partkey % 2 = 0, 'old', 'new') AS revision", "concat('f', p_partkey div 2) AS path", "cast(p_size % 3 AS STRING) AS content"), "old", "new")


@query("""WITH f AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'src/m' || p_size || '.py' ELSE 'm' || p_size || '.py' END AS path FROM part WHERE p_size % 2 = 0 OR p_partkey % 3 = 0),
g AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'm' || CAST(l_quantity AS INTEGER) || '.py' AS path FROM lineitem)
SELECT id, CASE WHEN path NOT IN (SELECT path FROM f) AND 'src/' || path IN (SELECT path FROM f) THEN 'src/' || path ELSE path END AS path FROM g""")
def existing_paths(spark, d):
    files = a.table(spark, d, "part").where("p_size % 2 = 0 OR p_partkey % 3 = 0").selectExpr("if(p_partkey % 3 = 0, concat('src/m', p_size, '.py'), concat('m', p_size, '.py')) AS path")
    return filters.existing_paths(a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "concat('m', cast(l_quantity AS INT), '.py') AS path"), files)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS fn, l_linenumber AS position, 't' || (l_linenumber % 3) AS type FROM lineitem),
v AS (SELECT 't' || n_regionkey AS type, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS nth, n_name AS value FROM nation WHERE n_regionkey < 3),
n AS (SELECT type, count(*) AS n FROM v GROUP BY type),
x AS (SELECT p.fn, p.position, p.type, n.n, product(n.n) OVER (PARTITION BY fn) AS total, coalesce(product(n.n) OVER (PARTITION BY fn ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS step FROM p JOIN n USING (type)),
c AS (SELECT *, unnest(range(CAST(least(total, 20) AS BIGINT))) AS case_no FROM x)
SELECT fn, case_no, position, value FROM c JOIN v ON v.type = c.type AND v.nth = (case_no // CAST(step AS BIGINT)) % n""")
def sample_cases(spark, d):
    parameters = a.table(spark, d, "lineitem").selectExpr("l_orderkey AS fn", "l_linenumber AS position", "concat('t', l_linenumber % 3) AS type").distinct()
    nations = a.table(spark, d, "nation").where("n_regionkey < 3").withColumn("nth", F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1").cast("long"))
    return compare.sample_cases(parameters, nations.selectExpr("concat('t', n_regionkey) AS type", "nth", "n_name AS value"), 20)


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS boundary FROM benchmark), b AS (SELECT lower(text) AS text FROM documents WHERE regexp_matches(lower(text), 'that'))
SELECT boundary FROM n WHERE boundary = '' OR NOT EXISTS (SELECT 1 FROM b WHERE contains(text, lower(boundary)))""")
def unnamed_boundaries(spark, d):
    words = a.table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("boundary"))
    return compare.unnamed_boundaries(words, a.table(spark, d, "documents").select(F.col("text").alias("body")), "that")


@query("""SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'call' ELSE 'test' END AS kind, 'x://f/main/src/m' || (l_partkey % 9) || '.py/f' || l_suppkey AS subject, 'f' || l_linenumber AS object, 1.0 AS confidence,
  'src/m' || (l_partkey % 9) || '.py' AS subject_file, 'f' || l_suppkey AS subject_name, '' AS object_file, 'f' || l_linenumber AS object_name FROM lineitem WHERE l_linenumber % 3 < 2""")
def typed_edges(spark, d):
    rows = a.table(spark, d, "lineitem").selectExpr("element_at(array('calls', 'tested_by', 'mentions'), cast(l_linenumber % 3 AS INT) + 1) AS predicate", "concat('x://f/main/src/m', l_partkey % 9, '.py/f', l_suppkey) AS subject", "concat('f', l_linenumber) AS object", "1.0D AS confidence").distinct()
    return graph.typed(rows)


@query(f"""WITH {a.CHAINED_SQL}, o AS (SELECT caller AS symbol, count(DISTINCT callee) AS calls FROM e GROUP BY 1), i AS (SELECT callee AS symbol, count(DISTINCT caller) AS callers FROM e GROUP BY 1)
SELECT coalesce(o.symbol, i.symbol) AS symbol, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers FROM o FULL JOIN i ON o.symbol = i.symbol""")
def adjacency(spark, d):
    return graph.adjacency(a.chained_edges(spark, d))


@query("""WITH s AS (SELECT p_partkey AS symbol, 'm' || (p_size % 50) AS module, 'n' || p_partkey AS name FROM part), x AS (SELECT 'pub' AS module, 'n' || p_partkey AS name, p_partkey AS symbol FROM part WHERE p_brand LIKE '%1'),
m AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'pub' ELSE 'm' || (l_suppkey % 50) END AS module, 'n' || l_partkey AS name FROM lineitem)
SELECT symbol FROM s WHERE symbol NOT IN (SELECT symbol FROM s JOIN m USING (module, name) UNION SELECT symbol FROM x JOIN m USING (module, name))""")
def unmentioned_symbols(spark, d):
    p, li = a.table(spark, d, "part"), a.table(spark, d, "lineitem")
    exports = p.where("p_brand LIKE '%1'").selectExpr("'pub' AS module", "concat('n', p_partkey) AS name", "p_partkey AS symbol")
    mentions = li.selectExpr("if(l_linenumber = 1, 'pub', concat('m', l_suppkey % 50)) AS module", "concat('n', l_partkey) AS name")
    return graph.unmentioned(p.selectExpr("p_partkey AS symbol", "concat('m', p_size % 50) AS module", "concat('n', p_partkey) AS name"), exports, mentions)


@query("SELECT o_custkey AS run, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS running, greatest(0, count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P')) AS queued FROM orders GROUP BY 1")
def queued_checks(spark, d):
    counts = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))
    return live.queued(counts)


@query("""WITH c AS (SELECT 'o' || l_orderkey AS name, string_agg('part ' || l_partkey || CASE WHEN l_returnflag = 'R' THEN '' ELSE chr(10) || 'x' END, '' ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1)
SELECT name, unnest(string_split(text, chr(10))) AS line FROM c""")
def chunked_output(spark, d):
    chunk = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", "").otherwise("\nx"))
    pieces = a.table(spark, d, "lineitem").select(F.expr("concat('o', l_orderkey)").alias("name"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("seq"), chunk.alias("chunk"))
    return live.whole_lines(pieces)


@query("""WITH e AS (SELECT DISTINCT 'e' || (l_partkey % 60) AS name, 'c' || (l_partkey % 60 // 2 + l_linenumber % 3) AS capability FROM lineitem), c AS (SELECT 'c' || (s_suppkey % 50) AS capability FROM supplier WHERE s_nationkey < 4)
SELECT DISTINCT name, 'N/A' AS status FROM e WHERE name NOT IN (SELECT name FROM e WHERE capability IN (FROM c))""")
def capability_gate(spark, d):
    engines = a.table(spark, d, "lineitem").selectExpr("concat('e', l_partkey % 60) AS name", "concat('c', l_partkey % 60 div 2 + l_linenumber % 3) AS capability").distinct()
    return filters.capability_gate(engines, a.table(spark, d, "supplier").selectExpr("concat('c', s_suppkey % 50) AS capability", "s_nationkey < 4 AS detected"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS run, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 ELSE 2 END AS need FROM part) SELECT p_partkey, run >= need AS allowed FROM p""")
def profile_gate(spark, d):
    names = "array('fast', 'pr', 'deep', 'all')"
    rows = a.table(spark, d, "part").selectExpr("p_partkey", f"element_at({names}, cast(p_size % 4 AS INT) + 1) AS run", f"if(p_partkey % 5 < 4, element_at({names}, cast(p_partkey % 5 AS INT) + 1), null) AS need")
    return rows.select("p_partkey", filters.profile_allows(F.col("run"), F.col("need")).alias("allowed"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 20 THEN 'warning' END AS severity,
  CASE p_partkey % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'warning' WHEN 6 THEN 'note' WHEN 7 THEN 'note' WHEN 8 THEN 'note' ELSE 'warning' END AS parsed FROM part""")
def severities(spark, d):
    words = "array('FATAL', 'critical', 'High', 'error', 'warn', 'Medium', 'info', 'information', 'style', 'refactor', null)"
    rows = a.table(spark, d, "part").selectExpr("p_partkey", "p_size", f"element_at({words}, cast(p_partkey % 11 AS INT) + 1) AS raw")
    return rows.select("p_partkey", fx.threshold_severity(F.col("p_size"), 20, 40).alias("severity"), fx.parsed_severity(F.col("raw"), "warning").alias("parsed"))


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 2 AS t, ['ms', 's'][l_suppkey % 2 + 1] AS u, round(1 - 6 * l_tax, 6) AS c FROM lineitem)
SELECT id, CASE WHEN u = 'ms' THEN 'ms' END AS unit, CASE WHEN t = 1 THEN 'time:1' ELSE '' END AS dimension, greatest(0.1, least(c, 0.5)) AS confidence, 'name:a+name:b' AS provenance FROM x""")
def combined_facts(spark, d):
    from siftspark.functions import semantic as sem

    fact = lambda t, unit, conf, who: f"named_struct('dimension', if({t} = 1, map('time', 1), map_from_arrays(cast(array() AS ARRAY<STRING>), cast(array() AS ARRAY<INT>))), 'unit', {unit}, 'dtype', cast(null AS STRING), 'timezone', 'aware', 'nominal', 'instant', 'dependencies', array('x'), 'nullable', false, 'provenance', 'name:{who}', 'confidence', {conf})"
    rows = a.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", f"{fact('l_partkey % 2', 'if(l_suppkey % 2 = 0, `ms`, `s`)'.replace('`', chr(39)), 'round(1 - 6 * l_tax, 6)', 'a')} AS p", f"{fact('l_partkey % 2', repr('ms'), '0.5D', 'b')} AS q")
    c = rows.select("id", sem.combined(F.col("p"), F.col("q")).alias("c"))
    return c.select("id", "c.unit", sem.dimension_text(F.col("c.dimension")).alias("dimension"), "c.confidence", "c.provenance")


@query("SELECT p_partkey, sha256('root' || chr(31) || p_brand || chr(31) || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS key FROM part")
def cache_keys(spark, d):
    from siftspark.sources import sinks

    return a.table(spark, d, "part").select("p_partkey", sinks.cache_key(F.lit("root"), F.col("p_brand"), F.expr("if(p_size > 25, p_size, null)")).alias("key"))


@query("""SELECT p_partkey AS run, CAST(p_size - 10 AS BIGINT) AS edges, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'unknown' END AS resolved FROM part WHERE p_partkey % 4 < 3 AND p_size > 10""")
def unresolved_edges(spark, d):
    status = F.expr(
        "concat('index: ok', chr(10), if(p_partkey % 2 = 0, concat('calls: resolved=', p_partkey, ' external=3'), 'calls: none'), chr(10), if(p_partkey % 4 = 3, 'unresolved=7', concat('likely_internal_unresolved=', greatest(p_size - 10, 0))))"
    )
    return graph.unresolved_summary(a.table(spark, d, "part").select(F.col("p_partkey").alias("run"), status.alias("text")))


@query(f"WITH {FS}, {KEYED_SQL} SELECT key, seq, 'BH-' || upper({a.MARK_SQL}) AS id FROM k")
def signal_members(spark, d):
    return report.signal_members(a.findings(spark, d))


@query(f"WITH {FS} SELECT tool, seq, 'BH-' || upper({a.MARK_SQL}) AS id FROM f WHERE fixable")
def autofix_members(spark, d):
    return report.autofix_members(a.findings(spark, d))


@query(f"""WITH {FS}, {KEYED_SQL}, g AS (SELECT key, min(CASE severity WHEN 'error' THEN 0 WHEN 'note' THEN 2 ELSE 1 END) AS first_rank, count(*) AS findings FROM k GROUP BY key ORDER BY 2, 3 DESC, 1 LIMIT 12)
SELECT seq, k.key AS signal_key, CAST(first_rank AS INTEGER) AS first_rank, findings, substr(sha256(k.key), 1, 12) AS task FROM k JOIN g ON g.key = k.key""")
def task_groups(spark, d):
    return report.task_groups(report.repair_queue(a.findings(spark, d), a.results(spark, d)), 12).select("seq", "signal_key", "first_rank", "findings", "task")


@query("""WITH m AS (SELECT DISTINCT 'M' || (p_partkey % 90) AS name, p_brand AS field, 'f' || p_size AS path FROM part), f AS (SELECT name, min(path) AS path FROM m GROUP BY 1) SELECT DISTINCT name, field FROM m JOIN f USING (name, path)""")
def first_models(spark, d):
    from siftspark.sources import documents

    return documents.first_of_name(a.table(spark, d, "part").selectExpr("concat('M', p_partkey % 90) AS name", "p_brand AS field", "concat('f', p_size) AS path"))


@query("SELECT DISTINCT '{\"schema_version\":2,\"name\":\"' || name || '\",\"path\":\"src/' || name || '.py\"}' AS value FROM (SELECT 't' || (s_suppkey % 40) AS name FROM supplier)")
def target_registry(spark, d):
    from siftspark.sources import sinks

    return sinks.registry(a.table(spark, d, "supplier").selectExpr("concat('t', s_suppkey % 40) AS name").distinct().withColumn("path", F.concat(F.lit("src/"), "name", F.lit(".py"))))


# ---------------------------------------------------------------- findings by code


def emitted(code: str, name: str, where: str = "TRUE") -> None:
    path, line, severity, message = emit.FINDINGS[code]
    QUERIES[f"emit_{code}"] = lambda spark, d: emit.findings(QUERIES[name](spark, d).where(where), code)
    ORACLES[f"emit_{code}"] = f"SELECT '{code}' AS code, CAST({path} AS VARCHAR) AS path, CAST({line} AS INTEGER) AS line, {severity} AS severity, {message} AS message FROM ({ORACLES[name]}) WHERE {where}"


for _code, *_source in (
    ("BHCFG002", "env_missing"), ("BHCFG003", "secret_values"), ("BHCOV002", "branch_gaps"), ("BHDIFF001", "version_diff"), ("BHDIS001", "checker_disagreement"), 
    ("BHINV001", "predicate_consistency"), ("BHPLC001", "contradictory_checks"), ("BHRT001", "uncovered_pairs"), ("BHRT002", "naming_pairs", "partner IS NULL"), ("BHSEAM002", "forwarding_mismatch"), ("BHSEAM003", "producer_consumer_drift"),
    ("BHSEAM004", "schema_drift"), ("BHSEM010", "nullable_dereference"), ("BHUNIT004", "contract_clash"), ("BHVERIFY001", "verification_gap"), ("BHVERIFY002", "boundary_gap"),
):
    emitted(_code, *_source)
