"""Rules over syntax nodes: code -> SQL that gives path, line, severity and message of each finding.

{n} stands for the node table (see siftspark.sources.syntax), {a} for nodes with what they stand in: a row for each node
and each of its ancestors that rules ask for (AROUND), with the ancestor's columns and the node's place as `below`. It
comes from one merge over each file (siftspark.operators.structure), so all joins are on equal keys. Users add rules
of their own with register().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.evidence import QUALITY
from siftspark.functions.findings import UNIT_SUFFIXES
from siftspark.operators.structure import enclosing
from siftspark.session import bucketed

RULES: dict[str, str] = {}

#: Magic methods that may be coroutines, that may yield, and binary ones, which return NotImplemented rather than raise; fixed values.
ASYNC_MAGIC = "'__aenter__', '__aexit__', '__aiter__', '__anext__'"
GENERATOR_MAGIC = "'__iter__', '__await__'"
REFLECTIVE_MAGIC = "'__eq__', '__ne__', '__lt__', '__le__', '__gt__', '__ge__', '__add__', '__radd__', '__sub__', '__mul__', '__rmul__', '__and__', '__rand__', '__or__', '__ror__', '__xor__'"
MAGIC = "RLIKE '^__.+__$'"
#: Calls that query a database, but for get, which is a dictionary's as well; fixed values.
DB_CALLS = "'execute', 'executemany', 'query', 'filter', 'filter_by', 'select', 'scalars', 'scalar'"
#: Names of operational settings, and of modules that may hold them; fixed values.
CONFIG_NAME = "(?:^|_)(timeout|retries|retry|host|port|url|endpoint|threshold|limit|max|min|interval|ttl|workers|batch(?:_size)?|concurrency|rate|delay|buffer|cache)(?:_|$)"
CONFIG_MODULE = "(?:^|[._/])(config|settings|constants|defaults|cli|options)(?:[._/]|$)"
#: Parts of names of quantities and of functions that integrate; fixed values.
QUANTITIES = "irradiance|radiation|dose|uv_index|uvi|_wm2|_j_m2|sed_|score|pigment|uva|uvb|vitamin|erythemal"
INTEGRATORS = "integrate|trapz|cumtrapz|window_|_dose"
FUNCS = "('FunctionDef', 'AsyncFunctionDef')"
LOOPS = "('For', 'AsyncFor', 'While')"


#: Rules that give one finding for all files together.
PROJECT_RULES = ("BHTIME001", "BHSEAM006")


def register(code: str, sql: str) -> None:
    RULES[code] = sql


def _inside(child: str, parent: str) -> str:
    """parent, a row of {a}, is an ancestor of child."""
    return f"{parent}.path = {child}.path AND {parent}.below = {child}.lo AND {parent}.lo < {child}.lo"


register(
    "BHCTRL001",
    f"""SELECT DISTINCT x.path, x.line, 'error' AS severity, concat(lower(x.kind), ' in a finally body hides the exception under way') AS message
    FROM {{n}} x JOIN {{a}} b ON {_inside('x', 'b').replace('b.lo < x.lo', 'b.lo <= x.lo')} AND b.field = 'finalbody' AND b.func = x.func
    WHERE x.kind IN ('Return', 'Break', 'Continue') AND NOT EXISTS (
      SELECT 1 FROM {{a}} l WHERE {_inside('x', 'l')} AND l.kind IN ('For', 'While', 'AsyncFor') AND x.kind <> 'Return' AND l.lo >= b.lo)""",
)
register(
    "BHPRT001",
    """SELECT a.path, a.line, 'error' AS severity, concat('assert message is the exception ', m.name) AS message FROM {n} a JOIN {n} m ON m.path = a.path AND m.parent = a.lo AND m.field = 'msg'
    WHERE a.kind = 'Assert' AND m.kind IN ('Name', 'Attribute', 'Call') AND m.name RLIKE '(Error|Exception|Warning)$'""",
)
register("BHPRT002", f"SELECT path, line, 'error' AS severity, concat(name, ' must not be async') AS message FROM {{n}} WHERE kind = 'AsyncFunctionDef' AND name {MAGIC} AND name NOT IN ({ASYNC_MAGIC})")
register(
    "BHPRT003",
    f"""SELECT f.path, min_by(y.line, y.bfs) AS line, 'error' AS severity, concat(f.name, ' yields, so it returns a generator') AS message
    FROM {{n}} y JOIN {{a}} f ON {_inside('y', 'f')} WHERE y.kind IN ('Yield', 'YieldFrom') AND f.kind = 'FunctionDef' AND f.name {MAGIC} AND f.name NOT IN ({GENERATOR_MAGIC}) GROUP BY f.path, f.lo, f.name""",
)
#: Handlers that catch the end of an iterator; fixed values.
CATCHES_STOP = "'StopIteration', 'RuntimeError', 'Exception', 'BaseException'"
register(
    "BHPRT004",
    f"""WITH guards AS (SELECT h.path, h.parent AS lo FROM {{n}} h LEFT JOIN {{n}} t ON t.path = h.path AND t.parent = h.lo AND t.field = 'type' WHERE h.kind = 'ExceptHandler' AND (t.path IS NULL OR t.kind = 'Name' AND t.name IN ({CATCHES_STOP})) GROUP BY h.path, h.parent),
    -- calls in a guarded try that stands in the function itself, not in one within it; their lines are safe
    safe AS (SELECT DISTINCT c.path, t.func, c.line FROM {{n}} c JOIN {{a}} t ON {_inside('c', 't')} AND t.kind = 'Try' JOIN guards g ON g.path = t.path AND g.lo = t.lo WHERE c.kind = 'Call'),
    yields AS (SELECT DISTINCT f.path, f.lo FROM {{n}} y JOIN {{a}} f ON {_inside('y', 'f')} AND f.kind IN {FUNCS} WHERE y.kind IN ('Yield', 'YieldFrom'))
    SELECT DISTINCT c.path, c.line, 'error' AS severity, 'next() without a default ends the generator with an error' AS message FROM {{n}} c JOIN {{a}} f ON {_inside('c', 'f')} AND f.kind IN {FUNCS}
    JOIN yields y ON y.path = f.path AND y.lo = f.lo JOIN {{n}} n ON n.path = c.path AND n.parent = c.lo AND n.field = 'func' AND n.kind = 'Name' AND n.name = 'next'
    LEFT JOIN safe s ON s.path = c.path AND s.func = f.lo AND s.line = c.line
    WHERE c.kind = 'Call' AND s.path IS NULL AND (SELECT count(*) FROM {{n}} a WHERE a.path = c.path AND a.parent = c.lo AND a.field = 'args') = 1""",
)
register(
    "BHPRT007",
    f"""SELECT f.path, min_by(r.line, r.bfs) AS line, 'error' AS severity, concat(f.name, ' raises NotImplementedError; return NotImplemented') AS message FROM {{n}} r
    JOIN {{a}} f ON {_inside('r', 'f')} AND f.kind IN {FUNCS} JOIN {{n}} e ON e.path = r.path AND e.parent = r.lo AND e.field = 'exc'
    WHERE r.kind = 'Raise' AND substring_index(e.name, '.', -1) = 'NotImplementedError' AND f.name IN ({REFLECTIVE_MAGIC}) GROUP BY f.path, f.lo, f.name""",
)
register(
    "BHPRT009",
    f"""SELECT c.path, c.line, 'warning' AS severity, concat('test class ', c.name, ' has methods but no tests') AS message FROM {{n}} c
    JOIN {{n}} m ON m.path = c.path AND m.parent = c.lo AND m.kind IN {FUNCS} WHERE c.kind = 'ClassDef' AND c.name LIKE 'Test%'
    GROUP BY c.path, c.line, c.name HAVING count_if(m.name LIKE 'test%') = 0""",
)
register(
    "BHPRT010",
    """SELECT c.path, c.line, 'warning' AS severity, 'root of a sum of squares; use hypot' AS message FROM {n} c JOIN {n} b ON b.path = c.path AND b.parent = c.lo AND b.field = 'args'
    JOIN {n} s ON s.path = c.path AND s.parent = b.lo WHERE c.kind = 'Call' AND c.name IN ('math.sqrt', 'sqrt', 'np.sqrt', 'numpy.sqrt') AND b.kind = 'BinOp' AND b.name = 'Add' AND s.kind = 'BinOp' AND s.name IN ('Mult', 'Pow')
    GROUP BY c.path, c.line, c.lo HAVING count(*) = 2""",
)
register(
    "BHPRT011",
    """SELECT path, line, 'warning' AS severity, 'whole stream is read at once' AS message FROM {n} c WHERE kind = 'Call' AND name IN ('json.loads', 'yaml.safe_load', 'pickle.loads')
    AND EXISTS (SELECT 1 FROM {n} r WHERE r.path = c.path AND r.parent = c.lo AND r.field = 'args' AND r.kind = 'Call' AND r.name LIKE '%.read')""",
)
register(
    "BHDB001",
    f"""SELECT DISTINCT c.path, c.line, 'warning' AS severity, concat(c.name, ' runs once for each turn of a loop') AS message FROM {{n}} c JOIN {{a}} l ON {_inside('c', 'l')} AND l.kind IN {LOOPS} AND l.func >= 0
    WHERE c.kind = 'Call' AND substring_index(c.name, '.', -1) IN ({DB_CALLS})""",
)
register(
    "BHEVID002",
    "SELECT c.path, c.line, 'warning' AS severity, 'cast of a cast' AS message FROM {n} c JOIN {n} d ON d.path = c.path AND d.parent = c.lo AND d.field = 'args' WHERE c.kind = 'Call' AND c.name IN ('cast', 'typing.cast') AND d.kind = 'Call' AND d.name IN ('cast', 'typing.cast')",
)
register(
    "BHEVID003",
    f"""SELECT DISTINCT a.path, a.line, 'warning' AS severity, concat(t.name, ' is copied whole in each turn of the loop') AS message FROM {{n}} a
    JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name' JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'value'
    JOIN {{n}} x ON x.path = a.path AND x.parent = v.lo AND x.kind = 'Name' AND x.name = t.name JOIN {{a}} l ON {_inside('a', 'l')} AND l.kind IN {LOOPS} AND l.func >= 0
    WHERE a.kind IN ('Assign', 'AugAssign') AND NOT EXISTS (SELECT 1 FROM {{n}} o WHERE o.path = a.path AND o.parent = a.lo AND o.field = 'targets' AND o.lo <> t.lo)
      AND (v.kind = 'BinOp' AND v.name IN ('Add', 'BitOr') AND x.field IN ('left', 'right') OR v.kind = 'Dict' AND x.field = 'values'
        OR v.kind = 'Call' AND v.name IN ('list', 'dict', 'set', 'tuple') AND x.field = 'args' AND NOT EXISTS (SELECT 1 FROM {{n}} y WHERE y.path = v.path AND y.parent = v.lo AND y.field = 'args' AND y.lo < x.lo))""",
)
#: Modules imported at the top of a file.
_TOP_IMPORTS = """(SELECT path, line, lo, name FROM {n} WHERE kind = 'ImportFrom' AND parent = 0 AND name IS NOT NULL
  UNION ALL SELECT a.path, i.line, i.lo, a.name FROM {n} a JOIN {n} i ON i.path = a.path AND i.lo = a.parent AND i.kind = 'Import' AND i.parent = 0 WHERE a.kind = 'alias')"""
_PRIVATE = lambda c: f"({c} LIKE '\\\\_%' AND {c} NOT LIKE '\\\\_\\\\_%')"
register("BHARCH001", f"SELECT path, line, 'warning' AS severity, concat('import of private module ', name) AS message FROM {_TOP_IMPORTS} WHERE path NOT LIKE 'tests/%' AND exists(split(name, '[.]'), p -> {_PRIVATE('p')})")
register("BHARCH002", f"SELECT a.path, i.line, 'warning' AS severity, concat('import of private symbol ', a.name) AS message FROM {{n}} a JOIN {{n}} i ON i.path = a.path AND i.lo = a.parent AND i.kind = 'ImportFrom' AND i.parent = 0 WHERE a.kind = 'alias' AND {_PRIVATE('a.name')} AND a.path NOT LIKE 'tests/%'")
register("BHTEST001", "SELECT a.path, a.line, 'warning' AS severity, concat('test imports private symbol ', a.name) AS message FROM {n} a JOIN {n} i ON i.path = a.path AND i.lo = a.parent AND i.kind = 'ImportFrom' WHERE a.kind = 'alias' AND a.name LIKE '\\\\_%' AND a.name NOT LIKE '\\\\_\\\\_%' AND a.path LIKE 'tests/%'")
register("BHTEST002", "SELECT path, line, 'warning' AS severity, concat(name, ' pins the exact calls') AS message FROM {n} WHERE path LIKE 'tests/%' AND (kind = 'Call' AND name RLIKE '[.](assert_has_calls|assert_called_once_with|assert_called_with)$' OR kind = 'Attribute' AND name RLIKE '[.](mock_calls|call_args_list|method_calls)$')")
register(
    "BHTEST003",
    f"SELECT DISTINCT v.path, v.line, 'warning' AS severity, 'asserted literal of 1000 characters or more' AS message FROM {{n}} v JOIN {{a}} a ON {_inside('v', 'a')} AND a.kind = 'Assert' WHERE v.kind = 'Constant' AND length(v.value) >= 1000 AND v.path LIKE 'tests/%'",
)
register(
    "BHTEST004",
    f"""SELECT f.path, f.line, 'warning' AS severity, concat(f.name, ' patches much and checks the mocks') AS message FROM {{a}} f JOIN {{n}} c ON {_inside('c', 'f')} AND c.kind = 'Call'
    WHERE f.kind IN {FUNCS} AND f.name LIKE 'test%' AND f.path LIKE 'tests/%' GROUP BY f.path, f.line, f.name HAVING count_if(c.name RLIKE '(^|[.])patch([.]|$)|setattr$') >= 5 AND count_if(c.name RLIKE '[.]assert_') >= 2""",
)
register(
    "BHCX001",
    f"""SELECT path, line, CASE WHEN v > 20 THEN 'error' ELSE 'warning' END AS severity, concat('cyclomatic complexity ', v) AS message FROM (
      SELECT f.path, f.line, f.lo, 1 + count_if(x.kind IN ('If', 'For', 'AsyncFor', 'While', 'ExceptHandler', 'IfExp', 'comprehension', 'Assert', 'match_case')) + sum(CASE WHEN x.kind = 'BoolOp' THEN (SELECT count(*) - 1 FROM {{n}} o WHERE o.path = x.path AND o.parent = x.lo) ELSE 0 END) AS v
      FROM {{n}} f JOIN {{n}} x ON x.path = f.path AND x.func = f.lo WHERE f.kind IN {FUNCS} GROUP BY f.path, f.line, f.lo) WHERE v > 10""",
)
register("BHCX002", f"SELECT path, line, CASE WHEN end_line - line + 1 > 150 THEN 'error' ELSE 'warning' END AS severity, concat('function of ', end_line - line + 1, ' lines') AS message FROM {{n}} WHERE kind IN {FUNCS} AND end_line - line + 1 > 80")
register("BHCX003", "SELECT path, 1 AS line, CASE WHEN max(end_line) > 1200 THEN 'error' ELSE 'warning' END AS severity, concat('file of ', max(end_line), ' lines') AS message FROM {n} GROUP BY path HAVING max(end_line) > 500")
register(
    "BHCX004",
    f"""SELECT path, line, CASE WHEN v > 45 THEN 'error' ELSE 'warning' END AS severity, concat('ABC magnitude ', round(v, 1)) AS message FROM (
      SELECT f.path, f.line, f.lo, sqrt(power(count_if(x.kind IN ('Assign', 'AugAssign', 'AnnAssign', 'NamedExpr')), 2) + power(count_if(x.kind = 'Call'), 2) + power(count_if(x.kind IN ('If', 'IfExp', 'Compare', 'ExceptHandler', 'While', 'BoolOp')), 2)) AS v
      FROM {{n}} f JOIN {{n}} x ON x.path = f.path AND x.func = f.lo WHERE f.kind IN {FUNCS} GROUP BY f.path, f.line, f.lo) WHERE v > 30""",
)
_UNITS = "(" + "|".join(suffix for suffix, _ in UNIT_SUFFIXES) + ")"
register(
    "BHUNIT001",
    f"SELECT t.path, t.line, 'warning' AS severity, concat(t.name, ' is bound to a bare number') AS message FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name' JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'value' AND v.kind = 'Constant' AND v.value RLIKE '^-?[0-9.]+$' WHERE a.kind IN ('Assign', 'AnnAssign') AND lower(t.name) RLIKE '{_UNITS}$'",
)
register(
    "BHUNIT002",
    f"SELECT b.path, b.line, 'error' AS severity, concat(l.name, ' and ', r.name, ' have different units') AS message FROM {{n}} b JOIN {{n}} l ON l.path = b.path AND l.parent = b.lo AND l.field = 'left' AND l.kind = 'Name' JOIN {{n}} r ON r.path = b.path AND r.parent = b.lo AND r.field = 'right' AND r.kind = 'Name' WHERE b.kind = 'BinOp' AND b.name IN ('Add', 'Sub') AND l.name RLIKE '{_UNITS}$' AND r.name RLIKE '{_UNITS}$' AND regexp_extract(l.name, '{_UNITS}$', 1) <> regexp_extract(r.name, '{_UNITS}$', 1)",
)
register(
    "BHUNIT003",
    f"SELECT path, min(line) AS line, 'warning' AS severity, concat(stem, ' comes in units ', array_join(array_sort(collect_set(unit)), ', ')) AS message FROM (SELECT path, line, regexp_replace(name, '{_UNITS}$', '') AS stem, regexp_extract(name, '{_UNITS}$', 1) AS unit FROM {{n}} WHERE kind IN ('Name', 'arg') AND name RLIKE '.{_UNITS}$') GROUP BY path, stem HAVING count(DISTINCT unit) > 1",
)
register("BHTIME002", "SELECT c.path, c.line, 'error' AS severity, 'local wall clock labelled UTC' AS message FROM {n} c JOIN {n} k ON k.path = c.path AND k.parent = c.lo AND k.kind = 'keyword' AND k.name = 'tzinfo' JOIN {n} v ON v.path = c.path AND v.parent = k.lo WHERE c.kind = 'Call' AND c.name RLIKE 'datetime[.]now[.]replace$' AND v.name RLIKE '(UTC|utc)$'")
register("BHTIME001", "SELECT min_by(path, struct(path, line)) AS path, min_by(line, struct(path, line)) AS line, 'warning' AS severity, concat(count(*), ' wall-clock calls, none under control in tests') AS message FROM {n} WHERE kind = 'Call' AND name IN ('time.time', 'datetime.now', 'datetime.datetime.now', 'datetime.utcnow', 'date.today') AND path NOT LIKE 'tests/%' AND NOT EXISTS (SELECT 1 FROM {n} t WHERE t.path LIKE 'tests/%' AND t.name RLIKE 'freeze_time|time_machine|freezegun') HAVING count(*) > 0")
register("BHCFG004", f"SELECT t.path, a.line, 'note' AS severity, concat(t.name, ' is an operational constant outside configuration') AS message FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name' JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'value' AND v.kind = 'Constant' WHERE a.kind IN ('Assign', 'AnnAssign') AND a.parent = 0 AND lower(t.name) RLIKE '{CONFIG_NAME}' AND t.name <> upper(t.name) AND lower(a.path) NOT RLIKE '{CONFIG_MODULE}'")
register(
    "BHCFG005",
    f"""SELECT k.path, k.line, 'note' AS severity, concat('literal ', k.name, ' at a call') AS message FROM {{n}} k JOIN {{n}} c ON c.path = k.path AND c.lo = k.parent AND c.kind = 'Call'
    JOIN {{n}} v ON v.path = k.path AND v.parent = k.lo LEFT JOIN {{n}} u ON u.path = v.path AND u.parent = v.lo AND v.kind = 'UnaryOp' AND v.name IN ('USub', 'UAdd') AND u.vtype IN ('int', 'float')
    WHERE k.kind = 'keyword' AND lower(k.name) RLIKE '{CONFIG_NAME}' AND lower(k.path) NOT RLIKE '{CONFIG_MODULE}' AND (v.vtype IN ('int', 'float', 'bool') OR v.vtype = 'str' AND v.value <> '' OR u.path IS NOT NULL)""",
)
register(
    "BHIMPL001",
    f"SELECT f.path, f.line, 'warning' AS severity, concat(f.name, ' is a public stub') AS message FROM {{n}} f WHERE f.kind IN {FUNCS} AND f.name NOT LIKE '\\\\_%' AND f.path NOT LIKE 'tests/%' AND EXISTS (SELECT 1 FROM {{n}} r JOIN {{n}} e ON e.path = r.path AND e.parent = r.lo WHERE r.path = f.path AND r.parent = f.lo AND r.kind = 'Raise' AND e.name = 'NotImplementedError') AND (SELECT count(*) FROM {{n}} b WHERE b.path = f.path AND b.parent = f.lo AND b.field = 'body') <= 2 AND NOT EXISTS (SELECT 1 FROM {{n}} t WHERE t.path LIKE 'tests/%' AND t.kind IN ('Name', 'Attribute', 'alias') AND substring_index(t.name, '.', -1) = f.name)",
)


#: Ancestors that rules ask for, as a condition on nodes.
AROUND = f"kind IN {FUNCS} OR kind IN {LOOPS} OR kind IN ('Try', 'Assert', 'Assign', 'Compare') OR field = 'finalbody' OR kind = 'Call' AND lower(name) RLIKE '({QUANTITIES}|{INTEGRATORS})'"


def run(nodes: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Findings of the given rules, all of them by default: code, path, line, severity, message.

    The nodes are written once, dealt out by path, and what stands around each is found once, in a pass over them.
    """
    spark, nodes = nodes.sparkSession, bucketed(nodes, "nodes", "path", "kind", "field", "path", "lo")
    rules = {code: sql for code, sql in RULES.items() if codes is None or code in codes}
    around = nodes.where(AROUND).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), "lo", "hi", "bfs", "field", "kind", "name", "line", "func")
    if any("{a}" in sql for sql in rules.values()):
        around = bucketed(enclosing(nodes.select("path", F.col("lo").alias("place")), around).drop("start", "stop").withColumnRenamed("place", "below"), "around", "path", "kind", "path", "below")
    found = [spark.sql(sql, n=nodes, a=around).withColumn("code", F.lit(code)).select("code", "path", "line", "severity", "message") for code, sql in rules.items()]
    return reduce(DataFrame.unionByName, found)


def in_order(findings: DataFrame) -> DataFrame:
    """The order in which findings are shown."""
    return findings.orderBy("path", "line", "code", "message")


def env_uses(nodes: DataFrame) -> DataFrame:
    """name, path, line, required: environment variables read by subscript (required) or by get (not)."""
    return nodes.sparkSession.sql(
        """SELECT v.value AS name, x.path, x.line, x.kind = 'Subscript' AS required FROM {n} x JOIN {n} v ON v.path = x.path AND v.parent = x.lo AND v.kind = 'Constant' AND v.field IN ('args', 'slice')
        WHERE x.kind = 'Subscript' AND x.name = 'os.environ' OR x.kind = 'Call' AND x.name IN ('os.getenv', 'os.environ.get')""",
        n=nodes,
    )


# ---------------------------------------------------------------- streams and fields

_CALLS = """calls AS (
  SELECT c.path, c.func, c.lo, c.line, v.name AS var, substring_index(c.name, '.', -1) AS method, NOT EXISTS (SELECT 1 FROM {n} x WHERE x.path = c.path AND x.parent = c.lo AND x.field IN ('args', 'keywords')) AS bare
  FROM {n} c JOIN {n} a ON a.path = c.path AND a.parent = c.lo AND a.field = 'func' AND a.kind = 'Attribute' JOIN {n} v ON v.path = c.path AND v.parent = a.lo AND v.kind = 'Name' WHERE c.kind = 'Call' AND c.func >= 0),
opens AS (
  SELECT a.path, a.func, a.lo, a.line, t.name AS var, coalesce(max(CASE WHEN m.field = 'args' THEN m.value END), max(k.value), 'r') AS mode
  FROM {n} a JOIN {n} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'optional_vars') AND t.kind = 'Name'
  JOIN {n} c ON c.path = a.path AND c.parent = a.lo AND c.field IN ('value', 'context_expr') AND c.kind = 'Call' AND substring_index(c.name, '.', -1) = 'open'
  LEFT JOIN {n} m ON m.path = a.path AND m.parent = c.lo AND m.field = 'args' AND m.kind = 'Constant' AND m.lo > c.lo + 2 AND m.value RLIKE '^[rwaxbt+]+$'
  LEFT JOIN {n} w ON w.path = a.path AND w.parent = c.lo AND w.kind = 'keyword' AND w.name = 'mode' LEFT JOIN {n} k ON k.path = a.path AND k.parent = w.lo AND k.kind = 'Constant'
  WHERE a.kind IN ('Assign', 'withitem') AND a.func >= 0 GROUP BY a.path, a.func, a.lo, a.line, t.name),
events AS (
  SELECT path, func, lo, line, var, 'open' AS op, mode FROM opens UNION ALL
  SELECT path, func, lo, line, var, CASE WHEN method = 'close' AND bare THEN 'close' WHEN method = 'close' THEN 'other' ELSE method END, CAST(NULL AS STRING) FROM calls),
state AS (
  SELECT *, last_value(CASE WHEN op IN ('open', 'close') THEN op END) IGNORE NULLS OVER w AS phase, last_value(mode) IGNORE NULLS OVER w AS now
  FROM events WINDOW w AS (PARTITION BY path, func, var ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
register("BHPRT005", f"WITH {_CALLS} SELECT path, line, 'error' AS severity, concat(var, '.', op, '() after close()') AS message FROM state WHERE op NOT IN ('open', 'close', 'other') AND phase = 'close'")
register(
    "BHPRT006",
    f"""WITH {_CALLS} SELECT path, line, 'error' AS severity, concat(var, ' is open with mode ', now) AS message FROM state WHERE coalesce(phase, '') <> 'close'
    AND (now IN ('w', 'wb', 'a', 'ab', 'x', 'xb') AND op IN ('read', 'readline', 'readlines') OR now IN ('r', 'rb') AND op IN ('write', 'writelines'))""",
)
register(
    "BHPRT008",
    """WITH s AS (SELECT a.path, a.func, a.parent, a.field, a.lo, a.hi, a.line, t.lo AS t_lo, t.hi AS t_hi, t.name AS base, k.value AS key,
      lead(a.lo) OVER w AS next_lo, lead(a.hi) OVER w AS next_hi, lead(t.lo) OVER w AS next_t_lo, lead(t.hi) OVER w AS next_t_hi
      FROM {n} a JOIN {n} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'targets' AND t.kind = 'Subscript' JOIN {n} v ON v.path = a.path AND v.parent = t.lo AND v.field = 'value' AND v.kind = 'Name'
      JOIN {n} k ON k.path = a.path AND k.parent = t.lo AND k.field = 'slice' AND k.kind = 'Constant' WHERE a.kind = 'Assign' AND a.func >= 0
      WINDOW w AS (PARTITION BY a.path, a.parent, a.field, t.name, k.value ORDER BY a.lo))
    SELECT path, line, 'warning' AS severity, concat(base, '[', key, '] is stored twice and not read between') AS message FROM s WHERE next_lo IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM {n} r WHERE r.path = s.path AND r.kind = 'Name' AND r.name = s.base AND r.lo > s.hi AND r.lo <= s.next_hi AND NOT (r.lo >= s.next_t_lo AND r.lo <= s.next_t_hi)
        AND NOT EXISTS (SELECT 1 FROM {n} o WHERE o.path = r.path AND o.lo = r.parent AND o.kind = 'Subscript' AND o.field = 'targets'))""",
)
_IMPORTS = lambda module: f"EXISTS (SELECT 1 FROM {{n}} i WHERE i.path = b.path AND (i.kind = 'ImportFrom' OR i.kind = 'alias') AND i.name RLIKE '^{module}([.]|$)')"
register("BHPRT012", f"SELECT b.path, b.line, 'error' AS severity, concat('Python ', lower(b.name), ' over SQL expressions') AS message FROM {{n}} b WHERE b.kind = 'BoolOp' AND {_IMPORTS('sqlalchemy')} AND EXISTS (SELECT 1 FROM {{n}} c WHERE c.path = b.path AND c.parent = b.lo AND c.kind = 'Compare')")
_TRUE = lambda name: f"EXISTS (SELECT 1 FROM {{n}} k JOIN {{n}} v ON v.path = k.path AND v.parent = k.lo WHERE k.path = b.path AND k.parent = b.lo AND k.kind = 'keyword' AND k.name = '{name}' AND v.value = 'True')"
register("BHPRT013", f"SELECT b.path, b.line, 'error' AS severity, 'null=True has no effect on a many-to-many field' AS message FROM {{n}} b WHERE b.kind = 'Call' AND b.name RLIKE '(^|[.])ManyToManyField$' AND {_IMPORTS('django')} AND {_TRUE('null')}")
register("BHPRT014", f"SELECT b.path, b.line, 'warning' AS severity, 'unique=True beside primary_key=True' AS message FROM {{n}} b WHERE b.kind = 'Call' AND {_IMPORTS('django')} AND {_TRUE('primary_key')} AND {_TRUE('unique')}")
register("BHPRT015", f"SELECT b.path, b.line, 'warning' AS severity, concat(k.name, ' is no database constraint') AS message FROM {{n}} b JOIN {{n}} k ON k.path = b.path AND k.parent = b.lo AND k.kind = 'keyword' AND k.name IN ('unique_for_date', 'unique_for_month', 'unique_for_year') WHERE b.kind = 'Call' AND {_IMPORTS('django')}")

# ---------------------------------------------------------------- layers, seams, data

#: Words of module paths; fixed values.
UPPER_LAYER = "api|apis|route|routes|web|ui|service|services|domain|core|application|usecase|usecases|handler|handlers|controller|controllers"
STORAGE = "sqlite|postgres|postgresql|mysql|sqlalchemy|peewee|orm|mongo|mongodb|redis"

register("BHPERS001", f"SELECT path, line, 'warning' AS severity, concat('upper layer imports storage implementation ', name) AS message FROM {_TOP_IMPORTS} WHERE lower(path) RLIKE '(^|[/_.-])({UPPER_LAYER})([/_.-]|$)' AND lower(name) RLIKE '(^|[._-])({STORAGE})([._-]|$)'")
register(
    "BHPERS002",
    f"""WITH i AS (SELECT a.path, coalesce(a.value, CASE WHEN p.kind = 'Import' THEN substring_index(a.name, '.', 1) ELSE a.name END) AS alias FROM {{n}} a JOIN {{n}} p ON p.path = a.path AND p.lo = a.parent AND p.parent = 0
      WHERE a.kind = 'alias' AND lower(CASE WHEN p.kind = 'Import' THEN a.name ELSE p.name END) RLIKE '(^|[._-])({STORAGE})([._-]|$)'),
    s AS (SELECT t.path, t.line, f.name, t.value AS annotation FROM {{n}} f JOIN {{n}} t ON t.path = f.path AND t.field = 'returns' AND t.parent = f.lo WHERE f.kind IN {FUNCS} AND f.parent = 0 AND f.name NOT LIKE '\\\\_%'
      UNION ALL SELECT g.path, g.line, f.name, t.value FROM {{n}} f JOIN {{n}} l ON l.path = f.path AND l.parent = f.lo AND l.kind = 'arguments' JOIN {{n}} g ON g.path = f.path AND g.parent = l.lo AND g.kind = 'arg' JOIN {{n}} t ON t.path = f.path AND t.parent = g.lo AND t.field = 'annotation'
      WHERE f.kind IN {FUNCS} AND f.parent = 0 AND f.name NOT LIKE '\\\\_%')
    SELECT DISTINCT s.path, s.line, 'warning' AS severity, concat('public function ', s.name, ' shows the storage type ', s.annotation) AS message FROM s JOIN i ON i.path = s.path AND s.annotation RLIKE concat('\\\\b\\\\Q', i.alias, '\\\\E\\\\b')
    WHERE lower(s.path) RLIKE '(^|[/_.-])({UPPER_LAYER})([/_.-]|$)'""",
)
register(
    "BHSEAM005",
    """SELECT DISTINCT a.path, a.line, 'warning' AS severity, concat('HTTP JSON enters ', t.name, ' and is read by key without validation') AS message FROM {n} a
    JOIN {n} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'targets' AND t.kind = 'Name' JOIN {n} c ON c.path = a.path AND c.parent = a.lo AND c.field = 'value' AND c.kind = 'Call' AND c.name RLIKE '(response|resp|requests|httpx|client|session|res|r)([.].*)?[.]json$'
    JOIN {n} s ON s.path = a.path AND s.func = a.func AND s.kind = 'Subscript' AND s.name = t.name AND s.lo > a.hi WHERE a.kind = 'Assign' AND a.func >= 0
      AND NOT EXISTS (SELECT 1 FROM {n} v JOIN {n} g ON g.path = v.path AND g.parent = v.lo AND g.kind = 'Name' AND g.name = t.name WHERE v.path = a.path AND v.func = a.func AND v.kind = 'Call' AND v.name RLIKE '(validate|model_validate|parse_obj|TypeAdapter|load|check)')""",
)
register(
    "BHSEAM006",
    """SELECT min_by(path, struct(path, line)) AS path, min_by(line, struct(path, line)) AS line, 'warning' AS severity, concat(count(*), ' HTTP calls without recorded payloads in tests') AS message FROM {n}
    WHERE kind = 'Call' AND path NOT LIKE 'tests/%' AND lower(name) RLIKE '(requests|httpx|client|session).*[.](get|post|put|patch|delete|request|send)$'
      AND NOT EXISTS (SELECT 1 FROM {n} t WHERE t.path LIKE 'tests/%' AND lower(concat(coalesce(t.name, ''), ' ', coalesce(t.value, ''))) RLIKE 'vcr|cassette|responses|respx|recorded_payload|fixture_payload') HAVING count(*) > 0""",
)
register(
    "BHMISS001",
    f"""WITH z AS (SELECT c.* FROM {{n}} c JOIN {{n}} v ON v.path = c.path AND v.parent = c.lo AND v.field = 'args' AND v.value IN ('0', '0.0') WHERE c.kind = 'Call' AND c.name RLIKE '[.]fillna$|^fillna$' AND c.func >= 0),
    u AS (SELECT z.path, z.func, t.name FROM z JOIN {{a}} a ON {_inside('z', 'a')} AND a.kind = 'Assign' AND a.func = z.func JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'targets' AND t.kind = 'Name'),
    h AS (SELECT k.path, k.func, k.line, k.name, k.lo FROM {{a}} k JOIN {{n}} x ON {_inside('x', 'k')} LEFT JOIN u ON u.path = x.path AND u.func = x.func AND u.name = x.name AND x.kind = 'Name' LEFT JOIN z ON z.path = x.path AND z.lo = x.lo
      WHERE k.kind = 'Call' AND lower(k.name) RLIKE '({QUANTITIES}|{INTEGRATORS})' AND (u.name IS NOT NULL OR z.lo IS NOT NULL))
    SELECT path, min(line) AS line, 'error' AS severity, concat('zero put for a missing value flows into ', min_by(name, lo)) AS message FROM h GROUP BY path, func""",
)
register(
    "BHMETA001",
    f"""SELECT d.path, d.line, 'error' AS severity, 'a quantity stands beside complete or full coverage' AS message FROM {{n}} d JOIN {{n}} k ON k.path = d.path AND k.parent = d.lo AND k.field = 'keys' AND k.kind = 'Constant'
    JOIN (SELECT *, row_number() OVER (PARTITION BY path, parent, field ORDER BY lo) AS nth FROM {{n}} WHERE field = 'keys') kk ON kk.path = k.path AND kk.lo = k.lo
    JOIN (SELECT *, row_number() OVER (PARTITION BY path, parent, field ORDER BY lo) AS nth FROM {{n}} WHERE field = 'values') vv ON vv.path = k.path AND vv.parent = d.lo AND vv.nth = kk.nth
    WHERE d.kind = 'Dict' GROUP BY d.path, d.lo, d.line
    HAVING count_if(k.value = 'complete' AND vv.value = 'True' OR k.value = 'coverage' AND vv.value IN ('1', '1.0')) > 0 AND count_if(lower(k.value) RLIKE '{QUANTITIES}') > 0""",
)
register(
    "BHDF001",
    """WITH s AS (SELECT a.path, a.func, a.lo, a.line, t.name AS base, k.value AS col, a.hi FROM {n} a JOIN {n} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'targets' AND t.kind = 'Subscript' JOIN {n} k ON k.path = a.path AND k.parent = t.lo AND k.field = 'slice' AND k.kind = 'Constant' WHERE a.kind = 'Assign' AND a.func >= 0),
    r AS (SELECT s.*, q.value AS source FROM s JOIN {n} x ON x.path = s.path AND x.lo > s.lo AND x.lo <= s.hi AND x.kind = 'Subscript' AND x.name = s.base AND x.field <> 'targets' JOIN {n} q ON q.path = s.path AND q.parent = x.lo AND q.field = 'slice' AND q.kind = 'Constant' WHERE q.value <> s.col),
    e AS (SELECT c.path, c.func, c.lo, c.line, regexp_extract(c.name, '^([A-Za-z_0-9]+)[.]', 1) AS base FROM {n} c WHERE c.kind = 'Call' AND c.name RLIKE '[.]to_(dict|csv|parquet|json)$')
    SELECT e.path, min(e.line) AS line, 'error' AS severity, concat(r.col, ' is exported after ', r.source, ' changed') AS message FROM r JOIN s m ON m.path = r.path AND m.func = r.func AND m.base = r.base AND m.col = r.source AND m.lo > r.lo
    JOIN e ON e.path = r.path AND e.func = r.func AND e.base = r.base AND e.lo > m.lo WHERE NOT EXISTS (SELECT 1 FROM s d WHERE d.path = r.path AND d.func = r.func AND d.base = r.base AND d.col = r.col AND d.lo > m.lo AND d.lo < e.lo) GROUP BY e.path, r.func, r.col, r.source""",
)
register(
    "BHTEST005",
    f"SELECT DISTINCT v.path, v.line, 'warning' AS severity, 'long literal against generated text' AS message FROM {{n}} v JOIN {{a}} c ON c.path = v.path AND c.lo = v.parent AND c.kind = 'Compare' JOIN {{a}} a ON {_inside('c', 'a')} AND a.kind = 'Assert' JOIN {{n}} o ON {_inside('o', 'c')} AND lower(o.name) RLIKE '(source|generated|render|output|code)' WHERE v.kind = 'Constant' AND length(v.value) >= 200 AND v.path LIKE 'tests/%'",
)

# ---------------------------------------------------------------- seams, evidence, intervals, artifacts

#: Calls that hand a dictionary over; fixed values.
BOUNDARIES = "'json.dump', 'json.dumps', 'send', 'sendall', 'put', 'put_nowait', 'publish', 'emit', 'write', 'write_text', 'write_bytes', 'save'"
register(
    "BHSEAM001",
    f"""WITH e AS (
      SELECT a.path, a.func, t.name AS var, k.value AS key, 'write' AS op, a.lo, a.line FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name'
        JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'value' AND v.kind = 'Dict' LEFT JOIN {{n}} k ON k.path = a.path AND k.parent = v.lo AND k.field = 'keys' AND k.vtype = 'str' WHERE a.kind IN ('Assign', 'AnnAssign')
      UNION ALL SELECT s.path, s.func, b.name, k.value, CASE WHEN s.field IN ('targets', 'target') THEN 'write' ELSE 'read' END, s.lo, s.line FROM {{n}} s JOIN {{n}} b ON b.path = s.path AND b.parent = s.lo AND b.field = 'value' AND b.kind = 'Name'
        JOIN {{n}} k ON k.path = s.path AND k.parent = s.lo AND k.field = 'slice' AND k.vtype = 'str' WHERE s.kind = 'Subscript'
      UNION ALL SELECT c.path, c.func, b.name, k.value, CASE substring_index(c.name, '.', -1) WHEN 'setdefault' THEN 'write' WHEN 'get' THEN 'soft' ELSE 'read' END, c.lo, c.line FROM {{n}} c JOIN {{n}} m ON m.path = c.path AND m.parent = c.lo AND m.field = 'func' AND m.kind = 'Attribute'
        JOIN {{n}} b ON b.path = c.path AND b.parent = m.lo AND b.kind = 'Name' JOIN {{n}} k ON k.path = c.path AND k.lo = m.hi + 1 AND k.parent = c.lo AND k.vtype = 'str'
        WHERE c.kind = 'Call' AND substring_index(c.name, '.', -1) IN ('get', 'pop', 'setdefault') AND NOT (c.name LIKE '%.get' AND k.value LIKE '/%')),
    d AS (SELECT path, func, var, min(lo) AS lo, min_by(line, lo) AS line, collect_set(CASE WHEN op = 'write' THEN key END) AS written, collect_set(CASE WHEN op = 'soft' THEN key END) AS soft, collect_set(CASE WHEN op = 'read' THEN key END) AS reads FROM e WHERE func >= 0 GROUP BY path, func, var),
    m AS (SELECT *, array_sort(array_except(array_except(reads, soft), written)) AS missing FROM d)
    SELECT path, line, 'error' AS severity, concat(var, ' is handed over, and its keys ', array_join(missing, ', '), ' are read but never written') AS message FROM m WHERE size(missing) > 0 AND EXISTS (
      SELECT 1 FROM {{n}} x JOIN {{n}} c ON c.path = x.path AND c.lo = x.parent AND c.kind = 'Call' WHERE x.path = m.path AND x.func = m.func AND x.field = 'args' AND x.kind = 'Name' AND x.name = m.var AND c.lo > m.lo
        AND (substring_index(c.name, '.', -1) IN ({BOUNDARIES}) OR c.name IN ({BOUNDARIES})))""",
)
_BROAD = lambda c: f"(replace({c}, ' ', '') IN ('Any', 'typing.Any', 'object', 'builtins.object') OR {c} LIKE '%Any%' AND replace({c}, ' ', '') RLIKE '^(dict|Mapping|MutableMapping)[\\\\[]')"
register(
    "BHEVID001",
    f"""WITH k AS (
      SELECT g.path, g.func, g.name AS var, t.value AS type, -1 AS bfs FROM {{n}} g JOIN {{n}} t ON t.path = g.path AND t.parent = g.lo AND t.field = 'annotation' WHERE g.kind = 'arg' AND g.field IN ('posonlyargs', 'args', 'kwonlyargs')
      UNION ALL SELECT a.path, a.func, v.name, t.value, a.bfs FROM {{n}} a JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'target' AND v.kind = 'Name' JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'annotation' WHERE a.kind = 'AnnAssign' AND a.func >= 0),
    w AS (SELECT a.path, a.func, a.bfs, v.name AS var, s.name AS source, max_by(k.type, k.bfs) AS type FROM {{n}} a JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'target' AND v.kind = 'Name' JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'annotation'
      JOIN {{n}} s ON s.path = a.path AND s.parent = a.lo AND s.field = 'value' AND s.kind = 'Name' JOIN k ON k.path = a.path AND k.func = a.func AND k.var = s.name AND k.bfs < a.bfs WHERE a.kind = 'AnnAssign' AND {_BROAD('t.value')} GROUP BY a.path, a.func, a.bfs, v.name, s.name)
    SELECT DISTINCT c.path, c.line, 'error' AS severity, concat(w.source, ' of type ', w.type, ' is widened into ', w.var, ' and cast back') AS message FROM {{n}} c JOIN {{n}} f ON f.path = c.path AND f.parent = c.lo AND f.field = 'func'
    JOIN {{n}} t ON t.path = c.path AND t.lo = f.hi + 1 AND t.field = 'args' JOIN {{n}} x ON x.path = c.path AND x.lo = t.hi + 1 AND x.parent = c.lo AND x.field = 'args' AND x.kind = 'Name' JOIN w ON w.path = c.path AND w.func = c.func AND w.var = x.name AND w.bfs < c.bfs
    WHERE c.kind = 'Call' AND substring_index(c.name, '.', -1) = 'cast' AND NOT {_BROAD('w.type')}""",
)
register(
    "BHINT001",
    f"""WITH m AS (SELECT a.path, a.func, t.name FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name' JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'value' AND (v.kind = 'BoolOp' AND v.name = 'And' OR v.kind = 'BinOp' AND v.name = 'BitAnd')
      JOIN {{n}} c ON c.path = a.path AND c.lo > v.lo AND c.lo <= v.hi AND c.kind = 'Compare' WHERE a.kind IN ('Assign', 'NamedExpr') AND a.func >= 0 GROUP BY a.path, a.func, a.lo, t.name HAVING count_if(c.name IN ('GtE', 'Gt')) > 0 AND count_if(c.name = 'Lt') > 0)
    SELECT c.path, min_by(c.line, c.bfs) AS line, 'error' AS severity, 'a half-open selection feeds an integrator of neighbouring samples' AS message FROM {{n}} c JOIN {{n}} f ON f.path = c.path AND f.parent = c.lo AND f.field = 'func'
    JOIN {{n}} x ON x.path = c.path AND x.lo > f.hi AND x.lo <= c.hi AND x.kind = 'Name' JOIN m ON m.path = c.path AND m.func = c.func AND m.name = x.name WHERE c.kind = 'Call' AND lower(c.name) RLIKE '({INTEGRATORS})' GROUP BY c.path, c.func""",
)
#: Parts of names of values over the time before, and beginnings of names of the time ahead; fixed values.
TRAILING = "trailing|tan_dose_30m"
FORWARD_START = "best_|window_start"
register(
    "BHINT002",
    f"""WITH t AS (
      SELECT path, func, name, -1 AS bfs FROM {{n}} WHERE kind = 'arg' AND field IN ('args', 'kwonlyargs') AND lower(name) RLIKE '({TRAILING})'
      UNION ALL SELECT a.path, a.func, v.name, a.bfs FROM {{n}} a JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'targets' AND v.kind = 'Name' WHERE a.kind = 'Assign' AND lower(v.name) RLIKE '({TRAILING})'),
    u AS (SELECT a.path, a.func, a.bfs, a.line, s.name, concat(s.name, ', a value over the time before, starts ', v.name) AS message FROM {{n}} a JOIN {{n}} v ON v.path = a.path AND v.parent = a.lo AND v.field = 'targets' AND v.kind = 'Name' AND lower(v.name) RLIKE '^({FORWARD_START})' AND lower(v.name) NOT RLIKE '({TRAILING})'
        JOIN {{n}} s ON s.path = a.path AND s.parent = a.lo AND s.field = 'value' AND s.kind = 'Name' WHERE a.kind = 'Assign'
      UNION ALL SELECT k.path, k.func, k.bfs, c.line, s.name, concat(s.name, ', a value over the time before, is passed as ', k.name) FROM {{n}} k JOIN {{n}} c ON c.path = k.path AND c.lo = k.parent AND c.kind = 'Call' JOIN {{n}} s ON s.path = k.path AND s.parent = k.lo AND s.kind = 'Name' WHERE k.kind = 'keyword' AND k.name IN ('start', 'begin', 'start_ts'))
    SELECT DISTINCT u.path, u.line, 'error' AS severity, u.message FROM u JOIN t ON t.path = u.path AND t.func = u.func AND t.name = u.name AND t.bfs < u.bfs WHERE u.func >= 0""",
)
#: Suffixes of files that are kept, and parts of names that tell of freshness; fixed values.
ARTIFACTS = "[.](parquet|pkl|pickle|npz|npy|joblib|onnx)"
FRESHNESS = "exists|stat|mtime|fresh|stale|manifest|_version|version|valid"
STATEMENTS = "('Assign', 'AugAssign', 'AnnAssign', 'Expr', 'Return', 'Delete', 'For', 'AsyncFor', 'While', 'If', 'With', 'AsyncWith', 'Raise', 'Try', 'TryStar', 'Assert', 'Import', 'ImportFrom', 'Global', 'Nonlocal', 'Pass', 'Break', 'Continue', 'Match')"
register(
    "BHART001",
    f"""WITH s AS (SELECT f.path, f.lo AS f, s.lo, s.hi, s.bfs FROM {{a}} f JOIN {{n}} s ON {_inside('s', 'f')} AND s.kind IN {STATEMENTS} WHERE f.kind IN {FUNCS}),
    fresh AS (SELECT path, lo FROM {{n}} WHERE kind = 'Call' AND lower(name) RLIKE '({FRESHNESS})'
      UNION ALL SELECT c.path, c.lo FROM {{n}} c JOIN {{n}} k ON k.path = c.path AND k.parent = c.lo AND k.vtype = 'str' AND lower(k.value) RLIKE '({FRESHNESS})' WHERE c.kind = 'Compare'),
    reads AS (SELECT c.path, c.lo, c.bfs, min(c.line) AS line FROM {{n}} c JOIN {{n}} g ON g.path = c.path AND g.parent = c.lo AND g.field = 'func' JOIN {{n}} k ON k.path = c.path AND k.lo > g.hi AND k.lo <= c.hi AND k.vtype = 'str' AND k.value RLIKE '({ARTIFACTS})$' WHERE c.kind = 'Call' GROUP BY c.path, c.lo, c.bfs),
    r AS (SELECT s.path, s.f, min_by(x.line, struct(s.bfs, x.bfs)) AS line, min(s.bfs) AS bfs FROM s JOIN reads x ON x.path = s.path AND x.lo >= s.lo AND x.lo <= s.hi GROUP BY s.path, s.f),
    v AS (SELECT s.path, s.f, min(s.bfs) AS bfs FROM s JOIN fresh x ON x.path = s.path AND x.lo >= s.lo AND x.lo <= s.hi GROUP BY s.path, s.f)
    SELECT r.path, r.line, 'warning' AS severity, 'a kept file is read before it is checked for freshness' AS message FROM r LEFT JOIN v ON v.path = r.path AND v.f = r.f WHERE v.bfs IS NULL OR v.bfs > r.bfs""",
)
register(
    "BHART002",
    f"""WITH k AS (SELECT f.path, f.lo, f.name, f.line, collect_set(CASE WHEN x.kind = 'Name' THEN x.name ELSE x.value END) AS keys FROM {{a}} f JOIN {{n}} x ON {_inside('x', 'f')}
      AND (x.kind = 'Name' AND x.name = upper(x.name) AND x.name RLIKE '[A-Z]' AND x.name LIKE '%\\\\_%' OR x.vtype = 'str' AND x.value = upper(x.value) AND x.value RLIKE '[A-Z]' AND x.value LIKE '%\\\\_%') WHERE f.kind IN {FUNCS} GROUP BY f.path, f.lo, f.name, f.line)
    SELECT c.path, c.line, 'error' AS severity, concat(c.name, ' leaves out settings that ', b.name, ' reads: ', array_join(array_sort(array_except(b.keys, c.keys)), ', ')) AS message FROM k b JOIN k c ON c.path = b.path AND c.lo <> b.lo
    WHERE lower(b.name) RLIKE '(build|compute|refresh|update|make)' AND size(b.keys) >= 2 AND lower(c.name) RLIKE '(fresh|valid|stale|manifest|version|check)' AND size(array_except(b.keys, c.keys)) > 0""",
)
register(
    "BHMETA002",
    f"""WITH d AS (
      SELECT path, func, name FROM {{n}} WHERE kind = 'arg' AND field IN ('args', 'kwonlyargs')
      UNION SELECT a.path, a.func, t.name FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field IN ('targets', 'target') AND t.kind = 'Name' WHERE a.kind IN ('Assign', 'AnnAssign')
      UNION SELECT a.path, a.func, k.value FROM {{n}} a JOIN {{n}} t ON t.path = a.path AND t.parent = a.lo AND t.field = 'targets' AND t.kind = 'Subscript' JOIN {{n}} b ON b.path = a.path AND b.parent = t.lo AND b.field = 'value' AND b.kind = 'Name' JOIN {{n}} k ON k.path = a.path AND k.parent = t.lo AND k.field = 'slice' AND k.vtype = 'str' WHERE a.kind = 'Assign'),
    r AS (SELECT DISTINCT x.path, x.func, x.lo, x.line, k.value AS key FROM {{n}} x JOIN {{n}} o ON o.path = x.path AND o.parent = x.lo AND o.kind = 'Dict' JOIN {{n}} k ON k.path = x.path AND k.parent = o.lo AND k.field = 'keys' AND k.vtype = 'str' WHERE x.kind = 'Return' AND x.func >= 0),
    c AS (SELECT r.*, concat(CASE WHEN length(key) - length(replace(key, '_', '')) >= 2 THEN regexp_replace(key, '_[^_]*_[^_]*$', '') ELSE key END, s) AS wanted FROM r LATERAL VIEW explode(array('{"', '".join(QUALITY)}')) x AS s WHERE lower(key) NOT RLIKE '.({"|".join(QUALITY)})$')
    SELECT c.path, c.line, 'warning' AS severity, concat(c.key, ' is returned without ', array_join(array_sort(collect_set(c.wanted)), ', ')) AS message FROM c JOIN d ON d.path = c.path AND d.func = c.func AND d.name = c.wanted
    LEFT ANTI JOIN r ON r.path = c.path AND r.lo = c.lo AND r.key = c.wanted GROUP BY c.path, c.lo, c.line, c.key""",
)
