"""The given tables seen as findings, results, ledgers, edges and the like; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str | None], index: str) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.expr(f"cast({index} AS INT) + 1"))


TOOLS = ["ruff", "mypy", "basedpyright", "pyrefly", "ty"]
CATEGORIES = ["lint", "types", "contract-drift", "runtime-validation", "complexity-budgets"]
SEVERITIES = ["error", "warning", "note", "info"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "BHCOV001").when(F.col("event_type") == "purchase", "BHCOV002").when(F.col("event_type") == "view", "F401").when(F.col("event_type") == "click", "misc")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        _pick(TOOLS, "event_id % 5").alias("tool"),
        _pick(TOOLS, "event_id % 5").alias("result_name"),
        _pick(CATEGORIES, "event_id % 5").alias("category"),
        F.expr("concat('Name `v', event_id % 7, '` at /tmp/x', event_id, ' value ', user_id)").alias("message"),
        F.expr("concat('src/m', user_id % 20, '.py')").alias("path"),
        F.expr("cast(cast(floor(value) AS INT) % 50 AS INT)").alias("line"),
        code.alias("code"),
        _pick(SEVERITIES, "event_id % 4").alias("severity"),
        F.expr("event_id % 3 = 0").alias("fixable"),
        _pick(["safe", "unsafe", None], "floor((event_id % 9) / 3)").alias("fix_safety"),
        F.lit(False).alias("accepted"),
    )


FINDINGS_SQL = """f AS (
  SELECT event_id AS seq, ['ruff', 'mypy', 'basedpyright', 'pyrefly', 'ty'][event_id % 5 + 1] AS tool,
         ['ruff', 'mypy', 'basedpyright', 'pyrefly', 'ty'][event_id % 5 + 1] AS result_name,
         ['lint', 'types', 'contract-drift', 'runtime-validation', 'complexity-budgets'][event_id % 5 + 1] AS category,
         'Name `v' || (event_id % 7) || '` at /tmp/x' || event_id || ' value ' || user_id AS message,
         'src/m' || (user_id % 20) || '.py' AS path, CAST(floor(value) AS INTEGER) % 50 AS line,
         CASE event_type WHEN 'error' THEN 'BHCOV001' WHEN 'purchase' THEN 'BHCOV002' WHEN 'view' THEN 'F401' WHEN 'click' THEN 'misc' END AS code,
         ['error', 'warning', 'note', 'info'][event_id % 4 + 1] AS severity, event_id % 3 = 0 AS fixable,
         ['safe', 'unsafe', NULL][(event_id % 9) // 3 + 1] AS fix_safety
  FROM events)"""

MARK_SQL = "substr(sha256(tool || '|' || coalesce(code, '') || '|' || path || '|' || trim(message)), 1, 16)"
SHAPE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(message), '`[^`]+`', '`<symbol>`', 'g'),
  '(?:[A-Za-z]:)?[/\\][^\s:]+', '<path>', 'g'), '\b0x[0-9a-f]+\b', '<hex>', 'g'), '\b\d+(?:\.\d+)?\b', '<n>', 'g'), '\s+', ' ', 'g'))"""
KEY_SQL = f"""CASE WHEN coalesce(code, '') = '' OR lower(code) IN ('misc', 'unknown', 'none', '-1', '-2')
  THEN tool || ':' || coalesce(code || ':', '') || substr({SHAPE_SQL}, 1, 180) ELSE tool || ':' || code END"""
_ANY = lambda *words: " OR ".join(f"contains(lower(category || ' ' || coalesce(code, '')), '{w}')" for w in words)
CLASS_SQL = f"""CASE WHEN {_ANY('seam', 'api', 'schema', 'architecture', 'contract', 'migration')} THEN 'interface'
  WHEN {_ANY('concurrency', 'async', 'time', 'random', 'matrix')} THEN 'timing/serialization'
  WHEN {_ANY('package', 'build', 'dependency', 'ci-')} THEN 'build/package/merge'
  WHEN {_ANY('doc', 'doctest')} THEN 'documentation'
  WHEN {_ANY('complexity', 'performance', 'benchmark', 'memory')} THEN 'algorithm'
  WHEN {_ANY('type', 'coverage', 'test', 'validation', 'lint', 'static')} THEN 'checking' ELSE 'function' END"""
RANK_SQL = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 0 WHEN 'error' THEN 0 WHEN 'note' THEN 2 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 1 END"
WEIGHT_SQL = "CASE lower(severity) WHEN 'critical' THEN 8 WHEN 'high' THEN 8 WHEN 'error' THEN 6 WHEN 'note' THEN 1 WHEN 'low' THEN 1 WHEN 'info' THEN 1 ELSE 3 END"

STATUSES = ["PASS", "FINDINGS", "SKIPPED", "ERROR", "N/A"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check for each supplier; every fifth one is named after a tool, some with a suffix."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("seq"),
        F.when(F.expr("s_suppkey % 5 = 1"), F.concat(_pick(TOOLS, "floor(s_suppkey / 5) % 5"), F.when(F.expr("s_suppkey % 2 = 0"), F.concat(F.lit(":"), F.col("s_nationkey").cast("string"))).otherwise(""))).otherwise(F.expr("concat('d', s_suppkey)")).alias("name"),
        F.expr("concat('cat', s_nationkey)").alias("category"),
        _pick(STATUSES, "s_suppkey % 5").alias("status"),
        F.expr("concat('run ', s_name)").alias("command"),
    )


RESULTS_SQL = """r AS (
  SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 5 = 1 THEN ['ruff', 'mypy', 'basedpyright', 'pyrefly', 'ty'][(s_suppkey // 5) % 5 + 1]
           || CASE WHEN s_suppkey % 2 = 0 THEN ':' || s_nationkey ELSE '' END ELSE 'd' || s_suppkey END AS name,
         'cat' || s_nationkey AS category, ['PASS', 'FINDINGS', 'SKIPPED', 'ERROR', 'N/A'][s_suppkey % 5 + 1] AS status, 'run ' || s_name AS command
  FROM supplier)"""


def checkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the five tools, one a supplier; those of one tool fail."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("seq"), _pick(TOOLS, "s_suppkey % 5").alias("name"), F.expr("if(s_suppkey % 5 = 3, 'ERROR', 'FINDINGS')").alias("status"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted debt: one entry for each nation; later entries overlap earlier ones."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("entry_ord"),
        F.expr("concat(element_at(array('ruff', 'mypy', 'basedpyright', 'pyrefly', 'ty'), n_nationkey % 5 + 1), ':F401')").alias("signal"),
        F.expr("array(concat('src/m', n_nationkey % 6, '.py'), concat('src/m', n_nationkey % 6 + 5, '.py'), 'src/m3.py')").alias("paths"),
        F.lit(5).alias("count"),
    )


LEDGER_SQL = """l AS (
  SELECT n_nationkey AS entry_ord, ['ruff', 'mypy', 'basedpyright', 'pyrefly', 'ty'][n_nationkey % 5 + 1] || ':F401' AS signal,
         ['src/m' || (n_nationkey % 6) || '.py', 'src/m' || (n_nationkey % 6 + 5) || '.py', 'src/m3.py'] AS paths, 5 AS count
  FROM nation)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, confidence: orders call parts, with the surest that their line items show."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee")).agg(F.round(1 - 10 * F.min("l_discount"), 6).alias("confidence"))


EDGES_SQL = "e AS (SELECT l_orderkey AS caller, l_partkey AS callee, round(1 - 10 * min(l_discount), 6) AS confidence FROM lineitem GROUP BY 1, 2)"


def chained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee: each part calls up to three with about half its number, as its line items' suppliers say."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.expr("l_partkey div 2 + l_suppkey % 3").alias("callee")).distinct()


CHAINED_SQL = "e AS (SELECT DISTINCT l_partkey AS caller, l_partkey // 2 + l_suppkey % 3 AS callee FROM lineitem)"


def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that never ran: file, line."""
    return table(spark, sf_dir, "events").select(F.expr("concat('src/m', user_id % 20, '.py')").alias("file"), F.expr("cast(event_id % 400 AS INT)").alias("line"))


COVERED_SQL = "c AS (SELECT 'src/m' || (user_id % 20) || '.py' AS file, CAST(event_id % 400 AS INTEGER) AS line FROM events)"


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to a thing in order: key, pos, op, name."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("op"), F.expr("concat('n', event_id % 3)").alias("name"))


OPS_SQL = "o AS (SELECT user_id AS key, event_id AS pos, event_type AS op, 'n' || (event_id % 3) AS name FROM events)"


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of analyzers: each document's lines, made to look like a text report."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run"), F.col("source").alias("tool"), F.expr("cast(doc_id % 4 AS INT)").alias("exit_code"), F.coalesce("text", F.lit("")).alias("stdout"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: path from the address, size and text."""
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path"), F.length("html").alias("size"), F.col("html").alias("head"))


FILES_SQL = "p AS (SELECT regexp_replace(url, '^https?://', '') AS path, length(html) AS size, html AS head FROM pages)"
