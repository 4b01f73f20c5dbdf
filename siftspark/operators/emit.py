"""What the operators find, as findings of the codes that stand for it: code, path, line, severity, message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: code -> path, line, severity and message as SQL over the rows of the operator that finds it.
FINDINGS = {
    "BHCFG002": ("path", "line", "'warning'", "concat('environment variable ', name, ' is not in the example file')"),
    "BHCFG003": ("path", "line", "'error'", "concat('the example value of ', name, ' looks like a live credential')"),
    "BHCONC001": ("file", "line", "'warning'", "concat('target ', target, ' is written by several functions without a lock')"),
    "BHCOV002": ("file", "line", "'warning'", "concat('branch edge ', line, ' -> ', target, ' is never taken')"),
    "BHDIFF001": ("NULL", "NULL", "'warning'", "concat(fn, ' gives another result than before in ', differences, ' case(s), first in ', case_no)"),
    "BHDIS001": ("path", "line", "'warning'", "concat('reported by ', loud, ', not by ', silent)"),
    "BHFAULT001": ("path", "line", "'warning'", "concat('external boundary ', boundary, ' in ', function, ' has no test that makes it fail')"),
    "BHINV001": ("NULL", "NULL", "'error'", "concat(places, ' places accept ', variants, ' different sets of values for ', variable)"),
    "BHPLC001": ("NULL", "NULL", "'warning'", "concat(a, ' and ', b, ' exclude each other and are both on')"),
    "BHRT001": ("NULL", "NULL", "'warning'", "concat('no one test calls both ', a, ' and ', b)"),
    "BHRT002": ("owner", "NULL", "'warning'", "concat(name, ' has no inverse')"),
    "BHSEAM002": ("NULL", "NULL", "'error'", "concat(name, ' passes on ', key, ', which ', terminal, ' does not take')"),
    "BHSEAM003": ("NULL", "NULL", "'error'", "concat(consumer, ' reads ', key, ', which ', producer, ' never gives')"),
    "BHSEAM004": ("NULL", "NULL", "'warning'", "concat(name, '.', field, ' is in the ', only_in, ' only')"),
    "BHSEM010": ("NULL", "NULL", "'warning'", "concat(name, ' may be None where it is used in ', scope)"),
    "BHUNIT004": ("NULL", "NULL", "severity", "concat(unit, ' reaches parameter ', position, ' of ', callee, ', which wants ', wanted)"),
    "BHVERIFY001": ("NULL", "NULL", "'warning'", "concat(symbol, ' has no test of its own, and ', tested_callees, ' of its callees have')"),
    "BHVERIFY002": ("NULL", "NULL", "'warning'", "concat(symbol, ' goes over ', boundary, ', whose failure no test shows')"),
}


def findings(rows: DataFrame, code: str) -> DataFrame:
    """rows: what the operator behind the code returns."""
    path, line, severity, message = (F.expr(x) for x in FINDINGS[code])
    return rows.select(F.lit(code).alias("code"), path.cast("string").alias("path"), line.cast("int").alias("line"), severity.alias("severity"), message.alias("message"))


def missing_example(uses: DataFrame, files: DataFrame, example: str = ".env.example") -> DataFrame:
    """uses: name, path, line; files: path. BHCFG001 at the first use, with the number of names, where no example file is there at all."""
    first = uses.agg(F.min(F.struct("path", "line")).alias("f"), F.count_distinct("name").alias("names")).where("names > 0")
    there = files.where((F.col("path") == example) | F.endswith("path", F.lit("/" + example))).limit(1).select(F.lit(1).alias("there"))
    rows = first.join(there, F.lit(True), "left_anti")
    return rows.select(F.lit("BHCFG001").alias("code"), F.col("f.path").alias("path"), F.col("f.line").alias("line"), F.lit("warning").alias("severity"), F.concat("names", F.lit(" environment variable(s) are used and there is no "), F.lit(example)).alias("message"))


def measured(gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """gaps: findings by run; runs: run, suite_failed, measured. The gaps, with one error more for each run whose suite failed (BHCOV003) or that gave no measurement (BHCOV002)."""
    failed = runs.where("suite_failed OR NOT measured").select(
        "run", F.when(F.col("measured"), "BHCOV003").otherwise("BHCOV002").alias("code"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("error").alias("severity"),
        F.when(F.col("measured"), "coverage was measured over a failing suite").otherwise("coverage could not be measured").alias("message"),
    )
    return gaps.select("run", "code", "path", "line", "severity", "message").unionByName(failed)
