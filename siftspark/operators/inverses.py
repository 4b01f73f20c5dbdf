"""Operations that bring data out and those that bring it back, read from syntax nodes: pairs without a test of the round trip, and operations without their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.compare import uncovered_pairs
from siftspark.operators.scopes import FUNCTIONS
from siftspark.operators.structure import enclosing
from siftspark.session import stored_wide

# Words that are inverse to each other, parameters and calls of operations on a user's data, words of names that have nothing to do with it.
PAIRS = (("export", "import"), ("backup", "restore"))
PARAMETERS = "path file filename stream archive backup data content payload".split()
CALLS = "open read_text write_text read_bytes write_bytes json.dump json.dumps json.load json.loads yaml. toml pickle. csv. zipfile. tarfile. encode decode shutil.make_archive shutil.unpack_archive".split()
INNER = "config configured configuration linter module package plugin library lib path".split()


def operations(nodes: DataFrame) -> DataFrame:
    """path, owner, func, line, name, outward, word, partner: functions at the top of a file (owner '') and of its classes whose name has one of the words, and the name with the inverse word in its place. Of names that are defined again, the last."""
    top = nodes.where("parent = 0 AND field = 'body'")
    classes = top.where("kind = 'ClassDef'").groupBy("path", F.col("name").alias("owner")).agg(F.max("lo").alias("parent"))
    functions = nodes.where("field = 'body'").where(F.col("kind").isin(*FUNCTIONS)).select("path", "parent", "lo", "line", "name")
    owned = functions.where("parent = 0").withColumn("owner", F.lit("")).unionByName(functions.join(classes, ["path", "parent"]))
    last = owned.groupBy("path", "owner", "name").agg(F.max_by(F.struct("lo", "line"), "lo").alias("f")).select("path", "owner", "name", F.col("f.lo").alias("func"), F.col("f.line").alias("line"))
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("out"), F.lit(y).alias("back")) for x, y in PAIRS)))
    rows = last.withColumn("parts", F.split("name", "_")).withColumn("p", pairs)
    outward = F.array_contains("parts", F.col("p.out"))
    rows = rows.where(outward | F.array_contains("parts", F.col("p.back"))).withColumn("outward", outward)
    rows = rows.withColumn("word", F.when(F.col("outward"), F.col("p.out")).otherwise(F.col("p.back"))).withColumn("other", F.when(F.col("outward"), F.col("p.back")).otherwise(F.col("p.out")))
    at = F.array_position("parts", F.col("word")).cast("int")
    partner = F.array_join(F.concat(F.slice("parts", F.lit(1), at - 1), F.array("other"), F.slice("parts", at + 1, F.size("parts"))), "_")
    return rows.select("path", "owner", "func", "line", "name", "outward", "word", partner.alias("partner"), F.array_except("parts", F.array(F.col("p.out"), F.col("p.back"), F.lit(""))).alias("subject"))


def on_user_data(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """functions: path, func. Those with a parameter, or anywhere in them a call, that reads or writes a user's data."""
    parameter = nodes.where("kind = 'arg' AND field IN ('posonlyargs', 'args', 'kwonlyargs')").where(F.lower("name").isin(*PARAMETERS)).select("path", "func")
    marked = nodes.where("kind = 'Call'").where(F.lower("name").rlike("|".join(c.replace(".", "[.]") for c in CALLS))).select("path", F.col("lo").alias("place"))
    whole = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.col("lo").alias("func")).join(functions, ["path", "func"], "left_semi").select("path", "start", "stop", "func")
    return functions.join(parameter.unionByName(enclosing(marked, whole).select("path", "func")).distinct(), ["path", "func"], "left_semi")


def calls_of_tests(nodes: DataFrame) -> DataFrame:
    """test, name: last names of what each function whose name begins with test calls, anywhere in it."""
    tests = nodes.where(F.col("kind").isin(*FUNCTIONS) & F.startswith("name", F.lit("test"))).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.col("lo").alias("test"))
    calls = nodes.where("kind = 'Call' AND name IS NOT NULL").select("path", F.col("lo").alias("place"), F.element_at(F.split("name", "[.]"), -1).alias("name"))
    return calls.join(enclosing(calls.select("path", "place"), tests), ["path", "place"]).select(F.concat("path", F.lit(":"), F.col("test").cast("string")).alias("test"), "name").distinct()


def round_trips(nodes: DataFrame, tests: str = "tests/") -> DataFrame:
    """nodes (read several times: store them first). code, path, line, name, partner: pairs that no one test calls both of (BHRT001, at the one that goes out), and operations on a user's data without an inverse beside them (BHRT002).

    Files below `tests` are tests and have no operations. Tests know operations by their last names alone. Names that
    speak of the program's own parts need no inverse. Files that are no Python have no nodes; empty tables give nothing.
    """
    of_tests = F.startswith("path", F.lit(tests))
    found = stored_wide(operations(nodes.where(~of_tests)), "operations")
    full = lambda c: F.when(F.col("owner") == "", F.col(c)).otherwise(F.concat("owner", F.lit("."), c)).alias(c)
    # the partner has a word of the list too, so it is among the operations
    beside = found.select("path", "owner", F.col("name").alias("partner")).distinct()
    pairs = found.where("outward").join(beside, ["path", "owner", "partner"], "left_semi")
    bare = uncovered_pairs(pairs.select(F.col("name").alias("a"), F.col("partner").alias("b")).distinct(), calls_of_tests(nodes.where(of_tests)))
    untested = pairs.join(bare.select(F.col("a").alias("name"), F.col("b").alias("partner")), ["name", "partner"], "left_semi").withColumn("code", F.lit("BHRT001"))
    alone = found.join(beside, ["path", "owner", "partner"], "left_anti").where(~F.arrays_overlap("subject", F.array(*map(F.lit, INNER))))
    alone = alone.join(on_user_data(nodes, alone.select("path", "func").distinct()), ["path", "func"], "left_semi").withColumn("code", F.lit("BHRT002"))
    return untested.unionByName(alone, allowMissingColumns=True).select("code", "path", "line", full("name"), full("partner"))
