"""Calls and what can be said about them. edges: caller, callee, and confidence where it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import symbols
from siftspark.session import stored


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """roots: root. root, node and the least number of calls, up to depth; one join a level, seen nodes not taken again."""
    edges = edges.select("caller", "callee").distinct()
    front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    seen = front
    for level in range(1, depth + 1):
        step = front.join(edges, front.node == edges.caller).select("root", F.col("callee").alias("node")).distinct()
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def unique_callees(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Callers with exactly one confirmed callee."""
    return edges.where(F.col("confidence") >= least).groupBy("caller").agg(F.count_distinct("callee").alias("n"), F.min("callee").alias("callee")).where("n = 1").drop("n")


def unambiguous(names: DataFrame) -> DataFrame:
    """names: name, target. Names with a single target."""
    return names.groupBy("name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def multi_writers(writers: DataFrame) -> DataFrame:
    """writers: file, target, function, line, synchronized. Targets that two functions or more write unsynchronized."""
    rows = writers.where(~F.col("synchronized")).groupBy("file", "target").agg(F.array_sort(F.collect_set("function")).alias("functions"), F.min("line").alias("line"))
    return rows.where(F.size("functions") >= 2)


def verification_gaps(symbols: DataFrame, tested: DataFrame, edges: DataFrame, shown: int = 5) -> DataFrame:
    """symbols, tested: symbol. Symbols without a test whose callees have some: callees counted, the first shown."""
    callees = edges.join(tested.select(F.col("symbol").alias("callee")).distinct(), "callee", "left_semi").select(F.col("caller").alias("symbol"), "callee").distinct()
    gaps = symbols.select("symbol").distinct().join(tested.select("symbol").distinct(), "symbol", "left_anti").join(callees, "symbol")
    nth = F.row_number().over(W.partitionBy("symbol").orderBy("callee"))
    few = gaps.withColumn("nth", nth)
    names = F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("callee"))))
    return few.groupBy("symbol").agg(F.count("*").alias("tested_callees"), names.alias("shown"))


def boundary_gaps(calls: DataFrame, failure_tests: DataFrame) -> DataFrame:
    """calls: symbol, boundary. Calls over a boundary that no test of its failure names."""
    return calls.select("symbol", "boundary").distinct().join(failure_tests.select("boundary").distinct(), "boundary", "left_anti")


def chain_ends(forwards: DataFrame) -> DataFrame:
    """forwards: name, target (one each). Where forwarding ends; what runs in a circle ends nowhere.

    Pointers double: after k rounds each name has gone 2^k steps or to its end. A chain that goes on has names at
    every distance from its end, so once a round brings no name to an end, only circles are left. Each round is
    written to the shared folder.
    """
    at = stored(forwards.groupBy("name").agg(F.min("target").alias("target")).withColumn("steps", F.lit(1)), "chains")
    names, before = at.select(F.col("name").alias("target")), None
    while (left := at.join(names, "target", "left_semi").count()) and left != before:
        before = left
        onward = at.select(F.col("name").alias("target"), F.col("target").alias("onward"), F.col("steps").alias("more"))
        moved = at.join(onward, "target", "left")
        at = stored(moved.select("name", F.when(F.col("more").isNull(), F.col("target")).otherwise(F.col("onward")).alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chains")
    return at.join(names, "target", "left_anti").select("name", F.col("target").alias("terminal"), "steps")


def strengthened(values: DataFrame, flows: DataFrame, passes: int = 5) -> DataFrame:
    """Fixed point of facts along calls. values: name, value, confidence; flows: source, target, factor.

    In each pass a name takes the surest value that flows to it, if that is strictly surer than its own; it ends
    when nothing changes, after `passes` at most. Each pass is written to the shared folder.
    """
    best = F.max_by(F.struct("value", "confidence"), F.struct("confidence", "value"))
    now = values.groupBy("name").agg(best.alias("b")).select("name", "b.*")
    for _ in range(passes):
        came = now.join(flows, now.name == flows.source).select(F.col("target").alias("name"), "value", F.round(F.col("confidence") * F.col("factor"), 9).alias("confidence"))
        came = came.groupBy("name").agg(best.alias("c"))
        joined = now.join(came, "name", "full").withColumn("changes", F.col("c").isNotNull() & (F.col("confidence").isNull() | (F.col("c.confidence") > F.col("confidence"))))
        out = joined.select("name", F.when(F.col("changes"), F.col("c.value")).otherwise(F.col("value")).alias("value"), F.when(F.col("changes"), F.col("c.confidence")).otherwise(F.col("confidence")).alias("confidence"), "changes")
        out = stored(out, "facts")
        now = out.drop("changes")
        if out.where("changes").isEmpty():
            break
    return now


def unresolved_summary(statuses: DataFrame) -> DataFrame:
    """statuses: run, text (what an index says of itself). run, edges and resolved: references that are likely internal and were left unresolved, where there are any, beside the calls that were resolved."""
    number = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    rows = statuses.select("run", number(r"likely_internal_unresolved=(\d+)").cast("long").alias("edges"), F.coalesce(number(r"calls:\s*resolved=(\d+)"), F.lit("unknown")).alias("resolved"))
    return rows.where("edges > 0")


def typed(relationships: DataFrame) -> DataFrame:
    """relationships: predicate, subject, object, confidence (see sources.inventory.call_graph). Calls and links to tests, with file and name of both ends."""
    kind = F.when(F.col("predicate") == "calls", "call").when(F.col("predicate") == "tested_by", "test")
    ends = [f(F.col(e)).alias(f"{e}_{n}") for e in ("subject", "object") for n, f in (("file", symbols.symbol_file), ("name", symbols.symbol_name))]
    return relationships.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "subject", "object", "confidence", *ends)


def adjacency(calls: DataFrame) -> DataFrame:
    """calls: caller, callee. symbol, how many it calls and how many call it."""
    out = calls.groupBy(F.col("caller").alias("symbol")).agg(F.count_distinct("callee").alias("calls"))
    into = calls.groupBy(F.col("callee").alias("symbol")).agg(F.count_distinct("caller").alias("callers"))
    return out.join(into, "symbol", "full").select("symbol", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("callers", F.lit(0)).alias("callers"))


def unmentioned(symbols_: DataFrame, exports: DataFrame, mentions: DataFrame) -> DataFrame:
    """symbols: symbol, module, name; exports: module, name, symbol (other names under which a symbol is given out); mentions: module, name. Symbols that no mention reaches under any of their names."""
    keys = symbols_.select("symbol", "module", "name").unionByName(exports.select("symbol", "module", "name"))
    reached = keys.join(mentions.select("module", "name").distinct(), ["module", "name"], "left_semi").select("symbol").distinct()
    return symbols_.join(reached, "symbol", "left_anti").select("symbol").distinct()
