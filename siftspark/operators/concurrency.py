"""Targets that several functions write, run by threads or tasks, without a lock; read from syntax nodes.

A function holds what stands anywhere in it, also in functions within. It is synchronized if it enters something that
is called a lock or a mutex, or acquires or releases anything. What a file starts are the functions whose names it
hands to threads, tasks or pools; what runs is all that these reach by at most DEPTH calls, found for all starts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.graph import multi_writers, reachable
from siftspark.operators.scopes import FUNCTIONS, resolved
from siftspark.operators.structure import enclosing
from siftspark.session import stored_wide

DEPTH = 3
#: Calls that start functions, and the keywords by which they take them; fixed values.
STARTS = "Thread create_task submit gather".split()
KEYWORDS = "target fn func coro".split()


def _short(name: str = "name"):
    return F.element_at(F.split(name, "[.]"), -1)


def _held(nodes: DataFrame) -> DataFrame:
    """nodes with owner: a row for each function that a node stands in."""
    functions = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", (F.col("lo") + 1).alias("start"), F.col("hi").alias("stop"), F.col("lo").alias("owner"))
    return nodes.join(enclosing(nodes.select("path", F.col("lo").alias("place")), functions).select("path", F.col("place").alias("lo"), "owner"), ["path", "lo"])


def started(nodes: DataFrame) -> DataFrame:
    """path, name of the functions that a file hands to threads, tasks or pools."""
    calls = nodes.where("kind = 'Call'").select("path", F.col("lo").alias("call"))
    by = nodes.where("field = 'func' AND kind IN ('Name', 'Attribute')").where(_short().isin(*STARTS)).select("path", F.col("parent").alias("call"))
    starts = calls.join(by, ["path", "call"])
    first = nodes.where("field = 'args'").groupBy("path", F.col("parent").alias("call")).agg(F.min_by(F.struct("kind", "name"), "lo").alias("a"))
    keys = nodes.where(F.col("kind").eqNullSafe("keyword") & F.col("name").isin(*KEYWORDS)).select("path", F.col("parent").alias("call"), F.col("lo").alias("parent"))
    given = keys.join(nodes.where("field = 'value' AND kind = 'Name'").select("path", "parent", "name"), ["path", "parent"]).select("path", "call", "name")
    names = first.where("a.kind = 'Name'").select("path", "call", "a.name").unionByName(given)
    return names.join(starts, ["path", "call"]).select("path", "name").distinct()


def synchronized(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, owner of the functions that take a lock."""
    withs = nodes.where("kind = 'With'").select("path", F.col("lo").alias("with_"))
    items = nodes.where("kind = 'withitem'").select("path", F.col("parent").alias("with_"), F.col("lo").alias("item")).join(withs, ["path", "with_"])
    what = nodes.where("field = 'context_expr'").select("path", F.col("parent").alias("item"), F.col("lo").alias("start"), F.col("hi").alias("stop")).join(items, ["path", "item"]).select("path", "start", "stop")
    named = nodes.where(F.lower(F.concat_ws(" ", "name", "value")).rlike("lock|mutex")).select("path", F.col("lo").alias("place"))
    locks = enclosing(named, what, nearest=True).select("path", F.col("place").alias("lo"))
    taken = nodes.where("field = 'func' AND kind = 'Attribute'").where(_short().isin("acquire", "release")).select("path", "lo")
    return held.join(locks.unionByName(taken), ["path", "lo"], "left_semi").select("path", "owner").distinct()


def writers(nodes: DataFrame) -> DataFrame:
    """file, target, function, line, synchronized: assignments to global names, and of files opened to be written."""
    held = stored_wide(_held(nodes), "held-by-functions")
    sent = held.where("kind = 'Global'").select("path", "owner", F.explode(F.split("name", ",")).alias("name")).distinct()
    assigns = held.where("kind = 'Assign'").select("path", "owner", "lo", "line")
    target = nodes.where("field = 'targets'").groupBy("path", F.col("parent").alias("lo")).agg(F.count("*").alias("n"), F.first(F.struct("kind", "name")).alias("t")).where("n = 1 AND t.kind = 'Name'").select("path", "lo", "t.name")
    single = stored_wide(assigns.join(target, ["path", "lo"]), "single-targets")
    to_global = single.join(sent, ["path", "owner", "name"], "left_semi").select("path", "owner", "line", F.concat(F.lit("global:"), "name").alias("target"))
    call = nodes.where("field = 'value' AND kind = 'Call'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("call"))
    by = nodes.where("field = 'func' AND kind IN ('Name', 'Attribute')").where(_short() == "open").select("path", F.col("parent").alias("call"), F.col("kind").alias("by"), F.col("name").alias("called"))
    args = nodes.where("field = 'args'").groupBy("path", F.col("parent").alias("call")).agg(F.sort_array(F.collect_list(F.struct("lo", "kind", "value", "vtype"))).alias("args"))  # a call's arguments
    opened = single.join(call, ["path", "lo"]).join(by, ["path", "call"]).join(args, ["path", "call"])
    plain = (F.col("by") == "Name") & (F.col("called") == "open") & (F.size("args") >= 2)
    mode = F.when(plain, F.get("args", F.lit(1))).when(F.col("by") == "Attribute", F.get("args", F.lit(0)))
    path = F.when(plain & (F.get("args", F.lit(0))["vtype"] == "str"), F.get("args", F.lit(0))["value"]).when(F.col("by") == "Attribute", F.concat(F.lit("method:"), "called"))
    opened = opened.where((mode["kind"] == "Constant") & mode["value"].rlike("^[wax]") & path.isNotNull()).select("path", "owner", "line", F.concat(F.lit("file:"), path).alias("target"))
    names = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("owner"), F.col("name").alias("function"))
    safe = synchronized(held, nodes).withColumn("safe", F.lit(True))
    rows = to_global.unionByName(opened).distinct().join(names, ["path", "owner"]).join(safe, ["path", "owner"], "left")
    return rows.select(F.col("path").alias("file"), "target", "function", "line", F.coalesce("safe", F.lit(False)).alias("synchronized"))


def call_names(nodes: DataFrame) -> DataFrame:
    """caller, callee: last names of functions of the sources and of those they call, by names that scope resolves to a function or an import, and by methods of self."""
    defined = nodes.where(F.col("kind").isin(*FUNCTIONS)).select(F.col("name").alias("callee")).distinct()
    functions = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("func"), F.col("name").alias("caller"))
    callee = nodes.where("field = 'func' AND kind IN ('Name', 'Attribute') AND func >= 0").select("path", F.col("hi").alias("root"), "func", F.split_part("name", F.lit("."), F.lit(1)).alias("head"), _short().alias("last"))
    found = resolved(nodes).where("how IN ('function', 'import')").select("path", F.col("lo").alias("root"), F.when(F.col("how") == "import", F.element_at(F.split("origin", "[.]"), -1)).alias("stands"))
    rows = callee.join(found, ["path", "root"], "left").join(nodes.where("kind = 'Name'").select("path", F.col("lo").alias("root"), F.lit(True).alias("plain")), ["path", "root"])
    known = rows.join(nodes.where("kind = 'Name'").select("path", F.col("lo").alias("root")).join(found.select("path", "root"), ["path", "root"], "left_semi").withColumn("known", F.lit(True)), ["path", "root"], "left")
    name = F.when(F.col("head") == F.col("last"), F.coalesce("stands", "last")).otherwise(F.col("last"))
    return known.where("known OR head = 'self'").select("path", "func", name.alias("callee")).join(functions, ["path", "func"]).join(defined, "callee", "left_semi").select("caller", "callee").distinct()


def unsynchronized(nodes: DataFrame) -> DataFrame:
    """nodes (read several times: store them first). file, target, functions, line where two functions or more that run at once write a target without a lock."""
    roots = stored_wide(started(nodes), "started")
    run = reachable(call_names(nodes), roots.select(F.col("name").alias("root")).distinct(), DEPTH).select("root", "node")
    runs = roots.join(run, F.col("name") == F.col("root")).select(F.col("path").alias("file"), F.col("node").alias("function")).distinct()
    return multi_writers(writers(nodes).join(runs, ["file", "function"], "left_semi"))
