"""Names of Python sources resolved to what binds them, from the syntax nodes (see siftspark.sources.syntax).

A scope is a module, a function, a lambda, a class or a comprehension; it holds its body, not its decorators, defaults,
annotations and bases, nor a comprehension's first iterable: those belong to the scope around. A use is joined
with the bindings of its name in all scopes around it, and takes the innermost; a class counts only for uses directly
in it and bindings before them. Among a scope's bindings of a name it takes the last one before it, or the first if all
come later; from inside a function, which runs later, the last of the scope. `global` sends a name to the module, `nonlocal` makes no binding.
What an assignment binds is bound after its value, what a loop binds after its iterable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.structure import enclosing
from siftspark.session import stored_wide

FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]
COMPREHENSIONS = ["ListComp", "SetComp", "DictComp", "GeneratorExp"]


def module_of(path: Column) -> Column:
    """src/a/b.py -> a.b"""
    return F.replace(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"[.]py$", ""), F.lit("/"), F.lit("."))


def absolute(module: Column, dots: Column, path: Column) -> Column:
    """What an import from `module` with so many dots in front means in the file; null if nothing is left."""
    own = F.split(module_of(path), "[.]")
    package = F.slice(own, F.lit(1), F.greatest(F.size(own) - F.length(dots), F.lit(0)))
    return F.when(dots.isNull(), module).otherwise(F.nullif(F.concat_ws(".", package, F.when(module.isNotNull(), F.array(module))), F.lit("")))


def regions(nodes: DataFrame) -> DataFrame:
    """path, start, stop, scope (its node), scope_kind: where the names of each scope hold."""
    owners = nodes.where(F.col("kind").isin(*FUNCTIONS, "Lambda", "ClassDef", *COMPREHENSIONS)).select("path", F.col("lo").alias("scope"), F.col("hi").alias("end"), F.col("kind").alias("scope_kind"))
    inside = nodes.where(F.col("field").isin("body", "generators")).select("path", F.col("parent").alias("scope"), "field", "lo", "hi").join(owners, ["path", "scope"])
    bodies = inside.where("field = 'body'").groupBy("path", "scope", "scope_kind").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"))
    first = inside.where("field = 'generators'").groupBy("path", "scope", "scope_kind", "end").agg(F.min("lo").alias("parent"))
    iterable = nodes.where("field = 'iter'").select("path", "parent", F.col("lo").alias("i"), F.col("hi").alias("j"))
    around = first.join(iterable, ["path", "parent"])
    head = around.select("path", "scope", "scope_kind", (F.col("scope") + 1).alias("start"), (F.col("i") - 1).alias("stop"))
    tail = around.select("path", "scope", "scope_kind", (F.col("j") + 1).alias("start"), F.col("end").alias("stop"))
    whole = nodes.where("kind = 'Module'").select("path", F.lit(0).alias("scope"), F.lit("Module").alias("scope_kind"), F.col("lo").alias("start"), F.col("hi").alias("stop"))
    return bodies.unionByName(head).unionByName(tail.where("start <= stop")).unionByName(whole).select("path", "start", "stop", "scope", "scope_kind")


def imports(nodes: DataFrame) -> DataFrame:
    """path, lo, line, bfs, name (the local one), origin (what it stands for), module (None for a plain import), symbol, dots. Star imports are left out."""
    alias = nodes.where("kind = 'alias' AND name <> '*'").select("path", "lo", "bfs", "parent", F.col("name").alias("symbol"), F.col("value").alias("other"))
    whole = nodes.where("kind IN ('Import', 'ImportFrom')").select("path", F.col("lo").alias("parent"), "line", F.col("kind").alias("how"), F.col("name").alias("module"), F.col("value").alias("dots"))
    plain = F.col("how") == "Import"
    top = F.split_part("symbol", F.lit("."), F.lit(1))
    source = absolute(F.col("module"), F.col("dots"), F.col("path"))
    return alias.join(whole, ["path", "parent"]).select(
        "path", "lo", "line", "bfs",
        F.coalesce("other", F.when(plain, top).otherwise(F.col("symbol"))).alias("name"),
        F.when(plain & F.col("other").isNull(), top).when(plain, F.col("symbol")).otherwise(F.concat_ws(".", source, "symbol")).alias("origin"),
        F.when(~plain, F.col("module")).alias("module"), "symbol", "dots",
    )


def _definitions(nodes: DataFrame) -> DataFrame:
    """path, lo, line, name, how, at (the place from which it holds), origin; func for parameters."""
    plain = nodes.select("path", "lo", "hi", "line", "kind", "name", "func", "field", "ctx")
    none = F.lit(None).cast("string").alias("origin")
    defs = plain.where(F.col("kind").isin(*FUNCTIONS, "ClassDef")).select("path", "lo", "line", "name", F.when(F.col("kind") == "ClassDef", "class").otherwise("function").alias("how"), F.col("hi").alias("at"), none, F.lit(None).cast("int").alias("func"))
    params = plain.where("kind = 'arg'").select("path", "lo", "line", "name", F.lit("parameter").alias("how"), F.col("lo").alias("at"), none, "func")
    caught = plain.where("kind IN ('ExceptHandler', 'MatchAs', 'MatchStar', 'MatchMapping') AND name IS NOT NULL").select("path", "lo", "line", "name", F.lit("variable").alias("how"), F.col("lo").alias("at"), none, F.lit(None).cast("int").alias("func"))
    imported = imports(nodes).select("path", "lo", "line", "name", F.lit("import").alias("how"), F.col("lo").alias("at"), "origin", F.lit(None).cast("int").alias("func"))
    said = plain.where("kind IN ('Global', 'Nonlocal')").select("path", "lo", "line", F.explode(F.split("name", ",")).alias("name"), F.lower("kind").alias("how"), F.lit(-1).alias("at"), none, F.lit(None).cast("int").alias("func"))
    names = plain.where("kind = 'Name' AND ctx = 'Store'").select("path", "lo", "line", "name", "field")
    iterable = nodes.where("field = 'iter'").select("path", F.col("parent").alias("lo"), F.col("hi").alias("until"))
    binders = plain.where("kind IN ('Assign', 'AugAssign', 'AnnAssign', 'NamedExpr', 'For', 'AsyncFor', 'comprehension')").join(iterable, ["path", "lo"], "left")
    binders = binders.select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.coalesce("until", "hi").alias("until"), (F.col("kind") == "NamedExpr").alias("walrus"))
    held = enclosing(names.select("path", F.col("lo").alias("place")), binders, nearest=True).select("path", F.col("place").alias("lo"), "until", "walrus")
    stores = names.join(held, ["path", "lo"], "left").select("path", "lo", "line", "name", F.when(F.col("walrus") & (F.col("field") == "target"), "walrus").otherwise("variable").alias("how"), F.greatest("lo", "until").alias("at"), none, F.lit(None).cast("int").alias("func"))
    return defs.unionByName(params).unionByName(caught).unionByName(imported).unionByName(said).unionByName(stores)


def resolved(nodes: DataFrame, within: DataFrame | None = None, store: Callable[[DataFrame, str], DataFrame] = stored_wide) -> DataFrame:
    """path, lo, line, name of every use of a name, or of those `within` (path, lo), with scope, definition (its node), defined (its line), how it is bound and, for imports, origin; null where nothing in the file binds it. store: how tables are kept, by_path() for callers that join in place."""
    uses = nodes.where("kind = 'Name' AND ctx IN ('Load', 'Del')").select("path", "lo", "line", "name")
    uses = uses if within is None else store(uses.join(within, ["path", "lo"], "left_semi"), "name-uses")
    definitions = store(_definitions(nodes), "definitions")
    places = uses.select("path", F.col("lo").alias("place")).unionByName(definitions.select("path", F.col("lo").alias("place")))
    around = store(enclosing(places, regions(nodes)).withColumnRenamed("place", "lo"), "scopes-around")
    plain = ~F.col("scope_kind").isin(*COMPREHENSIONS)
    own = around.groupBy("path", "lo").agg(
        F.max_by("scope", "start").alias("own"),
        F.max_by(F.when(plain, F.col("scope")), F.when(plain, F.col("start"))).alias("own_plain"),
        F.max(F.when(F.col("scope_kind").isin(*FUNCTIONS, "Lambda"), F.col("start"))).alias("runs_from"),
    )
    placed = definitions.join(own, ["path", "lo"]).select(
        "path", "lo", "line", "name", "how", "at", "origin", F.coalesce("func", F.when(F.col("how") == "walrus", F.col("own_plain")).otherwise(F.col("own"))).alias("scope")
    )
    said = placed.where("how IN ('global', 'nonlocal')").select("path", "scope", "name", F.col("how").alias("said")).distinct()
    bound = placed.where("how <> 'nonlocal'").join(said, ["path", "scope", "name"], "left").where("said IS NULL OR said = 'global'")
    away = (F.col("said") == "global") & (F.col("how") != "global")
    bound = store(bound.select("path", F.when(away, F.lit(0)).otherwise(F.col("scope")).alias("scope"), "name", F.struct(F.col("lo").alias("definition"), F.col("line").alias("defined"), F.when(F.col("how") == "walrus", "variable").otherwise(F.col("how")).alias("how"), "origin").alias("d"), "at"), "bindings")
    reach = uses.join(around, ["path", "lo"]).join(own.select("path", "lo", "own", "runs_from"), ["path", "lo"]).where("scope_kind <> 'ClassDef' OR scope = own")
    later = F.coalesce(F.col("runs_from") > F.col("start"), F.lit(False))
    rank = F.struct("start", F.when(later | (F.col("at") < F.col("lo")), 1).otherwise(0).alias("before"), F.when(later | (F.col("at") < F.col("lo")), F.col("at")).otherwise(-F.col("at")).alias("nearness"))
    taken = reach.join(bound, ["path", "scope", "name"]).where("scope_kind <> 'ClassDef' OR at < lo").groupBy("path", "lo").agg(F.max_by(F.struct("scope", "d.*"), rank).alias("t"))
    found = uses.join(taken, ["path", "lo"], "left").select("path", "lo", "line", "name", "t.*")
    of_module = bound.where("scope = 0").groupBy("path", "name").agg(F.max_by("d", "at").alias("m"))
    sent = F.col("how") == "global"
    return found.join(of_module, ["path", "name"], "left").select(
        "path", "lo", "line", "name", F.when(sent & F.col("m").isNull(), None).when(sent, F.lit(0)).otherwise(F.col("scope")).alias("scope"),
        *(F.when(sent, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("definition", "defined", "how", "origin")),
    )
