"""Keys and literals that cross a seam, read from syntax nodes (see siftspark.sources.syntax): keywords along a chain of
functions, keys of returned dicts and of those who read them, fields of schemas and classes, literals that checks reject.

All is found by equality of path and node and by containment; nothing compares functions, calls or reads in pairs.
Sources that are no Python have no nodes and so no findings; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.graph import chain_ends
from siftspark.operators.scopes import FUNCTIONS, imports, module_of
from siftspark.operators.structure import enclosing
from siftspark.session import stored_wide


def _leaf(name: str = "name") -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def _id(path: str = "path", name: str = "name") -> Column:
    return F.concat(F.col(path), F.lit(":"), F.col(name))


def _child(nodes: DataFrame, field: str, where: str, *columns) -> DataFrame:
    """path, parent and columns of the nodes in a field."""
    return nodes.where(F.col("field") == field).where(where).select("path", "parent", *columns)


def calls(nodes: DataFrame) -> DataFrame:
    """path, call, line, bfs, name and leaf (its last part) of the calls whose function is a name, an attribute or what a call gives."""
    named = _child(nodes, "func", "kind IN ('Name', 'Attribute', 'Call')").withColumnRenamed("parent", "call")
    rows = nodes.where("kind = 'Call' AND name IS NOT NULL").select("path", F.col("lo").alias("call"), "line", "bfs", "name", _leaf().alias("leaf"))
    return rows.join(named, ["path", "call"], "left_semi")


def dict_keys(nodes: DataFrame) -> DataFrame:
    """path, dict, key: the literal texts among the keys of each dict that is written out."""
    dicts = nodes.where("kind = 'Dict'").select("path", F.col("lo").alias("dict"))
    return _child(nodes, "keys", "vtype = 'str'", F.col("value").alias("key")).withColumnRenamed("parent", "dict").join(dicts, ["path", "dict"], "left_semi")


def signatures(nodes: DataFrame) -> DataFrame:
    """path, name, takes (the keywords a function accepts, without self and cls), rest (its **name, or null). Of a name that a file defines again, the last one's."""
    last = nodes.where(F.col("kind").isin(*FUNCTIONS)).groupBy("path", "name").agg(F.max_by("lo", "bfs").alias("func"))
    args = nodes.where("kind = 'arg'").select("path", "func", "field", F.col("name").alias("key"))
    own = F.col("field").isin("posonlyargs", "args", "kwonlyargs") & ~F.col("key").isin("self", "cls")
    return last.join(args, ["path", "func"], "left").groupBy("path", "name").agg(F.collect_set(F.when(own, F.col("key"))).alias("takes"), F.max(F.when(F.col("field") == "kwarg", F.col("key"))).alias("rest"))


def links(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """path, name (as calls write it), target: functions of other files by imports. Names that a file imports from two places, and modules that two files have, stay unresolved."""
    heads = imports(nodes).groupBy("path", F.col("name").alias("head")).agg(F.count_distinct("origin").alias("n"), F.min("origin").alias("origin")).where("n = 1").drop("n")
    module = F.regexp_replace(module_of(F.col("path")), "[.]__init__$", "")
    given = functions.select(F.concat(module, F.lit("."), "name").alias("full"), _id().alias("target")).groupBy("full").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    called = calls(nodes).select("path", "name").distinct().withColumn("head", F.split_part("name", F.lit("."), F.lit(1)))
    full = F.concat("origin", F.substring("name", F.length("head") + 1, F.lit(1 << 20)))
    return called.join(heads, ["path", "head"]).withColumn("full", full).join(given, "full").select("path", "name", "target")


def rejected_keywords(nodes: DataFrame) -> DataFrame:
    """nodes (read several times: store them first). path, line, function, terminal, keys: calls that name keywords which the end of a chain of forwarding functions doesn't take. BHSEAM002.

    A function forwards if a call in it hands on its **name; where several do, the last whose function is known counts.
    A call's function is one of its file with that last name, or else one of another file, by import. Chains run over
    any number of files, by doubled pointers; one that runs in a circle ends nowhere. An end that takes any keyword
    takes all; a call that reaches a function of its own file directly is left to type checkers. Keys are what the call
    names, itself or in a dict that is written out behind **; a parameter of a function in between doesn't take a key away.
    """
    functions = stored_wide(signatures(nodes), "signatures")
    known = functions.select("path", F.col("name").alias("leaf"), F.lit(True).alias("own"))
    called = calls(nodes).join(known, ["path", "leaf"], "left").join(links(nodes, functions), ["path", "name"], "left")
    called = called.withColumn("target", F.when(F.col("own"), _id("path", "leaf")).otherwise(F.col("target"))).where("target IS NOT NULL")
    called = stored_wide(called.select("path", "call", "line", "bfs", "leaf", "own", "target"), "called")

    given = nodes.where("kind = 'keyword'").select("path", F.col("parent").alias("call"), F.col("lo").alias("parent"), F.col("name").alias("key"))
    behind = given.where("key IS NULL").drop("key")
    spread = behind.join(_child(nodes, "value", "kind = 'Dict'", F.col("lo").alias("dict")), ["path", "parent"]).join(dict_keys(nodes), ["path", "dict"])
    keys = given.where("key IS NOT NULL").select("path", "call", "key").unionByName(spread.select("path", "call", "key"))
    keys = keys.groupBy("path", "call").agg(F.collect_set("key").alias("keys"))  # of one call

    handed = behind.join(_child(nodes, "value", "kind = 'Name'", F.col("name").alias("var")), ["path", "parent"]).select("path", "call", "var").join(called, ["path", "call"])
    rests = nodes.where("kind = 'arg' AND field = 'kwarg'").select("path", F.col("func").alias("lo"), F.col("name").alias("rest"))
    takers = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", "lo", "hi", "name", F.col("bfs").alias("order")).join(rests, ["path", "lo"])
    around = enclosing(handed.select("path", F.col("call").alias("place")), takers.select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), "name", "order", "rest")).withColumnRenamed("place", "call")
    forwards = handed.join(around, ["path", "call"]).where("var = rest").groupBy(_id().alias("name")).agg(F.max_by("target", F.struct("order", "bfs")).alias("target"))
    forwards = stored_wide(forwards, "forwards")
    ends = forwards.select("name").join(chain_ends(forwards).select("name", "terminal"), "name", "left").withColumn("moves", F.lit(True))

    passed = called.join(keys, ["path", "call"]).join(ends.withColumnRenamed("name", "target"), "target", "left")
    passed = passed.withColumn("terminal", F.when(F.col("moves"), F.col("terminal")).otherwise(F.col("target"))).where("terminal <> target OR own IS NULL")
    takes = functions.where("rest IS NULL").select(_id().alias("terminal"), "takes")
    rows = passed.join(takes, "terminal").withColumn("keys", F.array_sort(F.array_except("keys", "takes"))).where(F.size("keys") > 0)
    return rows.select("path", "line", F.col("leaf").alias("function"), "terminal", "keys").distinct()


def reads(nodes: DataFrame) -> DataFrame:
    """path, place, var, key: literal keys read from a name, by subscript, get or pop."""
    subscripts = nodes.where("kind = 'Subscript' AND ctx = 'Load'").select("path", F.col("lo").alias("parent"))
    of = _child(nodes, "value", "kind = 'Name'", F.col("name").alias("var"))
    by_place = subscripts.join(of, ["path", "parent"]).join(_child(nodes, "slice", "vtype = 'str'", F.col("value").alias("key")), ["path", "parent"]).withColumnRenamed("parent", "place")
    methods = _child(nodes, "func", "kind = 'Attribute'", F.col("lo").alias("attribute"), _leaf().alias("method")).where(F.col("method").isin("get", "pop"))
    methods = methods.withColumnRenamed("parent", "place").join(of.withColumnRenamed("parent", "attribute"), ["path", "attribute"])
    first = _child(nodes, "args", "TRUE", "lo", "vtype", "value").groupBy("path", F.col("parent").alias("place")).agg(F.min_by(F.struct("vtype", "value"), "lo").alias("a"))
    by_method = methods.join(first, ["path", "place"]).where("a.vtype = 'str'").select("path", "place", "var", F.col("a.value").alias("key"))
    return by_place.select("path", "place", "var", "key").unionByName(by_method)


def shapes(nodes: DataFrame) -> DataFrame:
    """path, producer, keys: the functions at the top of a file whose returned dicts, those that are written out with literal keys, all have the same ones. Of a name that is defined again, the last with such a shape."""
    top = nodes.where("parent = 0 AND field = 'body'").where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.col("name").alias("producer"))
    returns = nodes.where("kind = 'Return'").select("path", F.col("lo").alias("parent"))
    given = returns.join(_child(nodes, "value", "kind = 'Dict'", F.col("lo").alias("dict")), ["path", "parent"]).join(dict_keys(nodes), ["path", "dict"])
    each = given.groupBy("path", F.col("parent").alias("place")).agg(F.array_sort(F.collect_set("key")).alias("keys"))  # of one return
    held = each.join(enclosing(each.select("path", "place"), top), ["path", "place"])
    steady = held.groupBy("path", "producer", "start").agg(F.count_distinct("keys").alias("n"), F.min("keys").alias("keys")).where("n = 1")
    return steady.groupBy("path", "producer").agg(F.max_by("keys", "start").alias("keys"))


def unmet_keys(nodes: DataFrame) -> DataFrame:
    """nodes (read several times). path, line, producer, keys: what a function reads, anywhere in it, from a name that it assigns from a function of the same file, and that function's dicts don't have. BHSEAM003.

    Of a function's assignments to a name from such functions the last counts, at its line. What stands in a function within counts for both; equal rows are one.
    """
    made = stored_wide(shapes(nodes), "shapes")
    value = _child(nodes, "value", "kind = 'Call'", F.col("lo").alias("call"))
    assigns = nodes.where("kind = 'Assign'").select("path", F.col("lo").alias("parent"), "line", "bfs").join(value, ["path", "parent"])
    assigns = assigns.join(calls(nodes).select("path", "call", F.col("leaf").alias("producer")), ["path", "call"]).join(made, ["path", "producer"])
    assigns = assigns.join(_child(nodes, "targets", "kind = 'Name'", F.col("name").alias("var")), ["path", "parent"]).withColumnRenamed("parent", "place")
    functions = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.col("lo").alias("owner"))
    taken = reads(nodes).join(assigns.select("path", "var").distinct(), ["path", "var"], "left_semi")
    assigns, taken = stored_wide(assigns, "assigned"), stored_wide(taken, "reads")
    around = stored_wide(enclosing(assigns.select("path", "place").unionByName(taken.select("path", "place")), functions), "around").select("path", "place", "owner")
    last = assigns.join(around, ["path", "place"]).groupBy("path", "owner", "var").agg(F.max_by(F.struct("line", "producer", "keys"), "bfs").alias("a"))
    read = taken.join(around, ["path", "place"]).join(last, ["path", "owner", "var"]).where(~F.array_contains("a.keys", F.col("key")))
    rows = read.groupBy("path", "owner", "var", "a.line", "a.producer").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return rows.select("path", "line", "producer", "keys").distinct()


def models(nodes: DataFrame) -> DataFrame:
    """name, path, fields: fields of the classes at the top of files, annotated or assigned (then without _ in front), by the first path that has such a class; within a file the last."""
    classes = nodes.where("parent = 0 AND field = 'body' AND kind = 'ClassDef'").select("path", F.col("lo").alias("cls"), F.col("name").alias("model"))
    made = _child(nodes, "body", "kind IN ('AnnAssign', 'Assign')", "lo").withColumnRenamed("parent", "cls").withColumnRenamed("lo", "parent").join(classes, ["path", "cls"])
    names = nodes.where("kind = 'Name'").where((F.col("field") == "target") | ((F.col("field") == "targets") & ~F.startswith("name", F.lit("_")))).select("path", "parent", "name")
    whole = made.join(names, ["path", "parent"]).groupBy("path", "model", "cls").agg(F.array_sort(F.collect_set("name")).alias("fields"))  # of one class
    return whole.groupBy(F.col("model").alias("name")).agg(F.min_by(F.struct("path", "fields"), F.struct("path", -F.col("cls"))).alias("m")).select("name", "m.*")


def drifted_models(nodes: DataFrame, schemas: DataFrame) -> DataFrame:
    """schemas: path, name, fields (see sources.documents.schemas). path (of the class), name, schema (its path), only_in_schema, only_in_model, where a class and a schema of its name differ. BHSEAM004."""
    rows = models(nodes).join(schemas.select(F.col("path").alias("schema"), "name", F.col("fields").alias("wanted")), "name")
    only = lambda x, y: F.array_sort(F.array_except(x, y))
    rows = rows.select("path", "name", "schema", only("wanted", "fields").alias("only_in_schema"), only("fields", "wanted").alias("only_in_model"))
    return rows.where((F.size("only_in_schema") > 0) | (F.size("only_in_model") > 0))


def rejections(nodes: DataFrame) -> DataFrame:
    """path, line, name, op (Eq or NotEq), literal, place: checks in functions at the left margin that compare a name with a literal text and, where that holds, raise, return nothing, None or False, or do nothing but call something that rejects."""
    tops = nodes.where("col = 0").where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("parent"), F.col("bfs").alias("order"))
    statements = _child(nodes, "body", "TRUE", F.col("lo").alias("start"), F.col("hi").alias("stop")).join(tops, ["path", "parent"]).select("path", "start", "stop", "order", F.col("start").alias("statement"))
    ifs = nodes.where("kind = 'If'").select("path", F.col("lo").alias("parent"), "line", "bfs")
    test = _child(nodes, "test", "kind = 'Compare' AND name IN ('Eq', 'NotEq')", F.col("lo").alias("compare"), F.col("name").alias("op"))
    left = _child(nodes, "left", "kind = 'Name'", "name").withColumnRenamed("parent", "compare")
    right = _child(nodes, "comparators", "vtype = 'str'", F.col("value").alias("literal")).withColumnRenamed("parent", "compare")
    checks = ifs.join(test, ["path", "parent"]).join(left, ["path", "compare"]).join(right, ["path", "compare"])

    body = _child(nodes, "body", "TRUE", F.col("lo").alias("statement"), "kind").join(checks.select("path", "parent"), ["path", "parent"], "left_semi")
    value = _child(nodes, "value", "TRUE", F.struct(F.col("kind"), "vtype", "value", "name").alias("v")).withColumnRenamed("parent", "statement")
    nothing = F.col("v").isNull() | F.col("v.vtype").eqNullSafe("NoneType") | (F.col("v.vtype").eqNullSafe("bool") & (F.col("v.value") == "False"))
    stops = (F.col("kind") == "Raise") | ((F.col("kind") == "Return") & nothing)
    says = (F.col("kind") == "Expr") & F.col("v.kind").eqNullSafe("Call") & F.coalesce(F.contains(F.lower("v.name"), F.lit("reject")), F.lit(False))
    rejecting = body.join(value, ["path", "statement"], "left").groupBy("path", "parent").agg(F.bool_or(stops).alias("stops"), F.bool_or(says).alias("says"), F.count("*").alias("n")).where("stops OR (says AND n = 1)")
    checks = checks.join(rejecting.select("path", "parent"), ["path", "parent"], "left_semi").withColumnRenamed("parent", "place")
    held = enclosing(checks.select("path", "place"), statements).select("path", "place", "order", "statement")
    return checks.join(held, ["path", "place"]).select("path", "line", "name", "op", "literal", F.struct("order", "statement", "bfs").alias("place"))


def inconsistent_rejections(nodes: DataFrame) -> DataFrame:
    """path, line, name, first_line, first_set, set: the first check of a name in a file that rejects another set than the first check does. BHINV001.

    `==` stands for the set of its literal, `!=` for all but it: two sets that are written alike are equal, a finite one and a complement never are. first_set and set show both among the literals that the file's checks of the name hold.
    """
    checks = stored_wide(rejections(nodes), "rejections")
    whole = checks.groupBy("path", "name").agg(F.min_by(F.struct("op", "literal", "line"), "place").alias("f"), F.collect_set("literal").alias("domain"))
    differ = checks.join(whole, ["path", "name"]).where("op <> f.op OR literal <> f.literal")
    rows = differ.groupBy("path", "name").agg(F.min_by(F.struct("line", "op", "literal", "f", "domain"), "place").alias("d")).select("path", "name", "d.*")
    among = lambda op, x: F.when(op == "Eq", F.array(x)).otherwise(F.array_sort(F.array_remove("domain", x)))
    return rows.select("path", "line", "name", F.col("f.line").alias("first_line"), among(F.col("f.op"), F.col("f.literal")).alias("first_set"), among(F.col("op"), F.col("literal")).alias("set"))
