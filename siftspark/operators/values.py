"""What values in Python sources are, and where that contradicts what takes them: dimensions, units, kinds, number types, shapes.

A fact is a STRUCT (see FACT). Names, annotations and calls of known functions give facts; transfer rules give those of
expressions from their parts. Rules run bottom-up over all files at once, one round a height: a round takes every
expression whose parts are known, so there are as many rounds as the longest chain of assignments and operators that
feed one another, and only what still waits goes into the next. Then facts go along calls: a parameter takes the
surest argument that is surer than what it has, and what a function binds and returns is derived again from its
parameters, in each pass; it ends when nothing gets surer, after PASSES at most. Called functions are found by scope
(siftspark.operators.scopes).

While sources are read, a name is what was assigned to it last before, in its function or those around, else a
parameter, else what its spelling says; what is assigned must also agree with the spelling. In later passes a name is
the surest of what its function assigned to it before (a returned one: anywhere) and of its parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions import evidence
from siftspark.functions import semantic as sem
from siftspark.operators.scopes import FUNCTIONS, imports, module_of, regions, resolved
from siftspark.operators.structure import enclosing
from siftspark.session import by_path, joined_in_place, stored

PASSES = 5
#: Spellings that say something, up to which all tasks are given them.
SPELLINGS = 50_000
#: Functions that a pass derives again, up to which all tasks are given them.
FUNCTIONS_SENT = 100_000
FACETS = ("unit", "nominal", "dtype", "shape", "timezone", "encoding", "frame")
FACT = "struct<dimension: map<string,int>, " + ", ".join(f"{f}: string" for f in FACETS) + ", nullable: boolean, provenance: string, confidence: double>"
#: What known functions give and want: name, dimension, unit, nominal, timezone, encoding; 0.98 sure. Fixed values.
SOURCES = (
    ("time.monotonic", "time", "s", "instant", None, None),
    ("time.time", "time", "s", "instant", None, None),
    ("datetime.now", None, None, "instant", "naive", None),
    ("datetime.utcnow", None, None, "instant", "naive", None),
)
SINKS = (
    ("time.sleep", "time", "s", None, None, None),
    ("asyncio.sleep", "time", "s", None, None, None),
    ("socket.settimeout", "time", "s", None, None, None),
    ("threading.timer", "time", "s", None, None, None),
    ("hashlib.md5", None, None, None, None, "bytes"),
    ("hashlib.sha256", None, None, None, None, "bytes"),
    ("hashlib.sha1", None, None, None, None, "bytes"),
)
ARRAYS = "numpy.zeros numpy.ones numpy.empty numpy.full numpy.array numpy.asarray numpy.arange".split()


# ---------------------------------------------------------------- facts as columns


def _axes(axis: Column | str | None = None, power: Column | int = 1) -> Column:
    if axis is None:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return F.map_from_arrays(F.array(axis if isinstance(axis, Column) else F.lit(axis)), F.array(power if isinstance(power, Column) else F.lit(power)))


def fact(provenance: Column, confidence: Column | float = 0.0, dimension: Column | None = None, nullable: Column | bool = False, **facets: Column | str) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        (_axes() if dimension is None else dimension).alias("dimension"),
        *(lit(facets.get(f)).cast("string").alias(f) for f in FACETS),
        lit(nullable).alias("nullable"),
        provenance.alias("provenance"),
        lit(confidence).cast("double").alias("confidence"),
    )


def _said(e: Column) -> Column:
    """A fact from evidence of a name or an annotation."""
    axis, power = F.split_part(e["dimension"], F.lit(":"), F.lit(1)), F.split_part(e["dimension"], F.lit(":"), F.lit(2))
    facets = {f: F.when(e["facet"] == f, e["value"]) for f in FACETS}
    return F.when(e.isNotNull(), fact(e["provenance"], e["confidence"], F.when(e["dimension"] != "", _axes(axis, power.cast("int"))).otherwise(_axes()), **facets))


def _contract(row: tuple) -> Column:
    name, axis, *facets = row
    return fact(F.lit(f"api-contract:{name}"), 0.98, _axes(axis), **dict(zip(("unit", "nominal", "timezone", "encoding"), facets)))


def agreed(a: Column, b: Column) -> Column:
    """What two facts about one value agree on."""
    same = sem.dimension_text(a["dimension"]) == sem.dimension_text(b["dimension"])
    facets = {f: F.when(a[f].eqNullSafe(b[f]), a[f]) for f in FACETS}
    return fact(F.concat(a["provenance"], F.lit("+"), b["provenance"]), F.greatest(F.lit(sem.FLOOR), F.least(a["confidence"], b["confidence"])), F.when(same, a["dimension"]).otherwise(_axes()), a["nullable"] | b["nullable"], **facets)


def _none(dimension: Column) -> Column:
    return F.size(F.map_keys(dimension)) == 0


def _risky(a: Column, b: Column) -> Column:
    """Sums and products of number types that may lose whole numbers; null where they don't."""
    said = F.concat(F.lit("promotion-risk:"), a["provenance"], F.lit("+"), b["provenance"], F.lit(" ("), a["dtype"], F.lit("+"), b["dtype"], F.lit(" may lose integer precision)"))
    return F.when(sem.promotion_risk(a["dtype"], b["dtype"]), fact(said, F.least(a["confidence"], b["confidence"])))


def added(a: Column, b: Column) -> Column:
    clash = ~_none(a["dimension"]) & ~_none(b["dimension"]) & (sem.dimension_text(a["dimension"]) != sem.dimension_text(b["dimension"]))
    instants = (a["nominal"] == "instant") & (b["nominal"] == "instant")
    zones = (a["timezone"] != b["timezone"]) & a["timezone"].isin("aware", "naive") & b["timezone"].isin("aware", "naive")
    tag = lambda on, text: F.when(F.coalesce(on, F.lit(False)), text).otherwise("")
    said = F.concat(tag(zones, "tz-clash:"), tag(instants, "instant-clash:"), tag(clash, "dimension-clash:"), a["provenance"], F.lit("+"), b["provenance"])
    kept = {f: F.when(a[f].eqNullSafe(b[f]), a[f]) for f in ("unit", "timezone")}
    return F.coalesce(_risky(a, b), fact(said, F.least(a["confidence"], b["confidence"]), F.when(_none(a["dimension"]), b["dimension"]).otherwise(a["dimension"]), **kept))


def multiplied(a: Column, b: Column) -> Column:
    return F.coalesce(_risky(a, b), fact(F.concat(a["provenance"], F.lit("*"), b["provenance"]), F.least(a["confidence"], b["confidence"]), sem.product(a["dimension"], b["dimension"])))


def divided(a: Column, b: Column) -> Column:
    """Percent by 100 is a fraction, ms by 1000 are s; ms by anything else stay ms and say so."""
    factor = F.get(F.split(b["provenance"], "literal:"), F.lit(1)).try_cast("double")
    sure = F.least(a["confidence"], F.when(b["confidence"] == 0, 1.0).otherwise(b["confidence"]))
    ms = (a["unit"] == "ms") & (sem.dimension_text(a["dimension"]) == "time:1")
    by = lambda n: F.concat(a["provenance"], F.lit(f"/{n}"))
    over = F.concat(a["provenance"], F.lit("/"), b["provenance"])
    return (
        F.when((a["unit"] == "percent") & factor.between(99, 101), fact(by(100), sure, unit="fraction"))
        .when(ms & factor.between(999, 1001), fact(by(1000), sure, _axes("time"), unit="s"))
        .when(ms, fact(F.concat(F.lit("bad-divisor:"), over), F.least(a["confidence"], F.lit(0.80)), _axes("time"), unit="ms"))
        .otherwise(fact(over, F.least(a["confidence"], b["confidence"]), sem.quotient(a["dimension"], b["dimension"])))
    )


def cast_to(a: Column, dtype: Column, called: Column) -> Column:
    narrow = F.coalesce(sem.narrower(a["dtype"], dtype), F.lit(False))
    said = F.when(narrow, F.concat(F.lit("narrow:"), a["dtype"], F.lit("->"), dtype, F.lit(" ("), a["provenance"], F.lit(")"))).otherwise(F.concat(F.lit("call:"), called))
    return fact(said, F.least(F.when(a["confidence"] == 0, 0.70).otherwise(a["confidence"]), F.lit(0.90)), dtype=dtype, shape=a["shape"])


def reshaped(a: Column, dims: Column, called: Column) -> Column:
    """dims: numbers as text, null where some are not known."""
    total = lambda shape: F.aggregate(F.split(shape, " "), F.lit(1).cast("long"), lambda x, d: x * d.cast("long"))
    known = a["shape"].rlike("^-?[0-9]+( -?[0-9]+)*$") & (dims != "") & ~F.array_contains(F.split(dims, " "), "-1")
    clash = F.when(known, total(F.when(known, a["shape"])) != total(F.when(known, dims)))
    said = F.concat(F.lit("shape-clash:reshape "), total(F.when(known, a["shape"])).cast("string"), F.lit(" elements into "), total(F.when(known, dims)).cast("string"), F.lit(" ("), a["provenance"], F.lit(")"))
    return F.when(clash, fact(said, 0.75, dtype=a["dtype"], shape=dims)).otherwise(fact(F.concat(F.lit("call:"), called), a["confidence"], dtype=a["dtype"], shape=F.nullif(dims, F.lit(""))))


# ---------------------------------------------------------------- sources as tables


class Sources:
    """Tables read off the syntax nodes, each stored once."""

    def __init__(self, nodes: DataFrame) -> None:
        self.value = _value()
        self.nodes = by_path(nodes, "nodes")
        n = self.nodes
        bodies = regions(n).where(F.col("scope_kind").isin(*FUNCTIONS)).select("path", "start", "stop", F.col("scope").alias("home"))
        whole = n.where(F.col("kind").isin(*FUNCTIONS)).select("path", (F.col("lo") + 1).alias("start"), F.col("hi").alias("stop"), F.lit(None).cast("int").alias("home"))
        #: places in a function's body; what stands in a decorator or default, in the function and not in its body, is in none
        own = enclosing(n.select("path", F.col("lo").alias("place")), bodies.unionByName(whole), nearest=True).where("home IS NOT NULL").select("path", F.col("place").alias("lo"), "home")
        self.held = by_path(n.drop("func").join(own, ["path", "lo"]).withColumnRenamed("home", "func"), "held-nodes")
        #: places whose facts are asked for: what is assigned, returned, passed, computed with, or has an attribute
        self.asked = self.held.where("field IN ('value', 'args', 'left', 'right')")
        uses = self.asked.where("kind = 'Name'")
        #: names that are asked for, with all functions in whose bodies they stand
        self.around = by_path(enclosing(uses.select("path", F.col("lo").alias("place")), bodies).withColumnRenamed("place", "lo").join(uses.select("path", "lo", "name"), ["path", "lo"]).select("path", "lo", "name", "home"), "functions-around")
        self.names = self._names()
        self.params = self._params()
        self.calls = self._calls()
        self.assigns = self._assigns()
        value = self.held.where("field = 'value'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("expr"))
        self.returns = by_path(self.held.where("kind = 'Return'").select("path", "lo", "hi", "func").join(value, ["path", "lo"]), "returns")

    def _names(self) -> DataFrame:
        last = F.element_at(F.split("name", "[.]"), -1)
        spelled = self.nodes.where("kind IN ('Name', 'Attribute', 'arg') AND name IS NOT NULL").select(last.alias("spelling")).distinct()
        # stored first: a filter on what a spelling says would go below distinct(), to every node
        e = stored(spelled, "spellings").withColumn("e", evidence.name_evidence(F.col("spelling"))).where("e IS NOT NULL")
        e = stored(e, "name-evidence")
        said = stored(e.select("spelling", _said(F.col("e")).alias("says")), "name-facts")
        return F.broadcast(said) if e.count() <= SPELLINGS else said

    def _params(self) -> DataFrame:
        """path, func, nth, name, fact."""
        n = self.nodes
        args = n.where("kind = 'arg' AND field IN ('args', 'kwonlyargs')").select("path", "lo", "func", "name", (F.col("field") == "kwonlyargs").alias("later"), "parent")
        held = n.where("kind = 'arguments'").select("path", F.col("lo").alias("parent"), F.col("parent").alias("of"))
        functions = n.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("of"))
        note = n.where("field = 'annotation'").select("path", F.col("parent").alias("lo"), F.col("value").alias("note"))
        rows = args.join(held, ["path", "parent"]).join(functions, ["path", "of"]).join(note, ["path", "lo"], "left").join(self.names, F.col("name") == F.col("spelling"), "left")
        rows = by_path(rows.select("path", F.col("of").alias("func"), "lo", "name", "later", "says", evidence.annotation_evidence(F.col("note")).alias("e")), "parameters")
        noted = _said(F.col("e"))
        said = F.when(F.col("says").isNull(), noted).when(F.col("e").isNull(), F.col("says")).otherwise(agreed(F.col("says"), noted))
        ordered = rows.groupBy("path", "func").agg(F.sort_array(F.collect_list(F.struct("later", "lo"))).alias("order"))  # a function's parameters
        nth = (F.array_position("order", F.struct("later", "lo")) - 1).cast("int")
        return by_path(rows.join(ordered, ["path", "func"]).select("path", "func", nth.alias("nth"), "name", F.col("lo").alias("at"), F.coalesce(said, fact(F.concat(F.lit("param:"), "name"))).alias("fact")), "parameter-facts")

    def _calls(self) -> DataFrame:
        """path, lo, func, line, dotted (null unless a plain chain), canonical, callee and the looks of their arguments."""
        h = self.held
        callee = h.where("field = 'func'").select("path", F.col("parent").alias("lo"), F.col("kind").alias("by"), F.when(F.col("kind").isin("Name", "Attribute") & (F.col("hi") - F.col("lo") == F.size(F.split("name", "[.]")) - 1), F.col("name")).alias("dotted"), (F.col("lo") + 1).alias("receiver"), F.col("hi").alias("root"))
        args = h.where("field = 'args'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("arg"), F.struct("lo", "kind", "name", "value", "vtype").alias("a"))
        args = args.groupBy("path", "lo").agg(F.count("*").alias("nargs"), F.min_by("a", "arg").alias("first"))
        keys = h.where("kind = 'keyword'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("parent"), F.col("name").alias("key"))
        given = h.where("field = 'value'").select("path", "parent", F.coalesce("name", "value").alias("text"))
        keys = keys.join(given, ["path", "parent"]).groupBy("path", "lo").agg(F.count_if(F.col("key") == "tz").alias("tz"), F.max(F.when(F.col("key") == "dtype", F.col("text"))).alias("dtype"))
        calls = h.where("kind = 'Call'").select("path", "lo", "func", "line", "field").join(callee, ["path", "lo"]).join(args, ["path", "lo"], "left").join(keys, ["path", "lo"], "left")
        root = F.split_part("dotted", F.lit("."), F.lit(1))
        alias = imports(self.nodes).groupBy("path", F.col("name").alias("head")).agg(F.max_by(F.when(F.col("module").isNull() & F.col("dots").isNull(), F.coalesce("symbol")).otherwise(F.concat_ws(".", "module", "symbol")), "lo").alias("stands"))
        found = resolved(self.nodes, callee.select("path", F.col("root").alias("lo")), by_path).select("path", F.col("lo").alias("root"), "definition", "how", "origin")
        rows = calls.withColumn("head", root).join(alias, ["path", "head"], "left").join(found, ["path", "root"], "left")
        rest = F.regexp_replace("dotted", "^[^.]*", "")
        rows = rows.withColumn("canonical", F.concat(F.coalesce("stands", "head"), rest)).withColumn("origin", F.concat(F.col("origin"), rest))
        top = self.nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", "lo", "parent", "name")
        near = top.select("path", F.col("lo").alias("definition"), F.lit(True).alias("near"))
        far = top.where("parent = 0").groupBy(F.concat_ws(".", module_of(F.col("path")), "name").alias("origin")).agg(F.max_by(F.struct("path", "lo"), "lo").alias("far"))
        rows = rows.join(near, ["path", "definition"], "left").join(far, "origin", "left")
        here = F.col("near") & (F.col("how") == "function") & (F.col("by") == "Name")
        rows = rows.withColumn("to_path", F.when(here, F.col("path")).otherwise(F.col("far.path"))).withColumn("to_func", F.when(here, F.col("definition")).otherwise(F.col("far.lo")))
        return by_path(rows.select("path", "lo", "func", "line", "field", "by", "dotted", "canonical", "receiver", F.coalesce("nargs", F.lit(0)).alias("nargs"), "first", F.coalesce("tz", F.lit(0)).alias("tz"), "dtype", "to_path", "to_func"), "calls")

    def _assigns(self) -> DataFrame:
        """path, func, name, expr (what is assigned), lo and at (from where it holds), call (it is one whose function is known)."""
        h = self.held
        stmt = h.where("kind IN ('Assign', 'AnnAssign')").select("path", "func", "lo", F.col("hi").alias("at"))
        target = h.where("field IN ('targets', 'target') AND kind = 'Name'").select("path", F.col("parent").alias("lo"), "name")
        value = h.where("field = 'value'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("expr"))
        known = self.calls.where("to_func IS NOT NULL").select("path", F.col("lo").alias("expr"), F.lit(True).alias("call"))
        return by_path(stmt.join(target, ["path", "lo"]).join(value, ["path", "lo"]).join(known, ["path", "expr"], "left").select("path", "func", "name", "expr", "lo", "at", F.coalesce("call", F.lit(False)).alias("call")), "assignments")

    # ------------------------------------------------------------ what expressions say alone, and what they are made of

    def alone(self, aliases: bool) -> tuple[DataFrame, DataFrame]:
        """path, lo, fact of expressions that need no other; path, lo, op, inputs and details of those that do, but for names."""
        h, c = self.asked, self.calls.where("field IN ('value', 'args', 'left', 'right')")
        spelling = F.element_at(F.split("name", "[.]"), -1)
        said = h.where("kind IN ('Name', 'Attribute')").select("path", "lo", "kind", spelling.alias("spelling")).join(self.names, "spelling", "left")
        names = said.select("path", "lo", F.coalesce("says", fact(F.concat(F.when(F.col("kind") == "Name", "name:").otherwise("attr:"), "spelling"))).alias("fact"))
        literal = F.concat(F.lit("literal:"), F.when(F.col("vtype") == "str", F.concat(F.lit("'"), "value", F.lit("'"))).otherwise(F.col("value")))
        literals = h.where("kind = 'Constant'").select("path", "lo", fact(literal).alias("fact"))
        ops = {"Div": "divided", "Add": "added", "Sub": "added", "Mult": "multiplied", "MatMult": "multiplied"}
        made = h.where(F.col("kind") == "BinOp").where(F.col("name").isin(*ops))
        sides = self.held.where("field IN ('left', 'right')").select("path", F.col("parent").alias("lo"), F.col("lo").alias("side"))
        op = reduce(lambda w, kv: w.when(F.col("name") == kv[0], kv[1]), list(ops.items())[1:], F.when(F.col("name") == "Div", "divided"))
        sums = made.select("path", "lo", op.alias("op")).join(sides, ["path", "lo"]).groupBy("path", "lo", "op").agg(F.sort_array(F.collect_list("side")).alias("inputs"))
        others = h.where("kind NOT IN ('Name', 'Attribute', 'Constant', 'Call')").join(made.select("path", "lo"), ["path", "lo"], "left_anti").select("path", "lo", fact(F.concat(F.lit("expr:"), "kind")).alias("fact"))
        canonical = F.col("canonical" if aliases else "dotted")
        short = F.coalesce(F.element_at(F.split("dotted", "[.]"), -1), F.lit(""))
        method = F.col("by") == "Attribute"
        called = F.coalesce("dotted", F.lit("?"))
        text = F.concat(F.lit("call:"), called)
        first = F.col("first")
        target = sem.dtype_name(F.coalesce(first["name"], first["value"]))
        now = F.endswith(canonical, F.lit("datetime.now")) | (canonical == "now")
        aware = (F.col("tz") > 0) | ((F.col("nargs") > 0) & ~((first["kind"] == "Constant") & (first["vtype"] == "NoneType")))
        shape = self._elements(c.where("nargs > 0"), first=True)
        c = c.join(shape, ["path", "lo"], "left")
        dtype = sem.dtype_name(F.col("dtype"))
        result = reduce(lambda w, row: w.when(canonical == row[0], _contract(row)), SOURCES[1:], F.when(canonical == SOURCES[0][0], _contract(SOURCES[0])))
        astype = (short == "astype") & (F.col("nargs") > 0) & method & target.isNotNull()
        array = canonical.isin(*ARRAYS)
        reshape = (short == "reshape") & method
        result = (
            result.when(now, fact(text, 0.90, nominal="instant", timezone=F.when(aware, "aware").otherwise("naive")))
            .when(F.endswith("dotted", F.lit(".get")) & (F.col("nargs") == 1), fact(text, 0.60, nullable=True))
            .when((short == "encode") & method, fact(text, 0.85, encoding="bytes"))
            .when((short == "decode") & method, fact(text, 0.85, encoding="utf8"))
            .when(short == "recv", fact(text, 0.80, encoding="bytes"))
            .when(astype, F.lit(None))
            .when(array, fact(text, F.when(dtype.isNotNull(), 0.90).otherwise(0.50), dtype=dtype, shape=F.col("shape")))
            .when(reshape, F.lit(None))
            .otherwise(fact(text))
        )
        results = c.select("path", "lo", result.alias("fact"), F.when(astype, "cast").when(reshape, "reshaped").alias("op"), F.array("receiver").alias("inputs"), target.alias("dtype"), called.alias("called"))
        results = by_path(results, "call-facts")
        plain = names.unionByName(literals).unionByName(others).unionByName(results.where("fact IS NOT NULL").select("path", "lo", "fact"))
        dims = self._elements(self.calls.where("nargs > 0"), first=False).withColumnRenamed("shape", "dims")
        waits = results.where("fact IS NULL").select("path", "lo", "op", "inputs", "dtype", "called").unionByName(sums, allowMissingColumns=True)
        return plain, waits.join(dims, ["path", "lo"], "left")

    def _elements(self, calls: DataFrame, first: bool) -> DataFrame:
        """path, lo, shape: the numbers in a call's first argument if it is a tuple or list (others as ?), or in all arguments, null where one isn't a number."""
        h = self.held
        args = h.where("field = 'args'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("arg"), "kind", "vtype", "value", "name")
        args = args.join(calls.select("path", "lo", F.col("first.lo").alias("head")), ["path", "lo"])
        if first:
            args = args.where("arg = head AND kind IN ('Tuple', 'List')")
        elements = h.where("field = 'elts'").select("path", F.col("parent").alias("arg"), F.col("lo").alias("at"), F.col("kind").alias("k"), F.col("vtype").alias("t"), F.col("value").alias("v"), F.col("name").alias("m"))
        rows = args.join(elements, ["path", "arg"], "left")
        listed = F.col("kind").isin("Tuple", "List")
        rows = rows.where(~listed | F.col("at").isNotNull()) if not first else rows
        pick = lambda a, b: F.when(listed, F.col(a)).otherwise(F.col(b))
        number = F.when((pick("k", "kind") == "Constant") & pick("t", "vtype").isin("int", "bool"), F.replace(F.replace(pick("v", "value"), F.lit("True"), F.lit("1")), F.lit("False"), F.lit("0")))
        if first:
            each = F.when(F.col("at").isNotNull(), F.coalesce(number, F.lit("?")))
            return rows.groupBy("path", "lo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", each.alias("d"))))), lambda x: x["d"]), " ").alias("shape"))
        below = h.where("field = 'operand' AND kind = 'Constant' AND value = '1'").select("path", F.col("parent").alias("minus"), F.lit(True).alias("one"))
        rows = rows.withColumn("minus", F.when((pick("k", "kind") == "UnaryOp") & (pick("m", "name") == "USub"), pick("at", "arg"))).join(below, ["path", "minus"], "left")
        each = F.coalesce(number, F.when(F.col("one"), "-1"))
        rows = rows.groupBy("path", "lo").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("at", "arg").alias("at"), F.coalesce(each, F.lit("x")).alias("d")))).alias("ds"))
        return rows.select("path", "lo", F.when(~F.exists("ds", lambda x: x["d"] == "x"), F.array_join(F.transform("ds", lambda x: x["d"]), " ")).alias("shape"))


def evaluated(known: DataFrame, waits: DataFrame, value: Column) -> DataFrame:
    """known: path, lo, fact; waits: path, lo, op, inputs (places), own (a fact), dtype, called, dims. All facts, by rounds of rising height.

    A round brings the facts of the round before to what waits for them, and is written once, with the facts that each
    has got so far. value: the column that _value() makes, which takes a while.
    """
    fresh = by_path(known, "facts")
    done, waits = [fresh], waits.withColumn("got", F.lit(None).cast(f"array<struct<nth: int, fact: {FACT}>>"))
    while True:
        came = waits.select("path", "lo", F.posexplode("inputs").alias("nth", "input")).join(fresh.select("path", F.col("lo").alias("input"), "fact"), ["path", "input"])
        came = came.groupBy("path", "lo").agg(F.collect_list(F.struct("nth", "fact")).alias("new"))  # an expression's inputs
        got = F.concat(F.coalesce("got", F.array()), F.coalesce("new", F.array()))
        state = by_path(waits.join(came, ["path", "lo"], "left").withColumn("got", got).drop("new").withColumn("ready", F.size("got") == F.size("inputs")), "waiting")
        ready, open_ = state.agg(F.count_if("ready"), F.count_if(~F.col("ready"))).first()
        if not ready:
            return reduce(DataFrame.unionByName, done)
        at = lambda n: F.get(F.filter("got", lambda g: g["nth"] == n), F.lit(0))["fact"]
        surer = lambda x, y: F.when((y["fact"]["confidence"] > x["fact"]["confidence"]) | ((y["fact"]["confidence"] == x["fact"]["confidence"]) & (y["nth"] < x["nth"])), y).otherwise(x)
        surest = F.aggregate("got", F.get("got", F.lit(0)), surer)["fact"]
        fresh = state.where("ready").select("path", "lo", "op", "own", "dtype", "called", "dims", at(0).alias("a"), at(1).alias("b"), surest.alias("surest"))
        fresh = by_path(fresh.select("path", "lo", value.alias("fact")), "facts")
        done.append(fresh)
        if not open_:
            return reduce(DataFrame.unionByName, done)
        waits = state.where("NOT ready").drop("ready")


def _value() -> Column:
    """The fact of an expression from its first and second inputs, a and b, or of a name from the surest."""
    a, b, own, surest = F.col("a"), F.col("b"), F.col("own"), F.col("surest")
    return (
        F.when(F.col("op") == "added", added(a, b)).when(F.col("op") == "multiplied", multiplied(a, b)).when(F.col("op") == "divided", divided(a, b))
        .when(F.col("op") == "cast", cast_to(a, F.col("dtype"), F.col("called"))).when(F.col("op") == "reshaped", reshaped(a, F.col("dims"), F.col("called")))
        .when(F.col("op") == "assigned", F.when(own.isNull(), a).otherwise(agreed(own, a)))
        .otherwise(F.when(own.isNotNull() & (own["confidence"] >= surest["confidence"]), own).otherwise(surest))
    )


def read(s: Sources) -> tuple[DataFrame, DataFrame]:
    """Facts of all expressions as the sources are read, and of bindings (path, func, name, fact), the last one of each name."""
    plain, waits = s.alone(aliases=True)
    defs = s.assigns.select("path", F.col("func").alias("home"), "name", "at", F.col("expr")).unionByName(s.params.select("path", F.col("func").alias("home"), "name", "at", F.lit(None).cast("int").alias("expr")))
    linked = s.around.join(defs, ["path", "home", "name"]).where("at < lo").groupBy("path", "lo", "name").agg(F.max_by(F.struct("home", "expr"), F.struct("home", "at")).alias("d"))
    linked = by_path(linked.select("path", "lo", "name", "d.*"), "uses").join(s.params.select("path", F.col("func").alias("home"), "name", F.col("fact").alias("given")), ["path", "home", "name"], "left")
    linked = linked.join(s.names, F.col("name") == F.col("spelling"), "left")
    given = linked.where("expr IS NULL").select("path", "lo", F.col("given").alias("fact"))
    known = plain.join(linked.select("path", "lo"), ["path", "lo"], "left_anti").unionByName(given)
    names = linked.where("expr IS NOT NULL").select("path", "lo", F.lit("assigned").alias("op"), F.array("expr").alias("inputs"), F.col("says").alias("own"))
    facts = evaluated(known, waits.withColumn("own", F.lit(None).cast(FACT)).unionByName(names, allowMissingColumns=True), s.value)
    bound = s.assigns.join(facts.withColumnRenamed("lo", "expr"), ["path", "expr"]).groupBy("path", "func", "name").agg(F.max_by("fact", "at").alias("f")).join(s.names, F.col("name") == F.col("spelling"), "left")
    return facts, by_path(bound.select("path", "func", "name", F.when(F.col("says").isNull(), F.col("f")).otherwise(agreed(F.col("says"), F.col("f"))).alias("fact")), "bindings")


def derived(s: Sources, alone: tuple[DataFrame, DataFrame], params: DataFrame, returns: DataFrame, some: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bindings and returned facts, derived again from parameters and what called functions return; of all functions, or of `some` (path, func)."""
    of = lambda df: df if some is None else df.join(some, ["path", "func"], "left_semi")
    calls, written, read_ = of(s.calls.where("to_func IS NOT NULL")), of(s.assigns), of(s.returns)
    asked, params = of(s.asked), of(params)
    plain, waits = alone
    if some is not None:
        here = asked.select("path", "lo")
        plain, waits = (t.join(here, ["path", "lo"], "left_semi") for t in alone)
        returns = returns.join(calls.select(F.col("to_path").alias("path"), F.col("to_func").alias("func")).distinct(), ["path", "func"], "left_semi")
    joined = returns.groupBy("path", "func").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fact")), lambda x, y: x["nth"] - y["nth"]), lambda x: x["fact"]).alias("all"))  # a function's returns
    both = joined.select(F.col("path").alias("to_path"), F.col("func").alias("to_func"), F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), agreed).alias("fact"))
    # a known call's result stands at the place below zero that answers to its own
    given = calls.join(both, ["to_path", "to_func"]).select("path", (-F.col("lo") - 1).alias("lo"), "fact")
    has = given.select("path", (-F.col("lo") - 1).alias("expr"), F.lit(True).alias("has"))
    assigns = by_path(written.join(has, ["path", "expr"], "left").select("path", "func", "name", "lo", "at", F.when(F.col("has"), -F.col("expr") - 1).otherwise(F.col("expr")).alias("input")), "inputs")
    # names in what is assigned see the assignments before; names in what is returned see all
    inside = written.select("path", "func", F.col("lo").alias("start"), F.col("at").alias("stop"), F.col("lo").alias("until")).unionByName(read_.select("path", "func", F.col("lo").alias("start"), F.col("hi").alias("stop"), F.lit(1 << 30).alias("until")))
    uses = asked.where("kind = 'Name' AND ctx = 'Load'").select("path", "lo", "func", "name")
    uses = enclosing(uses.select("path", F.col("lo").alias("place")), inside.distinct(), nearest=True).select("path", F.col("place").alias("lo"), "until").join(uses, ["path", "lo"])
    before = uses.join(assigns.select("path", "func", "name", F.col("lo").alias("set"), "input"), ["path", "func", "name"]).where("set < until").groupBy("path", "lo").agg(F.transform(F.sort_array(F.collect_list(F.struct("set", "input"))), lambda x: x["input"]).alias("inputs"))
    linked = by_path(uses.join(before, ["path", "lo"], "left").join(params.select("path", "func", "name", F.col("fact").alias("own")), ["path", "func", "name"], "left").where("inputs IS NOT NULL OR own IS NOT NULL"), "uses")
    known = plain.join(linked.select("path", "lo"), ["path", "lo"], "left_anti").unionByName(given).unionByName(linked.where("inputs IS NULL").select("path", "lo", F.col("own").alias("fact")))
    names = linked.where("inputs IS NOT NULL").select("path", "lo", F.lit("surest").alias("op"), "inputs", "own")
    facts = evaluated(known, waits.withColumn("own", F.lit(None).cast(FACT)).unionByName(names, allowMissingColumns=True), s.value)
    bound = assigns.join(facts.withColumnRenamed("lo", "input"), ["path", "input"]).groupBy("path", "func", "name").agg(F.max_by("fact", F.struct(F.col("fact.confidence"), -F.col("lo"))).alias("fact"))
    bound = by_path(bound.join(params.select("path", "func", "name"), ["path", "func", "name"], "left_anti"), "bindings")
    back = read_.join(facts.withColumnRenamed("lo", "expr"), ["path", "expr"]).select("path", "func", F.col("lo").alias("nth"), "fact")
    return bound, by_path(back, "returned")


def arguments(s: Sources, facts: DataFrame) -> DataFrame:
    """Every argument of every call: path, func, lo, line, dotted, to_path, to_func, nth (null for keywords), key, arg_name, fact as read."""
    args = s.held.where("field = 'args'").select("path", F.col("parent").alias("lo"), F.col("lo").alias("arg"), F.when(F.col("kind").isin("Name", "Attribute"), F.element_at(F.split("name", "[.]"), -1)).alias("arg_name"))
    order = args.groupBy("path", "lo").agg(F.sort_array(F.collect_list("arg")).alias("order"))  # a call's arguments
    args = args.join(order, ["path", "lo"]).select("path", "lo", "arg", "arg_name", (F.array_position("order", F.col("arg")) - 1).cast("int").alias("nth"), F.lit(None).cast("string").alias("key"))
    keys = s.held.where("kind = 'keyword' AND name IS NOT NULL").select("path", F.col("parent").alias("lo"), F.col("lo").alias("parent"), F.col("name").alias("key"))
    value = s.held.where("field = 'value'").select("path", "parent", F.col("lo").alias("arg"))
    keys = keys.join(value, ["path", "parent"]).select("path", "lo", "arg", F.lit(None).cast("string").alias("arg_name"), F.lit(None).cast("int").alias("nth"), "key")
    rows = args.unionByName(keys).join(facts.withColumnRenamed("lo", "arg"), ["path", "arg"])
    return by_path(rows.join(s.calls.select("path", "lo", "func", "line", "dotted", "to_path", "to_func"), ["path", "lo"]), "arguments")


def _final(args: DataFrame, *scopes: DataFrame) -> DataFrame:
    """args with what their names are bound to where that is as sure; of several scopes the first that has the name and is as sure."""
    for i, scope in enumerate(scopes):
        args = args.join(scope.select("path", "func", F.col("name").alias("arg_name"), F.col("fact").alias(f"s{i}")), ["path", "func", "arg_name"], "left")
    pick = F.lit(None).cast(FACT)
    for i in range(len(scopes)):
        sure = F.col(f"s{i}").isNotNull() & (F.col(f"s{i}.confidence") >= F.col("fact.confidence"))
        pick = F.coalesce(pick, F.when(sure, F.col(f"s{i}")))
    return args.withColumn("fact", F.coalesce(pick, F.col("fact"))).drop(*(f"s{i}" for i in range(len(scopes))))


def contradictions(nodes: DataFrame, passes: int = PASSES) -> DataFrame:
    """code, path, line (0 for what is no call), function, name (the sink, variable or return), severity, message of BHSEM001 to BHSEM010 and BHUNIT004 in the sources whose syntax nodes are given."""
    with joined_in_place(nodes.sparkSession):
        return _contradictions(nodes, passes)


def _contradictions(nodes: DataFrame, passes: int) -> DataFrame:
    s = Sources(nodes)
    facts, bound = read(s)
    facts = by_path(facts, "facts-as-read")
    args = arguments(s, facts)
    params = s.params
    returns = by_path(s.returns.join(facts.withColumnRenamed("lo", "expr"), ["path", "expr"]).select("path", "func", F.col("lo").alias("nth"), "fact"), "returned")
    plain, waits = s.alone(aliases=False)
    alone = by_path(plain, "plain"), by_path(waits, "waits")
    some = surer = None
    for step in range(passes):
        came = _final(args.where("to_func IS NOT NULL AND nth IS NOT NULL"), bound).unionByName(args.where("to_func IS NOT NULL AND key IS NOT NULL")).where("fact.confidence > 0")
        onto = params.select(F.col("path").alias("to_path"), F.col("func").alias("to_func"), F.col("nth").alias("p"), F.col("name").alias("param"))
        came = came.join(onto, ["to_path", "to_func"]).where("nth = p OR key = param")
        best = came.groupBy("to_path", "to_func", "param").agg(F.max_by("fact", F.struct(F.col("fact.confidence"), F.struct(-F.crc32("path"), -F.col("lo")))).alias("came"))
        best = best.select(F.col("to_path").alias("path"), F.col("to_func").alias("func"), F.col("param").alias("name"), "came")
        stronger = F.col("came").isNotNull() & (F.col("came.confidence") > F.col("fact.confidence"))
        params = by_path(params.join(best, ["path", "func", "name"], "left").withColumn("stronger", F.coalesce(stronger, F.lit(False))).select("path", "func", "nth", "name", "at", F.when(F.col("stronger"), F.col("came")).otherwise(F.col("fact")).alias("fact"), "stronger"), "parameter-facts")
        if step:
            # what a function gives depends on its parameters and on what it calls: where neither changed, it stays
            callers = s.calls.join(surer.select(F.col("path").alias("to_path"), F.col("func").alias("to_func")), ["to_path", "to_func"], "left_semi")
            some = stored(params.where("stronger").select("path", "func").unionByName(callers.select("path", "func")).distinct(), "changed-functions")
            n = some.count()
            if not n:
                break
            some = F.broadcast(some) if n <= FUNCTIONS_SENT else some
        params = params.drop("stronger")
        new, again = derived(s, alone, params, returns, some)
        bound = new if some is None else by_path(bound.join(some, ["path", "func"], "left_anti").unionByName(new), "bindings")
        surer = again.withColumnRenamed("fact", "new").join(returns, ["path", "func", "nth"]).where("new.confidence > fact.confidence").select("path", "func").distinct()
        surer = stored(surer, "surer-returns")
        returns = by_path(returns.join(surer, ["path", "func"], "left_anti").unionByName(again.join(surer, ["path", "func"], "left_semi")), "returned")
    return _reported(s, facts, args, params, bound, returns)


def _reported(s: Sources, facts: DataFrame, args: DataFrame, params: DataFrame, bound: DataFrame, returns: DataFrame) -> DataFrame:
    label = lambda text: F.lit(text)
    final = stored(_final(args.where("nth IS NOT NULL"), bound, params), "final-arguments")
    # what known functions want of their first argument
    short = F.element_at(F.split("dotted", "[.]"), -1)
    wanted = None
    for row in SINKS:
        wanted = (F if wanted is None else wanted).when((short == row[0].split(".")[-1]) | (F.col("dotted") == row[0]), _contract(row))
    sinks = final.where("nth = 0").withColumn("wanted", wanted).where("wanted IS NOT NULL").withColumn("code", sem.sink_code(F.col("fact"), F.col("wanted")))
    sinks = sinks.withColumn("sure", F.least("fact.confidence", "wanted.confidence")).where(F.col("code").isNotNull() & sem.reportable(F.col("sure"), F.col("fact.provenance")))
    sinks = sinks.select("code", "path", "line", "func", F.col("dotted").alias("name"), "sure", F.concat(F.col("fact.provenance"), label(" reaches "), F.col("dotted")).alias("message"))
    # parameters of known functions
    onto = params.select(F.col("path").alias("to_path"), F.col("func").alias("to_func"), "nth", F.col("fact").alias("wanted"))
    spaced = lambda f: F.struct(f["nominal"].alias("nominal"), f["frame"].alias("frame"), f["unit"].alias("unit"), F.split(f["shape"], " ").alias("shape"))
    kinds = final.join(onto, ["to_path", "to_func", "nth"]).withColumn("code", sem.nominal_code(spaced(F.col("fact")), spaced(F.col("wanted")))).withColumn("sure", F.least("fact.confidence", "wanted.confidence"))
    sources = sem.source_count(F.col("fact.provenance")) + sem.source_count(F.col("wanted.provenance"))
    kinds = kinds.where(F.col("code").isNotNull() & ((F.col("sure") >= 0.70) | ((F.col("sure") >= 0.45) & (sources >= 2))))
    kinds = kinds.select("code", "path", "line", "func", F.col("dotted").alias("name"), "sure", F.concat(F.col("fact.provenance"), label(" is passed where "), F.col("wanted.provenance"), label(" is wanted")).alias("message"))
    # contradictions inside expressions
    listed = returns.groupBy("path", "func").agg(F.sort_array(F.collect_list("nth")).alias("order"))
    back = returns.join(listed, ["path", "func"]).select("path", "func", F.concat(label("return@"), (F.array_position("order", F.col("nth")) - 1).cast("string")).alias("name"), "fact")
    tagged = bound.select("path", "func", "name", "fact").unionByName(params.select("path", "func", "name", "fact")).unionByName(back)
    tagged = tagged.withColumn("code", sem.tag_code(F.col("fact.provenance"))).where(F.col("code").isNotNull() & sem.reportable(F.col("fact.confidence"), F.col("fact.provenance")))
    tagged = tagged.select("code", "path", F.lit(0).alias("line"), "func", "name", F.col("fact.confidence").alias("sure"), F.col("fact.provenance").alias("message"))
    found = sinks.unionByName(kinds).unionByName(tagged).unionByName(_nullable(s, facts))
    names = s.nodes.where(F.col("kind").isin(*FUNCTIONS)).select("path", F.col("lo").alias("func"), F.col("name").alias("function"))
    severity = F.when(F.col("code") == "BHSEM010", "warning").otherwise(sem.severity(F.col("sure")))
    return found.join(names, ["path", "func"]).select("code", "path", "line", "function", "name", severity.alias("severity"), "message")


def _nullable(s: Sources, facts: DataFrame) -> DataFrame:
    """Methods called on what may be None, in functions that never look whether it is."""
    h = s.held
    base = h.where("field = 'value' AND kind = 'Name'").select("path", F.col("parent").alias("attribute"), "lo", "name")
    called = h.where("field = 'func' AND kind = 'Attribute'").select("path", F.col("lo").alias("attribute"), F.col("parent").alias("call"), "func")
    lines = h.where("kind = 'Call'").select("path", F.col("lo").alias("call"), "line")
    may = called.join(base, ["path", "attribute"]).join(lines, ["path", "call"]).join(facts, ["path", "lo"]).where("fact.nullable")
    side = h.where("kind = 'Name'").select("path", "parent", "func", "field", "name")
    at = lambda kinds: h.where(kinds).select("path", F.col("lo").alias("parent"))
    tested = h.where("field = 'test'").select("path", "lo", "kind", "name", "func", F.col("parent").alias("stmt")).join(h.where("kind = 'If'").select("path", F.col("lo").alias("stmt")), ["path", "stmt"])
    leaves = h.where("field = 'body' AND kind IN ('Return', 'Raise', 'Break', 'Continue')").select("path", F.col("parent").alias("stmt")).distinct()
    within = lambda tests: side.where("field IN ('values', 'operand')").join(tests.select("path", F.col("lo").alias("parent")), ["path", "parent"]).select("path", "func", "name")
    asked = h.where("kind = 'Call' AND name = 'isinstance'").select("path", F.col("lo").alias("parent"))
    first = side.where("field = 'args'").join(h.where("field = 'args'").groupBy("path", "parent").agg(F.min("lo").alias("first")), ["path", "parent"]).join(asked, ["path", "parent"])
    first = first.join(h.select("path", F.col("lo").alias("first"), F.col("name").alias("n0"), F.col("kind").alias("k0")), ["path", "first"]).where("k0 = 'Name' AND n0 = name").select("path", "func", "name")
    guarded = (
        side.where("field IN ('left', 'comparators')").join(at(F.col("kind").eqNullSafe("Compare") & F.col("name").rlike("(^|,)Is(Not)?(,|$)")), ["path", "parent"]).select("path", "func", "name")
        .unionByName(tested.where("kind = 'Name'").select("path", "func", "name"))
        .unionByName(within(tested.where("kind = 'BoolOp' AND name = 'And'")))
        .unionByName(within(tested.where("kind = 'UnaryOp' AND name = 'Not'").join(leaves, ["path", "stmt"])))
        .unionByName(first)
    ).distinct()
    sure = F.least("fact.confidence", F.lit(0.60))
    rows = may.join(guarded, ["path", "func", "name"], "left_anti").withColumn("sure", sure).where("sure >= 0.45")
    return rows.select(F.lit("BHSEM010").alias("code"), "path", "line", "func", "name", "sure", F.concat("name", F.lit(" may be None")).alias("message"))
