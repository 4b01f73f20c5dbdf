"""Python sources as a table of syntax nodes, by a table function: what rules over source code read.

A node has its place in depth-first order (lo), the last place below it (hi), its place in breadth-first order (bfs),
its parent's lo, and the field of the parent that holds it. `a` is an ancestor of `n` where the path is the same and
a.lo < n.lo <= a.hi. `func` is the lo of the function around it, -1 for none. `value` and `vtype` are a literal's text
and type; `value` is also the text of an annotation, the other name of an import, and the dots of a relative one. `ctx`
tells whether a name, attribute, subscript, list or tuple is loaded, stored or deleted. A source that is no Python
gives no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from siftspark.session import importable

SCHEMA = "path string, lo int, hi int, bfs int, parent int, field string, kind string, name string, value string, vtype string, line int, end_line int, col int, func int, cls int, ctx string"
_NAMES, _TYPES = zip(*((name, pa.string() if kind == "string" else pa.int32()) for name, kind in (c.split() for c in SCHEMA.split(", "))))
#: Nodes in a batch, but for a source that has more.
BATCH = 20_000


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; calls and subscripts inside are skipped."""
    parts = []
    while not isinstance(node, ast.Name):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, (ast.Call, ast.Subscript)):
            node = node.func if isinstance(node, ast.Call) else node.value
        else:
            return ".".join(reversed(parts)) or None
    return ".".join([node.id, *reversed(parts)])


#: What names a node of each type.
_NAMED = {
    **dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.alias, ast.ExceptHandler, ast.MatchAs, ast.MatchStar), lambda n: n.name),
    **dict.fromkeys((ast.Global, ast.Nonlocal), lambda n: ",".join(n.names)),
    **dict.fromkeys((ast.arg, ast.keyword), lambda n: n.arg),
    **dict.fromkeys((ast.Attribute, ast.Subscript), dotted),
    **dict.fromkeys((ast.BinOp, ast.BoolOp, ast.UnaryOp, ast.AugAssign), lambda n: type(n.op).__name__),
    ast.Name: lambda n: n.id,
    ast.Call: lambda n: dotted(n.func),
    ast.MatchMapping: lambda n: n.rest,
    ast.ImportFrom: lambda n: n.module,
    ast.Compare: lambda n: ",".join(type(op).__name__ for op in n.ops),
}


def _name(node: ast.AST) -> str | None:
    name = _NAMED.get(type(node))
    return name and name(node)


def _value(node: ast.AST, field: str) -> str | None:
    """The text of a literal or of an annotation, the other name of an import, the dots of a relative one."""
    if field in ("annotation", "returns"):
        return ast.unparse(node)
    if isinstance(node, ast.alias):
        return node.asname
    if isinstance(node, ast.ImportFrom):
        return "." * node.level or None
    return str(node.value) if isinstance(node, ast.Constant) else None


#: Nodes that only tell how a name is used or which operator stands there.
_MARKS = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
#: Fields that hold no nodes, or marks only.
_PLAIN = {"id", "attr", "arg", "ctx", "op", "ops", "level", "module", "asname", "conversion", "simple", "is_async", "type_comment"}
_FIELDS = {t: tuple(f for f in t._fields if f not in _PLAIN) for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST)}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


def _below(node: ast.AST) -> list[tuple[str, ast.AST]]:
    """Field and child, without the marks."""
    found = []
    for field in _FIELDS[type(node)]:
        value = getattr(node, field, None)
        for child in value if isinstance(value, list) else (value,):
            if isinstance(child, ast.AST) and not isinstance(child, _MARKS):
                found.append((field, child))
    return found


def rows(path: str | None, source: str | None) -> list[list]:
    """The nodes of one source, depth first."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    found, below = [tree], []  # breadth first: nodes, and field and number of each one's children
    for node in found:
        kids = _below(node)
        below.append([(field, k) for k, (field, _) in enumerate(kids, len(found))])
        found.extend([child for _, child in kids])
    rows, stack = [], [("", 0, -1, -1, -1)]
    while stack:  # depth first; hi is filled in from the last row below
        field, bfs, parent, func, cls = stack.pop()
        node, lo, get = found[bfs], len(rows), found[bfs].__dict__.get
        ctx = get("ctx")
        vtype = type(node.value).__name__ if isinstance(node, ast.Constant) else None
        rows.append([path, lo, lo, bfs, parent, field, type(node).__name__, _name(node), _value(node, field), vtype, get("lineno"), get("end_lineno"), get("col_offset"), func, cls, ctx and type(ctx).__name__])
        if below[bfs]:
            inner = lo if isinstance(node, _FUNCTIONS) else func
            owner = lo if isinstance(node, ast.ClassDef) else cls
            stack.extend([(f, k, lo, inner, owner) for f, k in reversed(below[bfs])])
    for row in reversed(rows):
        if row[4] >= 0 and rows[row[4]][2] < row[2]:
            rows[row[4]][2] = row[2]
    return rows


@udtf(returnType=SCHEMA, useArrow=True)
class SyntaxNodes:
    """syntax_nodes(path, source), for SQL; nodes() gives the same rows in large batches."""

    def eval(self, path: str, source: str) -> Iterator[tuple]:
        yield from map(tuple, rows(path, source))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, source -> nodes, of many sources in a batch."""
    held = []
    for batch in batches:
        for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist()):
            held += rows(path, source)
            if len(held) >= BATCH:
                yield _batch(held)
                held = []
    if held:
        yield _batch(held)


def _batch(held: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type_) for column, type_ in zip(zip(*held), _TYPES)], _NAMES)


def nodes(sources: DataFrame) -> DataFrame:
    """sources: path, source. Their syntax nodes.

    Sources are dealt out before they are parsed: a small file of texts is one task's, and its nodes are many.
    """
    spark = importable(sources.sparkSession)
    spark.udtf.register("syntax_nodes", SyntaxNodes.asDeterministic())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.select("path", "source").repartition(n, "path").mapInArrow(_batches, SCHEMA)
