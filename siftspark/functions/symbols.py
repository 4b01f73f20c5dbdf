"""Names of code: parts of symbol addresses, modules of files, imports under other names, generators for types."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Generators of the simple types; fixed values.
SIMPLE_STRATEGIES = {
    "str": "st.text()",
    "builtins.str": "st.text()",
    "bytes": "st.binary()",
    "builtins.bytes": "st.binary()",
    "bytearray": "st.binary().map(bytearray)",
    "int": "st.integers()",
    "builtins.int": "st.integers()",
    "float": "st.floats(allow_nan=False, allow_infinity=False)",
    "builtins.float": "st.floats(allow_nan=False, allow_infinity=False)",
    "bool": "st.booleans()",
    "builtins.bool": "st.booleans()",
}


def symbol_file(uri: Column) -> Column:
    """Of scheme://kind/project/file.../name, the file; nothing for addresses with fewer parts."""
    parts = F.split(F.regexp_replace(uri, "^.*?://", ""), "/")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, F.lit(3), F.size(parts) - 3), "/")).otherwise("")


def symbol_name(uri: Column) -> Column:
    """The last part; the whole address where symbol_file() gives nothing."""
    parts = F.split(F.regexp_replace(uri, "^.*?://", ""), "/")
    return F.when(F.size(parts) >= 4, F.element_at(parts, -1)).otherwise(uri)


def module_of(file: Column) -> Column:
    """src/a/b.py as a.b"""
    return F.replace(F.regexp_replace(F.regexp_replace(file, "^src/", ""), r"\.py$", ""), F.lit("/"), F.lit("."))


def expanded(dotted: Column, target: Column) -> Column:
    """A dotted name whose first part is an import's other name, under its own one; target: what that part stands for, or null."""
    rest = F.regexp_extract(dotted, r"^[^.]*\.(.*)$", 1)
    return F.when(target.isNull(), dotted).when(rest == "", target).otherwise(F.concat(target, F.lit("."), rest))


#: Generators of the collections of one type; fixed values.
COLLECTIONS = {"list": "lists", "set": "sets", "frozenset": "frozensets"}


def _generator(node: ast.expr) -> str | None:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        sides = [x for x in (node.left, node.right) if not (isinstance(x, ast.Constant) and x.value is None)]
        return _optional(sides[0]) if len(sides) == 1 else None
    if not isinstance(node, ast.Subscript):
        return SIMPLE_STRATEGIES.get(ast.unparse(node))
    kind, inner = ast.unparse(node.value), node.slice
    if kind == "Optional":
        return _optional(inner)
    parts = [_generator(x) for x in (inner.elts if isinstance(inner, ast.Tuple) else [inner])]
    if not all(parts):
        return None
    if kind in COLLECTIONS and len(parts) == 1:
        return f"st.{COLLECTIONS[kind]}({parts[0]}, max_size=32)"
    if kind == "dict" and len(parts) == 2:
        return f"st.dictionaries({parts[0]}, {parts[1]}, max_size=32)"
    return f"st.tuples({', '.join(parts)})" if kind == "tuple" and len(parts) > 1 else None


def _optional(node: ast.expr) -> str | None:
    inner = _generator(node)
    return inner and f"st.one_of(st.none(), {inner})"


def strategy(annotation: str | None) -> str | None:
    """The generator of values of a type; None where there is none."""
    try:
        return _generator(ast.parse((annotation or "").strip(), mode="eval").body)
    except SyntaxError:
        return None


def _strategies(annotations: pd.Series) -> pd.Series:
    known = {a: strategy(a) for a in annotations.dropna().unique()}
    return annotations.map(lambda a: known.get(a))


def strategy_of(annotation: Column | str) -> Column:
    """strategy() of a column; each different annotation once a batch."""
    return F.pandas_udf(_strategies, StringType())(annotation)
