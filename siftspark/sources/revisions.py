"""Versions of a tree as tables: which one to compare with, and what it held.

refs: ref, merge_base (with the head); heads: commit, parent; files_at: revision, path, content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Branches to compare with, in order; fixed values.
BRANCHES = ("origin/main", "origin/master", "main", "master")


def baseline(refs: DataFrame, heads: DataFrame, *keys: str) -> DataFrame:
    """The merge base of the first of BRANCHES that is not the head itself, else the head's parent; of each value of the keys. No row without either."""
    place = F.array_position(F.array(*map(F.lit, BRANCHES)), F.col("ref"))
    rows = refs.where(F.col("ref").isin(*BRANCHES) & (F.coalesce("merge_base", F.lit("")) != ""))
    rows = rows.join(heads, list(keys)) if keys else rows.crossJoin(F.broadcast(heads.limit(1)))
    best = rows.where("merge_base <> commit").groupBy(*keys).agg(F.min_by("merge_base", place).alias("base"))
    both = heads.join(best, list(keys), "left") if keys else heads.limit(1).crossJoin(F.broadcast(best))
    return both.select(*keys, F.coalesce("base", F.nullif("parent", F.lit(""))).alias("revision")).where("revision IS NOT NULL")


def at_revision(files_at: DataFrame, revisions: DataFrame) -> DataFrame:
    """The files of the given revisions."""
    return files_at.join(revisions.select("revision").distinct(), "revision", "left_semi")


def changed(files_at: DataFrame, old: str, new: str) -> DataFrame:
    """path: files that both revisions have with different contents."""
    of = lambda r, c: files_at.where(F.col("revision") == r).select("path", F.sha2("content", 256).alias(c))
    return of(old, "a").join(of(new, "b"), "path").where("a <> b").select("path")
