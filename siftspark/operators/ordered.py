"""Passes whose result depends on order: runs, first hits, state carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.session import stored


def runs(lines: DataFrame) -> DataFrame:
    """lines: file, line. Maximal runs of neighbouring lines."""
    distinct = lines.select("file", "line").distinct()
    group = F.col("line") - F.row_number().over(W.partitionBy("file").orderBy("line"))
    return distinct.withColumn("g", group).groupBy("file", "g").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines")).drop("g")


def coverage_gaps(lines: DataFrame, most: int = 50, long: int = 25) -> DataFrame:
    """The first `most` runs of each file as findings; a long run is an error."""
    nth = F.row_number().over(W.partitionBy("file").orderBy("first_line"))
    rows = runs(lines).withColumn("nth", nth).where(F.col("nth") <= most)
    span = F.when(F.col("first_line") == F.col("last_line"), F.col("first_line").cast("string")).otherwise(F.concat(F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string")))
    message = F.concat(F.col("n_lines").cast("string"), F.lit(" executable line(s) are never exercised by the test suite (missing range "), span, F.lit(")"))
    return rows.select(F.lit("BHCOV001").alias("code"), F.col("file").alias("path"), F.col("first_line").alias("line"), F.when(F.col("n_lines") >= long, "error").otherwise("warning").alias("severity"), message.alias("message"))


def branch_gaps(branches: DataFrame, most: int = 50) -> DataFrame:
    """branches: file, nth, line, target. The first `most` branch edges of each file that were never taken, in the report's order."""
    return branches.withColumn("place", F.row_number().over(W.partitionBy("file").orderBy("nth"))).where(F.col("place") <= most).select("file", "line", "target")


def first_per_group(rows: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def carried_header(rows: DataFrame, keys: list[str], order: str, header: Column) -> DataFrame:
    """rows with carried: the last header at or before each row."""
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(header, ignorenulls=True).over(window))


def _upto(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)


def stale_derived(ops: DataFrame, derive: str, mutate: str, export: str) -> DataFrame:
    """ops: key, pos, op. The first export of each key that follows a mutation later than the last derivation."""
    seen = ops.withColumn("d", F.max(F.when(F.col("op") == derive, F.col("pos"))).over(_upto(["key"]))).withColumn("m", F.max(F.when(F.col("op") == mutate, F.col("pos"))).over(_upto(["key"])))
    stale = seen.where((F.col("op") == export) & F.col("d").isNotNull() & (F.col("m") > F.col("d")))
    return stale.groupBy("key").agg(F.min("pos").alias("pos"))


def use_after_close(ops: DataFrame, open_: str, close: str, use: str) -> DataFrame:
    """ops: key, name, pos, op. Uses of a thing whose last opening or closing before them was a closing."""
    last = F.last(F.when(F.col("op").isin(open_, close), F.col("op")), ignorenulls=True).over(_upto(["key", "name"]))
    return ops.withColumn("state", last).where((F.col("op") == use) & (F.col("state") == close)).select("key", "name", "pos")


def mode_mismatch(ops: DataFrame, read_mode: str, write_mode: str, read: str) -> DataFrame:
    """Reads while the last mode set was the writing one."""
    mode = F.last(F.when(F.col("op") == read_mode, "r").when(F.col("op") == write_mode, "w"), ignorenulls=True).over(_upto(["key", "name"]))
    return ops.withColumn("mode", mode).where((F.col("op") == read) & (F.col("mode") == "w")).select("key", "name", "pos")


def dead_stores(ops: DataFrame, store: str, read: str) -> DataFrame:
    """Stores that the next store of the same name overwrites unread: key, name, pos of the first, next_pos."""
    rows = ops.where(F.col("op").isin(store, read))
    window = W.partitionBy("key", "name").orderBy("pos")
    rows = rows.withColumn("before", F.lag("op").over(window)).withColumn("dead", F.lag("pos").over(window))
    return rows.where((F.col("op") == store) & (F.col("before") == store)).select("key", "name", F.col("dead").alias("pos"), F.col("pos").alias("next_pos"))


def read_before_check(ops: DataFrame, check: str, read: str) -> DataFrame:
    """The first read of each key that no check comes before."""
    fresh = F.coalesce(F.max((F.col("op") == check).cast("int")).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ops.withColumn("fresh", fresh).where((F.col("op") == read) & (F.col("fresh") == 0)).groupBy("key").agg(F.min("pos").alias("pos"))


def last_kept_first_placed(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row for each key: the last value, at the place where the key first came."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 1: sorted by range, a place is the one in the partition plus what the partitions before hold."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranged = stored(ranged, "ordered").withColumn("_part", F.shiftright(name, 33))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    ahead = counts.select("_part", before.alias("_ahead"))
    return ranged.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col(name).bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_ahead")
