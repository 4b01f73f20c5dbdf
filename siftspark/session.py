"""What a session needs for Python functions of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster it is installed or shipped there."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and the executors are the driver."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftspark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_wide(df: DataFrame, name: str) -> DataFrame:
    """Like stored(), for syntax nodes and what comes from them: their files are far smaller than their rows, so a join that goes by the files' size would collect a large side on the driver. Joins on these exchange both sides."""
    return stored(df, name).hint("merge")


def bucketed(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """Like stored(), dealt out by the key, so that joins on it need no exchange, and sorted by `order`, so that filters on its first columns skip pages. The catalogue entry that the writer needs goes again; the files stay."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(*(order or (key,))).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved here, while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return table


def by_path(df: DataFrame, name: str) -> DataFrame:
    """Like stored_wide(), dealt out by path: groups of such tables by path and more exchange nothing, nor do joins that run in joined_in_place()."""
    return bucketed(df, name.replace("-", "_"), "path", "path", *(c for c in ("lo",) if c in df.columns)).hint("merge")


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """In it, tables that are dealt out by some of a join's keys are not exchanged by all of them. Holds for what is written in it; the setting goes back to what it was."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
