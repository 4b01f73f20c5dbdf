"""Queries that this package registers, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftspark.plans import queries as plans
from siftspark.plans import source_queries, view_queries  # noqa: F401 - register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
