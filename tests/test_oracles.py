"""Every registered query with an SQL twin gives the twin's rows."""

import os

import duckdb
import pytest

from siftspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, sf, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
    assert ours == theirs


#: Queries that may rightly give no rows on the smallest tables.
MAY_BE_EMPTY = {"contradictory_checks", "emit_BHPLC001", "env_missing", "emit_BHCFG002", "reference_pairs"}


def test_every_query_has_sql_and_sql_has_rows(db):
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    empty = {name for name, sql in catalog.oracle_sql().items() if db.execute(sql).fetchone() is None}
    assert empty <= MAY_BE_EMPTY, empty


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
