"""A project made from the suppliers whose modules hand keywords, dicts and literals to each other; its schemas; and what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: @ stands for a supplier's key, $ for the next one's, # for its hundredth's: within each ten, hand goes on to the next module, up to the tenth. % is a literal that depends on the key.
HEAD = """from shop.c$ import hand$ as onward
def hand@(**options):
    return onward(deep#=@, **options)
def ask@(hand):
    return hand@(size@=1, **{"colour": hand})
"""
LAST = """import shop
def hand@(colour, *rest, size@=0, deep=None):
    return colour
def ask@(hand):
    return hand@(size@=1, shape=hand)
"""
BODY = """def knot@(**o):
    return loop@(**o)
def loop@(**o):
    return knot@(**o)
def open@(**o):
    return any@(**o) if o else knot@(x=1)
def any@(a, **o):
    return open@(b=1, **o), loop@(c=2)
def shape@(flag):
    def inner():
        return {"a": 1, "b@": 2}
    return {"b@": flag, "a": inner} if not flag else {}
def pair@(flag):
    if flag:
        return {"a": 1, "b@": 2}
    return {"b@": flag, **flag, "a": 1}
def mixed@(flag):
    return {"a": 1} if flag else None
def read@(got):
    one = two = pair@(1)
    def deep():
        return one["a"], one.get("b@"), two.pop("%"), other["z"]
    other = mixed@(two[got])
    return deep
class Box@:
    a: int
    b% = 1
    _own = 2
    def c(self):
        self.d = 3
def check@(tier):
    if tier == "low":
        raise ValueError(tier)
    while tier:
        if tier == "mid":
            return tier
def again@(tier):
    if tier %op% "%":
        reject_all(tier)
"""
_SCHEMA = '{"$defs": {"Box@": {"properties": {"a": {}, "b%": {}}}, "Other@": {"properties": {"q": {}}}}}'


def sources(supplier: DataFrame) -> DataFrame:
    """path and source, a module for each supplier."""
    k = F.col("s_suppkey").cast("int")
    text = F.concat(F.when(k % 10 == 9, F.lit(LAST)).otherwise(F.lit(HEAD)), F.lit(BODY))
    marks = {"%op%": F.when(k % 4 == 3, "!=").otherwise("=="), "%": F.when(k % 3 == 0, "a").when(k % 3 == 1, "low").otherwise("up"), "#": F.when(k % 20 < 10, "").otherwise("er"), "$": (k + 1).cast("string"), "@": k.cast("string")}
    for mark, value in marks.items():
        text = F.replace(text, F.lit(mark), value)
    return supplier.select(F.concat(F.lit("src/shop/c"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("source"))


def schema_files(supplier: DataFrame) -> DataFrame:
    """path and text, a schema for each supplier; of every fifth the class has a field more than the schema."""
    k = F.col("s_suppkey").cast("int")
    lit = F.when(k % 5 == 0, "x").when(k % 3 == 0, "a").when(k % 3 == 1, "low").otherwise("up")
    return supplier.select(F.concat(F.lit("api/s"), k.cast("string"), F.lit(".json")).alias("path"), F.replace(F.replace(F.lit(_SCHEMA), F.lit("%"), lit), F.lit("@"), k.cast("string")).alias("text"))


_K = "k AS (SELECT CAST(s_suppkey AS INTEGER) AS k, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'low' ELSE 'up' END AS lit FROM supplier)"

#: Every ten's modules end at its last one, if there is one: it takes neither another's size nor, in every second ten, what the call in hand adds.
FORWARDING_SQL = f"""WITH {_K}, e AS (SELECT a.k, b.k AS last, 'src/shop/c' || a.k || '.py' AS path, 'src/shop/c' || b.k || '.py:hand' || b.k AS terminal FROM k a JOIN k b ON b.k = a.k - a.k % 10 + 9 WHERE a.k < b.k)
SELECT path, 5 AS line, 'hand' || k AS function, terminal, ['size' || k] AS keys FROM e
UNION ALL SELECT path, 3, 'onward', terminal, ['deeper'] FROM e WHERE k % 20 >= 10"""

#: two.pop reads what the literal says; pair gives a and its own b. Lines stand after those of HEAD or LAST, five each.
SHAPES_SQL = f"""WITH {_K} SELECT 'src/shop/c' || k || '.py' AS path, 25 AS line, 'pair' || k AS producer, [lit] AS keys FROM k WHERE lit <> 'a'"""

MODELS_SQL = f"""WITH {_K} SELECT 'src/shop/c' || k || '.py' AS path, 'Box' || k AS name, 'api/s' || k || '.json' AS schema, ['bx'] AS only_in_schema, ['b' || lit] AS only_in_model FROM k WHERE k % 5 = 0"""

#: The check that returns its argument rejects nothing. A complement differs from any finite set.
DOMAINS_SQL = f"""WITH {_K} SELECT 'src/shop/c' || k || '.py' AS path, 43 AS line, 'tier' AS name, 37 AS first_line, ['low'] AS first_set,
CASE WHEN k % 4 <> 3 THEN [lit] WHEN lit = 'low' THEN [] ELSE ['low'] END AS set FROM k WHERE lit <> 'low' OR k % 4 = 3"""

_TRIPS = """import json
def export_@(path):
    return path
def import_@(text):
    return text
class Store@:
    def backup_@(self, n):
        return json.dumps(n)
    def restore_@(self):
        return 1
    def export_%(self, data):
        return data
def restore_x(n):
    return n
def read_backup(n):
    return [open(x) for x in n]
"""
_TRIP_TESTS = "def test_trip():\n    assert import_@(export_@(1)) == 1\n"
_TRIP_STORES = "class TestStore:\n    def test_store(self):\n        s.back.restore_@(), s.backup_@(1)\ndef test_one():\n    export_@(1)\ndef test_other():\n    import_@(1)\n"


def trips(supplier: DataFrame) -> DataFrame:
    """path and source: a module for each supplier; every second has a test of one round trip, every third one of the other; of every fifth the export is of a module."""
    k = F.col("s_suppkey").cast("int")
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("%"), F.when(k % 5 == 0, "module").otherwise("rows")), F.lit("@"), k.cast("string"))
    of = lambda rows, head, text: rows.select(F.concat(F.lit(head), k.cast("string"), F.lit(".py")).alias("path"), filled(text).alias("source"))
    return of(supplier, "src/trip", _TRIPS).unionByName(of(supplier.where(k % 2 == 0), "tests/test_trip", _TRIP_TESTS)).unionByName(of(supplier.where(k % 3 == 0), "tests/test_store", _TRIP_STORES))


TRIPS_SQL = f"""WITH {_K}, p AS (SELECT *, 'src/trip' || k || '.py' AS path FROM k)
SELECT 'BHRT001' AS code, path, 2 AS line, 'export_' || k AS name, 'import_' || k AS partner FROM p WHERE k % 2 = 1
UNION ALL SELECT 'BHRT001', path, 7, 'Store' || k || '.backup_' || k, 'Store' || k || '.restore_' || k FROM p WHERE k % 3 <> 0
UNION ALL SELECT 'BHRT002', path, 11, 'Store' || k || '.export_rows', 'Store' || k || '.import_rows' FROM p WHERE k % 5 <> 0
UNION ALL SELECT 'BHRT002', path, 15, 'read_backup', 'read_restore' FROM p"""
