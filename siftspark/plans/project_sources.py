"""A project made from the suppliers: a module for each, which calls the next one's, and tests for some; and what its names mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: @ stands for a supplier's key, $ for the next one's of its ten, the first's after the last.
MODULE = """import requests as r
from shop.s$ import send$ as forward
from .s$ import LIMIT as limit

LIMIT = @

def load@(url):
    return forward(url, limit)

def send@(url, LIMIT):
    return r.get(url, timeout=LIMIT)

def calc@(LIMIT):
    return [LIMIT for LIMIT in range(LIMIT)]

class Box@:
    LIMIT = LIMIT + 1
    def get(self, size=LIMIT):
        global seen
        seen = LIMIT
        return calc@(size)

def hollow@():
    raise NotImplementedError

def local@(r):
    return r.get(seen), forward(load@, r)

def run@(c):
    import subprocess
    return subprocess.run(c)
"""
TEST = "from shop.s@ import send@\n\ndef test_send():\n    assert send@('u', 1)\n"
FAILING = "import shop.s@ as m\n\ndef test_send_refused():\n    assert m.send@('u', 1) is m.hollow@()\n    with pytest.raises(OSError):\n        m.Run@(1), m.run@(2)\n"


def sources(supplier: DataFrame) -> DataFrame:
    """path and source: a module for each supplier, a test for every second, a test of failure for every third."""
    ring = supplier.selectExpr("s_suppkey AS k", "CAST(s_suppkey AS STRING) AS key", "CAST(CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 9 ELSE s_suppkey + 1 END AS STRING) AS next")
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("@"), F.col("key")), F.lit("$"), F.col("next"))
    module = ring.select(F.concat(F.lit("src/shop/s"), "key", F.lit(".py")).alias("path"), filled(MODULE).alias("source"))
    test = ring.where("k % 2 = 0").select(F.concat(F.lit("tests/test_s"), "key", F.lit(".py")).alias("path"), filled(TEST).alias("source"))
    failing = ring.where("k % 3 = 0").select(F.concat(F.lit("tests/test_s"), "key", F.lit("_refused.py")).alias("path"), filled(FAILING).alias("source"))
    return module.unionByName(test).unionByName(failing)


#: Uses of the module in order of line and place: line, name, line of what binds it (NULL: nothing), how, origin.
USES = (
    (8, "forward", 2, "import", "shop.s$.send$"), (8, "url", 7, "parameter", None), (8, "limit", 3, "import", "shop.s$.LIMIT"),
    (11, "r", 1, "import", "requests"), (11, "url", 10, "parameter", None), (11, "LIMIT", 10, "parameter", None),
    (14, "LIMIT", 14, "variable", None), (14, "range", None, None, None), (14, "LIMIT", 13, "parameter", None),
    (17, "LIMIT", 5, "variable", None), (18, "LIMIT", 17, "variable", None), (20, "LIMIT", 5, "variable", None), (21, "calc@", 13, "function", None), (21, "size", 18, "parameter", None),
    (24, "NotImplementedError", None, None, None),
    (27, "r", 26, "parameter", None), (27, "seen", 20, "variable", None), (27, "forward", 2, "import", "shop.s$.send$"), (27, "load@", 7, "function", None), (27, "r", 26, "parameter", None),
    (31, "subprocess", 30, "import", "subprocess"), (31, "c", 29, "parameter", None),
)
_RING = "WITH ring AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 9 ELSE s_suppkey + 1 END AS n FROM supplier)"


def uses_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(text(v) for v in u) + ")" for u in USES)
    filled = lambda c: f"replace(replace({c}, '@', CAST(k AS VARCHAR)), '$', CAST(n AS VARCHAR))"
    return f"{_RING} SELECT 'src/shop/s' || k || '.py' AS path, CAST(line AS INTEGER) AS line, {filled('name')} AS name, CAST(defined AS INTEGER) AS defined, how, {filled('origin')} AS origin FROM ring CROSS JOIN (VALUES {values}) v(line, name, defined, how, origin)"


#: send is tested where its supplier is even or divisible by three, its failure only in the latter; load and local call the next one's send, the box nothing at the top.
GAPS_SQL = f"""{_RING}, t AS (SELECT k, n, k % 2 = 0 OR k % 3 = 0 AS own, (n % 2 = 0 OR n % 3 = 0) AND n IN (SELECT s_suppkey FROM supplier) AS other FROM ring)
SELECT 'BHVERIFY001' AS code, 'src/shop/s' || k || '.py' AS path, 7 AS line, 'warning' AS severity, 'load' || k || ' is tested through others only: send' || n AS message FROM t WHERE other
UNION ALL SELECT 'BHVERIFY001', 'src/shop/s' || k || '.py', 26, 'warning', 'local' || k || ' is tested through others only: send' || n FROM t WHERE other
UNION ALL SELECT 'BHIMPL001', 'src/shop/s' || k || '.py', 23, 'warning', 'hollow' || k || ' is a public stub without a test' FROM t WHERE k % 3 <> 0
UNION ALL SELECT 'BHVERIFY002', 'src/shop/s' || k || '.py', 10, 'warning', 'send' || k || ' leaves the process without a test of failure: requests.get' FROM t WHERE k % 3 <> 0
UNION ALL SELECT 'BHVERIFY002', 'src/shop/s' || k || '.py', 29, 'warning', 'run' || k || ' leaves the process without a test of failure: subprocess.run' FROM t WHERE k % 3 <> 0"""

#: A test of failure names run and its supplier's key, which may begin with another key: run12 has run1 in it.
FAULTS_SQL = f"""{_RING} SELECT 'src/shop/s' || k || '.py' AS path, 31 AS line, 'shop.s' || k || '.run' || k AS function, 'subprocess.run' AS boundary
FROM ring WHERE NOT EXISTS (SELECT 1 FROM ring t WHERE t.k % 3 = 0 AND contains('run' || t.k, 'run' || ring.k))"""

#: Threads of a supplier's module: @ stands for its key. Two functions write one name and one file; what guards them and what starts them depends on the key.
THREADS = """import threading
total = 0
def add@():
    global total
    total = total + 1
    log = open('log@', 'w')

def reset@():
    global total
    %guard%
        total = 0

def tidy@():
    log = open('log@', 'a')

def go@():
    reset@()

def start@(pool):
    threading.Thread(target=add@)
    pool.%start%(go@, tidy@)
    pool.run(tidy@)
"""


def threads(supplier: DataFrame) -> DataFrame:
    """path and source: a lock guards the second writer of every second supplier, its thread starts for every third."""
    key = F.col("s_suppkey").cast("string")
    guard = F.when(F.col("s_suppkey") % 2 == 0, "with self.write_lock:").otherwise("if pool:")
    start = F.when(F.col("s_suppkey") % 3 == 0, "submit").otherwise("map")
    text = F.replace(F.replace(F.replace(F.lit(THREADS), F.lit("@"), key), F.lit("%guard%"), guard), F.lit("%start%"), start)
    return supplier.select(F.concat(F.lit("src/run"), key, F.lit(".py")).alias("path"), text.alias("source"))


THREADS_SQL = """SELECT 'src/run' || s_suppkey || '.py' AS file, 'global:total' AS target, ['add' || s_suppkey, 'reset' || s_suppkey] AS functions, 5 AS line FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 = 0"""
