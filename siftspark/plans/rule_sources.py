"""Sources made from the parts table, one a part, on which each rule fires or stays quiet; and what they must give.

A part's key picks the case, an odd size picks its first source, an even one the second; @ stands for the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (folder, source where the rule fires, source where it is quiet)
CASES = (
    ("src", "def f@():\n try:\n  g()\n finally:\n  return @\n", "def f@():\n try:\n  return g()\n finally:\n  for x in y:\n   break\n"),
    ("src", "assert x@, ValueError('no')\n", "assert x@, 'no'\n"),
    ("src", "class A@:\n async def __len__(self):\n  return 1\n", "class A@:\n async def __aenter__(self):\n  return 1\n"),
    ("src", "class A@:\n def __len__(self):\n  yield @\n", "class A@:\n def __iter__(self):\n  yield @\n"),
    ("src", "def g@(it):\n yield next(it)\n", "def g@(it):\n try:\n  yield next(it)\n except StopIteration:\n  return\n"),
    ("src", "def f@(s):\n s.close()\n s.read()\n", "def f@(s):\n s.read()\n s.close()\n"),
    ("src", "def f@(p):\n h = open(p, 'w')\n h.read()\n", "def f@(p):\n h = open(p, 'w')\n h.write('x')\n"),
    ("src", "class A@:\n def __rand__(self, o):\n  raise NotImplementedError\n", "class A@:\n def __rand__(self, o):\n  return NotImplemented\n"),
    ("src", "def f@(d):\n d['a'] = 1\n d['a'] = 2\n", "def f@(d):\n d['a'] = 1\n g(d)\n d['a'] = 2\n"),
    ("src", "class Test@:\n def helper(self):\n  pass\n", "class Test@:\n def test_a(self):\n  pass\n"),
    ("src", "import math\nx@ = math.sqrt(a*a + b*b)\n", "import math\nx@ = math.sqrt(a*a + b)\n"),
    ("src", "import json\nx@ = json.loads(f.read())\n", "import json\nx@ = json.load(f)\n"),
    ("src", "from sqlalchemy import x\nq@ = a == @ and b == 2\n", "q@ = a == @ and b == 2\n"),
    ("src", "from django.db import models\nx@ = models.ManyToManyField(A, null=True)\n", "from django.db import models\nx@ = models.CharField(null=True)\n"),
    ("src", "from django.db import models\nx@ = models.CharField(primary_key=True, unique=True)\n", "from django.db import models\nx@ = models.CharField(primary_key=True)\n"),
    ("src", "from django.db import models\nx@ = models.CharField(unique_for_date='d')\n", "from django.db import models\nx@ = models.CharField(unique=True)\n"),
    ("src", "def f@(ids):\n for i in ids:\n  cur.execute(q, i)\n", "def f@(ids):\n cur.execute(q, ids)\n"),
    ("src", "x@ = cast(int, cast(object, y))\n", "x@ = cast(int, y)\n"),
    ("src", "def f@(x: int):\n y: object = x\n return cast(int, y)\n", "def f@(x: int):\n y: int = x\n return cast(int, y)\n"),
    ("src", "def f@(xs):\n for x in xs:\n  acc = acc + [x]\n", "def f@(xs):\n for x in xs:\n  acc.append(x)\n"),
    ("src", "from pkg@._inner import thing\n", "from pkg@.inner import thing\n"),
    ("src", "from pkg@ import _thing\n", "from pkg@ import thing\n"),
    ("src", "def f@(x):\n" + " if x:\n  x = 1\n" * 12, "def f@(x):\n" + " if x:\n  x = 1\n" * 5),
    ("src", "def f@():\n" + " x = 1\n" * 90, "def f@():\n" + " x = 1\n" * 70),
    ("src", "x@ = 1\n" * 600, "x@ = 1\n" * 400),
    ("src", "def f@(x):\n" + " g(x)\n" * 40, "def f@(x):\n" + " g(x)\n" * 20),
    ("src", "wait_ms = @\n", "wait = @\n"),
    ("src", "x@ = wait_ms + delay_seconds\n", "x@ = wait_ms + delay_ms\n"),
    ("src", "wait@_ms = f()\nwait@_seconds = g()\n", "wait@_ms = f()\nother@_seconds = g()\n"),
    ("src", "t@ = datetime.now().replace(tzinfo=timezone.utc)\n", "t@ = datetime.now(timezone.utc)\n"),
    ("src", "timeout = @\n", "TIMEOUT = @\n"),
    ("src", "get(url, timeout=@)\n", "get(url, timeout=limit)\n"),
    ("src", "def f@():\n raise NotImplementedError\n", "def f@():\n return 1\n"),
    ("src/api", "import sqlalchemy as s@\n", "import math as s@\n"),
    ("src/api", "from redis import Redis as R@\ndef f(c: R@) -> int:\n pass\n", "from redis import Redis as R@\ndef f(c: Store) -> int:\n pass\n"),
    ("src", "def f@(q):\n d = {'a': @}\n q.put(d)\n return d['b']\n", "def f@(q):\n d = {'a': @}\n q.put(d)\n return d['a'], d.get('b')\n"),
    ("src", "def f@(c):\n data = response.json()\n return data['x']\n", "def f@(c):\n data = response.json()\n Model.model_validate(data)\n return data['x']\n"),
    ("src", "def f@(x):\n y = x.fillna(0)\n return integrate(y)\n", "def f@(x):\n y = x.dropna()\n return integrate(y)\n"),
    ("src", "x@ = {'dose': 0.5, 'complete': True}\n", "x@ = {'dose': 0.5, 'complete': False}\n"),
    ("src", "def f@(dose, dose_complete):\n return {'dose': dose}\n", "def f@(dose, dose_complete):\n return {'dose': dose, 'dose_complete': dose_complete}\n"),
    ("src", "def f@(df):\n df['b'] = df['a'] * 2\n df['a'] = 0\n df.to_csv(p)\n", "def f@(df):\n df['a'] = 0\n df['b'] = df['a'] * 2\n df.to_csv(p)\n"),
    ("src", "def f@(t, v):\n m = (t >= a) & (t < b)\n return integrate(v[m])\n", "def f@(t, v):\n m = (t >= a) & (t <= b)\n return integrate(v[m])\n"),
    ("src", "def f@(trailing_dose):\n window_start = trailing_dose\n", "def f@(leading_dose):\n window_start = leading_dose\n"),
    ("src", "def f@(p):\n x = load('a@.parquet')\n if exists(p):\n  return x\n", "def f@(p):\n if exists(p):\n  return load('a@.parquet')\n"),
    ("src", "def build_@():\n return A_B, C_D\ndef is_fresh():\n return A_B\n", "def build_@():\n return A_B, C_D\ndef is_fresh():\n return A_B, C_D\n"),
    ("tests", "from pkg@ import _thing\n", "from pkg@ import thing\n"),
    ("tests", "def test_@(m):\n m.assert_called_once_with(1)\n", "def test_@(m):\n assert m == 1\n"),
    ("tests", f"def test_@():\n assert f() == '{'x' * 1200}'\n", "def test_@():\n assert f() == 'x'\n"),
    ("tests", "def test_@(m):\n" + " with patch('a.b'):\n  pass\n" * 5 + " m.assert_called()\n" * 2, "def test_@(m):\n with patch('a.b'):\n  pass\n m.assert_called()\n"),
    ("tests", f"def test_@():\n assert render() == '{'y' * 300}'\n", f"def test_@():\n assert total() == '{'y' * 300}'\n"),
    ("src", "def g@(it):\n try:\n  yield next(it)\n except ValueError:\n  return\n", "def g@(it):\n try:\n  yield next(it)\n except ValueError:\n  pass\n except Exception:\n  return\n"),
    ("src", "def g@(it):\n def h():\n  try:\n   yield next(it)\n  except StopIteration:\n   pass\n yield h, next(it)\n", "def g@(it):\n try:\n  yield next(it)\n except:\n  x.next(it)\n"),
)


def sources(parts: DataFrame) -> DataFrame:
    """parts: p_partkey, p_size. path and source, one a part."""
    spark: SparkSession = parts.sparkSession
    rows = [(k, odd, folder, text) for k, (folder, *texts) in enumerate(CASES) for odd, text in zip((1, 0), texts)]
    cases = F.broadcast(spark.createDataFrame(rows, "k int, odd int, folder string, text string"))
    picked = parts.select("p_partkey", (F.col("p_partkey") % len(CASES)).cast("int").alias("k"), (F.col("p_size") % 2).cast("int").alias("odd")).join(cases, ["k", "odd"])
    key = F.col("p_partkey").cast("string")
    return picked.select(F.concat("folder", F.lit("/p"), key, F.lit(".py")).alias("path"), F.replace("text", F.lit("@"), key).alias("source"))


#: What the first source of each case gives: code, line, severity.
EXPECTED = (
    ("BHCTRL001", 5, "error"),
    ("BHPRT001", 1, "error"),
    ("BHPRT002", 2, "error"),
    ("BHPRT003", 3, "error"),
    ("BHPRT004", 2, "error"),
    ("BHPRT005", 3, "error"),
    ("BHPRT006", 3, "error"),
    ("BHPRT007", 3, "error"),
    ("BHPRT008", 2, "warning"),
    ("BHPRT009", 1, "warning"),
    ("BHPRT010", 2, "warning"),
    ("BHPRT011", 2, "warning"),
    ("BHPRT012", 2, "error"),
    ("BHPRT013", 2, "error"),
    ("BHPRT014", 2, "warning"),
    ("BHPRT015", 2, "warning"),
    ("BHDB001", 3, "warning"),
    ("BHEVID002", 1, "warning"),
    ("BHEVID001", 3, "error"),
    ("BHEVID003", 3, "warning"),
    ("BHARCH001", 1, "warning"),
    ("BHARCH002", 1, "warning"),
    ("BHCX001", 1, "warning"),
    ("BHCX002", 1, "warning"),
    ("BHCX003", 1, "warning"),
    ("BHCX004", 1, "warning"),
    ("BHUNIT001", 1, "warning"),
    ("BHUNIT002", 1, "error"),
    ("BHUNIT003", 1, "warning"),
    ("BHTIME002", 1, "error"),
    ("BHCFG004", 1, "note"),
    ("BHCFG005", 1, "note"),
    ("BHIMPL001", 1, "warning"),
    ("BHPERS001", 1, "warning"),
    ("BHPERS002", 2, "warning"),
    ("BHSEAM001", 2, "error"),
    ("BHSEAM005", 2, "warning"),
    ("BHMISS001", 3, "error"),
    ("BHMETA001", 1, "error"),
    ("BHMETA002", 2, "warning"),
    ("BHDF001", 4, "error"),
    ("BHINT001", 3, "error"),
    ("BHINT002", 2, "error"),
    ("BHART001", 2, "warning"),
    ("BHART002", 3, "error"),
    ("BHTEST001", 1, "warning"),
    ("BHTEST002", 2, "warning"),
    ("BHTEST003", 2, "warning"),
    ("BHTEST004", 1, "warning"),
    ("BHTEST005", 2, "warning"),
    ("BHPRT004", 3, "error"),
    ("BHPRT004", 7, "error"),
)
#: What else a case gives: case, whether odd, code, line, severity. Ninety assignments are over the ABC budget too, the storage import is there in both, and what a function within guards the one around it does not.
BESIDES = ((23, 1, "BHCX004", 1, "error"), (23, 0, "BHCX004", 1, "error"), (34, 1, "BHPERS001", 1, "warning"), (34, 0, "BHPERS001", 1, "warning"), (51, 1, "BHPRT004", 4, "error"))


def findings_sql(*prefixes: str) -> str:
    """What the rules whose codes begin so find in sources(), in DuckDB."""
    rows = [(k, 1, CASES[k][0], *e) for k, e in enumerate(EXPECTED)] + [(k, odd, CASES[k][0], *e) for k, odd, *e in BESIDES]
    values = ", ".join(str(r) for r in rows if r[3].startswith(prefixes))
    return f"""SELECT code, folder || '/p' || p_partkey || '.py' AS path, CAST(line AS INTEGER) AS line, severity
FROM part JOIN (VALUES {values}) v(k, odd, folder, code, line, severity) ON p_partkey % {len(CASES)} = k AND p_size % 2 = odd"""
