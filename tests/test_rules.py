import textwrap

import pytest

from siftspark.operators import rules
from siftspark.sources import syntax

CASES = {
    "BHCTRL001": ("def f():\n try:\n  g()\n finally:\n  return 1\n", "def f():\n try:\n  return g()\n finally:\n  for x in y:\n   break\n"),
    "BHPRT001": ("assert x, ValueError('no')\n", "assert x, 'no'\n"),
    "BHPRT002": ("class A:\n async def __len__(self): return 1\n", "class A:\n async def __aenter__(self): return 1\n"),
    "BHPRT003": ("class A:\n def __len__(self):\n  yield 1\n", "class A:\n def __iter__(self):\n  yield 1\n"),
    "BHPRT004": ("def g(it):\n yield next(it)\n", "def g(it):\n try:\n  yield next(it)\n except StopIteration:\n  return\n"),
    "BHPRT007": ("class A:\n def __add__(self, o):\n  raise NotImplementedError\n", "class A:\n def __add__(self, o):\n  return NotImplemented\n"),
    "BHPRT009": ("class TestA:\n def helper(self): pass\n", "class TestA:\n def test_a(self): pass\n"),
    "BHPRT010": ("import math\nx = math.sqrt(a*a + b*b)\n", "import math\nx = math.sqrt(a*a + b)\n"),
    "BHPRT011": ("import json\nx = json.loads(f.read())\n", "import json\nx = json.load(f)\n"),
    "BHDB001": ("def f(ids):\n for i in ids:\n  cur.execute(q, i)\n", "def f(ids):\n cur.execute(q, ids)\n"),
    "BHEVID002": ("x = cast(int, cast(object, y))\n", "x = cast(int, y)\n"),
    "BHEVID003": ("def f(xs):\n acc = []\n for x in xs:\n  acc = acc + [x]\n", "def f(xs):\n acc = []\n for x in xs:\n  acc.append(x)\n"),
    "BHARCH001": ("from pkg._inner import thing\n", "from pkg.inner import thing\n"),
    "BHARCH002": ("from pkg.inner import _thing\n", "from pkg.inner import thing, __version__\n"),
    "BHCX002": ("def f():\n" + " x = 1\n" * 90, "def f():\n" + " x = 1\n" * 70),
    "BHCX001": ("def f(x):\n" + " if x: x = 1\n" * 12, "def f(x):\n" + " if x: x = 1\n" * 5),
    "BHCX003": ("x = 1\n" * 600, "x = 1\n" * 400),
    "BHCX004": ("def f(x):\n" + " g(x)\n" * 40, "def f(x):\n" + " g(x)\n" * 20),
    "BHUNIT001": ("wait_ms = 5\n", "wait = 5\n"),
    "BHUNIT002": ("x = wait_ms + delay_seconds\n", "x = wait_ms + delay_ms\n"),
    "BHUNIT003": ("wait_ms = f()\nwait_seconds = g()\n", "wait_ms = f()\nother_seconds = g()\n"),
    "BHTIME002": ("t = datetime.now().replace(tzinfo=timezone.utc)\n", "t = datetime.now(timezone.utc)\n"),
    "BHTIME001": ("t = time.time()\n", "t = clock()\n"),
    "BHCFG004": ("timeout = 5\n", "TIMEOUT = 5\n"),
    "BHCFG005": ("get(url, timeout=5)\n", "get(url, timeout=limit)\n"),
    "BHIMPL001": ("def stub_untested():\n raise NotImplementedError\n", "def stub_tested():\n raise NotImplementedError\n"),
}
CASES |= {
    "BHPRT005": ("def f(s):\n s.close()\n s.read()\n", "def f(s):\n s.read()\n s.close()\n"),
    "BHPRT006": ("def f(p):\n h = open(p, 'w')\n h.read()\n", "def f(p):\n h = open(p, 'w')\n h.write('x')\n"),
    "BHPRT008": ("def f(d):\n d['a'] = 1\n d['a'] = 2\n", "def f(d):\n d['a'] = 1\n g(d)\n d['a'] = 2\n"),
    "BHPRT012": ("from sqlalchemy import x\nq = a == 1 and b == 2\n", "q = a == 1 and b == 2\n"),
    "BHPRT013": ("from django.db import models\nx = models.ManyToManyField(A, null=True)\n", "from django.db import models\nx = models.CharField(null=True)\n"),
    "BHPRT014": ("from django.db import models\nx = models.CharField(primary_key=True, unique=True)\n", "from django.db import models\nx = models.CharField(primary_key=True)\n"),
    "BHPRT015": ("from django.db import models\nx = models.CharField(unique_for_date='d')\n", "from django.db import models\nx = models.CharField(unique=True)\n"),
    "BHSEAM005": ("def f(c):\n data = response.json()\n return data['x']\n", "def f(c):\n data = response.json()\n Model.model_validate(data)\n return data['x']\n"),
    "BHMISS001": ("def f(x):\n y = x.fillna(0)\n return integrate(y)\n", "def f(x):\n y = x.dropna()\n return integrate(y)\n"),
    "BHMETA001": ("x = {'dose': 0.0, 'complete': True}\n", "x = {'dose': 0.0, 'complete': False}\n"),
    "BHDF001": ("def f(df):\n df['b'] = df['a'] * 2\n df['a'] = 0\n df.to_csv(p)\n", "def f(df):\n df['a'] = 0\n df['b'] = df['a'] * 2\n df.to_csv(p)\n"),
}
CASES |= {
    "BHSEAM001": ("def f(q):\n d = {'a': 1}\n q.put(d)\n return d['b']\n", "def f(q):\n d = {'a': 1}\n q.put(d)\n return d['a'], d.get('b')\n"),
    "BHEVID001": ("def f(x: int):\n y: object = x\n return cast(int, y)\n", "def f(x: int):\n y: int = x\n return cast(int, y)\n"),
    "BHINT001": ("def f(t, v):\n m = (t >= a) & (t < b)\n return integrate(v[m])\n", "def f(t, v):\n m = (t >= a) & (t <= b)\n return integrate(v[m])\n"),
    "BHINT002": ("def f(trailing_dose):\n window_start = trailing_dose\n g(start=trailing_dose)\n", "def f(leading_dose):\n window_start = leading_dose\n g(start=leading_dose)\n"),
    "BHART001": ("def f(p):\n x = load('a.parquet')\n if exists(p):\n  return x\n", "def f(p):\n if exists(p):\n  return load('a.parquet')\n"),
    "BHART002": ("def build_it():\n return A_B, C_D\ndef is_fresh():\n return A_B\n", "def build_it():\n return A_B, C_D\ndef is_fresh():\n return A_B, C_D\n"),
    "BHMETA002": ("def f(dose, dose_complete):\n return {'dose': dose}\n", "def f(dose, dose_complete):\n return {'dose': dose, 'dose_complete': dose_complete}\n"),
}
#: Members of the rules' tables, each of which must be known, and neighbours that must not.
MAGIC = "__eq__ __ne__ __lt__ __le__ __gt__ __ge__ __add__ __radd__ __sub__ __mul__ __rmul__ __and__ __rand__ __or__ __ror__ __xor__".split()
DB = "execute executemany query filter filter_by select scalars scalar".split()
TEST_CASES = {
    "BHTEST001": ("from pkg import _thing, stub_tested\n", "from pkg import thing\n"),
    "BHTEST002": ("def test_a(m):\n m.assert_called_once_with(1)\n", "def test_a(m):\n assert m == 1\n"),
    "BHTEST003": (f"def test_a():\n assert f() == '{'x' * 1200}'\n", "def test_a():\n assert f() == 'x'\n"),
    "BHTEST004": ("def test_a(m):\n" + " with patch('a.b'): pass\n" * 5 + " m.assert_called()\n" * 2, "def test_a(m):\n with patch('a.b'): pass\n m.assert_called()\n"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"src/{c}_{k}.py", s) for c, pair in CASES.items() for k, s in zip(("fires", "quiet"), pair)]
    rows += [(f"tests/{c}_{k}.py", s) for c, pair in TEST_CASES.items() for k, s in zip(("fires", "quiet"), pair)]
    rows += [("src/api/routes.py", "import sqlalchemy\n"), ("src/store/db.py", "import sqlalchemy\n"), ("src/http.py", "requests.get(u)\n")]
    rows += [(f"src/reflective/{m}.py", f"class A:\n def {m}(self, o):\n  raise NotImplementedError()\n") for m in [*MAGIC, "__truediv__", "__rsub__"]]
    rows += [(f"src/db/{m}.py", f"def f(xs):\n for x in xs:\n  s.{m}(x)\n") for m in [*DB, "get", "fetchone"]]
    rows += [(f"src/magic/{m}.py", f"class A:\n async def {m}(self):\n  pass\n def {m}(self):\n  yield\n") for m in ("__add__", "__call__", "__aenter__", "__anext__", "__iter__", "__await__", "plain")]
    rows += [(f"src/export/{m}.py", f"def f(df):\n df['b'] = df['a'] * 2\n df['a'] = 0\n df.{m}(p)\n") for m in ("to_dict", "to_csv", "to_parquet", "to_json", "to_excel", "to_sql")]
    rows += [(f"src/knob/{i}.py", f"g({a})\n") for i, a in enumerate(("max_rate=-1", "db_host='x'", "cache=True", "host=''", "limit=n", "colour=3", "port=None"))]
    rows += [("src/settings.py", "g(timeout=5)\n"), ("src/web/views.py", "from sqlalchemy.orm import Session as S\nimport redis\ndef f(s: S) -> int: pass\ndef _g(s: S): pass\ndef h(x: int) -> 'redis.Redis': pass\n")]
    rows += [(f"src/loop/{i}.py", f"def f(xs):\n for x in xs:\n  {a}\n") for i, a in enumerate(("acc = x | acc", "acc = {**acc}", "acc = list(acc)", "acc += [acc]", "acc = list(x, acc)"))]
    rows += [("src/broken.py", "def f(:\n"), ("src/empty.py", None)]
    nodes = syntax.nodes(spark.createDataFrame(rows, "path string, source string")).cache()
    assert nodes.where("path = 'src/broken.py'").count() == 0
    return {(r.code, r.path) for r in rules.run(nodes).collect()}


@pytest.mark.parametrize("code", [*CASES, *TEST_CASES])
def test_rule_fires_and_is_quiet(found, code):
    top = "src" if code in CASES else "tests"
    assert (code, f"{top}/{code}_fires.py") in found
    assert (code, f"{top}/{code}_quiet.py") not in found


def of(found, code, top):
    return {p.removeprefix(f"src/{top}/").removesuffix(".py") for c, p in found if c == code and p.startswith(f"src/{top}/")}


def test_members_of_the_tables(found):
    assert of(found, "BHPRT007", "reflective") == set(MAGIC)
    assert of(found, "BHDB001", "db") == set(DB)
    assert of(found, "BHPRT002", "magic") == {"__add__", "__call__", "__iter__", "__await__"}
    assert of(found, "BHPRT003", "magic") == {"__add__", "__call__", "__aenter__", "__anext__"}
    assert of(found, "BHDF001", "export") == {"to_dict", "to_csv", "to_parquet", "to_json"}
    assert of(found, "BHCFG005", "knob") == {"0", "1", "2"} and ("BHCFG005", "src/settings.py") not in found
    assert of(found, "BHEVID003", "loop") == {"0", "1", "2"}
    assert ("BHPERS002", "src/web/views.py") in found and ("BHPERS001", "src/web/views.py") in found


def test_layers_and_recorded_payloads(found):
    assert ("BHPERS001", "src/api/routes.py") in found and ("BHPERS001", "src/store/db.py") not in found
    assert ("BHSEAM006", "src/http.py") in found


def test_nodes_have_intervals_scopes_and_both_orders(spark):
    source = textwrap.dedent("""
        import os
        class A:
            def f(self):
                return os.environ["KEY"], os.getenv("OTHER")
    """)
    nodes = syntax.nodes(spark.createDataFrame([("a.py", source)], "path string, source string"))
    rows = {r.lo: r for r in nodes.collect()}
    assert sorted(rows) == list(range(len(rows))) and sorted(r.bfs for r in rows.values()) == list(range(len(rows)))
    for r in rows.values():
        below = [x.lo for x in rows.values() if x.parent == r.lo]
        assert r.hi == max([r.lo, *(rows[b].hi for b in below)])
    f = next(r for r in rows.values() if r.kind == "FunctionDef")
    assert f.cls >= 0 and all(r.func == f.lo for r in rows.values() if f.lo < r.lo <= f.hi)
    uses = {(r.name, r.required) for r in rules.env_uses(nodes).collect()}
    assert uses == {("KEY", True), ("OTHER", False)}


def test_own_rules_can_be_registered(spark):
    rules.register("OWN1", "SELECT path, line, 'note' AS severity, 'print' AS message FROM {n} WHERE kind = 'Call' AND name = 'print'")
    nodes = syntax.nodes(spark.createDataFrame([("a.py", "print(1)\n")], "path string, source string"))
    assert [r.code for r in rules.run(nodes, ["OWN1"]).collect()] == ["OWN1"]
    del rules.RULES["OWN1"]
