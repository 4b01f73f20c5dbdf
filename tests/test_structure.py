"""Containment and names over syntax nodes, against plain walks over the trees."""

import ast
import glob
import os
import random
import time

import pytest

from siftspark.operators import concurrency, rules, scopes, structure, verification
from siftspark.sources import syntax

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TRICKY = '''import os.path as p, sys, json.decoder
from . import x as y
from ..z import q
LIMIT = 1
def f(LIMIT, *a, d=LIMIT, **k) -> LIMIT:
    global G, H
    G = LIMIT
    def inner():
        nonlocal a
        a = 1
        return a, G, k, later
    return [LIMIT for LIMIT in range(LIMIT) if (w := LIMIT)], w, inner, lambda a=a: (a, w)
@p.deco(LIMIT)
class A(q):
    LIMIT = LIMIT
    z = [LIMIT for i in LIMIT]
    def g(self, size=LIMIT):
        try:
            return LIMIT, self, G, H, A, json
        except ValueError as e:
            print(e)
        match self:
            case {"a": one, **rest}: return one, rest
            case [first, *others] as whole: return first, others, whole
def later(): return later, sys.path, y
for n, (m, o) in enumerate(n for n in LIMIT): print(n, m, o)
LIMIT = LIMIT + 1
with open(p) as h, h: del h
LIMIT += LIMIT
x: int = x
'''


def numbered(tree):
    """node -> (place, last place below), depth first."""
    at, count = {}, 0

    def go(node):
        nonlocal count
        lo = count
        count += 1
        for _, c in syntax._below(node):
            go(c)
        at[id(node)] = (lo, count - 1)

    go(tree)
    return at


def walked(path, source):
    """(place, name, place of the definition) of every use, by a recursive walk that keeps the scopes around."""
    tree = ast.parse(source)
    at = numbered(tree)
    uses, bound, kind, sent = [], {}, {}, {}
    funcs, comps = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda), (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)

    def bind(scope, name, place, node):
        bound.setdefault((scope, name), []).append((place, at[id(node)][0]))

    def go(node, field, chain, until, walrus):
        lo, hi = at[id(node)]
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                scope = chain[-1]
                if walrus and field == "target":
                    scope = next(s for s in reversed(chain) if kind[s] not in comps)
                bind(scope, node.id, max(lo, until), node)
            else:
                uses.append((lo, node.id, list(chain)))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            bind(chain[-1], node.name, hi, node)
        elif isinstance(node, ast.alias) and node.name != "*":
            bind(chain[-1], node.asname or node.name.split(".")[0] if field == "plain" else node.asname or node.name, lo, node)
        elif isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar, ast.MatchMapping)):
            name = node.rest if isinstance(node, ast.MatchMapping) else node.name
            if name:
                bind(chain[-1], name, lo, node)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            for name in node.names:
                sent[chain[-1], name] = type(node).__name__
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr)):
            until, walrus = hi, isinstance(node, ast.NamedExpr)
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.comprehension)):
            until, walrus = at[id(node.iter)][1], False
        if isinstance(node, (*funcs, ast.ClassDef, *comps)):
            kind[lo] = type(node)
        for f, c in syntax._below(node):
            inner = chain
            if isinstance(node, (*funcs, ast.ClassDef)) and f == "body":
                inner = [*chain, lo]
            if isinstance(node, comps):
                inner = [*chain, lo]
                if f == "generators" and c is node.generators[0]:
                    walk_first(c, inner, chain)
                    continue
            if isinstance(node, ast.arguments) and isinstance(c, ast.arg):
                bind(field_owner[id(node)], c.arg, at[id(c)][0], c)
            go(c, "plain" if isinstance(node, ast.Import) else f, inner, until, walrus)

    def walk_first(gen, inner, outer):
        until = at[id(gen.iter)][1]
        for f, c in syntax._below(gen):
            go(c, f, outer if f == "iter" else inner, until, False)

    field_owner = {id(n.args): at[id(n)][0] for n in ast.walk(tree) if isinstance(n, funcs)}
    kind[0] = ast.Module
    go(tree, "", [0], -1, False)
    for (scope, name), said in sent.items():
        moved = bound.pop((scope, name), [])
        if said == "Global":
            bound.setdefault((0, name), []).extend(moved)
    out = []
    for lo, name, chain in uses:
        answer = None
        for i in range(len(chain) - 1, -1, -1):
            scope = chain[i]
            if sent.get((scope, name)) == "Global":
                answer = max(bound.get((0, name), [(0, None)]))[1]
                break
            if kind[scope] is ast.ClassDef and i < len(chain) - 1:
                continue
            later = any(kind[s] in funcs for s in chain[i + 1 :])
            held = bound.get((scope, name), [])
            before = [b for b in held if later or b[0] < lo]
            if before:
                answer = max(before)[1]
                break
            if held and kind[scope] is not ast.ClassDef:
                answer = min(held)[1]
                break
        out.append((path, lo, name, answer))
    return out


def test_names_resolve_as_a_walk_over_the_trees_does(spark):
    files = {f: open(f).read() for f in sorted(glob.glob(f"{ROOT}/siftspark/**/*.py", recursive=True)) + [ast.__file__, random.__file__, os.__file__]}
    files |= {"src/a/b.py": TRICKY, "empty.py": "", "broken.py": "def", "none.py": None}
    df = spark.createDataFrame(list(files.items()), "path string, source string").repartition(4)
    nodes = syntax.nodes(df).cache()
    got = sorted((r.path, r.lo, r.name, r.definition) for r in scopes.resolved(nodes).collect())
    want = sorted(u for p, s in files.items() if s and p != "broken.py" for u in walked(p, s))
    assert len(want) > 10_000
    assert got == want
    nodes.unpersist()


def test_imports_stand_for_what_they_bring_in(spark):
    nodes = syntax.nodes(spark.createDataFrame([("src/a/b/c.py", "import os.path as p, json.decoder\nfrom . import x as y\nfrom ..z import q\nfrom m import *\nfrom m.n import o\nfrom .... import far\n")], "path string, source string"))
    assert {r.name: r.origin for r in scopes.imports(nodes).collect()} == {"p": "os.path", "json": "json", "y": "a.b.x", "q": "a.z.q", "o": "m.n.o", "far": "far"}


@pytest.mark.parametrize("nearest", [False, True])
def test_merge_equals_testing_every_interval(spark, nearest):
    rnd = random.Random(2)
    intervals, places = [], []
    for path in "abcd":
        stack = [(0, 999)]
        while stack:
            start, stop = stack.pop()
            intervals.append((path, start, stop, f"{path}{start}-{stop}"))
            cut = start + 1
            while cut < stop and rnd.random() < 0.8:
                end = rnd.randint(cut, stop)
                stack.append((cut, end))
                cut = end + rnd.randint(1, 40)
        places += [(path, rnd.randint(-5, 1005)) for _ in range(300)]
    places += [(None, 3), ("z", 3)]
    got = structure.enclosing(spark.createDataFrame(places, "path string, place int").repartition(3), spark.createDataFrame([*intervals, (None, 0, 9, "n")], "path string, start int, stop int, name string"), nearest)
    want = set()
    for path, place in set(places):
        held = [i for i in intervals if i[0] == path and i[1] <= place <= i[2]]
        held = sorted(held, key=lambda i: (i[1], -i[2]))[-1:] if nearest else held
        want |= {(path, place, *i[1:]) for i in held}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_one_large_file_takes_linear_time(spark):
    """300,000 nodes in one file: time grows with the file, not with its square."""
    def took(n):
        source = "def f(x):\n for y in x:\n  try:\n   cur.execute(y)\n  except ValueError:\n   pass\n" * n
        nodes = syntax.nodes(spark.createDataFrame([("src/a.py", source)], "path string, source string")).cache()
        count, began = nodes.count(), time.perf_counter()
        assert rules.run(nodes, ["BHDB001", "BHPRT004", "BHCTRL001"]).count() == n
        nodes.unpersist()
        return count, time.perf_counter() - began

    took(10)
    (few, short), (many, long) = took(2000), took(20_001)
    assert many > 300_000 and long < 3 + 3 * short * many / few


def test_gaps_of_a_project(spark):
    project = {
        "src/p/a.py": "import subprocess as sp\nfrom .b import helper\n\ndef run(c):\n    return sp.run(c)\n\ndef uses():\n    return helper()\n\ndef _own():\n    return sp.run(1)\n\ndef nested():\n    def go():\n        return sp.run(1)\n    class K:\n        x = sp.run(2)\n    return go\n\ndef shadow(sp):\n    return sp.run(1)\n\ndef db(cur):\n    cur.execute('x')\n",
        "src/p/b.py": "def helper():\n    return 1 + 1\n\n@overload\ndef contract():\n    ...\n\ndef doc():\n    'text'\n\ndef stub():\n    raise NotImplementedError('x')\n\nclass A:\n    def method(self):\n        pass\n",
        "src/p/api.py": "from .b import helper\nfrom p.a import run\n",
        "tests/test_a.py": "from p.api import helper, run\nimport p.a\n\ndef test_helper():\n    assert helper()\n\ndef test_db_fails():\n    p.a.db(1)\n\ndef test_run():\n    run(1)\n    try:\n        pass\n    except OSError:\n        pass\n",
    }
    sources = spark.createDataFrame(list(project.items()), "path string, source string")
    got = {(r.code, r.path, r.line) for r in verification.gaps(sources, syntax.nodes(sources).cache()).collect()}
    # run is tested, also for failure, under the name of another module; db by way of the module
    assert got == {("BHVERIFY001", "src/p/a.py", 7), ("BHIMPL001", "src/p/b.py", 8), ("BHIMPL001", "src/p/b.py", 11)}
    happy = {**project, "tests/test_a.py": "from p.a import run, db\n\ndef test_run():\n    run(1), db(2)\n"}
    sources = spark.createDataFrame(list(happy.items()), "path string, source string")
    got = {(r.code, r.path, r.line, r.message.split(": ")[-1]) for r in verification.gaps(sources, syntax.nodes(sources).cache()).collect() if r.code == "BHVERIFY002"}
    assert got == {("BHVERIFY002", "src/p/a.py", 4, "subprocess.run"), ("BHVERIFY002", "src/p/a.py", 23, "cur.execute")}


def test_writers_that_run_at_once(spark):
    sources = {
        "src/a.py": "import threading\nfrom b import far as near\ndef one():\n    global n\n    n = 1\ndef two():\n    def deep():\n        global n\n        n = 2\n    deep()\ndef far():\n    global n\n    n, m = 3, 4\ndef start():\n    threading.Thread(target=one)\n    create_task(two)\n    near()\n",
        "src/b.py": "def w():\n    f = open('x', mode)\n    f = p.open('w')\ndef v():\n    f = p.open('ab')\n    lock.acquire()\ndef u():\n    f = p.open('x')\ndef go():\n    submit(w)\n    submit(v)\n    gather(u)\n",
        "src/c.py": "def w():\n    global n\n    n = 1\ndef v():\n    global n\n    n = 2\n",
        "broken.py": "def",
    }
    nodes = syntax.nodes(spark.createDataFrame(list(sources.items()), "path string, source string")).cache()
    got = {(r.file, r.target, tuple(r.functions), r.line) for r in concurrency.unsynchronized(nodes).collect()}
    # the function within counts for both; nothing is started in the third file
    assert got == {("src/a.py", "global:n", ("deep", "one", "two"), 5), ("src/b.py", "file:method:p.open", ("u", "w"), 3)}
