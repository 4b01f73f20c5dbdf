"""Keywords, keys, fields and literals that cross a seam, against plain walks over the trees."""

import ast
import random

from siftspark.operators import inverses, seams
from siftspark.sources import documents, syntax

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def nodes_of(spark, files):
    return syntax.nodes(spark.createDataFrame(list(files.items()), "path string, source string").repartition(3)).cache()


def keywords(spark, files):
    return {(r.path, r.line, r.function, r.terminal, tuple(r["keys"])) for r in seams.rejected_keywords(nodes_of(spark, files)).collect()}


def unmet(spark, files):
    return {(r.path, r.line, r.producer, tuple(r["keys"])) for r in seams.unmet_keys(nodes_of(spark, files)).collect()}


def test_keywords_along_chains(spark):
    near = "def handler(**kw):\n    serve(**kw)\n\ndef serve(self, timeout, *, size=1):\n    return timeout\n\nhandler(retries=3)\nhandler(timeout=1, **{'size': 2})\nhandler(**{'far': 1, 'b': 2, **x})\nserve(wrong=1)\nhandler()\nhandler(self=1)\n"
    assert keywords(spark, {"src/a.py": near}) == {("src/a.py", 7, "handler", "src/a.py:serve", ("retries",)), ("src/a.py", 9, "handler", "src/a.py:serve", ("b", "far")), ("src/a.py", 12, "handler", "src/a.py:serve", ("self",))}
    # three files, a package, a method of the module, a direct call over the border, an end that takes anything
    far = {
        "src/one.py": "from two import middle as m\nimport p.three\ndef start(**k):\n    return m(**k)\nstart(z=1, a=2)\np.three.end(q=1)\np.three.any(q=1)\nstart(a=1)\n",
        "src/two.py": "from p import end\ndef middle(own, **k):\n    log.info(**k)\n    return end(**k)\n",
        "src/p/__init__.py": "from .three import end\ndef end(a): pass\n",
        "src/p/three.py": "def end(a): pass\ndef any(**k): pass\n",
        "broken.py": "def (",
    }
    assert keywords(spark, far) == {("src/one.py", 5, "start", "src/p/__init__.py:end", ("z",)), ("src/one.py", 6, "end", "src/p/three.py:end", ("q",))}
    # circles end nowhere; a name imported from two places, or of a module that two files have, stays unresolved; what goes elsewhere is silent
    quiet = {
        "src/a.py": "def a(**k): b(**k)\ndef b(**k): a(**k)\ndef c(**k): a(**k)\nc(x=1)\na(x=1)\n",
        "src/b.py": "try:\n    from e import f\nexcept ImportError:\n    from g import f\nf(x=1)\nimport e\ne.f(x=1)\ndef h(**k): unknown(**k)\nh(x=1)\ndef i(**k): t[0](**k), j(**other)\ndef j(): pass\ni(x=1)\nclass K(metaclass=M): pass\n",
        "src/e.py": "def f(): pass\n", "e.py": "def f(): pass\n", "src/g.py": "def f(): pass\n",
    }
    assert keywords(spark, quiet) == set()


def walked_keywords(path, source):
    """What a walk over one file finds."""
    tree = ast.parse(source)
    ends, on, out = {}, {}, set()
    for f in ast.walk(tree):
        if isinstance(f, DEFS):
            ends[f.name] = f
    leaf = lambda c: c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
    for f in ast.walk(tree):
        if isinstance(f, DEFS) and f.args.kwarg:
            for c in ast.walk(f):
                if isinstance(c, ast.Call) and leaf(c) in ends and any(w.arg is None and isinstance(w.value, ast.Name) and w.value.id == f.args.kwarg.arg for w in c.keywords):
                    on[f.name] = leaf(c)
    for c in ast.walk(tree):
        if isinstance(c, ast.Call) and leaf(c) in ends:
            at, gone = leaf(c), []
            while at in on and at not in gone:
                gone.append(at)
                at = on[at]
            args = ends[at].args
            extra = {w.arg for w in c.keywords if w.arg} - {a.arg for a in args.args + args.kwonlyargs}
            if at not in gone and gone and not args.kwarg and extra:
                out.add((path, c.lineno, leaf(c), f"{path}:{at}", tuple(sorted(extra))))
    return out


def random_program(rnd):
    lines = []
    for _ in range(rnd.randint(2, 9)):
        name, takes = rnd.choice("abcdef"), rnd.sample("xyz", rnd.randint(0, 3))
        rest = rnd.choice(["**k", "**k", "**o", ""])
        lines.append(f"def {name}({', '.join([*takes, *([rest] if rest else [])])}):")
        if rnd.random() < 0.3:
            lines += [f" def {rnd.choice('abcdef')}(**k):", f"  return {rnd.choice(['', 'm.'])}{rnd.choice('abcdef')}(**k)"]
        lines.append(f" {rnd.choice(['', 'm.'])}{rnd.choice('abcdefgh')}({rnd.choice(['', 'x=1, ', 'w=1, '])}**{rnd.choice('ko')})")
    lines += [f"{rnd.choice('abcdefg')}({', '.join(f'{w}={n}' for n, w in enumerate(rnd.sample('xyzuv', rnd.randint(0, 3))))})" for _ in range(6)]
    return "\n".join(lines) + "\n"


def test_keywords_of_random_programs(spark):
    rnd = random.Random(5)
    files = {f"src/r{n}.py": random_program(rnd) for n in range(240)}
    want = set().union(*(walked_keywords(p, s) for p, s in files.items()))
    assert len(want) > 40 and keywords(spark, files) == want


def test_keys_of_returned_dicts(spark):
    source = "def make():\n    return {'a': 1, 'b': 2}\n\ndef empty():\n    return {}\n\ndef use(key, dynamic):\n    one = make()\n    good = one['a']\n    bad = one['zzz']\n    other = unknown()\n    idx = one[key], one.get(dynamic), one.get('b', 'q')\n    first = second = make()\n    cache['m'] = make()\n    cache['n'], first.x['n'], f().get('n'), first.pop('n'), second.get()\n    one['new'] = 1\n    e = empty()\n    e['x']\n"
    assert unmet(spark, {"src/a.py": source}) == {("src/a.py", 8, "make", ("zzz",)), ("src/a.py", 13, "make", ("n",))}
    # the last assignment counts; a shape of the last definition that has one; methods and functions within give no shape, but make one for theirs
    source = "def f():\n    return {'a': 1}\ndef f():\n    return {'b': 1}\ndef f(): pass\nclass K:\n    def g(self): return {'a': 1}\ndef h():\n    def g(): return {'c': 1}\n    return g()\nasync def w():\n    v = h()\n    v['q']\n    v = self.f()\n    def deep():\n        v = f()\n        v['a'], v['b']\n    u = g()\n    u['zz']\nv['top']\n"
    assert unmet(spark, {"src/a.py": source, "src/none.py": "", "x.py": "def"}) == {("src/a.py", 16, "f", ("a",)), ("src/a.py", 16, "f", ("a", "q"))}


def walked_unmet(path, source):
    tree = ast.parse(source)
    shape, out = {}, set()
    text = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    for f in tree.body:
        if isinstance(f, DEFS):
            sets = [frozenset(text(k) for k in r.value.keys if k) - {None} for r in ast.walk(f) if isinstance(r, ast.Return) and isinstance(r.value, ast.Dict)]
            sets = {s for s in sets if s}
            if len(sets) == 1:
                shape[f.name] = sets.pop()
    for f in ast.walk(tree):
        if isinstance(f, DEFS):
            came, read = {}, {}
            for n in ast.walk(f):
                if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id in shape:
                    came |= {t.id: (n.value.func.id, n.lineno) for t in n.targets}
                if isinstance(n, ast.Subscript) and text(n.slice):
                    read.setdefault(n.value.id, set()).add(n.slice.value)
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
                    read.setdefault(n.func.value.id, set()).add(n.args[0].value)
            out |= {(path, line, made, tuple(sorted(read[v] - shape[made]))) for v, (made, line) in came.items() if read.get(v, set()) - shape[made]}
    return out


def test_keys_of_random_programs(spark):
    rnd = random.Random(6)

    def program():
        lines = []
        for _ in range(rnd.randint(1, 4)):
            lines.append(f"def {rnd.choice('fgh')}(c):")
            keys = "{" + ", ".join(f"'{k}': 1" for k in rnd.sample("abc", rnd.randint(0, 3))) + rnd.choice(["", ", **c"]) + "}"
            lines += [" if c:", "  return " + keys.replace("{, ", "{"), " return " + rnd.choice([keys.replace("{, ", "{"), "c", "{'a': 2}"])]
        for n in range(rnd.randint(1, 3)):
            lines.append(f"def use{n}():")
            for _ in range(rnd.randint(1, 6)):
                v = rnd.choice("uv")
                lines.append(" " + rnd.choice([f"{v} = {rnd.choice('fghi')}(1)", f"print({v}['{rnd.choice('abcd')}'])", f"{v}.{rnd.choice(['get', 'pop'])}('{rnd.choice('abcd')}', 'e')"]))
            if rnd.random() < 0.4:
                lines += [" def inner():", f"  {rnd.choice('uv')} = {rnd.choice('fgh')}(2)", f"  return {rnd.choice('uv')}['{rnd.choice('abcd')}']"]
        return "\n".join(lines) + "\n"

    files = {f"src/r{n}.py": program() for n in range(120)}
    want = set().union(*(walked_unmet(p, s) for p, s in files.items()))
    assert len(want) > 40 and unmet(spark, files) == want


def test_schemas_and_classes(spark):
    files = {
        "src/m.py": "class Widget:\n    size: int\n    color = 'red'\n    _secret = 1\n    _typed: int\n    x.y = 1\n    x += 1\n    def method(self):\n        self.q = 1\n\nclass Empty:\n    pass\n\nif x:\n    class Low:\n        a = 1\n",
        "src/z.py": "class Widget:\n    other: int\nclass Twice:\n    a: int\nclass Twice:\n    b: int\n",
    }
    docs = [
        ("a.json", '{"title": "Widget", "properties": {"size": {}, "color": {}, "_typed": {}}}'), ("b.json", '{"title": "Widget", "properties": {}}'),
        ("c.json", '{"components": {"schemas": {"Widget": {"properties": {"size": {}, "extra": {}, "color": 1, "_typed": 2}}}}}'), ("d.json", '{"$defs": {"Ghost": {"properties": {"a": {}}}, "Twice": {"properties": ["a"]}}}'),
        ("e.json", '{"definitions": {"Twice": {"properties": {"b": {}, "a": {}}}, "Empty": {"properties": {"a": {}}}, "Low": {"properties": {"b": {}}}}}'), ("f.json", "{nope"), ("g.json", "[1]"), ("h.json", None),
    ]
    rows = seams.drifted_models(nodes_of(spark, files), documents.schemas(spark.createDataFrame(docs, "path string, text string"))).collect()
    assert {(r.path, r.name, r.schema, tuple(r.only_in_schema), tuple(r.only_in_model)) for r in rows} == {
        ("src/m.py", "Widget", "b.json", (), ("_typed", "color", "size")), ("src/m.py", "Widget", "c.json", ("extra",), ()), ("src/z.py", "Twice", "e.json", ("a",), ()),
    }


def domains(spark, source):
    return [(r.line, r.name, r.first_line, r.first_set, r.set) for r in seams.inconsistent_rejections(nodes_of(spark, {"a.py": source})).orderBy("name").collect()]


def check(op, literal, body="raise ValueError(1)", var="tier"):
    return f"def f(tier):\n    if {var} {op} {literal!r}:\n        {body}\n    return True\n"


def test_literals_that_checks_reject(spark):
    assert domains(spark, check("==", "low") + check("!=", "top")) == [(6, "tier", 2, ["low"], ["low"])]  # all but one literal, and one: never alike
    assert domains(spark, check("!=", "top") + check("!=", "top")) == []
    assert domains(spark, check("!=", "top") + check("!=", "low", "return")) == [(6, "tier", 2, ["low"], ["top"])]
    assert domains(spark, check("==", "a", "return None") + check("==", "a", "return False") + check("==", "b", "m.Rejected(1)")) == [(10, "tier", 2, ["a"], ["b"])]
    quiet = check("==", "a") + check("==", "b", "return 0") + check("==", "b", "return tier") + check("==", "b", "log(1)") + check("==", "b", "reject(1); x = 1") + check(">", "b") + check("==", 1) + check("==", "b", var="other") + check("==", "b", var="tier.x")
    assert domains(spark, quiet) == []
    nested = "class K:\n    def f(self, tier):\n        if tier == 'b': raise E\n" + check("==", "a") + "if tier == 'c': raise E\n"
    assert domains(spark, nested) == []  # only functions at the left margin count
    inner = "def g(tier):\n    def h():\n        for x in tier:\n            if tier == 'b': return\n    if tier == 'a': return\n"
    assert domains(spark, inner) == [(5, "tier", 4, ["b"], ["a"])]  # in the order of statements


def test_no_nodes(spark):
    nodes = nodes_of(spark, {"a.py": "def", "b.py": None, "c.py": ""})
    schemas = documents.schemas(spark.createDataFrame([], "path string, text string"))
    assert all(df.isEmpty() for df in (seams.rejected_keywords(nodes), seams.unmet_keys(nodes), seams.drifted_models(nodes, schemas), seams.inconsistent_rejections(nodes)))


def test_round_trips(spark):
    files = {
        "src/a.py": "def export_all_rows(n): pass\ndef import_all_rows(n): pass\ndef export_x(File): pass\ndef export_y(n):\n    def deep(): return p.Read_Text()\ndef import_z(n): return n\ndef backup_plugin(path): pass\ndef exported(path): pass\ndef export_import(data): pass\nasync def db_backup_now(*data, **path):\n    return toml\n",
        "src/b.py": "class A:\n    def export(self, stream): pass\nclass A:\n    def restore(self): x.encode()\n    class In:\n        def export(self, data): pass\ndef import_it(self): pass\ndef backup(): pass\ndef f():\n    def export_q(data): pass\n",
        "tests/test_a.py": "def test_out(): export_all_rows(1)\ndef helper(): export_all_rows(import_all_rows(1))\ndef export_t(path): pass\n",
        "src/c.py": "def",
    }
    got = {(r.code, r.path, r.line, r.name, r.partner) for r in inverses.round_trips(nodes_of(spark, files)).collect()}
    assert got == {
        ("BHRT001", "src/a.py", 1, "export_all_rows", "import_all_rows"), ("BHRT002", "src/a.py", 3, "export_x", "import_x"), ("BHRT002", "src/a.py", 4, "export_y", "import_y"),
        ("BHRT002", "src/a.py", 9, "export_import", "import_import"), ("BHRT002", "src/b.py", 4, "A.restore", "A.backup"),
    }
    files["tests/test_b.py"] = "class T:\n    def test_it(self):\n        def go(): m.export_all_rows(1)\n        return go, self.import_all_rows\n    def test_both(self): x(m.import_all_rows(), export_all_rows)(), m.export_all_rows(2)\n"
    assert "BHRT001" not in {r.code for r in inverses.round_trips(nodes_of(spark, files)).collect()}
    assert inverses.round_trips(nodes_of(spark, {"a.py": ""})).isEmpty()
