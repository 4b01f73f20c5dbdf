"""Values' facts against a recursive evaluation, function by function, over random programs of sums, quotients, casts, calls and returns."""

import ast
import random

from siftspark.operators import values
from siftspark.sources import syntax

UNITS = {"_ms": ("time", "ms"), "_s": ("time", "s"), "_km": ("length", "km"), "_pct": (None, "percent"), "_ratio": (None, "fraction")}
NUMBERS = ("int8", "int64", "uint64", "float32", "float64")
WIDE = {"int8": 8, "int64": 64, "uint64": 64, "float32": 32, "float64": 64}
TAGS = [("dimension-clash:", "BHUNIT004"), ("instant-clash:", "BHSEM002"), ("tz-clash:", "BHSEM003"), ("narrow:", "BHSEM004"), ("promotion-risk:", "BHSEM005"), ("shape-clash:", "BHSEM006")]
EMPTY = {"dim": {}, "unit": None, "nominal": None, "dtype": None, "zone": None, "said": "", "sure": 0.0}


def fact(said, sure=0.0, **more):
    return {**EMPTY, "said": said, "sure": sure, **more}


def spelled(name):
    for end, (axis, unit) in UNITS.items():
        if name.endswith(end):
            return fact(f"name:{name}", 0.8, dim={axis: 1} if axis else {}, unit=unit)
    if name.endswith("_at"):
        return fact(f"name:{name}", 0.8, nominal="instant")
    return None


def agreed(a, b):
    out = {k: a[k] if a[k] == b[k] else None for k in ("unit", "nominal", "dtype", "zone")}
    return fact(a["said"] + "+" + b["said"], max(0.1, min(a["sure"], b["sure"])), dim=a["dim"] if a["dim"] == b["dim"] else {}, **out)


def product(a, b, sign):
    dim = dict(a)
    for k, v in b.items():
        dim[k] = dim.get(k, 0) + sign * v
    return {k: v for k, v in dim.items() if v}


def risky(a, b):
    x, y = a["dtype"], b["dtype"]
    whole = lambda t: "int" in t
    if not x or not y or x == y:
        return None
    if ("uint64" in (x, y) and any(not t.startswith("u") for t in (x, y))) or whole(x) != whole(y):
        return fact(f"promotion-risk:{a['said']}+{b['said']} ({x}+{y} may lose integer precision)", min(a["sure"], b["sure"]))
    return None


def evaluate(node, look):
    if isinstance(node, ast.Name):
        return look(node) or spelled(node.id) or fact(f"name:{node.id}")
    if isinstance(node, ast.Constant):
        return fact(f"literal:{node.value!r}")
    if isinstance(node, ast.BinOp):
        a, b = evaluate(node.left, look), evaluate(node.right, look)
        low = min(a["sure"], b["sure"])
        if isinstance(node.op, ast.Div):
            parts = b["said"].split("literal:")
            try:
                factor = float(parts[1]) if len(parts) > 1 else None
            except ValueError:
                factor = None
            sure = min(a["sure"], b["sure"] or 1.0)
            if a["unit"] == "percent" and factor and 99 <= factor <= 101:
                return fact(a["said"] + "/100", sure, unit="fraction")
            if a["unit"] == "ms" and a["dim"] == {"time": 1}:
                if factor and 999 <= factor <= 1001:
                    return fact(a["said"] + "/1000", sure, dim={"time": 1}, unit="s")
                return fact(f"bad-divisor:{a['said']}/{b['said']}", min(a["sure"], 0.8), dim={"time": 1}, unit="ms")
            return fact(f"{a['said']}/{b['said']}", low, dim=product(a["dim"], b["dim"], -1))
        if risk := risky(a, b):
            return risk
        if isinstance(node.op, ast.Mult):
            return fact(f"{a['said']}*{b['said']}", low, dim=product(a["dim"], b["dim"], 1))
        said = f"{a['said']}+{b['said']}"
        if a["dim"] and b["dim"] and a["dim"] != b["dim"]:
            said = "dimension-clash:" + said
        if a["nominal"] == b["nominal"] == "instant":
            said = "instant-clash:" + said
        return fact(said, low, dim=a["dim"] or b["dim"], unit=a["unit"] if a["unit"] == b["unit"] else None)
    if isinstance(node, ast.Attribute):
        return spelled(node.attr) or fact(f"attr:{node.attr}")
    dotted = ast.unparse(node.func)
    if dotted == "time.time":
        return fact("api-contract:time.time", 0.98, dim={"time": 1}, unit="s", nominal="instant")
    if dotted == "numpy.ones":
        return fact("call:numpy.ones", 0.9, dtype=ast.unparse(node.keywords[0].value).split(".")[-1])
    if dotted.endswith(".astype"):
        a, to = evaluate(node.func.value, look), ast.unparse(node.args[0]).split(".")[-1]
        was = a["dtype"]
        real = lambda t: t.startswith("float")
        narrow = was and was != to and (real(was) and not real(to) or real(was) == real(to) and (WIDE[to] < WIDE[was] or was.startswith("u") and not real(to) and not to.startswith("u") and WIDE[to] <= WIDE[was]))
        return fact(f"narrow:{was}->{to} ({a['said']})" if narrow else f"call:{dotted}", min(a["sure"] or 0.7, 0.9), dtype=to)
    return fact(f"call:{dotted}")


def clashes(source, passes):
    """(code, line, function, name) in one file of functions without nesting."""
    functions = {f.name: f for f in ast.parse(source).body if isinstance(f, ast.FunctionDef)}
    params, bound, back, sites = {}, {}, {}, []
    for name, f in functions.items():
        params[name] = {a.arg: spelled(a.arg) or fact(f"param:{a.arg}") for a in f.args.args}
        env, bound[name], back[name] = dict(params[name]), {}, []
        for stmt in f.body:
            look = lambda n: env.get(n.id)  # noqa: E731, B023
            for call in [c for c in ast.walk(stmt) if isinstance(c, ast.Call)]:
                sites.append((name, call, [(a.id if isinstance(a, ast.Name) else None, evaluate(a, look)) for a in call.args]))
            if isinstance(stmt, ast.Assign):
                own, value = spelled(stmt.targets[0].id), evaluate(stmt.value, look)
                env[stmt.targets[0].id] = bound[name][stmt.targets[0].id] = agreed(own, value) if own else value
            elif isinstance(stmt, ast.Return):
                back[name].append(evaluate(stmt.value, look))
    for _ in range(passes):
        before = {n: dict(p) for n, p in params.items()}
        for caller, call, args in sites:
            callee = ast.unparse(call.func)
            for param, (said, value) in zip(params.get(callee, ()), args):
                if said in bound[caller] and bound[caller][said]["sure"] >= value["sure"]:
                    value = bound[caller][said]
                if value["sure"] > max(0, params[callee][param]["sure"]):
                    params[callee][param] = value
        again = {}
        for name, f in functions.items():
            env = dict(params[name])
            look = lambda n: env.get(n.id)  # noqa: E731, B023
            for stmt in f.body:
                if isinstance(stmt, ast.Assign):
                    value = evaluate(stmt.value, look)
                    if isinstance(stmt.value, ast.Call) and back.get(ast.unparse(stmt.value.func)):
                        value, *others = back[ast.unparse(stmt.value.func)]
                        for other in others:
                            value = agreed(value, other)
                    target = stmt.targets[0].id
                    if target not in env or value["sure"] > env[target]["sure"]:
                        env[target] = value
            bound[name] = {k: v for k, v in env.items() if k not in params[name]}
            new = [evaluate(stmt.value, look) for stmt in f.body if isinstance(stmt, ast.Return)]
            again[name] = new if any(n["sure"] > o["sure"] for n, o in zip(new, back[name])) else back[name]
        back, same = again, before == params and again == back
        if same and _:
            break
    out = []
    sources = lambda f: sum(t.split(":")[0] in ("name", "api-contract") for t in f["said"].replace("+", " ").replace("/", " ").split())
    sure = lambda f, s=None: min(f["sure"], s or 1) >= 0.7 or min(f["sure"], s or 1) >= 0.45 and sources(f) >= 2
    for caller, call, args in sites:
        callee = ast.unparse(call.func)
        final = []
        for said, value in args:
            for scope in (bound[caller], params[caller]):
                if said in scope and scope[said]["sure"] >= value["sure"]:
                    value = scope[said]
                    break
            final.append(value)
        if callee == "time.sleep" and final[0]["dim"] and ("bad-divisor" in final[0]["said"] or final[0]["dim"] != {"time": 1} or final[0]["unit"] not in (None, "s")) and sure(final[0]):
            out.append(("BHUNIT004", call.lineno, caller, callee))
        for value, want in zip(final, params.get(callee, {}).values()):
            if value["unit"] != want["unit"] and {value["unit"], want["unit"]} == {"percent", "fraction"} and min(value["sure"], want["sure"]) >= 0.45 and (min(value["sure"], want["sure"]) >= 0.7 or sources(value) + sources(want) >= 2):
                out.append(("BHSEM007", call.lineno, caller, callee))
    for name in functions:
        for key, value in [*bound[name].items(), *params[name].items(), *((f"return@{i}", r) for i, r in enumerate(back[name]))]:
            if (code := next((c for t, c in TAGS if value["said"].startswith(t)), None)) and sure(value):
                out.append((code, 0, name, key))
    return out


def program(rnd, k):
    names = [f"f{k}_{i}" for i in range(4)]
    word = lambda: rnd.choice("abc") + rnd.choice(["_ms", "_s", "_km", "_pct", "_ratio", "_at", "", ""])

    def expression(seen, depth=0):
        r = rnd.random()
        if r < 0.4 or depth > 1:
            return rnd.choice(seen)
        if r < 0.5:
            return str(rnd.choice([1000, 100, 60, 2.5]))
        if r < 0.8:
            return f"({expression(seen, depth + 1)} {rnd.choice('+-*/')} {expression(seen, depth + 1)})"
        if r < 0.9:
            return f"numpy.ones(3, dtype=numpy.{rnd.choice(NUMBERS)})" if rnd.random() < 0.6 else "time.time()"
        return f"{rnd.choice(seen)}.astype(numpy.{rnd.choice(NUMBERS)})"

    text = "import time\nimport numpy\n"
    for name in names:
        args = sorted({word() for _ in range(rnd.randint(1, 3))})
        seen = list(args)
        text += f"def {name}({', '.join(args)}):\n"
        for _ in range(rnd.randint(2, 3)):
            r = rnd.random()
            if r < 0.6:
                value = f"{rnd.choice(names)}({rnd.choice(seen)})" if rnd.random() < 0.25 else expression(seen)
                target = word()
                text += f"    {target} = {value}\n"
                seen.append(target)
            elif r < 0.8:
                text += f"    {rnd.choice(names)}({', '.join(expression(seen) for _ in range(rnd.randint(1, 2)))})\n"
            else:
                text += f"    time.sleep({expression(seen)})\n"
        text += f"    return {expression(seen)}\n"
    return text


def test_random_programs_give_what_a_recursive_evaluation_gives(spark):
    rnd = random.Random(4)
    files = {f"src/p{k}.py": program(rnd, k) for k in range(250)}
    nodes = syntax.nodes(spark.createDataFrame(list(files.items()), "path string, source string").repartition(4))
    got = {(r.path, r.code, r.line, r.function, r.name) for r in values.contradictions(nodes, 2).collect() if r.code not in ("BHSEM001", "BHSEM010")}
    want = {(path, *c) for path, source in files.items() for c in clashes(source, 2)}
    codes = {w[1] for w in want}
    assert {"BHUNIT004", "BHSEM002", "BHSEM004", "BHSEM005", "BHSEM007"} <= codes
    odd = sorted({g[0] for g in got ^ want})
    assert len(odd) <= 0, (odd[:3], sorted(got - want)[:3], sorted(want - got)[:3], files[odd[0]])
