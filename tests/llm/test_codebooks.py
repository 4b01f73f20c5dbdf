import hashlib
import random

import numpy as np
import pytest

from siftspark.llm import codebooks
from siftspark.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label int, block string, n int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((d, v, label) for d, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in kept if len(v) and len(v) % parts == 0), None)
    w = (dim or 0) // parts
    cut = [[[int(np.clip(np.floor(1024 * x), -codebooks.MOST, codebooks.MOST)) for x in v[p * w : p * w + w]] for p in range(parts)] if len(v) == dim else None for _, v, _ in kept]
    fits = [c for c in cut if c is not None]
    books = [[c[p] for c in fits[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for c in fits:
            for p in range(parts):
                held[p][near(p, c[p])[1]].append(c[p])
        books = [[[sum(x) // len(h) for x in zip(*h)] if h else e for h, e in zip(hs, b)] for hs, b in zip(held, books)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = []
    for (d, _, label), c in zip(kept, cut):
        ways = [near(p, c[p]) for p in range(parts)] if c is not None else None
        found.append((d, "".join(f"{i:02x}" for _, i in ways) if ways else None, sum(x for x, _ in ways) if ways else None, label))
    return [(d, code, error, sum(e or 0 for _, _, e, m in found if m == label), digest) for d, code, error, label in found]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_to_measuring_everything(spark, sf):
    df = table(spark, sf, "embeddings").limit(320)
    same(codebooks.op12_codebooks(df).collect(), brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]))


def test_unsound_and_repeated_vectors_ties_and_clashing_names(spark):
    rnd = random.Random(3)
    few = [[float(rnd.randint(-2, 2)) for _ in range(8)] for _ in range(300)]
    rows = [(i, v, i % 3) for i, v in enumerate(few)] + [(3, few[3], None)] * 50 + [(None, few[1], None), (4, few[5], 9)]
    rows += [(90, None, 1), (-1, [], 1), (92, few[0][:7], 1), (93, few[0][:7] + [None], 1), (94, few[0][:7] + [float("nan")], 1), (95, few[0][:7] + [float("-inf")], 2), (96, few[0] + [1.0] * 4, 1), (97, [1e30] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    same(codebooks.op12_codebooks(df).collect(), brute(rows))
    assert codebooks.op12_codebooks(df.limit(0)).collect() == []
    same(codebooks.op12_codebooks(df.where("vec_id = 3")).collect(), brute([r for r in rows if r[0] == 3]))
    same(codebooks.op12_codebooks(df.where("vec_id = -1")).collect(), brute([(-1, [], 1)]))


@pytest.mark.parametrize("spread", [3, 400])
def test_bounds_skip_and_change_nothing(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-600, 600, (1, 4, 8))[:, rng.integers(0, 4, 4000)].reshape(4000, 8) + rng.integers(-spread, spread, (4000, 8))
    history = [x[None, :128].copy()]
    groups = [codebooks.entry_groups(history[0][0])]
    state, all_measured = codebooks.State(len(x), 1, len(groups[0])), []
    for _ in range(6):
        own, error, measured = state.advance(x, codebooks.Rounds(history, groups))
        d = ((x[:, None] - history[-1][0][None]) ** 2).sum(axis=2)
        assert (own[:, 0] == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        for g, entries in enumerate(groups[0]):  # bounds hold at the round of their stamps
            for i in range(0, len(x), 97):
                then = history[state.stamps[i, 0, g]][0]
                others = [e for e in entries if e != own[i, 0]]
                assert float(state.bounds[i, 0, g]) ** 2 <= min((((x[i] - then[e]) ** 2).sum() for e in others), default=np.inf) + 1e-9
        all_measured.append(measured)
        state.own = own
        book = history[-1].copy()
        for e in range(128):
            if (mine := x[own[:, 0] == e]).size:
                book[0, e] = mine.sum(axis=0) // len(mine)
        history.append(book)
    assert all_measured[0] == x.shape[0] * 128 and all_measured[-1] < all_measured[0] * 0.75


def test_rounds_read_blocks_and_state_without_exchange(spark, sf, monkeypatch):
    made, write = [], codebooks.bucketed
    monkeypatch.setattr(codebooks, "bucketed", lambda df, name, key: made.append((name, df)) or write(df, name, key))
    codebooks.coded(table(spark, sf, "embeddings"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for name, df in made if name == "vector_state"]
    assert len(plans) == codebooks.ROUNDS and not any("Exchange" in p for p in plans)
