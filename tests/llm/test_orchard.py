import hashlib
import random

import numpy as np

from siftspark.llm import orchard
from siftspark.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


def brute(rows, k=40, rounds=5, dim=64):
    kept = [(d, [int(np.clip(np.floor(256 * x), -orchard.MOST, orchard.MOST)) for x in v]) for d, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[near(v)[1]].append(v)
        centroids = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, centroids)]
    found = [(d, *near(v)) for d, v in kept]
    whole = sum(f[1] for f in found)
    return [(d, c, dist, sum(f[1] for f in found if f[2] == c), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for d, dist, c in found]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_to_measuring_everything(spark, sf):
    df = table(spark, sf, "embeddings")
    same(orchard.op11_orchard(df).collect(), brute([tuple(r) for r in df.select("vec_id", "embedding").collect()]))


def test_unsound_and_repeated_vectors_ties_and_clashing_names(spark):
    rnd = random.Random(3)
    few = [[float(rnd.randint(-2, 2)) for _ in range(64)] for _ in range(45)]
    rows = [(i, v) for i, v in enumerate(few)] + [(3, few[3])] * 50 + [(None, few[1]), (None, few[2]), (4, few[5])]
    rows += [(90, None), (91, []), (92, few[0][:63]), (93, few[0][:63] + [None]), (94, few[0][:63] + [float("nan")]), (95, few[0][:63] + [float("inf")]), (96, few[0] + [1.0]), (97, [1e30] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    same(orchard.op11_orchard(df).collect(), brute(rows))
    assert orchard.op11_orchard(df.limit(0)).collect() == []
    same(orchard.op11_orchard(df.where("vec_id = 3")).collect(), brute([r for r in rows if r[0] == 3]))


def test_search_measures_fewer_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (40, 8))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    index = orchard.Orchard(np.concatenate([centres, centres[:5]]))
    best, dist = index.nearest(x)
    d = ((x[:, None] - index.centroids[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    line = orchard.Orchard(np.array([[4], [0], [2], [0], [8]]))
    assert line.nearest(np.array([[1], [3], [0], [6], [-9]]))[0].tolist() == [1, 0, 1, 0, 1]
