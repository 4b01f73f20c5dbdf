import random

import numpy as np
import pytest

from siftspark.llm import minhash
from siftspark.llm.common import table


def shingles(text, words=2):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def copies(rnd, originals=6, each=25):
    """Texts and copies of them at all similarities from about a half on: cut, lengthened, with words changed; all share a passage."""
    out = []
    for o in range(originals):
        text = [f"w{rnd.randint(0, 400)}" for _ in range(120)] + ["the", "shared", "passage"] * 3
        for _ in range(each):
            t = list(text)
            for _ in range(rnd.randint(0, 14)):
                t[rnd.randrange(len(t))] = f"n{rnd.randint(0, 10**6)}"
            t = t[: len(t) - rnd.randint(0, 20)] + [f"m{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 10))]
            out.append(" ".join(t))
    return out


def test_documents_equal_comparing_all_pairs(spark, sf):
    df = table(spark, sf, "documents")
    same(minhash.op13_minhash(df).collect(), brute([tuple(r) for r in df.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("limits", [{}, {"weight": 900}, {"members": 5}, {"weight": 300, "members": 8}])
def test_large_families_and_lists_lose_no_link(spark, limits):
    rows = list(enumerate(copies(random.Random(11))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(minhash.near_duplicates(df, **limits).collect(), brute(rows))


def test_nulls_empties_repeats_ties_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i % 9770}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (4, "one"), (None, "ONE"), (5, "a b c d e f"), (6, "A b c d e f"), (7, long), (8, long + " end"), (None, "alone here"), (None, None), (9, "two words"), (9, "something else"), (10, "é É"), (11, "É É"), (12, "f e d c b a")]
    rows += [(13, "a b c d e f g"), (14, "x y x y x y x"), (15, "y x y")]
    df = spark.createDataFrame([(*r, 0, b"x", 1) for r in rows], "doc_id long, text string, node int, keys binary, th int")
    same(minhash.op13_minhash(df).collect(), [(d, n, d if n == 0 else c, (d == d if n == 0 else k) or d is c is None) for d, n, c, k in brute(rows)])
    assert minhash.op13_minhash(df.limit(0)).collect() == []
    same(minhash.op13_minhash(df.where("doc_id = 1")).collect(), [(1, 0, 1, True)])


def test_pairs_at_the_similarity_share_enough_coordinates():
    rng = np.random.default_rng(1)
    for n in (5, 9, 90, 900):
        for _ in range(200):
            s = rng.integers(0, 2**63, n + n // 9 * 2 + (n == 5)).astype(np.uint64)
            both = n - n // 9 if n > 5 else 4
            a, b = np.unique(s[:n] if n > 5 else s[:4]), np.unique(np.concatenate([s[:both], s[n : n + n // 9]]) if n > 5 else s[:5])
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            assert (minhash.signature(a) == minhash.signature(b)).sum() >= minhash.SHARED


def test_a_forest_not_all_pairs():
    tags = np.zeros((500, minhash.KEYS), np.uint8)
    assert len(minhash.merged(tags, np.full(500, 10), 80)) == 499
    sets = [np.arange(100, dtype=np.uint64)] * 300 + [np.arange(50, 150, dtype=np.uint64)] * 2
    assert len(minhash.confirmed(sets, np.zeros((302, minhash.KEYS), np.uint8), 80)) == 300
