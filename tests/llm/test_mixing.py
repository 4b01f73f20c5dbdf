from collections import defaultdict

from siftspark.llm import mixing
from siftspark.llm.common import table


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Clamp and share again until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return target | share
        target |= {s: epochs * sizes[s] for s in above}


def check(spark, df):
    got = mixing.op5_mixing(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op5_mixing(df.repartition(7)).collect()), key=str)
    rows = df.collect()
    sizes, taken, large = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in rows}
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    want = water_fill(sizes)
    for g in got:
        s = source[g.doc_id]
        taken[s] += g.taken
        large[s] = max(large[s], g.size)
        assert g.taken in {g.size * k for k in range(4)}
        assert g.source_size == sizes[s] and abs(g.target - want[s]) < 1e-6 * max(1, want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= large[s] / 2 + 1e-6
    assert len(got) == len(rows)


def test_documents(spark, sf):
    check(spark, table(spark, sf, "documents"))


def test_small_sources_are_clamped_and_nulls_count(spark):
    rows = [(i, "word " * (i % 9), "big") for i in range(400)]
    rows += [(1000 + i, "a b c", s) for i, s in enumerate(["x", "y", None, "ü", "z"])]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, None, "big"), (2003, "long " * 50_000, "x"), (2003, "long " * 50_000, "x")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, copies int, target string")
    check(spark, df)
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    by_id = {r.doc_id: r.taken for r in mixing.op5_mixing(df).collect()}
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert all(counts.get(d, 0) * 3 == t for d, t in by_id.items() if 1000 <= d < 1005)
    assert max(counts.get(d, 0) for d in (2000, 2001)) <= 3


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.op5_mixing(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (None, " ", "a")], "doc_id long, text string, source string")
    assert sorted(tuple(r)[1:] for r in mixing.op5_mixing(blank).collect()) == [(0, 0, 0.0, 0)] * 2
