import random
import re

from siftspark.llm import decontamination as dc
from siftspark.llm.common import table


def brute(docs, items, window=13):
    """(doc_id, item_id) -> (item words, best matched, windows), over every alignment."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = split(text)
        for i, other in items:
            b = split(other)
            if not b:
                continue
            matched, windows = 0, 0
            for shift in range(-len(b) + 1, len(w)):
                eq = {q for q in range(len(b)) if 0 <= q + shift < len(w) and w[q + shift] == b[q]}
                width = min(window, len(b))
                n = sum(10 * sum(q in eq for q in range(a, a + width)) >= 8 * width for a in range(len(b) - width + 1))
                if n:
                    matched, windows = max(matched, len(eq)), windows + n
            if windows:
                out[d, i] = (len(b), matched, windows)
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, words int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    return {(r.doc_id, r.item_id): (r.item_words, r.matched, r.windows) for r in dc.overlaps(d, b, **kw).collect()}


def words(rnd, n):
    return [rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else f"w{rnd.randint(0, 900)}" for _ in range(n)]


def test_substituted_passages_and_quiet_neighbours(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(words(rnd, rnd.randint(8, 60)))) for i in range(20)] + [(50, "seven words that are in one item"), (54, "w7"), (51, None), (52, ""), (53, " ".join(["na"] * 20))]
    docs = [(100 + i, " ".join(words(rnd, 150))) for i in range(20)]
    for i, text in items[:20]:
        w = text.split()
        docs.append((i, " ".join(words(rnd, 30) + [f"X{k}" if k % 5 == i % 5 else x.upper() + "," for k, x in enumerate(w)] + words(rnd, 30))))
    docs += [(200, items[0][1]), (200, items[0][1]), (None, items[1][1]), (201, None), (202, ""), (203, " ".join(items[2][1].split()[3:])), (204, " ".join(words(rnd, 20_000)) + " " + items[3][1]), (205, "na " * 30), (206, "Seven words that are in one other item"), (207, "here: seven words, that are in one item")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, broadcast_seeds=0) == want
    assert {(i, i) for i in range(20)} <= set(want) and not any(d and 100 <= d < 120 and i != 54 for d, i in want)


def test_decontaminated_keeps_clean_rows_with_their_columns(spark):
    rnd = random.Random(9)
    item = " ".join(words(rnd, 30))
    rows = [(1, item, "x"), (None, item, "y"), (None, None, "z"), (2, "clean text", "th"), (1, "clean as well", "u")]
    docs = spark.createDataFrame([(*r, 1, True, "t", "r", 0) for r in rows], "doc_id long, text string, th string, _k int, _null boolean, _th string, row string, k int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = dc.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.th for r in kept.collect()) == ["th", "u", "z"]


def test_empty_tables(spark, sf):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = table(spark, sf, "benchmark")
    assert dc.op3_decontamination(none, bench).collect() == []
    assert dc.op3_decontamination(table(spark, sf, "documents"), bench.limit(0)).collect() == []
