import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftspark.llm import lm_scoring as lm
from siftspark.llm.common import table


def brute(rows, order=lm.ORDER, mus=lm.MU):
    docs = [(d, [*(t or "").encode().lower().split(), "END"], d is not None and zlib.crc32(str(d).encode()) % 5 == 1) for d, t in rows]
    c = [Counter() for _ in range(order + 1)]
    for _, w, held in docs:
        if not held:
            for k in range(1, order + 1):
                c[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n, v = sum(c[1].values()), len(c[1])
    n1, n2 = (sum(x == y for x in c[1].values()) for y in (1, 2))
    d = n1 / (n1 + 2 * max(n2, 1)) if n1 else 0.5

    def p(gram):
        if len(gram) == 1:
            return 1.0 if not n else (c[1][gram] - d) / n if c[1][gram] else d * v / n
        mu = mus[min(len(gram) - 1, len(mus)) - 1]
        return (c[len(gram)][gram] + mu * p(gram[1:])) / (c[len(gram) - 1][gram[:-1]] + mu)

    out = []
    for doc, w, held in docs:
        base = sum(math.log10((c[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))
        out.append((doc, held, len(w), sum(c[1][(x,)] > 0 for x in w), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order, block_bytes", [(3, lm.BLOCK_BYTES), (3, 60_000), (2, 60_000), (4, 100_000), (1, 60_000)])
def test_documents(spark, sf, order, block_bytes):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    frame = docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 5 = 1 AS held_out")
    same(lm.scored(frame, order=order, block_bytes=block_bytes).collect(), brute(rows, order))


def test_better_than_base_on_held_out(spark):
    rows = [r for r in lm.op2_lm_scoring(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.85 * sum(r.base_score for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b a B"), (3, "A b a B"), (None, "a \x0b b"), (4, "long text " * 20_000), (5, "É é"), (7, "a a a"), (8, "ends"), (12, "new words only")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, block int")
    same(lm.op2_lm_scoring(df).collect(), brute(rows))
    assert lm.op2_lm_scoring(df.limit(0)).collect() == []
    held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1][:3]
    alone = [(d, "nothing to learn from") for d in held]
    same(lm.op2_lm_scoring(spark.createDataFrame(alone, "doc_id long, text string")).collect(), brute(alone))


def test_rows_that_repeat_do_not_share_one_block(spark):
    text = "one row that comes again and again " * 10
    rows = [(None, text)] * 300 + [(4, "another text"), (5, None), (1, text)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, h int, parts string").repartition(4)
    frame = df.selectExpr("doc_id", "text", "coalesce(crc32(cast(doc_id as string)) % 5 = 1, false) AS held_out")
    same(lm.scored(frame, block_bytes=20_000).collect(), brute(rows))


def test_texts_that_training_saw_twice_score_higher(spark):
    """Per token, of texts that are not held out: those that occur twice against those that occur once."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = Counter(texts.values())
    rows = [(r.score / r.n_tokens, seen[texts[r.doc_id]]) for r in lm.op2_lm_scoring(docs).collect() if not r.held_out and r.n_tokens > 20]
    once = sorted(s for s, n in rows if n == 1)
    edge = once[int(len(once) * 0.9)]
    twice = [s for s, n in rows if n == 2]
    assert len(twice) > 100 and sum(s > edge for s in twice) > 0.28 * len(twice)


def test_totals_beyond_four_billion():
    """Two blocks whose counts of one word add up to more than 2 ** 32, and a word of one block."""
    ask = lambda block, keys, counts: {"bucket": 0, "block": block, "sizes": [len(keys)], "keys": lm._pack(np.diff(np.array(keys, np.uint64), prepend=np.uint64(0))), "counts": lm._pack(np.array(counts, np.uint32))}
    answer = lm._answer(pa.Table.from_pylist([ask(0, [7, 9], [3_000_000_000, 1]), ask(1, [7], [2_000_000_000])])).to_pylist()
    totals = {r["block"]: lm._unpack(r["totals"], np.uint64).tolist() for r in answer if r["block"] >= 0}
    assert totals == {0: [5_000_000_000, 1], 1: [5_000_000_000]}
    assert [(r["n"], r["v"], r["n1"]) for r in answer if r["block"] < 0] == [(5_000_000_001, 2, 1)]
