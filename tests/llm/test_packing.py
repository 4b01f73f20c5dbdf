import random
from collections import Counter

import numpy as np

from siftspark.llm import packing
from siftspark.llm.common import table


def check(rows, got, row):
    with open(packing.RANKS, "rb") as f:
        encode = packing._encoding(f.read())
    pieces = {}
    for r in got:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(at) == row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row
        assert (ids[r.n_tokens :] == packing.PAD_ID).all() and not at[r.n_tokens :].any()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (at[a:b] == np.arange(b - a)).all()
            pieces.setdefault((doc, piece), []).append(ids[a:b].tolist())
    texts = {}
    for (doc, piece), many in sorted(pieces.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        for k, ids in enumerate(sorted(many)):
            texts.setdefault((doc, k), []).extend(ids)
    back = Counter((doc, encode.decode(ids[:-1])) for (doc, _), ids in texts.items())
    assert all(ids[-1] == packing.END_ID for ids in texts.values())
    assert back == Counter((d, t or "") for d, t in rows)


def test_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = packing.op4_token_packing(docs).collect()
    check(rows, got, packing.ROW)
    assert sum(r.n_tokens for r in got) > 0.95 * packing.ROW * (len(got) - 1)
    check(rows, packing.packed(docs.repartition(3), row=100, group_tokens=5000).collect(), 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "<|endoftext|> is text"), (5, "long words " * 30_000), (6, "x" * 5000), (7, " \n\t é𝒳"), (8, " " * 1_000_000 + "end"), (9, "a\n" + "\n" * 400_000)]
    df = spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, ids binary")
    check(rows, packing.packed(df, row=64).collect(), 64)
    assert packing.op4_token_packing(df.limit(0)).collect() == []


def test_best_fit_decreasing_equals_plain_search():
    rnd = random.Random(2)
    for _ in range(50):
        row = rnd.randint(1, 40)
        lengths = [rnd.randint(1, row) for _ in range(rnd.randint(0, 80))]
        room, sizes = [], []
        for n in sorted(lengths, reverse=True):
            fit = [i for i, r in enumerate(room) if r >= n]
            if fit:
                best = min(fit, key=lambda i: room[i])
                room[best] -= n
            else:
                room.append(row - n)
        got = packing.pack(lengths, row)
        sizes = sorted(row - sum(lengths[i] for i in members) for members in got)
        assert sorted(i for m in got for i in m) == list(range(len(lengths))) and len(got) == len(room) and sizes == sorted(room)


def test_long_white_space_gets_the_ids_of_the_tokenizer():
    with open(packing.RANKS, "rb") as f:
        data = f.read()
    plain, whole = packing._encoding(data), packing._encoding(data, r"[\s\S]+")
    for n in (packing.SPACES - 1, packing.SPACES, packing.SPACES + 1, 200_000):
        for text in (f"a{' ' * n}word", f"{' ' * n}", f"x \n{'\n' * n}end", f"{' ' * n}\t{' ' * n}!", f"a{'\n' * n}", f"a{' ' * n}\x1cb{' ' * n}c"):
            assert packing.encode(plain, whole, text) == plain.encode_ordinary(text)
