import random

import numpy as np
import xxhash

from siftspark.llm import simhash
from siftspark.llm.common import table


def brute(rows, words=3, radius=3):
    """doc_id -> (fingerprint, smallest id reachable), bit by bit and pair by pair."""
    prints = []
    for _, text in rows:
        tokens = (text or "").encode().lower().split()
        shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip([r[0] for r in rows], prints))), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    return sorted((tuple(r) for r in simhash.op7_simhash(df).collect()), key=str)


def test_documents_match_pairwise_comparison(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.op7_simhash(table(spark, sf, "documents")).collect()), key=str)
    assert got == brute(rows)


def test_nulls_empties_repeats_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (4, "one"), (None, "ONE"), (5, "a b c d e f"), (6, "A b c d e f"), (7, long), (8, long + " end"), (None, "alone here")]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_links_in_crowded_buckets_equal_all_pairs(spark):
    rnd = random.Random(5)
    codes = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(30)}
    codes = sorted(codes)
    words = np.array(codes, np.uint64).reshape(-1, 1)
    m, r = simhash.link_codes(np.zeros(len(codes), np.int64), words, 3)
    label = np.arange(len(codes))
    for a, b in zip(m, r):
        label[label == label[a]] = label[b]
    want = np.arange(len(codes))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                want[want == want[i]] = want[j]
    same = lambda x: (x[:, None] == x[None, :])
    assert (same(label) == same(want)).all()


def test_buckets_dealt_out_again_lose_no_link(spark, sf):
    docs = table(spark, sf, "documents")
    whole = sorted(tuple(r) for r in simhash.hamming_components(docs, radius=10).collect())
    tight = sorted(tuple(r) for r in simhash.hamming_components(docs, radius=10, max_bucket=5).collect())
    assert whole == tight


def test_gray_rank_inverts_the_gray_code():
    ranks = np.array([0, 1, 2, 3, 12345, 2**64 - 1], np.uint64)
    codes = (ranks ^ (ranks >> np.uint64(1))).reshape(-1, 1)
    assert (simhash.gray_rank(codes)[:, 0] == ranks).all()
