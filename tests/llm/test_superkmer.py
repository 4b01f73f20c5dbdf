import hashlib
import random

from siftspark.llm import superkmer
from siftspark.llm.common import table


def brute(rows, window=50):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    return sorted((tuple(r) for r in superkmer.op10_substring_dedup(df).collect()), key=str)


def words(rnd, n):
    return [f"w{rnd.randint(0, 5000)}" for _ in range(n)]


def test_documents_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in superkmer.op10_substring_dedup(docs).collect()), key=str) == brute(rows)


def planted(rnd):
    passage, other = words(rnd, 80), words(rnd, 51)
    rows = [(i, " ".join(words(rnd, rnd.randint(0, 40)) + passage[: rnd.randint(45, 80)] + words(rnd, 9))) for i in range(40)]
    rows += [(100 + i, "\t\n".join(other)) for i in range(5)] + [(90, " ".join(other[:-1])), (91, " ".join(other[1:]))]
    return rows


def test_passages_edges_nulls_and_repeated_rows(spark):
    rnd = random.Random(3)
    rows = planted(rnd)
    same = " ".join(words(rnd, 70))
    rows += [(200, same), (200, same), (200, same + " more"), (None, same), (201, same), (202, None), (203, ""), (204, " "), (205, " ".join(["a"] * 400)), (206, " ".join(["a"] * 60 + ["b"] * 60))]
    rows += [(207, " ".join(words(rnd, 50_000)))]
    assert found(spark, rows) == brute(rows)


def test_salted_buckets(spark):
    rows = planted(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = superkmer.without_repeats(df, max_bucket=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
