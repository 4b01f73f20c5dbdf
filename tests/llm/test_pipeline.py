import random

import numpy as np

import corpus_pipeline
from siftspark.llm import packing, simhash
from siftspark.llm.common import table


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_stages_keep_the_columns_and_clean_documents(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert name == "mix" or out.count() >= 0.8 * n
        docs = out
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {d for r in packed for d in r.doc_ids} == ids


def test_run_decodes_to_texts_of_the_input(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    with open(packing.RANKS, "rb") as f:
        decode = packing._encoding(f.read()).decode
    seen = 0
    for r in corpus_pipeline.run(spark, sf).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            if piece == 0 and ids[b - 1] == packing.END_ID:
                assert decode(ids[a : b - 1].tolist()) == texts[doc]
                seen += 1
    assert seen > 50


def test_near_duplicates_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    group = {r.doc_id: r.group for r in simhash.near_duplicate_groups(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(sets)
    near = found = 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < 0.6 * max(len(x), len(y)):
                assert group[a] != group[b] or len(x) < 30
                continue
            j = len(x & y) / len(x | y)
            if j >= 0.8:
                near += 1
                found += group[a] == group[b]
    assert near > 20 and found >= 0.95 * near
    kept = [r.doc_id for r in simhash.one_of_each_group(docs).collect()]
    assert len(kept) == len(set(kept)) == len(set(group.values()))
    assert set(kept) == {min(d for d in ids if group[d] == g) for g in set(group.values())}


def test_near_copies_of_one_text_and_edges(spark):
    rnd = random.Random(1)
    base = [f"word{rnd.randint(0, 9999)}" for _ in range(400)]
    rows = [(i, " ".join(w if k != 13 * i % 400 else "changed" for k, w in enumerate(base))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "one"), (None, "one"), (104, "quite another text of a few words"), (104, "quite another text of a few words"), (None, "no id"), (105, "x " * 60_000)]
    df = spark.createDataFrame([(*r, "en", "s", 1, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    kept = simhash.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 100, 102, 104, 105, None], key=str)
    tight = {(r.doc_id, r.th): r.group for r in simhash.near_duplicate_groups(df, max_bucket=8).collect()}
    whole = {(r.doc_id, r.th): r.group for r in simhash.near_duplicate_groups(df).collect()}
    assert len(set(tight.values())) == len(set(whole.values()))
    assert simhash.one_of_each_group(df.limit(0)).collect() == []


def test_empty_documents_run_through(spark, tmp_path):
    empty = table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, "/root/testdata/sf0.001", "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
