import zlib
from collections import Counter, defaultdict

from siftspark.llm import sharding
from siftspark.llm.common import stored, table


def check(rows, got, shards=24, tolerance=0.005):
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(held.values()) / shards
    largest = max((r.size for r in got), default=0)
    assert all(abs(held[s] - mean) <= 2 * max(tolerance * mean, largest) for s in range(shards))


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], sharding.op9_sharding(docs).collect())


def test_hot_text_nulls_and_repeats(spark):
    rows = [(i, "the same text over and over") for i in range(3000)] + [(3000 + i, f"text {i} " * (i % 7)) for i in range(3000)]
    rows += [(None, None), (None, None), (1, None), (7000, ""), (7001, "x" * 20_000), (7001, "x" * 20_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    got = sharding.op9_sharding(df).collect()
    check(rows, got)
    shards_of = defaultdict(set)
    for r in got:
        shards_of[r.text_crc32].add(r.shard)
    assert len(shards_of[zlib.crc32(b"the same text over and over")]) < 24
    kept = sharding.sharded(df)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_groups_stay_whole_where_they_fit(spark):
    rows = [(i, f"text number {i // 3}") for i in range(30_000)]
    got = sharding.op9_sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    shards_of = defaultdict(set)
    for r in got:
        shards_of[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards_of.values()) == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, "w " * (i % 50), f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    for part_rows in (1000, 40):
        sharding.write_shards(df, str(tmp_path / f"out{part_rows}"), shards=5, part_rows=part_rows)
        back = spark.read.parquet(str(tmp_path / f"out{part_rows}"))
        assert sorted((r.doc_id, r.text, r._key) for r in back.collect()) == rows
        assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))


def test_slots_of_shards_in_several_parts(spark):
    rows = [(i, f"text {i}") for i in range(3000)]
    keyed = stored(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", sharding.sort_key().alias("key"), sharding.row_bytes().alias("size")), "keys")
    slots = defaultdict(list)
    for r in sharding.places(keyed, shards=4, part_rows=100).collect():
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_equal_in_text_and_id_are_split_too(spark):
    rows = [(7, "one row that comes again")] * 4000 + [(i, f"text {i}") for i in range(2000)]
    check(rows, sharding.op9_sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_no_rows(spark):
    assert sharding.op9_sharding(spark.createDataFrame([], "doc_id long, text string")).collect() == []
