from siftspark.llm import mixing


def test_rows_without_an_id_or_with_one_id_do_not_win_together(spark):
    rows = [(i, f"own {i} " * (1 + i % 7), "a") for i in range(300)]
    rows += [(None, f"none {i} " * (1 + i % 7), "a") for i in range(300)]
    rows += [(7_000, f"same {i} " * (1 + i % 7), "b") for i in range(200)] + [(None, f"last {i}", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target, taken = {}, {}
    for r in mixing.op5_mixing(df).collect():
        target[r.source_size] = r.target
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert len(target) == 3
    for s, want in target.items():
        assert abs(taken[s] - want) <= 21
    mix = mixing.mixed(df)
    assert sum(len(r.text.split()) for r in mix.collect()) == sum(taken.values())
