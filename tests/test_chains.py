from siftspark.operators import graph


def test_long_chains_end_and_circles_do_not(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)]
    got = graph.chain_ends(spark.createDataFrame(rows, "name int, target int"))
    assert sorted((r.name, r.terminal, r.steps) for r in got.collect()) == [(i, 300, 300 - i) for i in range(300)]
    assert graph.chain_ends(spark.createDataFrame([], "name int, target int")).collect() == []
