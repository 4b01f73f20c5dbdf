from itertools import combinations
from math import ceil

import pytest

from siftspark.llm import decontamination as dc


def fits(mask, gone, n):
    return any(all(a + o not in gone for o, c in enumerate(mask) if c == "1") for a in range(n - len(mask) + 1))


def test_masks_fit_between_any_substitutions():
    for n in range(1, dc.WINDOW + 1):
        masks = dc.MASKS if n == dc.WINDOW else (dc.surviving_run(n),)
        for gone in combinations(range(n), n - ceil(n * 8 / 10)):
            assert any(fits(m, gone, n) for m in masks), (n, gone)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 8, 9, 10, 12, 13])
def test_every_placement_of_allowed_substitutions_is_found(spark, n):
    most = n - ceil(n * 8 / 10)
    item = [f"w{k}" for k in range(n)]
    docs = [(i, " ".join(["before", *(f"x{k}" if k in gone else w for k, w in enumerate(item)), "after"])) for i, gone in enumerate(combinations(range(n), most))]
    lost = [(1000 + i, " ".join(f"x{k}" if k in gone else w for k, w in enumerate(item))) for i, gone in enumerate(combinations(range(n), most + 1))]
    d = spark.createDataFrame(docs + lost, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"other{k}" for k in range(40)))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_words, r.matched, r.windows) for r in dc.overlaps(d, b).collect())
    assert got == [(i, 1, n, n - most, 1) for i, _ in docs]
