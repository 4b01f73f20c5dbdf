import random

from siftspark.llm import simhash


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def copies(kind, low, high, n=120):
    """(text, copy) of a Jaccard similarity from low to high: cut short, or with a passage added, or with words changed."""
    rnd = random.Random(f"{kind} {low}")
    words = lambda k: [f"{rnd.choice(['of', 'stone', 'branches', 'yesterday'])}{rnd.randint(0, 9999)}" for _ in range(k)]
    out = []
    while len(out) < n:
        a = words(rnd.randint(120, 400))
        share = rnd.uniform(low, high)
        if kind == "cut":
            b = a[: int(len(a) * share)]
        elif kind == "added":
            b = a + words(int(len(a) * (1 / share - 1)))
        else:
            b = [w if rnd.random() > (1 - 2 * share / (1 + share)) / 5 else "changed" for w in a]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if low <= len(x & y) / len(x | y) <= high:
            out.append((" ".join(a), " ".join(b)))
    return out


def linked(spark, pairs, **kw):
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r.doc_id: r.group for r in simhash.near_duplicate_groups(df, **kw).collect()}
    assert len(set(group.values())) >= len(pairs)
    return sum(group[2 * i] == group[2 * i + 1] for i in range(len(pairs))) / len(pairs)


def test_cut_and_extended_copies_link_like_changed_ones(spark):
    for kind in ("cut", "added", "changed"):
        assert linked(spark, copies(kind, 0.83, 0.9)) >= 0.95, kind
        assert linked(spark, copies(kind, 0.8, 0.83)) >= 0.75, kind


def test_pairs_far_apart_stay_apart(spark):
    for kind in ("cut", "added"):
        assert linked(spark, copies(kind, 0.4, 0.6)) <= 0.02, kind


def test_crowded_buckets_link_the_same_texts(spark):
    rnd = random.Random(3)
    base = [f"word{rnd.randint(0, 9999)}" for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(80):  # copies of one text near and far, so that crowded buckets hold several groups
        b = [w if rnd.random() > 0.035 else f"other{rnd.randint(0, 9999)}" for w in base]
        texts.append(" ".join(b[: rnd.randint(230, 300)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def groups(**kw):
        found = {}
        for r in simhash.near_duplicate_groups(df, **kw).collect():
            found.setdefault(r.group, set()).add(r.doc_id)
        return sorted(map(sorted, found.values()))

    whole = groups()
    assert 3 < len(whole) < 81
    for size in (2, 5, 16):
        assert groups(max_bucket=size) == whole
