import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from siftspark.llm import merkle
from siftspark.llm.common import table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def pieces(text, mark):
    """text cut after each match of mark."""
    ends = [m.end() for m in re.finditer(mark, text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def grown(text):
    tree = [[[sha(x) for x in pieces(p, r"[.!?][ \t\n]")] for p in pieces(s, r"\n")] for s in pieces(text, r"\n\n+")]
    inner = [[sha("".join(p)) for p in s] for s in tree]
    sections = [sha("".join(s)) for s in inner]
    top = sha("".join(sections))
    return top, {x[:15] for s in tree for p in s for x in p if x != sha("")} | {top[:15]}, set(sections), {p for s in inner for p in s}


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (d, t), (e, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        (a, x, sa, pa), (b, y, sb, pb), (_, z, _, _) = grown(t), grown(edited), grown(nxt)
        like = lambda p, q: 2 * len(p & q) / (len(p) + len(q))
        out.append((d, len(t), sha(edited), a, b, like(x, y), like(x, z), e, len(sa - sb), len(pa - pb)))
    return Counter(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, n string")
    return Counter(tuple(r) for r in merkle.op6_merkle(df).collect())


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in merkle.op6_merkle(docs.repartition(5)).collect()) == brute(rows)


def test_edges(spark):
    rows = [(None, "x. y"), (3, None), (5, ""), (7, "A b. C d! E?\nF.\n\n\n\nG h.\n"), (8, "\x01a. \x01b"), (9, "𝒳é" * 9 + ". z"), (10, "One two. " * 20_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, "alone. text")]) == brute([(1, "alone. text")])
    assert found(spark, []) == Counter()


def test_repeated_rows_keep_their_number(spark):
    rows = [(1, "a. b. c."), (1, "a. b. c."), (1, "other"), (2, "z")]
    got = merkle.op6_merkle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, grown(t)[0]) for d, t in rows)


def test_edits_are_located(spark):
    a = "A one. Two.\nLine two.\n\nSecond. Part.\nEnd."
    old = spark.createDataFrame([(1, a), (2, a), (3, a)], "doc_id long, text string")
    new = spark.createDataFrame([(1, a), (2, a.replace("Part", "port")), (3, a + "\n\nMore.")], "doc_id long, text string")
    assert sorted(map(tuple, merkle.edits(old, new).collect())) == [(2, 1, 0), (3, 1, 1)]
    assert sorted(map(tuple, merkle.edits(new, old).collect())) == [(2, 1, 0), (3, 1, 1), (3, 2, 0)]
    roots = [r.fingerprint for r in merkle.fingerprinted(new).orderBy("doc_id").collect()]
    assert roots[0] == merkle.fingerprinted(old).where(F.col("doc_id") == 1).first().fingerprint and len(set(roots)) == 3


def test_an_inserted_section_marks_itself_alone(spark):
    parts = [f"Section {i}. Text.\nMore of {i}.\n\n" for i in range(6)]
    old = spark.createDataFrame([(1, "".join(parts)), (None, "a"), (4, "only here")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "".join([*parts[:2], "New one.\n\n", *parts[2:]])), (None, "b"), (5, "only there")], "doc_id long, text string")
    assert sorted(map(tuple, merkle.edits(new, old).collect())) == [(1, 2, 0)]
    assert merkle.edits(old, new).collect() == []


def test_pieces_keep_every_character(spark):
    text = "\x01a. \x01b\n\x01\n\nc! d"
    row = spark.createDataFrame([(text,)], "text string").select(merkle.sections(F.col("text")).alias("s"), merkle.sentences(F.col("text")).alias("x")).first()
    assert "".join(row.s) == text == "".join(row.x)
