"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A section ends after an empty line, a paragraph after a line feed, a sentence after . ! or ? with one white space
character. Every mark stays with the piece before it, so the pieces of a level joined are the whole text again,
and the root, a SHA-256 over section digests over paragraph digests over sentence digests, stands for every
character of it. Roots test equality; where they differ, the branches whose digests the other tree lacks locate the
edit: sections first, then paragraphs within those (edited_sections, edited_paragraphs, and edits(), which names them).

Likeness compares two trees by their nodes: twice the different sentences and roots in common, over those of both, so
1 for equal texts alone.

Defined results: a null text counts as empty; the empty text has a fingerprint like any other and likeness 1 to
itself and 0 to others that have sentences; the document after a row is the next by (doc_id, digest of the text),
null ids first, and the first follows the last, so a single document is its own next; rows that repeat an id and a
text are one document in that order and each get its result; branches that repeat count once; edits() compares rows
with equal ids, so none with a null id; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.common import stored


def sections(text: Column) -> Column:
    return F.split(text, r"(?<=\n\n)(?!\n)", -1)


def paragraphs(section: Column) -> Column:
    return F.split(section, r"(?<=\n)", -1)


def sentences(paragraph: Column) -> Column:
    return F.split(paragraph, r"(?<=[.!?][ \t\n])", -1)


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def tree(text: Column) -> Column:
    """The sentence digests: array (sections) of arrays (paragraphs) of arrays (sentences)."""
    leaf = lambda sentence: F.sha2(sentence, 256)
    return F.transform(sections(text), lambda s: F.transform(paragraphs(s), lambda p: F.transform(sentences(p), leaf)))


def branches(leaves: Column) -> Column:
    """The paragraph digests of a tree(): array (sections) of arrays."""
    return F.transform(leaves, lambda section: F.transform(section, _digest))


def section_digests(inner: Column) -> Column:
    """Of branches()."""
    return F.transform(inner, _digest)


def root(leaves: Column) -> Column:
    """Root of a tree()."""
    return _digest(section_digests(branches(leaves)))


#: First 60 bits of the digest of nothing, which pieces after a last mark have.
_NOTHING = 0xE3B0C44298FC1C1


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def nodes(leaves: Column, top: Column) -> Column:
    """What likeness is counted on: the first 60 bits of each different sentence digest and of the root."""
    short = F.transform(F.flatten(F.flatten(leaves)), _short)
    return F.array_distinct(F.concat(F.filter(short, lambda x: x != _NOTHING), F.array(_short(top))))


def likeness(a: Column, b: Column) -> Column:
    """Of two nodes() lists: 1 for equal texts alone."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def edits(docs: DataFrame, other: DataFrame) -> DataFrame:
    """Where docs has what other lacks under the same id: doc_id, section and paragraph, counted from 0, of each branch whose digest the other's tree doesn't have.

    Only documents whose roots differ are taken apart, and of these only the sections that differ.
    """
    trees = lambda d: d.where("doc_id IS NOT NULL").select("doc_id", branches(tree(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("inner"))
    rooted = lambda d: trees(d).withColumn("root", _digest(section_digests(F.col("inner"))))
    mine, theirs = stored(rooted(docs), "trees"), stored(rooted(other), "trees")
    mine = mine.join(theirs.select("doc_id").distinct(), "doc_id", "left_semi").join(theirs.select("doc_id", "root").distinct(), ["doc_id", "root"], "left_anti")
    section = mine.select("doc_id", F.posexplode("inner").alias("section", "s")).withColumn("digest", _digest(F.col("s")))
    there = theirs.select("doc_id", F.explode("inner").alias("s"))
    changed = section.join(there.select("doc_id", _digest(F.col("s")).alias("digest")).distinct(), ["doc_id", "digest"], "left_anti")
    paragraph = changed.select("doc_id", "section", F.posexplode("s").alias("paragraph", "digest"))
    return paragraph.join(there.select("doc_id", F.explode("s").alias("digest")).distinct(), ["doc_id", "digest"], "left_anti").select("doc_id", "section", "paragraph").distinct()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs with fingerprint, the root."""
    return docs.withColumn("fingerprint", root(tree(F.coalesce(F.col("text").cast("string"), F.lit("")))))


KEY = ["k", "th"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key without nulls that stands for both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"))


def followers(rows: DataFrame) -> DataFrame:
    """rows: as of _keyed(). Each key with that of the document before it (p_k, p_th) and half of that one's length.

    Only keys and lengths are sorted, by range; a place in the whole order is the place in the partition plus
    what the partitions before hold.
    """
    narrow = rows.select("k", "th", F.length("text").alias("n")).distinct()
    ordered = stored(narrow.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("row", F.monotonically_increasing_id()), "order")
    ordered = ordered.withColumn("part", F.shiftright("row", 33)).withColumn("row", F.col("row").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(W.orderBy("part"))
    total = F.sum("rows").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    base = stored(counts.select("part", (upto - F.col("rows")).alias("base"), total.alias("total")), "bases")
    placed = ordered.join(base, "part").withColumn("place", F.col("base") + F.col("row"))
    before = placed.select(((F.col("place") + 1) % F.col("total")).alias("place"), *(F.col(c).alias(f"p_{c}") for c in KEY), F.floor(F.col("n") / 2).cast("int").alias("need"))
    return stored(placed.select("place", *KEY).join(before, "place").drop("place"), "followers")


def with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, and of the next document next_id and the nodes of its tree, next_nodes.

    The next document sends only what the edit needs of it, to the one before it, and the digests of its tree.
    Both joins read the texts in the same columns and by the same key, so they are exchanged once.
    """
    rows = _keyed(docs)
    given = rows.join(followers(rows), KEY).select(*(F.col(f"p_{c}").alias(c) for c in KEY), F.col("doc_id").alias("next_id"), F.col("text").substr(F.lit(1), F.col("need")).alias("head"), tree(F.col("text")).alias("leaves"))
    sent = given.select(*KEY, "next_id", "head", nodes(F.col("leaves"), root(F.col("leaves"))).alias("next_nodes")).dropDuplicates(KEY)
    n = F.length("text")
    kept = F.col("text").substr(F.lit(1), n - F.floor(n / 2).cast("int"))
    return rows.join(sent, KEY).select("doc_id", "text", F.concat(kept, "head").alias("edited"), "next_id", "next_nodes")


def op6_merkle(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they have in common."""
    grown = with_edit(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "next_id", "next_nodes", tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"))
    inner = grown.select("*", branches(F.col("a")).alias("pa"), branches(F.col("b")).alias("pb"))
    inner = inner.select("*", section_digests(F.col("pa")).alias("sa"), section_digests(F.col("pb")).alias("sb"))
    rooted = inner.select("*", _digest(F.col("sa")).alias("fingerprint"), _digest(F.col("sb")).alias("edited_fingerprint"))
    own = rooted.select("*", nodes(F.col("a"), F.col("fingerprint")).alias("x"), nodes(F.col("b"), F.col("edited_fingerprint")).alias("y"))
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("x"), F.col("y")).alias("near_edited"),
        likeness(F.col("x"), F.col("next_nodes")).alias("near_next"),
        "next_id",
        F.size(F.array_except("sa", "sb")).alias("edited_sections"),
        F.size(F.array_except(F.flatten("pa"), F.flatten("pb"))).alias("edited_paragraphs"),
    )


_TREE = r"""list_transform(string_split(regexp_replace({t}, '(\n\n+)', '\1' || chr(1), 'g'), chr(1)), lambda s:
  list_transform(string_split(regexp_replace(s, '(\n)', '\1' || chr(1), 'g'), chr(1)), lambda p:
    list_transform(string_split(regexp_replace(p, '([.!?][ \t\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: sha256(x))))"""
_INNER = "list_transform({t}, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ''))))"
_SECTIONS = "list_transform({p}, lambda s: sha256(array_to_string(s, '')))"
_LACKS = "CAST(len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))) AS INTEGER)"
_NODES = "list_distinct(list_append(list_filter(list_transform(flatten(flatten({t})), lambda x: substr(x, 1, 15)), lambda x: x <> 'e3b0c44298fc1c1'), substr({r}, 1, 15)))"
_LIKE = "2 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next,
         coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT doc_id, n, text, next, next_id, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM o),
t AS (SELECT *, {_TREE.format(t='text')} AS a, {_TREE.format(t='edited')} AS b, {_TREE.format(t='next')} AS c FROM e),
i AS (SELECT *, {_INNER.format(t='a')} AS pa, {_INNER.format(t='b')} AS pb, {_INNER.format(t='c')} AS pc FROM t),
j AS (SELECT *, {_SECTIONS.format(p='pa')} AS sa, {_SECTIONS.format(p='pb')} AS sb, {_SECTIONS.format(p='pc')} AS sc FROM i),
r AS (SELECT *, sha256(array_to_string(sa, '')) AS ra, sha256(array_to_string(sb, '')) AS rb, sha256(array_to_string(sc, '')) AS rc FROM j),
s AS (SELECT *, {_NODES.format(t='a', r='ra')} AS x, {_NODES.format(t='b', r='rb')} AS y, {_NODES.format(t='c', r='rc')} AS z FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
       {_LIKE.format(a='x', b='y')} AS near_edited, {_LIKE.format(a='x', b='z')} AS near_next, next_id,
       {_LACKS.format(a='sa', b='sb')} AS edited_sections, {_LACKS.format(a='flatten(pa)', b='flatten(pb)')} AS edited_paragraphs
FROM s
"""
