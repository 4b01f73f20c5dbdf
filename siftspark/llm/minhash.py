"""Near duplicates by an inverted join of MinHash signatures, confirmed on full shingle sets.

A set's signature has KEYS coordinates: the least of its shingles' hashes under each of as many hash functions. A
coordinate and its value are one key, so two sets share as many keys as coordinates agree: of two at Jaccard
similarity 0.8, 51 of 64 on average, and fewer than SHARED (32) once in some fifty million pairs. Pairs above that
threshold are found as follows.

1. Prefix: keys are ordered by how many sets have them, rare ones first. Of two sets that share SHARED keys, the
   first shared one has SHARED - 1 behind it in both, so each set is posted only under the keys before its last
   SHARED - 1. A key of one set needs no posting; a set with fewer than SHARED keys that others have isn't posted
   at all. Posting lists with equal members are one list.
2. Merging: in each list, members sorted by size count collisions of their signatures with those behind them. Skipped
   are members too large to be 0.8 similar and those that are connected already. What is kept
   is a forest, not all pairs; its trees are families. No link leaves a family.
3. Full sets: each text of a family with several sets goes to its family's task once, where links are confirmed on
   whole sets, again without pairs that are connected. A family of more than WEIGHT shingles is dealt out by its
   posting lists instead, and a list of more than that into blocks: links are sought inside the blocks first, then
   the members outside the list's largest component meet its other blocks. So a size changes no result.

Sets that are equal are one throughout, so copies cost nothing beyond their signatures. In lists a signature has one
byte of each key: chance agreements (1 in 256) only add pairs that full sets refuse. Sets are sets of 64-bit hashes.

Defined results: a null text and one without words has an empty set and links with nothing, not even another such;
a text with fewer words than a shingle has one, the whole; rows that repeat link, also with the same id; a null id
takes part, a component whose ids are all null has a null id, and its rows are kept; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import stored
from siftspark.llm.simhash import ROWS, _widened, components, shingle_hashes

WORDS, PERCENT = 2, 80
#: Coordinates of a signature, and how many must agree.
KEYS, SHARED = 64, 32
#: Shingles whose sets a task holds for a family, list or pair of blocks, unless one text has more.
WEIGHT = 3_000_000
#: Members of a posting list that a task holds.
MEMBERS = 40_000
#: Elements of sets looked up at once.
LOOKUPS = 2_000_000


# ---------------------------------------------------------------- signatures


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or b"").lower(), words))


def signature(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys, the coordinate in the upper bits and its least hash in the lower."""
    least = np.full(KEYS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), ROWS):
        least = np.minimum(least, _widened(hashes[at : at + ROWS], KEYS).min(axis=0))
    bits = np.uint64((KEYS - 1).bit_length())
    return (least >> bits) | (np.arange(KEYS, dtype=np.uint64) << (np.uint64(64) - bits))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, node (a hash of the set; null if it is empty) and keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = shingle_set(text.as_py(), words)
                sizes.append(len(hashes))
                nodes.append(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64) if len(hashes) else None)
                keys.append(signature(hashes).view(np.int64) if len(hashes) else None)
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_shingles", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, th long, n_shingles long, node long, keys array<long>")


# ---------------------------------------------------------------- linking inside a bucket


class Forest:
    """Labels of a bucket's members, and the edges that joined them."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def join(self, i: int, linked: np.ndarray) -> None:
        """i is linked with each of `linked`, none of which is in its tree."""
        trees, first = np.unique(self.label[linked], return_index=True)
        self.edges += [(i, j) for j in linked[first].tolist()]
        self.label[np.isin(self.label, trees)] = self.label[i]

    def apart(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Those of lo .. hi - 1 that aren't in i's tree."""
        return lo + np.flatnonzero(self.label[lo:hi] != self.label[i])


def collisions(tags: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """tags: (n, KEYS) bytes. Those of the others that agree with i in SHARED coordinates."""
    return others[(tags[others] == tags[i]).sum(axis=1) >= SHARED] if len(others) else others


def merged(tags: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a forest over the members of one posting list, which come by rising size."""
    forest = Forest(len(tags))
    reach = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i in range(len(tags)):
        if len(near := collisions(tags, i, forest.apart(i, i + 1, reach[i]))):
            forest.join(i, near)
    return forest.edges


def confirmed(sets: list[np.ndarray], tags: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a forest over sets that come by rising size; each edge joins two that are similar enough."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(flat.max()) + 1, bool)
    forest = Forest(len(sets))
    reach = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for i in range(len(sets)):
        near = collisions(tags, i, forest.apart(i, i + 1, reach[i]))
        if not len(near):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        linked = []
        ends = np.cumsum(sizes[near])
        for part in np.split(near, np.searchsorted(ends, np.arange(LOOKUPS, ends[-1], LOOKUPS))):
            if len(part):
                n = sizes[part]
                before = np.cumsum(n) - n
                both = np.add.reduceat(mark[flat[np.repeat(starts[part] - before, n) + np.arange(n.sum())]].astype(np.int64), before)
                linked.append(part[100 * both >= percent * (sizes[i] + n - both)])
        mark[own] = False
        if len(linked := np.concatenate(linked)):
            forest.join(i, linked)
    return forest.edges


def _by_bucket(rows: DataFrame, link, columns: list[str]) -> DataFrame:
    """rows with bucket and node. Edges (a, b), a > b, that link() finds among each bucket's rows; a node's repeats count once."""

    def found(bucket: pa.Table) -> list[tuple[int, int]]:
        nodes, first = np.unique(bucket.column("node").to_numpy(), return_index=True)
        if len(nodes) < 2:
            return []
        return [(max(a, b), min(a, b)) for a, b in link(bucket.take(pa.array(first)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number = [], None
        for batch in batches:  # sorted by bucket: what stands before the last bucket of a batch is whole
            at = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1)) if len(at) else []
            edges = []
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                if open_ and at[a] != number:
                    edges += found(pa.Table.from_batches(open_))
                    open_ = []
                open_.append(batch.slice(a, b - a))
                number = at[a]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])
        if open_ and (edges := found(pa.Table.from_batches(open_))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

    return rows.select("bucket", "node", *columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def _tags(bucket: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(bucket.column("tags").to_pylist()), np.uint8).reshape(-1, KEYS)


def list_edges(rows: DataFrame, percent: int) -> DataFrame:
    """rows: bucket, node, n_shingles, tags."""

    def link(bucket: pa.Table) -> list[tuple[int, int]]:
        bucket = bucket.take(pa.array(np.argsort(bucket.column("n_shingles").to_numpy(), kind="stable")))
        node = bucket.column("node").to_pylist()
        return [(node[i], node[j]) for i, j in merged(_tags(bucket), bucket.column("n_shingles").to_numpy(), percent)]

    return _by_bucket(rows, link, ["n_shingles", "tags"])


def set_edges(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows: bucket, node, text, tags."""

    def link(bucket: pa.Table) -> list[tuple[int, int]]:
        sets = [shingle_set(t.as_py(), words) for t in bucket.column("text").cast(pa.binary())]
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        node = bucket.column("node").take(pa.array(order)).to_pylist()
        return [(node[i], node[j]) for i, j in confirmed([sets[i] for i in order], _tags(bucket)[order], percent)]

    return _by_bucket(rows, link, ["text", "tags"])


# ---------------------------------------------------------------- lists, families, blocks


def posting_lists(sets: DataFrame) -> DataFrame:
    """sets: node, keys. key and node of each set under the keys of its prefix; lists of one set and equal lists are left out."""
    posts = sets.select("node", F.explode("keys").alias("key"))
    counts = stored(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    known = posts.join(counts, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("known"))  # KEYS at most
    prefix = F.slice("known", F.lit(1), F.size("known") - (SHARED - 1))
    lists = stored(known.where(F.size("known") >= SHARED).select("node", F.explode(prefix).alias("k")).select("k.key", "node"), "posting-lists")
    members = lists.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor("node").alias("x")).where("n > 1")
    one_of_equal = stored(members.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"), "different-lists")
    return stored(lists.join(one_of_equal, "key"), "lists")


def _blocks(meeting: DataFrame, most: int, edges_of) -> DataFrame:
    """meeting: bucket, node, w. Edges of all buckets; edges_of() gives those of rows (bucket, node).

    A bucket over `most` in weight is cut into blocks. Links are sought inside the blocks; where a bucket then still
    has several components, the rows outside its largest one meet every other block.
    """
    weight = stored(meeting.groupBy("bucket").agg(F.sum("w").alias("weight")).where(F.col("weight") > most), "crowded-buckets")
    if weight.isEmpty():
        return edges_of(meeting.select("bucket", "node"))
    half = max(1, most // 2)
    meeting = stored(meeting.join(weight, "bucket", "left"), "meeting")
    own = F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("weight") / half)))
    edges = stored(edges_of(meeting.select("node", F.when(F.col("weight").isNull(), F.col("bucket")).otherwise(own).alias("bucket"))), "inner-links")
    crowded = meeting.where("weight IS NOT NULL").join(components(edges), "node", "left").select("bucket", "node", "w", F.coalesce("root", "node").alias("root"))
    crowded = stored(crowded, "crowded")
    trees = crowded.groupBy("bucket", "root").agg(F.sum("w").alias("w"))
    split = trees.groupBy("bucket").agg(F.max(F.struct("w", "root")).alias("main"), F.sum("w").alias("all")).where("`all` > main.w")
    split = stored(split.select("bucket", F.col("main.root").alias("main"), F.ceil(F.col("main.w") / half).alias("mains"), F.ceil((F.col("all") - F.col("main.w")) / half).alias("others")), "split-buckets")
    block = F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")))
    rows = crowded.join(split, "bucket").withColumn("own", block)
    rows = rows.withColumn("from", F.when(F.col("own") < F.col("mains"), F.col("mains")).otherwise(F.lit(0).cast("long")))
    rows = rows.select("bucket", "node", "own", F.explode(F.sequence("from", F.col("mains") + F.col("others") - 1)).alias("with")).where("own <> with")
    return edges.unionByName(edges_of(rows.select(F.xxhash64("bucket", F.least("own", "with"), F.greatest("own", "with")).alias("bucket"), "node")))


def links(docs: DataFrame, made: DataFrame, words: int = WORDS, percent: int = PERCENT, weight: int = WEIGHT, members: int = MEMBERS) -> DataFrame:
    """docs and their sketches. Edges (a, b) between nodes that connect whatever sets are similar enough."""
    tags = F.unhex(F.concat_ws("", F.transform("keys", lambda k: F.lpad(F.hex(k.bitwiseAND(255)), 2, "0"))))
    row = F.min(F.struct("th", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("row")
    sets = made.where(F.col("node").isNotNull()).groupBy("node").agg(row, F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    sets = stored(sets.select("node", "row.*", "n_shingles", "keys", tags.alias("tags")), "sets")
    lists = posting_lists(sets)
    short = sets.select("node", "n_shingles", "tags")
    near = _blocks(lists.select(F.col("key").alias("bucket"), "node", F.lit(1).alias("w")), members, lambda rows: list_edges(rows.join(short, "node"), percent))
    family = components(stored(near, "list-links"))
    family = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct()).distinct()
    placed = stored(family.join(sets.drop("keys"), "node"), "families")
    text = docs.select(F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("doc_id").cast("long").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("text").cast("string"))
    large = stored(placed.groupBy("root").agg(F.sum("n_shingles").alias("w")).where(F.col("w") > weight).select("root"), "large-families")
    meeting = placed.select(F.col("root").alias("bucket"), "node", F.col("n_shingles").alias("w"))
    if not large.isEmpty():
        listed = lists.join(placed.join(large, "root", "left_semi").select("node", F.col("n_shingles").alias("w")), "node").select(F.col("key").alias("bucket"), "node", "w")
        meeting = placed.join(large, "root", "left_anti").select(F.col("root").alias("bucket"), "node", F.col("n_shingles").alias("w")).unionByName(listed)
    at = placed.select("node", "th", "none", "id", "tags")
    return _blocks(meeting, weight, lambda rows: set_edges(rows.join(at, "node").join(text, ["th", "none", "id"]), words, percent))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, weight: int = WEIGHT, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept of every row."""
    made = stored(sketches(docs, words), "sketches")
    roots = components(links(docs, made, words, percent, weight, members))
    least = made.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = stored(least.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "root").select("node", "component_id")
    with_words = made.where(F.col("node").isNotNull()).select("doc_id", "n_shingles", "node").join(placed, "node").select("doc_id", "n_shingles", "component_id")
    rest = made.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(docs: DataFrame) -> DataFrame:
    """Components of all documents at a similarity of 0.8 of their sets of two-word shingles."""
    return near_duplicates(docs)


OP13_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS MATERIALIZED (
    SELECT r, doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sized AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM sets),
one_of_equal AS MATERIALIZED (SELECT min(r) AS r, len(s) AS n, s FROM (SELECT r, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
shingles AS MATERIALIZED (SELECT r, n, unnest(s) AS x FROM one_of_equal),
linked AS MATERIALIZED (
    SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
equal AS MATERIALIZED (SELECT o.r AS a, s.r AS b FROM one_of_equal o JOIN (SELECT r, list_sort(s) AS s FROM sets WHERE len(s) > 0) s ON s.s = o.s),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION SELECT b, a FROM linked UNION SELECT a, b FROM equal UNION SELECT b, a FROM equal),
reach(r, t) AS (SELECT r, r FROM sized UNION SELECT reach.r, e.b FROM reach JOIN edges e ON e.a = reach.t)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM reach JOIN sized s ON s.r = reach.r JOIN sized o ON o.r = reach.t GROUP BY s.r, s.doc_id, s.n
"""
