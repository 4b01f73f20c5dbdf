"""SimHash fingerprints and a Gray-order hierarchical index over them.

Fingerprints that lie close in Hamming space often share long runs of bits when sorted by Gray rank. The
index sorts the fingerprints of a bucket by that rank, gathers FANOUT neighbours at a time into a node that
keeps the bits its members share (a mask and a pattern), and repeats this upward. A search starts at the top
and adds, level by level, the differing bits among those the node has fixed and its parent has not: once the
sum passes the radius, the whole group below is left out.

Buckets make the work spread: with radius r, two fingerprints within r bits agree in at least one of r + 1
blocks of bits, so each fingerprint goes to one bucket for each block and no link is lost. A bucket over
MAX_BUCKET rows is dealt out again by blocks of its remaining bits, under the same law. Near duplicates by
similarity have no such law: their crowded buckets are cut into blocks that all meet (near_links).

Only distinct fingerprints are indexed; links become components in Spark by alternating star contraction.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; rows that repeat, also with the same id, share a component; a null id takes part, and a component
whose ids are all null has a null id; an empty table gives an empty result; further columns of the input are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import stored

FANOUT = 8
MAX_BUCKET = 20_000
SEED = 42
#: Words of codes of the pairs of (query, node) looked at together; bounds memory.
FRONTIER = 1_000_000
FRONTIER_WORDS = 4_000_000
#: Hashes of shingles taken at once; bounds memory.
ROWS = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words; of the whole sequence if there are fewer; none without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(b" ".join(tokens), SEED)], np.uint64)
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    return np.array([h(flat[a:b], SEED) for a, b in spans], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """hashes: (n, k) unsigned. In how many rows each bit is set."""
    n, k = hashes.shape
    data = hashes.astype(">u8").view(np.uint8).reshape(n, 8 * k)
    counts = np.bincount((data + np.arange(8 * k, dtype=np.int64) * 256).ravel(), minlength=2048 * k).reshape(8 * k, 256)
    return counts @ _BITS


def majority_bits(hashes: np.ndarray, words: int = 1) -> bytes:
    """A bit for each of 64 * words is 1 if set in over half of the hashes, widened to so many words. Big-endian bytes.

    Hashes are taken ROWS at a time, so that long texts need no more memory than short ones.
    """
    if not len(hashes):
        return bytes(8 * words)
    counts = sum(bit_counts(part.reshape(-1, 1) if words == 1 else _widened(part, words)) for part in (hashes[i : i + ROWS] for i in range(0, len(hashes), ROWS)))
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint of the text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = b"".join(majority_bits(shingle_hashes(t.as_py(), words)) for t in texts)
            codes = np.frombuffer(prints, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(codes)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """codes: (n, k) unsigned, most significant word first. Their places in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for i in range(1, rank.shape[1]):  # the last bit of a word carries into the next
        rank[:, i] ^= np.where(rank[:, i - 1] & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return rank


def distance(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count(x if mask is None else x & mask).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Forest over codes that come sorted by (bucket, Gray rank): one tree for each bucket.

    levels[0] has the codes themselves; a node of levels[l] has the children first[l][i] .. first[l][i + 1] - 1
    below it. pattern and own are what it fixes: own holds the bits that its members share and that its parent
    doesn't already account for.
    """

    def __init__(self, buckets: np.ndarray, codes: np.ndarray) -> None:
        self.codes = codes
        bucket, pattern, unlike = buckets, codes, np.zeros_like(codes)
        self.first, self.patterns, masks = [], [pattern], [~unlike]
        while True:
            new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            start = np.flatnonzero(new)
            place = np.arange(len(bucket)) - np.repeat(start, np.diff(np.append(start, len(bucket))))
            if self.first and len(start) == len(bucket):
                break
            start = np.flatnonzero(place % FANOUT == 0)
            sizes = np.diff(np.append(start, len(bucket)))
            unlike = np.bitwise_or.reduceat(unlike | (pattern ^ np.repeat(pattern[start], sizes, axis=0)), start, axis=0)
            bucket, pattern = bucket[start], pattern[start]
            self.first.append(np.append(start, len(place)))
            self.patterns.append(pattern)
            masks.append(~unlike)
        self.own = [masks[-1]]
        for low in range(len(masks) - 2, -1, -1):
            parents = np.repeat(np.arange(len(masks[low + 1])), np.diff(self.first[low]))
            self.own.insert(0, masks[low] & ~masks[low + 1][parents])
        self.roots = np.repeat(np.arange(len(bucket)), np.diff(self._leaves(len(bucket))))
        self.last = [np.arange(len(codes))]
        for first in self.first:
            self.last.append(self.last[-1][first[1:] - 1])

    def _leaves(self, tops: int) -> np.ndarray:
        ends = np.arange(tops + 1)
        for first in reversed(self.first):
            ends = first[ends]
        return ends

    def later(self, queries: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code after it in the order) of one bucket within the radius, without groups that are wholly in the query's component."""
        top = len(self.patterns) - 1
        low, high = [label], [label]
        for first in self.first:
            low.append(np.minimum.reduceat(low[-1], first[:-1]))
            high.append(np.maximum.reduceat(high[-1], first[:-1]))
        q, node, sofar = queries, self.roots[queries], np.zeros(len(queries), np.int64)
        for level in range(top, -1, -1):
            sofar = sofar + distance(self.codes[q], self.patterns[level][node], self.own[level][node])
            keep = (sofar <= radius) & (self.last[level][node] > q) & ~((low[level][node] == high[level][node]) & (low[level][node] == label[q]))
            q, node, sofar = q[keep], node[keep], sofar[keep]
            if level:
                first = self.first[level - 1]
                n = first[node + 1] - first[node]
                before = np.cumsum(n) - n
                node = np.repeat(first[node] - before, n) + np.arange(n.sum())
                q, sofar = np.repeat(q, n), np.repeat(sofar, n)
        return q, node


def link_codes(buckets: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (member, root) that connect whatever codes of one bucket lie within the radius, directly or by way of others."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = gray_rank(codes)
    order = np.lexsort((*rank.T[::-1], buckets))
    buckets, codes = buckets[order], codes[order]
    index, label = GrayIndex(buckets, codes), np.arange(len(codes))
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    sizes = np.diff(np.append(starts, len(codes)))
    work = np.cumsum(np.repeat(sizes, sizes))
    alone = np.repeat(sizes == 1, sizes)
    most = min(FRONTIER, FRONTIER_WORDS // codes.shape[1])
    for part in np.split(np.arange(len(codes)), np.searchsorted(work, np.arange(most, work[-1], most))):
        a, b = index.later(part[~alone[part]], radius, label)
        while len(a):
            la, lb = label[a], label[b]
            if not (unlike := la != lb).any():
                break
            np.minimum.at(label, np.maximum(la, lb)[unlike], np.minimum(la, lb)[unlike])
            while ((up := label[label]) != label).any():
                label = up
    member = np.flatnonzero(label != np.arange(len(label)))
    return order[member], order[label[member]]


# ---------------------------------------------------------------- distributed links


def dealt(rows: DataFrame, width: int, parts: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """rows: bucket long, rest long (width bits not yet used), and more. Buckets over max_bucket rows are dealt out again by `parts` blocks of the rest, until none is left or no bits are."""
    done = None
    while width >= parts:
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("bucket")
        if sizes.isEmpty():
            break
        sizes = stored(sizes, "hot-buckets")
        calm = rows.join(sizes, "bucket", "left_anti")
        done = calm if done is None else done.unionByName(calm)
        edge = [width * i // parts for i in range(parts + 1)]
        block = [
            F.struct(
                F.xxhash64("bucket", F.lit(lo), F.col("rest").bitwiseAND((1 << hi) - (1 << lo))).alias("bucket"),
                F.shiftleft(F.shiftrightunsigned("rest", hi), lo).bitwiseOR(F.col("rest").bitwiseAND((1 << lo) - 1)).alias("rest"),
            )
            for lo, hi in zip(edge, edge[1:])
        ]
        others = [c for c in rows.columns if c not in ("bucket", "rest")]
        rows = rows.join(sizes, "bucket", "left_semi").select(*others, F.explode(F.array(*block)).alias("b")).select("b.bucket", "b.rest", *others)
        width -= max(hi - lo for lo, hi in zip(edge, edge[1:]))
    return rows if done is None else done.unionByName(rows)


def bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """rows: bucket long, node long, code binary. Edges (a, b) between nodes, a > b, that connect each bucket's codes within the radius."""

    def links(buckets: list, nodes: list, codes: list) -> pa.RecordBatch:
        bucket, node = np.concatenate(buckets), np.concatenate(nodes)
        raw = b"".join(codes)
        code = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(node), -1) if len(node) else np.empty((0, 1), np.uint64)
        m, r = link_codes(bucket, code, radius)
        a, b = np.maximum(node[m], node[r]), np.minimum(node[m], node[r])
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, nodes, codes, held = [], [], [], 0
        for batch in batches:  # sorted by bucket: all but the last bucket are whole and can go
            bucket = batch.column("bucket").to_numpy()
            node, code = batch.column("node").to_numpy(), batch.column("code").to_pylist()
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if held + cut > 4 * MAX_BUCKET and (cut or buckets and bucket[0] != buckets[-1][-1]):
                yield links([*buckets, bucket[:cut]], [*nodes, node[:cut]], [*codes, *code[:cut]])
                bucket, node, code, buckets, nodes, codes, held = bucket[cut:], node[cut:], code[cut:], [], [], [], 0
            buckets.append(bucket)
            nodes.append(node)
            codes.extend(code)
            held += len(bucket)
        if buckets:
            yield links(buckets, nodes, codes)

    dealt_out = rows.select("bucket", "node", "code").repartition("bucket").sortWithinPartitions("bucket")
    return dealt_out.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. node and root, the smallest node it is connected with, for each node with an edge.

    Alternating stars: each round joins every node's neighbours to its smallest one; rounds grow with the
    logarithm of the longest chain. The smallest neighbour is an aggregate with map-side combine, stored before it
    comes back by a join: both sides are then plain tables, and Spark splits the rows of a node with very many.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def hamming_components(docs: DataFrame, words: int = 3, radius: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links of at most `radius` bits) of every row."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = radius + 1
    edge = [64 * i // parts for i in range(parts + 1)]
    mask = lambda n: F.lit((1 << n) - 1 if n < 63 else (1 << 63) - 1)
    blocks = F.array(
        *[
            F.struct(
                F.xxhash64(F.lit(i), F.shiftrightunsigned("fp", lo).bitwiseAND(mask(hi - lo))).alias("bucket"),
                (F.shiftleft(F.shiftrightunsigned("fp", hi), lo) if hi < 64 else F.lit(0).cast("long")).bitwiseOR(F.col("fp").bitwiseAND(mask(lo))).alias("rest"),
            )
            for i, (lo, hi) in enumerate(zip(edge, edge[1:]))
        ]
    )
    rows = distinct.select("fp", F.explode(blocks).alias("b")).select("b.bucket", "b.rest", F.col("fp").alias("node"))
    rows = dealt(rows, edge[-1] - max(hi - lo for lo, hi in zip(edge, edge[1:])), parts, max_bucket)
    edges = bucket_links(rows.withColumn("code", F.unhex(F.lpad(F.hex("node"), 16, "0"))), radius)
    roots = components(edges).withColumnRenamed("node", "fp")
    placed = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint as 16 hex digits, and component, of every document."""
    return hamming_components(docs, words=3, radius=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near duplicates by similarity

#: 64-bit words of the fingerprint that decides. A wide one tells similarities apart: about 11 bits of 1024 are its spread.
CODE_WORDS = 16
#: Candidates agree in one of BANDS bands of BAND_ROWS minima each: all but 0.003 % of pairs at Jaccard 0.8.
BANDS, BAND_ROWS = 20, 4
#: Spreads added to the expected distance at the similarity asked for, to keep links that chance puts beyond it.
SLACK = 1.6


def _widened(hashes: np.ndarray, k: int) -> np.ndarray:
    """k hashes for each."""
    x = hashes[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def allowed_bits(similarity: float, bits: int = 64 * CODE_WORDS) -> int:
    """Differing bits up to which two texts link: expected for sets of that Jaccard similarity and equal size, plus SLACK spreads."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + SLACK * (bits * share * (1 - share)) ** 0.5)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """hashes of a set of shingles. A signed 64-bit key for each band of MinHash values; equal for empty sets."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), ROWS):
        least = np.minimum(least, _widened(hashes[at : at + ROWS], BANDS * BAND_ROWS // 2).view(np.uint32).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, -1))], np.uint64).view(np.int64)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """rows: doc_id, th, text. code and bands (both of the set of shingles) of each text, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bands = [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = np.unique(shingle_hashes((text.as_py() or b"").lower(), words))
                codes.append(majority_bits(hashes, CODE_WORDS))
                bands.append(band_keys(hashes))
            lists = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(codes, pa.binary()), lists], ["doc_id", "th", "code", "bands"])

    return rows.mapInArrow(run, "doc_id long, th long, code binary, bands array<long>")


def near_links(meeting: DataFrame, codes: DataFrame, shared: DataFrame, radius: int, max_bucket: int) -> DataFrame:
    """meeting: bucket, n (its rows), node; codes: node, code; shared: bucket, n. Edges that connect each bucket's codes within the radius.

    A bucket over max_bucket rows is cut into blocks without a condition on what meets. Links are first sought
    inside the blocks, which are others in each bucket. Where a bucket then still has several components, the rows
    outside its largest one meet every block: pairs of one component need no link, so no pair that does is left out.
    """
    if shared.where(F.col("n") > max_bucket).isEmpty():
        return bucket_links(meeting.join(codes, "node"), radius)
    half = max(1, max_bucket // 2)
    block = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.ceil(n / half))
    meeting = stored(meeting, "meeting")
    inside = F.when(F.col("n") > max_bucket, F.xxhash64("bucket", block(F.col("n")))).otherwise(F.col("bucket"))
    edges = stored(bucket_links(meeting.select("node", inside.alias("bucket")).join(codes, "node"), radius), "inner-links")
    crowded = meeting.where(F.col("n") > max_bucket).select("bucket", "node").join(components(edges), "node", "left")
    crowded = stored(crowded.select("bucket", "node", F.coalesce("root", "node").alias("root")), "crowded")
    held = crowded.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    split = held.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n")).where("n > main.m")
    split = stored(split.select("bucket", F.col("main.root").alias("main"), F.ceil(F.col("main.m") / half).alias("mains"), F.ceil((F.col("n") - F.col("main.m")) / half).alias("others")), "split-buckets")
    rows = crowded.join(split, "bucket")
    own = F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")))
    # blocks of the largest component come first, and meet only the others
    rows = rows.withColumn("own", own).withColumn("from", F.when(F.col("own") < F.col("mains"), F.col("mains")).otherwise(F.lit(0).cast("long")))
    rows = rows.select("bucket", "node", "own", F.explode(F.sequence("from", F.col("mains") + F.col("others") - 1)).alias("with")).where("own <> with")
    pairs = rows.select(F.xxhash64("bucket", F.least("own", "with"), F.greatest("own", "with")).alias("bucket"), "node")
    return edges.unionByName(bucket_links(pairs.join(codes, "node"), radius))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, th (a hash of the text), and group of every row; equal groups are texts linked by their fingerprints.

    Fingerprints that may differ in many bits have no block in common to be found by, so candidates share a band
    of MinHash values of their shingles, which finds them by their similarity whatever the edit. The Gray-order
    index of each bucket then links codes within allowed_bits(similarity). Only buckets that several codes share
    get the codes.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    made = stored(sketches(rows, words).withColumn("node", F.xxhash64("code", "bands")), "sketches")
    distinct = stored(made.select("node", "code", "bands").dropDuplicates(["node"]), "codes")
    spread = distinct.select("node", F.explode("bands").alias("bucket"))
    shared = stored(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    meeting = spread.join(shared, "bucket")
    edges = near_links(meeting, distinct.select("node", "code"), shared, allowed_bits(similarity), max_bucket)
    return made.select("doc_id", "th", "node").join(components(edges), "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("group"))


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, null ids last."""
    groups = near_duplicate_groups(docs, words, similarity)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    keep = stored(first.select(F.col("f.none").alias("_none"), F.coalesce("f.doc_id", F.lit(0)).alias("_id"), F.col("f.th").alias("_th")), "kept")
    own = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.isNull().alias("_none"), F.coalesce(own, F.lit(0)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"))
    kept = rows.join(keep, ["_none", "_id", "_th"], "left_semi").dropDuplicates(["_none", "_id", "_th"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
