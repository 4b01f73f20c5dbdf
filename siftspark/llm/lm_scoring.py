"""Language-model scores by a weighted backoff automaton over word n-grams.

The model counts every n-gram up to ORDER of the training documents; none is left out. A state is an n-gram that
occurred (or the empty one); from each there is an arc for every word that followed, and a failure arc to the
state without its first word. A text is read from left to right in one traversal: take the arc of the next word if
there is one, else add the failure arc's weight, fall back, and try again. The weights are smoothed by
interpolation: with c counts and h the state,

    P(w | h) = (c(h w) + MU * P(w | h without its first word)) / (c(h) + MU), with a MU for each length of h,

on an arc, and log10(MU / (c(h) + MU)) on the failure arc. At the empty state a known word has
(c - D) / N and all unknown words together D * V / N, with D = n1 / (n1 + 2 * max(n2, 1)) from the words seen once and
twice. Each sums to one over the vocabulary and one unknown word, as the base score does.

No task holds the whole automaton. Documents are dealt into blocks of about BLOCK_BYTES. A block sends the hashes of
its different n-grams, sorted and packed for each bucket, with how often its training documents have them; a bucket
adds up all blocks and answers each one in its own order with counts alone. The block then has all arcs that its
documents can meet, and traverses them. What travels grows with the corpus: there are as many buckets as blocks, a
bucket has a range of hashes, and a block sends it one row for all orders, and only if it has keys for it, so rows
are never more than n-grams. N, V, n1 and n2 are one row. Words have hashes of 64 bits; longer n-grams have so many
that at most one absent n-gram in 2 ** SPARE_BITS is taken for one that is there.

Rows with equal id and text that would overfill a block together are dealt out by their places in the input, which
is written to the shared folder first.

Tokens: A-Z lower-cased, words, and one end for each text.

Defined results: a null text is the empty one, which has the end alone; without training documents every score is
0; a null id belongs to no fold, so it trains; rows that repeat count and are scored each; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import KNOWN_WORDS, WordHashes, fold, stored

ORDER = 3
#: For states of one word, of two, and of more; chosen on held-out text.
MU = (1000.0, 20.0)
BLOCK_BYTES = 8_000_000
#: Bits of a hash beyond those that count the bytes of the corpus.
SPARE_BITS = 16
LEAST_BITS = 48
#: The end of a text; no word holds a line feed.
END = xxhash.xxh64_intdigest(b"\n")


# ---------------------------------------------------------------- what a block knows


class Block:
    """The n-grams of a block of documents: `keys` are the different ones, one list for each order; `at` finds each position's."""

    def __init__(self, texts: pa.ChunkedArray, order: int, bits: int = 64) -> None:
        hashes, words, ends = WordHashes(), [], []
        for text in texts.cast(pa.binary()):
            tokens = (text.as_py() or b"").lower().split()
            if len(hashes) > KNOWN_WORDS:
                hashes.clear()
            words.append(np.array([hashes[t] for t in tokens] + [END], np.uint64))
        self.ends = np.cumsum([len(w) for w in words])
        grams = np.concatenate(words)
        place = np.arange(len(grams)) - np.repeat(self.ends - [len(w) for w in words], [len(w) for w in words])
        self.keys, self.at = [], []
        gram = grams
        for k in range(order):
            if k:
                gram = np.concatenate(([np.uint64(0)], gram[:-1] * np.uint64(0x9E3779B97F4A7C15))) ^ grams
                gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                gram ^= gram >> np.uint64(32)
            kept = gram[place >= k]
            keys, at = np.unique(kept if k == 0 else kept & ~np.uint64((1 << 64 - bits) - 1), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            ends.append(place >= k)
        self.whole = ends

    def trained(self, train: np.ndarray) -> list[np.ndarray]:
        """How often the training documents have each key."""
        weight = np.repeat(train, np.diff(np.concatenate(([0], self.ends))))
        return [np.bincount(at, weight[whole], len(keys)).astype(np.uint32) for keys, at, whole in zip(self.keys, self.at, self.whole)]


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, so that what is small in sorted keys' steps and in counts is squeezed out."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys, and the end: a bucket has a range of the upper half of the hash."""
    firsts = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


_ASKS = "bucket int, block int, sizes array<int>, keys binary, counts binary"
_ANSWERS = "block int, bucket int, totals binary, n long, v long, n1 long, n2 long"
_ANSWER_TYPES = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)


def _asker(order: int, buckets: int, bits: int):
    def ask(group: pa.Table) -> pa.Table:
        block, number = Block(group.column("text"), order, bits), group.column("block")[0].as_py()
        counts = block.trained(group.column("train").to_numpy())
        edges = [_edges(keys, buckets) for keys in block.keys]
        # steps between sorted keys; the low bits that longer n-grams don't use are left out
        steps = [np.diff(keys, prepend=np.uint64(0)) >> np.uint64(64 - bits if k else 0) for k, keys in enumerate(block.keys)]
        for k, e in enumerate(edges):
            first = np.unique(e[:-1][np.diff(e) > 0])
            steps[k][first] = block.keys[k][first] >> np.uint64(64 - bits if k else 0)
        sizes = np.diff(edges, axis=1)
        out = []
        for b in np.flatnonzero(sizes.sum(axis=0)).tolist():
            mine = [(e[b], e[b + 1]) for e in edges]
            out.append((b, number, sizes[:, b].tolist(), _pack(np.concatenate([x[i:j] for x, (i, j) in zip(steps, mine)])), _pack(np.concatenate([x[i:j] for x, (i, j) in zip(counts, mine)]))))
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "block", "sizes", "keys", "counts"])

    return ask


def _answer(group: pa.Table) -> pa.Table:
    """Totals over all blocks for each key that a block has sent; in block -1, N, V, n1 and n2 of the bucket's words."""
    rows = group.to_pylist()
    cuts = [np.cumsum(r["sizes"])[:-1] for r in rows]
    steps = [np.split(_unpack(r["keys"], np.uint64), c) for r, c in zip(rows, cuts)]
    counts = [np.split(_unpack(r["counts"], np.uint32), c) for r, c in zip(rows, cuts)]
    totals: list[list[np.ndarray]] = [[] for _ in rows]
    out = []
    for k in range(len(rows[0]["sizes"])):
        keys = np.concatenate([np.cumsum(s[k], dtype=np.uint64) for s in steps])
        _, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, np.concatenate([c[k] for c in counts])).astype(np.uint64)  # a corpus has more than 2 ** 32 of a word
        if k == 0:
            out.append((-1, rows[0]["bucket"], b"", int(total.sum(dtype=np.int64)), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())))
        for own, part in zip(totals, np.split(at, np.cumsum([len(s[k]) for s in steps])[:-1])):
            own.append(total[part])
    out += [(r["block"], r["bucket"], _pack(np.concatenate(own)), 0, 0, 0, 0) for r, own in zip(rows, totals)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER_TYPES)], ["block", "bucket", "totals", "n", "v", "n1", "n2"])


# ---------------------------------------------------------------- the automaton


def weights(counts: list[np.ndarray], n: int, v: int, n1: int, n2: int, mu: tuple[float, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """counts: by order, of the n-gram that ends at each position (0 where it would reach before the text).

    arcs[k]: log10 weight of the arc that the (k + 1)-gram is, not a number where there is none but at order 1.
    fails[k]: log10 weight of the failure arc of the state of k words that ends before the position.
    """
    with np.errstate(divide="ignore"):
        c = counts[0]
        discount = n1 / (n1 + 2 * max(n2, 1)) if n1 else 0.5
        p = np.where(c > 0, (c - discount) / n, discount * v / n) if n else np.ones(len(c))
        arcs, fails = [np.log10(p)], [np.zeros(len(c))]
        for k in range(1, len(counts)):
            before = np.concatenate(([0], counts[k - 1][:-1]))
            m = mu[min(k, len(mu)) - 1]
            p = (counts[k] + m * p) / (before + m)
            arcs.append(np.where(counts[k] > 0, np.log10(p), np.nan))
            fails.append(np.log10(m / (before + m)))
    return arcs, fails


def traverse(arcs: list[list[float]], fails: list[list[float]], known: list[bool]) -> float:
    """Read a text from the empty state; the state is how many words back it reaches."""
    longest = len(arcs) - 1
    total, state = 0.0, 0
    for i, is_known in enumerate(known):
        while state and (arc := arcs[state][i]) != arc:
            total += fails[state][i]
            state -= 1
        if state:
            total += arc
            if state < longest:
                state += 1
        else:
            total += arcs[0][i]
            state = 1 if longest and is_known else 0
    return total


def _scorer(order: int, buckets: int, bits: int, mu: tuple[float, ...]):
    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([[], [], [], [], [], [], []], schema=_SCORES)
        block = Block(group.column("text"), order, bits)
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        n, v, n1, n2 = (rows[0][c] for c in ("n", "v", "n1", "n2"))
        # a bucket's answer has its keys of the first order, then of the second, and so on, as they were asked for
        edges = np.array([_edges(keys, buckets) for keys in block.keys])
        answered = {r["bucket"]: np.split(_unpack(r["totals"], np.uint64), np.cumsum(edges[:, r["bucket"] + 1] - edges[:, r["bucket"]])[:-1]) for r in rows}
        counts = []
        for k in range(order):
            by_key = np.concatenate([answered[b][k] for b in sorted(answered)]).astype(np.float64)
            here = np.zeros(len(block.whole[k]))
            here[block.whole[k]] = by_key[block.at[k]]
            counts.append(here)
        c = counts[0]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        arcs, fails = weights(counts, n, v, n1, n2, mu)
        begins = np.concatenate(([0], block.ends[:-1]))
        scores = [traverse([x[a:b].tolist() for x in arcs], [x[a:b].tolist() for x in fails], (c[a:b] > 0).tolist()) for a, b in zip(begins.tolist(), block.ends.tolist())]
        return pa.table(
            [
                group.column("doc_id"),
                group.column("held_out"),
                pa.array(block.ends - begins),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)),
                pa.array(np.full(len(begins), n, np.int64)),
                pa.array(np.add.reduceat(base, begins)),
                pa.array(scores),
            ],
            schema=_SCORES,
        )

    return score


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(rows: DataFrame, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows: doc_id, text, held_out. Token counts, base score and model score of every row; rows that are not held out train."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    digest = F.xxhash64("doc_id", "text")
    total, most = rows.groupBy(digest.alias("h")).agg(F.sum(size).alias("b")).agg(F.sum("b"), F.max("b")).first()
    n = max(1, math.ceil((total or 0) / block_bytes))
    bits = min(64, max(LEAST_BITS, (total or 1).bit_length() + SPARE_BITS))
    rows = rows.select(F.col("doc_id").cast("long"), "text", "held_out", digest.alias("h"))
    if (most or 0) > 2 * block_bytes:
        crowded = rows.groupBy("h").agg(F.count("*").alias("rows"), F.sum(size).alias("b")).where((F.col("b") > 2 * block_bytes) & (F.col("rows") > 1))
        crowded = F.broadcast(stored(crowded.select("h", F.ceil(F.col("b") / block_bytes).alias("parts")), "crowded"))  # at most total / (2 * block_bytes) rows
        rows = stored(rows.join(crowded, "h", "left").withColumn("h", F.coalesce(F.xxhash64("h", F.pmod(F.monotonically_increasing_id(), "parts")), "h")).drop("parts"), "dealt")
    dealt = rows.select(F.pmod("h", F.lit(n)).cast("int").alias("block"), "doc_id", "text", "held_out", (~F.col("held_out")).cast("int").alias("train"))
    asks = dealt.groupBy("block").applyInArrow(_asker(order, n, bits), _ASKS)
    answers = asks.groupBy("bucket").applyInArrow(_answer, _ANSWERS)
    totals = answers.where("block < 0").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")))
    answers = answers.where("block >= 0").drop("n", "v", "n1", "n2").crossJoin(F.broadcast(totals))  # one row
    return (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_scorer(order, n, bits, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def op2_lm_scoring(docs: DataFrame) -> DataFrame:
    """Scores of every document under the model of those that are not held out."""
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out")))
