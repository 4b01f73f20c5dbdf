"""Removal of passages that repeat across documents, by super-k-mers of words.

A window is WINDOW consecutive words. Its minimiser is the least hash among the runs of MINIMISER words inside
it, so equal windows have equal minimisers. Neighbouring windows mostly share theirs: such a run of windows, at
most RUN of them, is one super-k-mer, and its words travel as one packed string to the bucket of the minimiser.
There the windows of all packed strings are sorted and counted as the byte strings they are.

What travels is kept small without losing a window:
1. each super-k-mer first sends only hashes; minimisers that occur in one document alone are done with;
2. equal super-k-mers are pre-aggregated to the one with the smallest id, and where all of a minimiser's
   super-k-mers are equal, nothing needs unpacking;
3. the rest go as packed strings, once for each distinct one. A bucket with over MAX_BUCKET of them is salted:
   each salt sorts its own windows, and the least ids meet in a second aggregation by window hash.

Defined results: a null text has no words; documents under WINDOW words keep everything; a null id neither
removes nor loses anything; rows that repeat an id don't count as earlier than each other; words are compared
unchanged, whatever white space stands between them; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import KNOWN_WORDS, WordHashes, stored

WINDOW = 50
MINIMISER = 8
RUN = 64
MAX_BUCKET = 4096


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, in steps that double."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def minimisers(hashes: np.ndarray, window: int, size: int) -> np.ndarray:
    """The minimiser of every window."""
    n = len(hashes) - size + 1
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    return sliding_least(runs, window - size + 1)


def super_kmers(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one minimiser, RUN windows at most."""
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    length = np.diff(np.append(cut, len(least)))
    pieces = -(-length // RUN)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(cut, pieces) + place * RUN
    return start, np.minimum(RUN, np.repeat(cut + length, pieces) - start)


def _spans(tokens: list[bytes]) -> tuple[bytes, list[int]]:
    """The words joined by one space, and where each begins; one more entry for the end."""
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)))
    return b" ".join(tokens), begins.tolist()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of it, which tells apart rows that share an id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))


def scan(rows: DataFrame, window: int = WINDOW, size: int = MINIMISER) -> DataFrame:
    """The super-k-mers of each text, as hashes: mini, s (of the packed string), doc_id, th, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("mini", "s", "doc_id", "th", "start", "n")}
            for doc, text, th in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("th").to_pylist()):
                tokens = (text.as_py() or b"").split()
                if doc is None or len(tokens) < window:
                    continue
                if len(hashes) > KNOWN_WORDS:
                    hashes.clear()
                least = minimisers(np.array([hashes[t] for t in tokens], np.uint64), window, size)
                start, n = super_kmers(least)
                flat, at = _spans(tokens)
                h = xxhash.xxh64_intdigest
                out["s"].append(np.array([h(flat[at[a] : at[b] - 1], 7) for a, b in zip(start.tolist(), (start + n + window - 1).tolist())], np.uint64).view(np.int64))
                out["mini"].append(least[start].view(np.int64))
                out["doc_id"].append(np.full(len(start), doc, np.int64))
                out["th"].append(np.full(len(start), th, np.int64))
                out["start"].append(start.astype(np.int32))
                out["n"].append(n.astype(np.int32))
            if out["s"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], list(out))

    return rows.mapInArrow(run, "mini long, s long, doc_id long, th long, start int, n int")


def pack(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows: text and wanted array<struct<mini, s, salt, salts, doc_id, start, n>>. One packed string for each wanted super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("mini", pa.int64()), ("s", pa.int64()), ("salt", pa.int64()), ("salts", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted")):
                flat, at = _spans((text.as_py() or b"").split())
                for w in wanted.as_py():
                    out.append({**{k: w[k] for k in schema.names[:-1]}, "packed": flat[at[w["start"]] : at[w["start"] + w["n"] + window - 1] - 1]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("text", "wanted").mapInArrow(run, "mini long, s long, salt long, salts long, doc_id long, packed binary")


def first_seen(packed: list[tuple[bytes, int]], window: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each packed string (with its id): the smallest id of each of its windows, and the windows' hashes."""
    windows = []
    for k, (string, doc) in enumerate(packed):
        flat, at = _spans(string.split(b" "))
        windows += [(flat[at[i] : at[i + window] - 1], doc, k, i) for i in range(len(at) - window)]
    windows.sort()
    least: list[list[int]] = [[] for _ in packed]
    hashes: list[list[int]] = [[] for _ in packed]
    for k, (string, _) in enumerate(packed):
        n = string.count(b" ") + 2 - window
        least[k], hashes[k] = [0] * n, [0] * n
    before, doc, code = None, 0, 0
    for string, own, k, i in windows:
        if string != before:
            before, doc = string, own
            code = xxhash.xxh64_intdigest(string) - (1 << 63)
        least[k][i], hashes[k][i] = doc, code
    return least, hashes


def sort_buckets(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sort the windows of each (mini, salt). mini, s, least array<long>, and hashes array<long> where the bucket is salted."""
    schema = pa.schema([("mini", pa.int64()), ("s", pa.int64()), ("least", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])

    def bucket(mini: int, salts: int, members: dict[int, tuple[bytes, int]]) -> list[dict]:
        least, hashes = first_seen(list(members.values()), window)
        return [{"mini": mini, "s": s, "least": a, "hashes": b if salts > 1 else None} for s, a, b in zip(members, least, hashes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, salts, out, held = None, {}, 1, [], 0
        for batch in batches:
            for mini, salt, n, s, doc, string in zip(*(batch.column(c).to_pylist() for c in ("mini", "salt", "salts", "s", "doc_id", "packed"))):
                if (mini, salt) != now and members:
                    out += bucket(now[0], salts, members)
                    held += len(members)
                    members = {}
                now, salts, members[s] = (mini, salt), n, (string, doc)
            if held > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if members:
            out += bucket(now[0], salts, members)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = rows.repartition("mini", "salt").sortWithinPartitions("mini", "salt")
    return rows.mapInArrow(run, "mini long, s long, least array<long>, hashes array<long>")


def repeats(rows: DataFrame, window: int = WINDOW, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """rows: as of keyed(). doc_id, th and spans array<struct<start, n, flags>>: windows that also start in a document with a smaller id; null flags: all n of them."""
    kmers = stored(scan(rows, window), "kmers")
    shared = stored(kmers.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mini"), "shared-minimisers")
    kmers = stored(kmers.join(shared, "mini", "left_semi"), "shared-kmers")
    distinct = stored(kmers.groupBy("mini", "s").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("r")), "distinct-kmers")
    # stored, so that Spark can split a minimiser's rows in the joins with it: an aggregate beside a join keeps them together
    several = stored(distinct.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1"), "several")
    salts = F.ceil(F.col("c") / max_bucket)
    wanted = distinct.join(several, "mini").select(
        "r.doc_id", "r.th", F.struct("mini", "s", F.pmod("s", salts).cast("long").alias("salt"), salts.cast("long").alias("salts"), "r.doc_id", "r.start", "r.n").alias("w")
    )
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))
    marks = sort_buckets(pack(rows.join(wanted, ["doc_id", "th"]), window), window)
    if not several.where(F.col("c") > max_bucket).isEmpty():
        marks = stored(marks, "marks")
        salted = marks.where("hashes is not null").select("mini", "s", F.posexplode(F.arrays_zip("hashes", "least")).alias("i", "w"))
        salted = salted.select("mini", "s", "i", F.col("w.hashes").alias("h"), F.col("w.least").alias("own"))
        least = salted.groupBy("mini", "h").agg(F.min("own").alias("l"))
        met = salted.join(least, ["mini", "h"]).groupBy("mini", "s").agg(F.array_sort(F.collect_list(F.struct("i", "l"))).alias("w"))
        marks = marks.where("hashes is null").select("mini", "s", "least").unionByName(met.select("mini", "s", F.col("w.l").alias("least")))
    # one super-k-mer alone under its minimiser: all of its windows start first where it does
    alone = distinct.join(several, "mini", "left_anti").select("mini", "s", F.array("r.doc_id").alias("least"), F.lit(True).alias("whole"))
    marks = marks.select("mini", "s", "least", F.lit(False).alias("whole")).unionByName(alone)
    flags = F.transform("least", lambda x: x < F.col("doc_id"))
    found = kmers.join(marks, ["mini", "s"]).where(F.exists("least", lambda x: x < F.col("doc_id")))
    span = F.struct("start", "n", F.when(~F.col("whole"), flags).alias("flags"))
    return found.select("doc_id", "th", span.alias("span")).groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))


def cut(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows: doc_id, text and spans as of repeats(), or null. doc_id, n_words, n_removed and the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
                tokens = (text.as_py() or b"").split()
                gone = 0
                if spans := spans.as_py():
                    edge = np.zeros(len(tokens) + 1, np.int32)
                    for s in spans:
                        if s["flags"] is None:
                            edge[s["start"]] += 1
                            edge[s["start"] + s["n"] + window - 1] -= 1
                        else:
                            at = s["start"] + np.flatnonzero(s["flags"])
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int(len(tokens) - keep.sum())
                    words.append(len(tokens))
                    tokens = [t for t, k in zip(tokens, keep.tolist()) if k]
                else:
                    words.append(len(tokens))
                removed.append(gone)
                kept.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every document."""
    rows = keyed(docs)
    return cut(rows.join(repeats(rows, window, max_bucket), ["doc_id", "th"], "left"), window)


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    """Word counts and the digest of what is kept, for every document."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
