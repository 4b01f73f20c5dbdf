"""Codes of vectors: each part of a vector is named by the nearest entry of its part's codebook.

Rounds skip most of the measuring by norm-of-sum bounds. A part keeps, for each group of codebook entries, a lower
bound on its distance to all of them but its own entry, stamped with the round in which it was measured. The
codebooks of all rounds are retained, so a later round takes off how far the group's entries have come from that
round to this one, net: the norm of the sum of their moves. That is never more than the moves of single rounds
added up. Where the bound still exceeds the distance to the part's own entry, measured anew, nothing in the group can
win or tie; otherwise the group's entries are measured exactly, and the bound gets this round's stamp.

Vectors are packed into blocks of up to BLOCK, written once, dealt out into as many buckets as there are shuffle
partitions; each round's state is written by block into the same buckets, so that a round reads blocks and state
side by side without an exchange, and starts from written tables if executors are lost. A round's new sums come
from the parts that changed their entry; the driver gets a row for each entry, never vectors.

Components are whole numbers, so results don't depend on the order in which rows are added. Those beyond MOST count as
MOST, so that squared distances fit 64 bits.

Defined results: a null vector and one with a null, infinite or not-a-number component are left out; a vector whose
length isn't that of the first entry, or that can't be cut into equal parts, stays with null code and error, which
adds nothing to its label's error; rows that repeat each count and are returned each; null ids come last among the
first entries, equal ids by their components; fewer vectors than entries give fewer entries; null labels are one
label; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import stored
from siftspark.llm.vectors import sound, whole
from siftspark.session import bucketed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that share a bound.
GROUP = 32
#: Vectors of a block.
BLOCK = 2048
#: Largest component: squared distances fit 64 bits. Up to SMALL they fit a double's 53 bits, and a matrix product gives them.
MOST, SMALL = 1 << 26, 1 << 22


def entry_groups(book: np.ndarray) -> list[np.ndarray]:
    """Entries of one part in groups of at most GROUP that lie close: halved at the median of the widest component."""
    groups = [np.arange(len(book))]
    while any(len(g) > GROUP for g in groups):
        cut = []
        for g in groups:
            if len(g) <= GROUP:
                cut.append(g)
                continue
            wide = np.ptp(book[g], axis=0).argmax()
            order = g[np.argsort(book[g, wide], kind="stable")]
            cut += [np.sort(order[: len(g) // 2]), np.sort(order[len(g) // 2 :])]
        groups = cut
    return groups


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= SMALL:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def _half(x: np.ndarray) -> np.ndarray:
    """A half-precision number not above each number, nor below zero: bounds take two bytes."""
    x = np.clip(np.nextafter(x, -np.inf), 0, 65504.0)
    half = x.astype(np.float16)
    return np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(0)), half)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Rounds:
    """All codebooks so far, the groups of their entries, and how far each group has come since each round; pickled to the tasks."""

    def __init__(self, history: list[np.ndarray], groups: list[list[np.ndarray]]) -> None:
        self.book, self.groups, self.now = history[-1], groups, len(history) - 1
        self.width = max(map(len, groups))
        self.come = np.zeros((len(history), len(groups), self.width))
        for then, book in enumerate(history[:-1]):
            for p, part in enumerate(groups):
                moved = _root(((self.book[p] - book[p]) ** 2).sum(axis=1))
                self.come[then, p, : len(part)] = [np.nextafter(moved[g].max(), np.inf) if moved[g].any() else 0.0 for g in part]

    def assign(self, x: np.ndarray, p: int, own: np.ndarray | None, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """x: the p-th parts. Nearest entries (ties: the lower), squared distances, and how many were measured; bound and stamp are brought up to date."""
        n, book, groups = len(x), self.book[p], self.groups[p]
        if own is None:
            best, dist = np.full(n, len(book)), np.full(n, np.iinfo(np.int64).max)
            need, low = np.ones((n, len(groups)), bool), None
        else:
            best, dist = own.astype(np.int64), ((x - book[own]) ** 2).sum(axis=1)
            low = bound[:, : len(groups)].astype(np.float64) - self.come[stamp[:, : len(groups)], p, np.arange(len(groups))]
            need = np.nextafter(low, -np.inf) <= np.nextafter(_root(dist), np.inf)[:, None]
        before, first, measured = dist.copy(), best.copy(), n if own is not None else 0
        seen = []
        for g, entries in enumerate(groups):
            rows = np.flatnonzero(need[:, g])
            d = _squared(x[rows], book[entries])
            at = d.argmin(axis=1) if len(rows) else np.empty(0, np.int64)
            least, name = d[np.arange(len(rows)), at], entries[at]
            d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
            seen.append((rows, least, name, d.min(axis=1, initial=np.iinfo(np.int64).max)))
            closer = (least < dist[rows]) | ((least == dist[rows]) & (name < best[rows]))
            dist[rows[closer]], best[rows[closer]] = least[closer], name[closer]
            measured += d.size
        for g, (rows, least, name, second) in enumerate(seen):
            bound[rows, g] = _half(_root(np.where(name == best[rows], second, least)))
            stamp[rows, g] = self.now
            if own is not None:  # an entry that was given up, in a group that wasn't measured
                left = np.flatnonzero((best != first) & ~need[:, g] & np.isin(first, groups[g]))
                bound[left, g] = _half(np.minimum(low[left, g], _root(before[left])))
                stamp[left, g] = self.now
        return best, dist, measured


class State:
    """Entries, bounds and stamps of a block; as bytes between rounds."""

    def __init__(self, n: int, parts: int, width: int, own: bytes = b"", bounds: bytes = b"", stamps: bytes = b"") -> None:
        shape = (n, parts, width)
        self.own = np.frombuffer(own, np.uint8).reshape(n, parts).astype(np.int64) if own else None
        self.bounds = np.frombuffer(bounds, np.float16).reshape(shape).copy() if own else np.zeros(shape, np.float16)
        self.stamps = np.frombuffer(stamps, np.uint8).reshape(shape).copy() if own else np.zeros(shape, np.uint8)

    def advance(self, x: np.ndarray, rounds: Rounds) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries and summed squared distances of this round."""
        parts = len(rounds.groups)
        cuts = np.split(x, parts, axis=1)
        found = [rounds.assign(cuts[p], p, None if self.own is None else self.own[:, p], self.bounds[:, p], self.stamps[:, p]) for p in range(parts)]
        return np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0), sum(f[2] for f in found)


def _moved(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (part * entries + entry) whose parts changed, and what that adds to their counts and sums."""
    parts = new.shape[1]
    pieces = x.reshape(len(x), parts, -1)
    rows, part = np.nonzero(new != old) if old is not None else np.nonzero(np.ones_like(new, bool))
    gain = part * entries + new[rows, part]
    cell, value, one = gain, pieces[rows, part], np.ones(len(gain), np.int64)
    if old is not None:
        cell, value, one = np.concatenate([gain, part * entries + old[rows, part]]), np.concatenate([value, -value]), np.concatenate([one, -one])
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    if not len(starts):
        return cell, one, value
    return cell[order][starts], np.add.reduceat(one[order], starts), np.add.reduceat(value[order], starts, axis=0)


_STATE = "block long, own binary, bounds binary, stamps binary, measured long, moved array<struct<cell int, n long, s array<long>>>"
_STATE_TYPES = pa.schema([("block", pa.int64()), ("own", pa.binary()), ("bounds", pa.binary()), ("stamps", pa.binary()), ("measured", pa.int64()), ("moved", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])))])
_CODED = "vec_id long, label string, code string, error long"
_CODED_TYPES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _block(group: pa.Table, dim: int) -> np.ndarray:
    data, n = group.column("data")[0].as_py(), group.column("n")[0].as_py()
    return np.frombuffer(data, np.dtype(f"i{len(data) // (n * dim)}")).reshape(n, dim).astype(np.int64)


def _advanced(group: pa.Table, state: pa.Table | None, rounds: Rounds, dim: int):
    x = _block(group, dim)
    row = state.to_pylist()[0] if state is not None else {}
    kept = State(len(x), len(rounds.groups), rounds.width, *(row[c] for c in ("own", "bounds", "stamps") if row))
    return x, kept, *kept.advance(x, rounds)


def _stepper(rounds: Rounds, dim: int):
    def step(group: pa.Table, state: pa.Table | None) -> pa.Table:
        x, kept, own, _, measured = _advanced(group, state, rounds, dim)
        cells, counts, sums = _moved(x, kept.own, own, rounds.book.shape[1])
        moved = [{"cell": c, "n": n, "s": s} for c, n, s in zip(cells.tolist(), counts.tolist(), sums.tolist())]
        row = {"block": group.column("block")[0].as_py(), "own": own.astype(np.uint8).tobytes(), "bounds": kept.bounds.tobytes(), "stamps": kept.stamps.tobytes(), "measured": measured, "moved": moved}
        return pa.Table.from_pylist([row], _STATE_TYPES)

    return step


def _coder(rounds: Rounds, dim: int):
    def code(group: pa.Table, state: pa.Table | None) -> pa.Table:
        _, _, own, error, _ = _advanced(group, state, rounds, dim)
        digits, each = own.astype(np.uint8).tobytes().hex(), 2 * own.shape[1]
        codes = [digits[i : i + each] for i in range(0, len(digits), each)]
        return pa.table([pa.array(group.column("ids")[0].as_py(), pa.int64()), pa.array(group.column("labels")[0].as_py(), pa.string()), pa.array(codes), pa.array(error)], schema=_CODED_TYPES)

    return code


def packed(vectors: DataFrame, dim: int, scale: int, parts: int) -> DataFrame:
    """vectors: vec_id long, label string, embedding array<double>. Blocks: block, n, ids, labels and the whole numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("embedding"), dim, scale, MOST)
            for at in range(0, len(x), BLOCK):
                part, rows = x[at : at + BLOCK], batch.slice(at, BLOCK)
                small = np.int16 if np.abs(part).max(initial=0) < 1 << 15 else np.int32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([rows.column("label").to_pylist()], pa.list_(pa.string())), pa.array([part.astype(small).tobytes()], pa.binary())],
                    ["n", "ids", "labels", "data"],
                )

    return vectors.mapInArrow(run, "n int, ids array<long>, labels array<string>, data binary").select(F.monotonically_increasing_id().alias("block"), "*")


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, label (as text), code and error of every sound vector; the codebooks; and how many distances each round measured."""
    sounds = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).where(sound(F.col("embedding")))
    fits = sounds.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    lead = fits.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("dim")).first()
    if lead is None:
        return sounds.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.empty((parts, 0, 0), np.int64), []
    dim = lead.dim
    fits = sounds.where(F.size("embedding") == dim)
    seeds = fits.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    first = whole(seeds.column("embedding").combine_chunks(), dim, scale, MOST)
    history = [np.stack(np.split(first, parts, axis=1))]
    groups = [entry_groups(book) for book in history[0]]
    blocks = bucketed(packed(fits, dim, scale, parts), "vector_blocks", "block")
    k = len(first)
    counts, totals = [0] * (parts * k), [[0] * (dim // parts) for _ in range(parts * k)]
    state, measured = None, []

    def run(make, schema: str) -> DataFrame:
        own = blocks.groupBy("block")
        return own.applyInArrow(lambda group: make(group, None), schema) if state is None else own.cogroup(state.groupBy("block")).applyInArrow(make, schema)

    for _ in range(rounds):
        state = bucketed(run(_stepper(Rounds(history, groups), dim), _STATE), "vector_state", "block")
        cells = state.select(F.explode("moved").alias("m")).groupBy("m.cell").agg(F.sum("m.n").alias("n"), *(F.sum(F.col("m.s")[i]).alias(f"s{i}") for i in range(dim // parts)))
        for cell, n, *sums in cells.collect():  # a row for each entry
            counts[cell] += n
            totals[cell] = [a + b for a, b in zip(totals[cell], sums)]
        measured.append(state.agg(F.sum("measured")).first()[0])
        book = history[-1].copy()
        for cell, n in enumerate(counts):
            if n:
                book[cell // k, cell % k] = [s // n for s in totals[cell]]
        history.append(book)
    rest = sounds.where(F.size("embedding") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return run(_coder(Rounds(history, groups), dim), _CODED).unionByName(rest), history[-1], measured


def op12_codebooks(vectors: DataFrame) -> DataFrame:
    """Code and error of every sound vector, its label's error and a digest of the codebooks."""
    rows, books, _ = coded(vectors)
    rows = stored(rows, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = rows.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(0).cast("long")).alias("label_error"))
    key = [F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("key")]
    joined = rows.select("vec_id", "code", "error", *key).join(of_label.select("label_error", *key), ["none", "key"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by measuring every part against every entry; for vectors of 64 components."""
    width = 64 // PARTS
    ctes = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM kept CROSS JOIN range({PARTS}) t(p))",
        f"books0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"""near{i} AS MATERIALIZED (
            SELECT r, p, v, m.e AS e, m.d AS d FROM (
                SELECT k.r, k.p, any_value(k.v) AS v, min({{'d': CAST(list_sum(list_transform(k.v, lambda x, j: (x - o.v[j]) * (x - o.v[j]))) AS BIGINT), 'e': o.e}}) AS m
                FROM parts k JOIN books{i} o ON o.p = k.p GROUP BY k.r, k.p))""")
        if i < ROUNDS:
            ctes.append(f"""books{i + 1} AS MATERIALIZED (
                SELECT o.p, o.e, coalesce(n.v, o.v) AS v FROM books{i} o LEFT JOIN (
                    SELECT p, e, list(x ORDER BY j) AS v FROM (
                        SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{i}) GROUP BY p, e, j)
                    GROUP BY p, e) n ON n.p = o.p AND n.e = o.e)""")
    return f"""WITH {", ".join(ctes)},
        codes AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM books{ROUNDS}) AS codebooks_sha256
        FROM kept JOIN codes USING (r)"""


OP12_SQL = _sql()
