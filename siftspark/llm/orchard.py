"""Clusters of vectors around centroids, each vector's nearest centroid found by Orchard's search.

Every centroid has a list of the others by rising distance. A search starts at some centroid and reads its list:
whenever an entry is closer to the vector (or as close with a smaller number), the search jumps to that entry's
list; entries already measured are marked and not measured again. It stops where the list's next entry lies strictly
beyond twice the current distance, as by the triangle inequality nothing from there on can be closer; one at exactly
twice may tie. Here a batch of vectors searches in step: each pass reads one entry for every vector still under way.

A round is one scan of the vectors. A task sends one row for each centroid that it met, with counts and sums that
Spark adds up; the driver gets a row for each centroid, never vectors. Nothing is exchanged but those sums.

Components are whole numbers, so results don't depend on the order in which rows are added. Those beyond MOST count
as MOST, so that squared distances fit 64 bits.

Defined results: a null vector, one of another length and one with a null, infinite or not-a-number component are left
out; rows that repeat each count and are returned each; null ids come last among the starting centroids, equal ids
by their components; fewer vectors than centroids give fewer centroids; an empty table gives an empty result; further
columns are not read.
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

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Largest component: four times the squared distance of two vectors still fits 64 bits.
MOST = 1 << 26


class Orchard:
    """The centroids with their neighbour lists; pickled to the tasks."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], np.int64).reshape(k, k)
        apart_from_self = apart.copy()
        np.fill_diagonal(apart_from_self, -1)
        self.lists = np.argsort(apart_from_self, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(apart, self.lists, axis=1)
        sums = centroids.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row (ties: the smaller) and the squared distance."""
        n, k = len(x), len(self.centroids)
        # any start is right; the centroid whose components add up to about as much is often not far
        best = self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(axis=1)), k - 1)]
        dist = ((x - self.centroids[best]) ** 2).sum(axis=1)
        marked = np.zeros((n, k), bool)
        marked[np.arange(n), best] = True
        at, live = np.zeros(n, np.int64), np.arange(n if k > 1 else 0)
        while len(live):
            live = live[self.gaps[best[live], at[live]] <= 4 * dist[live]]
            entry = self.lists[best[live], at[live]]
            at[live] += 1
            fresh = ~marked[live, entry]
            q, e = live[fresh], entry[fresh]
            marked[q, e] = True
            d = ((x[q] - self.centroids[e]) ** 2).sum(axis=1)
            closer = (d < dist[q]) | ((d == dist[q]) & (e < best[q]))
            q = q[closer]
            best[q], dist[q], at[q] = e[closer], d[closer], 0
            live = live[at[live] < k - 1]
        return best, dist


def _kept(vectors: DataFrame, dim: int) -> DataFrame:
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return kept.where((F.size("embedding") == dim) & sound(F.col("embedding")))


def starting(vectors: DataFrame, k: int = CENTROIDS, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of their ids."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = _kept(vectors, dim).orderBy(order.asc_nulls_last(), "embedding").limit(k).toArrow()
    return whole(rows.column("embedding").combine_chunks(), dim, scale, MOST)


def sums(vectors: DataFrame, orchard: Orchard, dim: int = DIM, scale: int = SCALE) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each centroid is nearest to, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(orchard.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = whole(batch.column("embedding"), dim, scale, MOST)
            best, _ = orchard.nearest(x)
            count += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = _kept(vectors, dim).select("embedding").mapInArrow(run, "c int, n long, s array<long>")
    added = parts.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
    return {r[0]: (r[1], list(r[2:])) for r in added.collect()}  # a row for each centroid


def trained(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """The centroids after so many rounds; one that no vector is nearest to stays."""
    centroids = starting(vectors, k, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, s) in sums(vectors, Orchard(centroids), dim, scale).items():
            centroids[c] = [x // n for x in s]
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
    orchard = Orchard(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, dist = orchard.nearest(whole(batch.column("embedding"), dim, scale, MOST))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return _kept(vectors, dim).mapInArrow(run, "vec_id long, cluster int, distance long")


def op11_orchard(vectors: DataFrame) -> DataFrame:
    """Cluster of every kept vector, with its distance, the clusters' and the whole inertia and a digest of the centroid."""
    centroids = trained(vectors)
    placed = stored(assigned(vectors, centroids), "clusters")
    parts = placed.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = sum(r.inertia for r in parts) if all(r.inertia is not None for r in parts) else None
    table = [(r.cluster, r.inertia, inertia if inertia is None or inertia < 1 << 63 else None, digest[r.cluster]) for r in parts]
    about = placed.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same by measuring every vector against every centroid."""
    ctes = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept ORDER BY c LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"""near{i} AS MATERIALIZED (
            SELECT r, vec_id, v, m.c AS c, m.d AS d FROM (
                SELECT r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': CAST(list_sum(list_transform(k.v, lambda x, j: (x - o.v[j]) * (x - o.v[j]))) AS BIGINT), 'c': o.c}}) AS m
                FROM kept k CROSS JOIN centroids{i} o GROUP BY r))""")
        if i < ROUNDS:
            ctes.append(f"""centroids{i + 1} AS MATERIALIZED (
                SELECT o.c, coalesce(n.v, o.v) AS v FROM centroids{i} o LEFT JOIN (
                    SELECT c, list(x ORDER BY j) AS v FROM (
                        SELECT c, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{i}) GROUP BY c, j)
                    GROUP BY c) n ON n.c = o.c)""")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(o.v, ',')) AS centroid_sha256
        FROM near{ROUNDS} n JOIN centroids{ROUNDS} o ON o.c = n.c"""


OP11_SQL = _sql()
