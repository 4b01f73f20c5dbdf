"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key of 40 hex digits: 16 of the text's digest, 16 of the id's, so equal texts are neighbours,
and 8 of the row's place in the input, which tell rows apart that are equal in both. Splitters between shards are
found without sorting: each round counts, in all partitions at once, the exact bytes that lie below candidate
boundaries (the 256 continuations of each open prefix), keeps the boundary if it is within TOLERANCE of a shard's
bytes from its goal, and otherwise probes inside the interval where the goal falls. Early boundaries fall between
texts, so equal texts stay in one shard unless keeping them together would miss the tolerance. The driver sees
(shards - 1) * 256 counts a round at most. With the splitters known, rows are exchanged once, each to the partition
of its shard; a shard over PART_ROWS rows has several, dealt by hash, so no shard is gathered in a task. A slot is
the place within the partition plus what the shard's partitions before hold.

Defined results: a null text counts no bytes; rows that repeat get places of their own, in either order; null ids
are allowed; an empty table gives an empty result; further columns are not read by the digest query and are kept
by sharded() and write_shards(), where a column named shard is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.common import stored

SHARDS = 24
#: Of a shard's mean bytes.
TOLERANCE = 0.005
OVERHEAD = 8
DIGITS, PROBE = 40, 2
#: Rows of a shard that one partition sorts.
PART_ROWS = 4_000_000


def sort_key() -> Column:
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    own = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    place = F.lpad(F.lower(F.hex(F.xxhash64(F.monotonically_increasing_id()))), 16, "0")
    return F.concat(F.substring(text, 1, 16), F.substring(own, 1, 16), F.substring(place, 1, 8))


def row_bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + OVERHEAD


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[str]:
    """rows: key, size. shards - 1 prefixes of keys; a row belongs after each one that is not above its key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = [total * i / shards for i in range(1, shards)]
    found: list[str | None] = [None] * len(goals)
    open_at = {i: ("", 0) for i in range(len(goals))}  # prefix, bytes below it
    used = 0
    while open_at:
        prefixes = sorted({p for p, _ in open_at.values()})
        inside = rows if used == 0 else rows.where(F.substring("key", 1, used).isin(prefixes))
        counted = inside.groupBy(F.substring("key", 1, used + PROBE).alias("p")).agg(F.sum("size").alias("n")).collect()
        below: dict[str, list[tuple[str, int]]] = {}
        for row in sorted(counted, key=lambda r: r.p):
            below.setdefault(row.p[:used], []).append((row.p, row.n))
        used += PROBE
        for i, (prefix, before) in list(open_at.items()):
            goal, held = goals[i], before
            for p, n in below.get(prefix, []):
                if held + n > goal:
                    break
                held += n
            else:
                p, n = prefix + "g", 0  # after every hex digit
            least, edge = min((goal - held, 0), (held + n - goal, 1))
            if least <= tolerance * total / shards or used >= DIGITS or n == 0:
                found[i] = p if edge == 0 else _after(p)
                del open_at[i]
            else:
                open_at[i] = (p, held)
    return [f or "" for f in found]


def _after(prefix: str) -> str:
    """A string above every key that starts with prefix, and below all others that are above those."""
    return prefix + "g"


def shard_of(key: Column, bounds: list[str]) -> Column:
    return sum((F.when(key >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with the shard of every row."""
    bounds = splitters(stored(docs.select(sort_key().alias("key"), row_bytes().alias("size")), "keys"), shards, tolerance)
    return docs.withColumn("shard", shard_of(sort_key(), bounds))


def exchanged(rows: DataFrame, n_rows: int, bounds: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """rows: key and more. Adds shard and part; each part is one partition, in key order."""
    shards = len(bounds) + 1
    parts = max(1, -(-n_rows // (shards * part_rows)))
    placed = rows.withColumn("shard", shard_of(F.col("key"), bounds))
    placed = placed.withColumn("part", (F.col("shard") * parts + F.pmod(F.xxhash64("key"), F.lit(parts))).cast("int"))
    return placed.repartitionById(shards * parts, "part").sortWithinPartitions("key")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS) -> None:
    """One folder for each shard, its rows in key order; a shard over part_rows rows has several files, each in key order."""
    keys = stored(docs.select(sort_key().alias("key"), row_bytes().alias("size")), "keys")
    columns = [c for c in docs.columns if c != "shard"]
    rows = docs.select(sort_key().alias("key"), F.struct(*columns).alias("row"))
    placed = exchanged(rows, keys.count(), splitters(keys, shards, tolerance), part_rows)
    placed.select(*(F.col("row").getField(c).alias(c) for c in columns), "shard").write.partitionBy("shard").parquet(path)


def places(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS) -> DataFrame:
    """rows: key, size and more. Adds shard and slot, the gapless place within the shard."""
    placed = exchanged(rows, rows.count(), splitters(rows, shards, tolerance), part_rows)
    # each partition is one part, so the place in the partition is the place in the part
    dealt = stored(placed.withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "exchanged")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = stored(counts.select("shard", "part", ahead.alias("base")), "bases")
    return dealt.join(base, ["shard", "part"]).select(*rows.columns, "shard", (F.col("base") + F.col("row")).alias("slot"))


def op9_sharding(docs: DataFrame) -> DataFrame:
    """Shard and place of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long"), row_bytes().alias("size"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"), sort_key().alias("key")
    )
    return places(stored(rows, "keys")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
