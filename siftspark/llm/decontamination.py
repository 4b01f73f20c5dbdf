"""Benchmark decontamination by spaced-seed hashing.

A mask is laid over consecutive words and keeps the positions with a 1; the words it keeps are hashed. Benchmark
items and documents are hashed at every position under every mask and joined on the hash, so a hit needs no run
of equal words. Around the hits of one alignment of document and item, the aligned words are compared position
by position: the item is found where a stretch of WINDOW item words (the whole item if shorter) has at least
SIMILARITY of them equal. Wherever the substitutions lie, one of the three masks fits between them; items under
WINDOW words are sought by a run of words that is as sure to be left. Masks no item needs are not laid.

The benchmark's seeds are broadcast only up to BROADCAST_SEEDS of them; the words a hit carries on are then those
aligned with the item, gathered once for each alignment on the map side. Beyond that both sides are exchanged on the
hash, with the place of each seed and nothing of the text; alignments meet their words again by document.

Words are runs of letters and digits, lower-cased.

Defined results: null and empty texts match nothing; an item of a word or two is found wherever they stand; equal
items are found each; rows that repeat an id and a text give one row for each item found; a null id is reported as null; an
empty table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import stored

#: However two of WINDOW words are substituted, one of these fits on the others.
MASKS = ("11011011", "1100110011", "11101010111")
WINDOW = 13
SIMILARITY = 0.8
#: About 40 bytes each.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def surviving_run(n: int, similarity: float = SIMILARITY) -> str:
    """The mask of the longest run of words that n words keep wherever so many are substituted that the similarity still holds."""
    need = math.ceil(n * Decimal(str(similarity)))
    return "1" * math.ceil(need / (n - need + 1))


def seeds(rows: DataFrame, masks: tuple[str, ...], wanted: Column | None = None) -> DataFrame:
    """rows: words and more. One row for each position and mask that fits: seed, at. wanted: the masks of a row, if not all."""
    n, k = F.size("words"), len(masks)
    shortest = min(map(len, masks))
    spread = rows.where(n >= shortest).select("*", F.explode(F.sequence(F.lit(0), (n - shortest + 1) * k - 1)).alias("place"))
    at, which = F.floor(F.col("place") / k).cast("int"), F.col("place") % k
    spread = spread.withColumn("at", at).withColumn("which", which)
    # one expression for all masks: code that grows with them is too large for the JVM to compile
    of = lambda values: F.element_at(F.array(*(F.lit(v).cast("int") for v in values)), (F.col("which") + 1).cast("int"))
    fits = F.col("at") + of(map(len, masks)) <= n
    if wanted is not None:
        fits = fits & F.array_contains(wanted, F.element_at(F.array(*map(F.lit, masks)), (F.col("which") + 1).cast("int")))
    places = zip_longest(*map(_offsets, masks))  # a mask that keeps fewer words hashes nulls, which count for nothing
    seed = F.xxhash64("which", *(F.get("words", F.col("at") + of(p)) for p in places))
    return spread.where(fits).withColumn("seed", seed).drop("place", "which")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, th (a hash of the text), item_id, item_words, matched (equal aligned words, of the best alignment) and windows (stretches that reach the similarity)."""
    items = benchmark.select(F.col("item_id").cast("long"), tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stored(items.withColumn("item_words", F.size("words")).withColumn("item", F.xxhash64("item_id", "words")).distinct(), "items")
    # of each number of words, WINDOW for all from there on
    by_width = {n: (surviving_run(n, similarity),) for n in range(1, window)} | {window: masks}
    width = F.least(F.lit(window), F.col("item_words"))
    present = [r.width for r in items.select(width.alias("width")).distinct().collect()]
    laid = tuple(sorted({m for n in present for m in by_width[n]})) or masks
    wanted = F.element_at(F.array(*(F.array(*map(F.lit, by_width[n])) for n in range(1, window + 1))), width)
    known = stored(seeds(items, laid, wanted).select("seed", "item", F.col("at").alias("item_at"), "item_words").distinct(), "seeds")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), tokens(F.col("text")).alias("words"))
    shift = F.col("at") - F.col("item_at")
    start = F.greatest(F.col("shift"), F.lit(0))
    aligned = F.slice("words", start + 1, F.col("item_words") - (start - F.col("shift"))).alias("aligned")
    place = ["doc_id", "th", "item", "shift"]
    if known.count() <= broadcast_seeds:
        hits = seeds(texts, laid).join(F.broadcast(known), "seed").withColumn("shift", shift).select(*place, aligned)
        found = hits.groupBy(*place).agg(F.first("aligned").alias("aligned"))
    else:
        hits = seeds(texts, laid).select("seed", "doc_id", "th", "at").join(known, "seed").withColumn("shift", shift)
        hits = hits.select(*place, "item_words").distinct().withColumns({"k": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()})
        own = texts.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "th", "words").dropDuplicates(["k", "none", "th"])
        found = hits.join(own, ["k", "none", "th"]).select(*place, aligned)
    both = found.join(items, "item")
    ahead = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.filter(F.sequence(F.lit(0), F.col("item_words") - 1), lambda i: F.get("aligned", i - ahead) == F.get("words", i))
    both = both.select("doc_id", "th", "item_id", "item_words", equal.alias("equal"))
    need = F.ceil(width * F.lit(similarity).cast("decimal(4,3)"))
    inside = lambda i: F.size(F.filter("equal", lambda x: (x >= i) & (x < i + width)))
    windows = F.size(F.filter(F.sequence(F.lit(0), F.col("item_words") - width), lambda i: inside(i) >= need))
    each = both.where(F.size("equal") >= need).select("doc_id", "th", "item_id", "item_words", F.size("equal").alias("matched"), windows.alias("windows")).where("windows > 0")
    return each.groupBy("doc_id", "th", "item_id", "item_words").agg(F.max("matched").alias("matched"), F.sum("windows").cast("long").alias("windows"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which an item was found; every column stays, whatever its name."""
    found = overlaps(docs, benchmark).select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("none"), "th").distinct()
    own = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(own, F.lit(0)).alias("k"), own.isNull().alias("none"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    kept = rows.join(stored(found, "contaminated"), ["k", "none", "th"], "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every item found in a document: doc_id, item_id, item_words, matched, windows."""
    return overlaps(docs, benchmark).select("doc_id", "item_id", "item_words", "matched", "windows")


#: The law itself, without seeds: every alignment of a document and an item that share a word.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
bw AS (SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM b),
m AS (
  SELECT doc_id, item_id, item_words, least(13, item_words) AS width, CAST(ceil(least(13, item_words) * 0.8) AS INTEGER) AS need, pos - q AS shift, list(q ORDER BY q) AS qs
  FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, item_words, pos - q HAVING count(*) >= ceil(least(13, item_words) * 0.8)),
v AS (
  SELECT *, len(list_filter(range(0, item_words - width + 1), lambda i: len(list_filter(qs, lambda x: x >= i AND x < i + width)) >= need)) AS n FROM m)
SELECT doc_id, item_id, CAST(item_words AS INTEGER) AS item_words, CAST(max(len(qs)) AS INTEGER) AS matched, CAST(sum(n) AS BIGINT) AS windows
FROM v WHERE n > 0 GROUP BY doc_id, item_id, item_words
"""
