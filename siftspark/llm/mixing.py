"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Every source has a weight. The whole volume is shared out by weight; a source whose share passes EPOCHS times
its own volume is clamped there and the excess goes to the others by weight, until nobody is above. In order of
cap over weight the clamped sources come first, so prefix sums find that fixed point without a loop.

A target is whole epochs plus a part of one. Documents of the part are those whose seeded digest comes first:
two histograms of digests for each source (4096 bins, then 4096 within the bin where the target falls) find the
digest at which the part is full. The documents that share this digest of the id, as those without an id do, are
split by one of the text in the same way. So no source is ever sorted or gathered, and the words taken miss the
target by half of the words that share both 24-bit digests at most.

Weights belong to sources in code point order, null last: WEIGHTS, repeating.

Defined results: null text has size 0; a source of size 0 has target 0 and takes nothing; a null source is a
source of its own; equal ids draw equal lots; a null id draws one lot too; rows of one lot are told apart by their
texts only, so rows equal in both win or lose together; rows that repeat count each; an empty table gives an empty result; mixed() keeps every column it gets, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17


def lot(seed: int) -> Column:
    """24 seeded bits of the id, as 6 hex digits."""
    return F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 6)


def tie(seed: int) -> Column:
    """24 seeded bits of the text, as 6 hex digits, for rows of one lot."""
    return F.substring(F.lpad(F.hex(F.xxhash64(F.col("text").cast("string"), F.lit(seed))), 16, "0"), 1, 6)


def source_key() -> Column:
    """The source as a key without nulls that sorts as sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sized: sk, size. One row for each source: source_size, target."""
    sources = sized.groupBy("sk").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("sk"))
    weighted = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = weighted.select(
        "sk",
        "source_size",
        "cap",
        "weight",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    clamped = left.withColumn("clamped", F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight"))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    free_words = F.max(F.when(~F.col("clamped"), F.col("words_left"))).over(every)
    free_weight = F.max(F.when(~F.col("clamped"), F.col("weight_left"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(free_words.cast("double") * F.col("weight") / free_weight)
    return clamped.select("sk", "source_size", target.alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """sized: doc_id, sk, size, tie. For each source its target, whole epochs, and the lots, and ties of the last one, that win one more."""
    whole = F.coalesce(F.least(F.lit(epochs), F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))), F.lit(0)).cast("int")
    shares = stored(targets(sized, weights, epochs).withColumn("whole", whole).withColumn("part", F.col("target") - whole * F.col("source_size")), "targets")
    drawn = sized.select("sk", "size", F.substring(lot(seed), 1, 3).alias("high"), lot(seed).alias("lot"), F.substring("tie", 1, 3).alias("high_tie"), "tie")

    def passed(bins: DataFrame, goals: DataFrame, digits: str) -> DataFrame:
        """The bin with which each source passes its goal; `ahead` is what the bins before it hold."""
        upto = F.sum("held").over(W.partitionBy("sk").orderBy(digits))
        over = bins.withColumn("upto", upto).join(goals, "sk").where(F.col("upto") > F.col("part"))
        first = over.groupBy("sk").agg(F.min_by(F.struct(digits, "held", "upto", "part"), digits).alias("f"))
        return first.select("sk", f"f.{digits}", "f.held", (F.col("f.part") - (F.col("f.upto") - F.col("f.held"))).alias("part"))

    high = stored(passed(drawn.groupBy("sk", "high").agg(F.sum("size").alias("held")), shares.select("sk", "part"), "high"), "high-lots")
    near = drawn.join(high.select("sk", "high"), ["sk", "high"], "left_semi")
    low = stored(passed(near.groupBy("sk", "lot").agg(F.sum("size").alias("held")), high.select("sk", "part"), "lot"), "low-lots")
    edge_rows = stored(near.join(low.select("sk", "lot"), ["sk", "lot"], "left_semi").groupBy("sk", "high_tie", "tie").agg(F.sum("size").alias("held")), "edge-lots")
    high_tie = passed(edge_rows.groupBy("sk", "high_tie").agg(F.sum("held").alias("held")), low.select("sk", "part"), "high_tie")
    last = passed(edge_rows.join(high_tie.select("sk", "high_tie"), ["sk", "high_tie"], "left_semi"), high_tie.select("sk", "part"), "tie")
    last = last.select("sk", F.col("tie").alias("edge_tie"), (F.col("part") * 2 >= F.col("held")).alias("edge_wins"))
    low = low.select("sk", F.col("lot").alias("edge_lot")).join(last, "sk")
    # a source without a part takes no more than its whole epochs
    edge = F.when(F.col("part") > 0, F.coalesce("edge_lot", F.lit(""))).otherwise("")
    return stored(shares.join(low, "sk", "left").select("sk", "source_size", "target", "whole", edge.alias("edge_lot"), F.coalesce("edge_tie", F.lit("")).alias("edge_tie"), F.coalesce("edge_wins", F.lit(False)).alias("edge_wins")), "mixing-plan")


def with_copies(rows: DataFrame, shares: DataFrame, seed: int = SEED) -> DataFrame:
    """rows: doc_id, sk, tie and more. Adds copies, how often the mix takes the row, and its source's source_size and target."""
    taken = F.col("whole") + ((lot(seed) < F.col("edge_lot")) | ((lot(seed) == F.col("edge_lot")) & ((F.col("tie") < F.col("edge_tie")) | ((F.col("tie") == F.col("edge_tie")) & F.col("edge_wins"))))).cast("int")
    return rows.join(shares, "sk").withColumn("copies", taken).drop("sk", "tie", "whole", "edge_lot", "edge_tie", "edge_wins")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), source_key().alias("sk"), word_count(F.col("text")).alias("size"), tie(seed).alias("tie"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    shares = plan(stored(sizes(docs, seed), "sizes"), weights, epochs, seed)
    rows = docs.select("doc_id", source_key().alias("sk"), tie(seed).alias("tie"), F.struct(*docs.columns).alias("row"))
    taken = with_copies(rows, shares, seed).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("again"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of every document."""
    sized = stored(sizes(docs), "sizes")
    return with_copies(sized, plan(sized)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 6) AS lot
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM w),
c AS (SELECT *, cap * weight_left <= words_left * weight AS clamped FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(max(CASE WHEN NOT clamped THEN words_left END) OVER () AS DOUBLE) * weight / max(CASE WHEN NOT clamped THEN weight_left END) OVER () END AS target
  FROM c),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END AS whole FROM t),
l AS (
  SELECT d.source, lot, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY lot) AS upto
  FROM d GROUP BY d.source, lot),
e AS (
  SELECT l.source, lot, l.upto <= part OR (l.upto > part AND l.upto - l.held <= part AND (part - (l.upto - l.held)) * 2 >= l.held) AS wins
  FROM l JOIN (SELECT source, target - whole * source_size AS part FROM p) q ON l.source IS NOT DISTINCT FROM q.source)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.whole + CAST(e.wins AS INT)) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.lot = d.lot
"""
