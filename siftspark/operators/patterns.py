"""Many names sought in many texts at once, inside words as well.

Up to MOST names (their number and bytes are counted first) are one automaton, which each task builds once and runs
over its texts: every text is read once, whatever the number of names. More names than that meet the texts by pieces
of GRAM characters instead: a name goes by the piece that fewest texts have, a name that has a piece which no text has
is out, and only texts with its piece are searched for it. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.session import stored

MOST, MOST_BYTES, GRAM = 200_000, 8_000_000, 5


def occurring(names: DataFrame, texts: DataFrame, most: int = MOST) -> DataFrame:
    """names: name; texts: text. The names that stand in some text, each once. Null names and texts are left out, and so is the empty name."""
    names = names.select("name").where("name <> ''").distinct()
    count, size = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    texts = texts.select("text").where("text <> ''")
    if count <= most and size <= MOST_BYTES:
        return _by_automaton([r.name for r in names.collect()], texts)
    return _by_pieces(names, texts)


def _by_automaton(names: list[str], texts: DataFrame) -> DataFrame:
    """names: at most MOST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        found: set[str] = set()
        for batch in batches:
            for text in batch.column("text"):
                found.update(name for _, name in automaton.iter(text.as_py()))
                if len(found) == len(names):
                    break
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["name"])

    if not names:
        return texts.limit(0).select(F.col("text").alias("name"))
    return texts.mapInArrow(run, "name string").distinct()


def _pieces(of: Column) -> Column:
    """Different pieces of GRAM characters; a shorter text is one piece."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(of) - (GRAM - 1), F.lit(1))), lambda i: F.substring(of, i, F.lit(GRAM))))


def _by_pieces(names: DataFrame, texts: DataFrame) -> DataFrame:
    texts = stored(texts.distinct().withColumn("id", F.xxhash64("text")), "texts")
    short, long = names.where(F.length("name") < GRAM), names.where(F.length("name") >= GRAM)
    lengths = F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, n)))
    here = short.join(texts.select(F.explode(F.array_distinct(F.flatten(lengths))).alias("name")).distinct(), "name", "left_semi")
    in_texts = stored(texts.select("id", F.explode(_pieces(F.col("text"))).alias("piece")), "pieces")
    counts = in_texts.groupBy("piece").agg(F.count("*").alias("n"))
    of_names = long.select("name", F.explode(_pieces(F.col("name"))).alias("piece")).join(counts, "piece", "left")
    rarest = of_names.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0").select("name", "r.piece")
    meeting = rarest.join(in_texts, "piece").select("name", "id").join(texts, "id").where(F.contains("text", F.col("name")))
    return here.unionByName(meeting.select("name").distinct())
