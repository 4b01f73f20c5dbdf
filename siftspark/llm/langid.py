"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of its own text. A text is compressed against every
one of them, BLOCK bytes at a time so that the dictionary keeps its say in long texts, and the smallest total
names the language. Where the runner-up is within MARGIN of it, the answer is rejected; on equal sizes the
language with more training rows comes first.

What is learned is bounded by rows: of each language the SAMPLE_ROWS rows with the least hash of their id, wherever
they stand, are drawn, and the dictionary is made of as many of them as fit into DICTIONARY bytes, each with its
whole text (texts over a SHARE-th of that only if room is left; if none fits, the shortest drawn one makes the
dictionary, however long). Everything else covers all rows and whole texts. Dictionaries are broadcast.

Before both uses, letters are lower-cased and every run of other characters becomes one space.

Defined results: null, empty and letterless texts are `und` with score 0 and rejected; so is everything if
nothing could be learned; rows without a language teach nothing; rows that repeat teach once; a null id belongs
to no fold and teaches; an empty table gives an empty result; further columns are not read by the query, and
accepted_rows() keeps the columns it gets whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm.common import fold

#: Bytes of a language's dictionary, rows drawn for it, and the part of it that one text may have at first.
DICTIONARY = 98_304
SAMPLE_ROWS = 300
SHARE = 16
BLOCK = 4096
LEVEL = 9
MARGIN = 0.01
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def sample(rows: list[tuple[int, int]], dictionary: int = DICTIONARY) -> list[int]:
    """rows: (draw, bytes). The draws whose texts make the dictionary."""
    chosen, held = [], 0
    for draw, size in sorted(rows, key=lambda r: (r[1] > dictionary // SHARE, r[0])):
        if held + size <= dictionary:
            chosen.append(draw)
            held += size
    return chosen or [min(rows, key=lambda r: (r[1], r[0]))[0]]


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """labelled: doc_id, text, lang. (language, dictionary), the language with most rows first.

    The driver gets a count for each language, the draws and sizes of about twice sample_rows rows of each, and then
    the texts of the rows that are used.
    """
    drawn = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(11)).alias("draw"))
    counts = {r.lang: r["count"] for r in labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample_rows / n))))
    near = drawn.where(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    sizes: dict[str, set[tuple[int, int]]] = {}
    for r in near.select("lang", "draw", F.octet_length("text").alias("size")).collect():
        sizes.setdefault(r.lang, set()).add((r.draw, r.size + 1))
    wanted = {lang: sample(sorted(rows, key=lambda r: (r[0] % (1 << 20), r[0]))[:sample_rows], dictionary) for lang, rows in sizes.items()}
    used = F.create_map(*(x for lang, draws in wanted.items() for x in (F.lit(lang), F.array(*map(F.lit, draws))))) if wanted else None
    texts: dict[str, dict[int, str]] = {}
    for r in near.where(F.array_contains(F.element_at(used, F.col("lang")), F.col("draw"))).collect() if wanted else []:
        texts.setdefault(r.lang, {})[r.draw] = letters(r.text)
    out = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        parts = dict.fromkeys(texts[lang][d] for d in wanted[lang]) if lang in wanted else {}
        if data := "\n".join(t for t in parts if t).encode():
            out.append((lang, data))
    return out


class Classifier:
    """One compressor for each language."""

    def __init__(self, learned: list[tuple[str, bytes]]) -> None:
        self.coders = []
        for lang, data in learned:
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.coders.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score (a half where the margin is just met) and whether it is accepted."""
        plain = letters(text)
        if not self.coders or not any(map(str.isalpha, plain)):
            return UNKNOWN, 0.0, False
        data = plain.encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(coder.compress(b)) for b in blocks) for _, coder in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        gap = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        return self.coders[best][0], gap / (gap + margin), gap >= margin


def identified(rows: DataFrame, learned: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """rows: text and more, none of it named lang_pred, score or accepted, which are added."""
    held = rows.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(held.value)
        for batch in batches:
            found = [classify(t.as_py(), margin) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "accepted"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def accepted_rows(docs: DataFrame, learned: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """docs without the rows that are rejected; every column stays, whatever its name."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return identified(rows, learned, margin).where("accepted").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op1_langid(docs: DataFrame) -> DataFrame:
    """Predicted language of every document; learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    learned = learn(rows.where(~held_out))
    return identified(rows.select("doc_id", "text", held_out.alias("held_out")), learned).select("doc_id", "held_out", "lang_pred", "score", "accepted")
