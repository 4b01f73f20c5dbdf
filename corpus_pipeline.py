"""From raw documents to packed token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage returns to the shared folder as
Parquet and reads it again for the next one. All but the last return the columns of documents.

1. language: a compression classifier learns from the rows with a language; documents that it rejects go. It
   rejects texts without letters and those for which two languages come out within its margin.
2. near_duplicates: texts whose sets of five-word shingles are about 0.8 similar or more, by their fingerprints;
   of each group the document with the smallest id stays.
3. benchmark: documents in which a benchmark item is found go.
4. mix: sources are brought to their target weights; rows repeat as often as they are taken.
5. tokens: the texts as packed rows of token ids.

Nulls, empty and very long texts, repeated rows and empty tables are handled as the operators in siftspark.llm say:
texts that are null, empty or without letters go with the first stage. All but the last stage keep every column of
documents, whatever further columns there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm import decontamination, langid, mixing, packing, simhash
from siftspark.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted_rows(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs, words=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("tokens", tokens)]

#: Fingerprints, compressed sizes and token ids have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
