"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from siftspark.llm import codebooks, decontamination, html_text, langid, lm_scoring, merkle, minhash, mixing, orchard, packing, sharding, simhash, superkmer
from siftspark.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": lambda spark, sf_dir: langid.op1_langid(table(spark, sf_dir, "documents")),
        "op2_lm_scoring": lambda spark, sf_dir: lm_scoring.op2_lm_scoring(table(spark, sf_dir, "documents")),
        "op3_decontamination": lambda spark, sf_dir: decontamination.op3_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op4_token_packing": lambda spark, sf_dir: packing.op4_token_packing(table(spark, sf_dir, "documents")),
        "op5_mixing": lambda spark, sf_dir: mixing.op5_mixing(table(spark, sf_dir, "documents")),
        "op8_html": lambda spark, sf_dir: html_text.op8_html(table(spark, sf_dir, "pages")),
        "op9_sharding": lambda spark, sf_dir: sharding.op9_sharding(table(spark, sf_dir, "documents")),
        "op6_merkle": lambda spark, sf_dir: merkle.op6_merkle(table(spark, sf_dir, "documents")),
        "op7_simhash": lambda spark, sf_dir: simhash.op7_simhash(table(spark, sf_dir, "documents")),
        "op10_substring_dedup": lambda spark, sf_dir: superkmer.op10_substring_dedup(table(spark, sf_dir, "documents")),
        "op11_orchard": lambda spark, sf_dir: orchard.op11_orchard(table(spark, sf_dir, "embeddings")),
        "op12_codebooks": lambda spark, sf_dir: codebooks.op12_codebooks(table(spark, sf_dir, "embeddings")),
        "op13_minhash": lambda spark, sf_dir: minhash.op13_minhash(table(spark, sf_dir, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontamination.OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op6_merkle": merkle.OP6_SQL, "op11_orchard": orchard.OP11_SQL, "op12_codebooks": codebooks.OP12_SQL, "op13_minhash": minhash.OP13_SQL}
