"""Documents that describe other things: schemas, contracts between services, ledgers of accepted debt, settings.

files: path, text. A document that can't be read gives no rows; so does an entry that is not as it should be.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.session import importable


def _parsed(files: DataFrame) -> DataFrame:
    return files.where(F.endswith(F.lower("path"), F.lit(".json"))).withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL")


def schemas(files: DataFrame) -> DataFrame:
    """path, name and fields of the schemas in JSON documents: the document itself if it has a title, components.schemas, and $defs or else definitions. Properties that are no object make no schema."""
    docs = _parsed(files)
    as_map = lambda p: F.try_variant_get("v", p, "map<string,variant>")
    none = F.array().cast("array<struct<key:string,value:variant>>")
    entries = lambda m: F.coalesce(F.map_entries(m), none)
    title = F.try_variant_get("v", "$.title", "string")
    own = F.when(title.isNotNull() & as_map("$.properties").isNotNull(), F.array(F.struct(title.alias("key"), F.col("v").alias("value")))).otherwise(none)
    named = docs.select("path", F.explode(F.concat(own, entries(as_map("$.components.schemas")), entries(F.coalesce(as_map('$["$defs"]'), as_map("$.definitions"))))).alias("s"))
    fields = F.map_keys(F.try_variant_get(F.col("s.value"), "$.properties", "map<string,variant>"))
    return named.select("path", F.col("s.key").alias("name"), fields.alias("fields")).where("fields IS NOT NULL")


def schema_fields(files: DataFrame) -> DataFrame:
    """path, name and field of every property of the schemas in JSON documents."""
    return schemas(files).select("path", "name", F.explode("fields").alias("field"))


def first_of_name(models: DataFrame) -> DataFrame:
    """models: name, field, path. The fields of each name as its first file has them."""
    first = models.groupBy("name").agg(F.min("path").alias("path"))
    return models.join(first, ["name", "path"], "left_semi").select("name", "field").distinct()


def pact_files(files: DataFrame) -> DataFrame:
    """Paths of JSON documents with a consumer, a provider and interactions."""
    has = lambda p, kind: F.try_variant_get("v", p, kind).isNotNull()
    return _parsed(files).where(has("$.consumer", "map<string,variant>") & has("$.provider", "map<string,variant>") & has("$.interactions", "array<variant>")).select("path")


def local_schemas(files: DataFrame) -> DataFrame:
    """path and schema: documents whose $schema names another of the files; addresses with a scheme are left alone, and so is what lies outside."""
    in_json = F.when(F.endswith(F.lower("path"), F.lit(".json")), F.try_variant_get(F.try_parse_json("text"), '$["$schema"]', "string"))
    in_text = F.nullif(F.regexp_extract("text", r"(?m)^\s*\$schema\s*:\s*[\"']?([^\"'\s#]+)", 1), F.lit(""))
    refs = files.select("path", F.coalesce(in_json, in_text).alias("ref")).where("ref IS NOT NULL").where(~F.col("ref").rlike(r"(?i)^[a-z][a-z0-9+.-]*://"))
    folder = F.regexp_replace(F.concat(F.lit("/"), "path"), "/[^/]*$", "")
    steps = F.filter(F.split(F.concat_ws("/", folder, "ref"), "/"), lambda x: (x != "") & (x != "."))
    walk = F.aggregate(steps, F.array(F.lit("ok")), lambda at, x: F.when(x != "..", F.concat(at, F.array(x))).when(F.size(at) > 1, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(F.array(F.lit("out"))))
    there = refs.withColumn("walk", walk).where(F.get("walk", F.lit(0)) == "ok").select("path", F.array_join(F.slice("walk", F.lit(2), F.size("walk")), "/").alias("schema"))
    return there.join(files.select(F.col("path").alias("schema")).distinct(), "schema", "left_semi").select("path", "schema")


def toml_values(files: DataFrame) -> DataFrame:
    """path and json: TOML documents as JSON, one row each; what is no TOML is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, values = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                try:
                    value = json.dumps(tomllib.loads(text or ""), default=str)
                except tomllib.TOMLDecodeError:
                    continue
                paths.append(path)
                values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], ["path", "json"])

    importable(files.sparkSession)
    return files.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "path string, json string")


def ledger_entries(files: DataFrame) -> DataFrame:
    """path, entry_ord, signal, paths and count of the [[debt]] tables; entries without a signal, paths or a whole count are left out."""
    entries = toml_values(files).select("path", F.posexplode(F.try_variant_get(F.try_parse_json("json"), "$.debt", "array<variant>")).alias("entry_ord", "e"))
    get = lambda p, kind: F.try_variant_get("e", p, kind)
    rows = entries.select("path", F.col("entry_ord").cast("long"), get("$.signal", "string").alias("signal"), get("$.paths", "array<string>").alias("paths"), get("$.count", "int").alias("count"))
    return rows.where("signal <> '' AND paths IS NOT NULL AND count IS NOT NULL")


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """base, overlay: key (dotted), value. Settings with the overlay's values in place of the base's; tables are merged key by key."""
    keys = overlay.select("key").distinct()
    # a plain value in one replaces a table in the other
    kept = base.join(keys, "key", "left_anti")
    parents = overlay.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\."))), lambda n: F.array_join(F.slice(F.split("key", r"\."), F.lit(1), n), "."))).alias("key")).distinct()
    kept = kept.join(parents, "key", "left_anti")
    ups = kept.select("key", "value", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\."))), lambda n: F.array_join(F.slice(F.split("key", r"\."), F.lit(1), n), "."))).alias("up"))
    hit = ups.join(keys.withColumnRenamed("key", "up"), "up", "left_semi").select("key").distinct()
    return kept.join(hit, "key", "left_anti").unionByName(overlay.select("key", "value"))
