"""Tolerant and strict reads of JSON and text files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.matching import keep_last
from .files import list_files, qualified, reachable, read_files
from .staging import staged

RECORD = "struct<sample_id:string,image_path:string,physical_properties:struct<albedo:string,roughness:double,metallic:double>,metadata:map<string,string>>"
CONFIG_KEYS = ("dataset", "model", "train", "eval", "output_dir", "seed")


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and whole ``text`` of files, trimmed; unreadable bytes replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.trim(F.expr("try_validate_utf8(cast(content as string))")).alias("text")).withColumn("text", F.coalesce("text", F.lit("")))


def parsed_object(text: Column, schema: str) -> Column:
    """The object, with nulls for whatever is missing or malformed."""
    return F.from_json(text, schema)


def parsed_list(text: Column, item: str) -> Column:
    """The list, empty if malformed."""
    return F.coalesce(F.from_json(text, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def records(rows: DataFrame, text: str = "text") -> DataFrame:
    """Annotation records; one without a required key raises, missing metadata is empty."""
    r = F.from_json(F.col(text), RECORD)
    out = rows.select(r.alias("r")).select("r.*")
    bad = F.col("sample_id").isNull() | F.col("image_path").isNull() | F.col("physical_properties").isNull()
    return out.withColumn(
        "sample_id", F.when(bad, F.raise_error(F.lit("record without a required key")).cast("string")).otherwise(F.col("sample_id"))
    ).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def missing_config_keys(text: Column) -> Column:
    """Required keys that a configuration lacks."""
    return F.array_compact(F.array(*[F.when(F.get_json_object(text, f"$.{k}").isNull(), k) for k in CONFIG_KEYS]))


def checked_configs(rows: DataFrame, text: str = "text") -> DataFrame:
    """Configurations; one that lacks required keys raises."""
    missing = missing_config_keys(F.col(text))
    failed = F.raise_error(F.concat(F.lit("missing config keys: "), F.array_join(missing, ", "))).cast("boolean")
    return rows.filter(F.when(F.size(missing) > 0, failed).otherwise(True))


def manifest_entries(rows: DataFrame, text: str = "text", key: str = "relative_image_path") -> DataFrame:
    """Entries of manifests (JSON lists) as ``key`` and ``entry``; of equal keys the last."""
    out = rows.select("path", F.posexplode(parsed_list(F.col(text), "string")).alias("place", "entry"))
    return keep_last(out.withColumn(key, F.get_json_object("entry", f"$.{key}")).filter(F.col(key).isNotNull()), [key], "path", "place").select(key, "entry")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Every ``metrics.json`` below a folder, by group and run.

    Files that tasks can reach are listed and opened in tasks, once: what follows, such as
    the finding of the schema, reads the staged bytes.
    """
    root = qualified(spark, path)
    if reachable(root):
        named = list_files(spark, root).filter(F.element_at(P.parts(F.col("location")), -1) == "metrics.json")
        read = staged(read_files(named).select("content"), "contents")
        found = spark.read.json(read.rdd.map(lambda r: bytes(r[0]).decode(json.detect_encoding(r[0]), "replace")))
    else:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.json").option("multiLine", "true").json(path)
    return found.orderBy("exp_group", "run_name")


def split_members(rows: DataFrame, text: str = "text") -> DataFrame:
    """(split, sample_id) of split files; splits may overlap."""
    return rows.select(F.explode(F.from_json(F.col(text), "map<string,array<string>>")).alias("split", "ids")).select("split", F.explode("ids").alias("sample_id"))
