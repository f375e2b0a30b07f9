"""The star-schema tables read as maps and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_maps(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """Triples of 8 x 8 maps: ground truth, the next vector as its prediction, the one after as its mask (positive values).

    Equi-joins on the id; columns ``image``, ``category``, ``scene``, ``gt``, ``pred``, ``valid``.
    """
    e = table(spark, sf_dir, "embeddings")
    lift = lambda c: F.transform(c, lambda v: v.cast("double") + shift)
    gt = e.select(F.col("vec_id").alias("image"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), (F.col("vec_id") % 20).alias("scene"), lift("embedding").alias("gt"))
    pred = e.select((F.col("vec_id") - 1).alias("image"), lift("embedding").alias("pred"))
    mask = e.select((F.col("vec_id") - 2).alias("image"), F.transform("embedding", lambda v: v > 0).alias("valid"))
    return gt.join(pred, "image").join(mask, "image")


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large pixel table: image by part, with values in 0..1 and a mask."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("image"), (F.col("l_quantity") / 50).alias("gt"), (F.col("l_discount") * 10).alias("pred"), (F.col("l_tax") > 0.02).alias("valid"))
