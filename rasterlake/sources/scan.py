"""Scans of image folders: paths first, bytes after matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.matching import preferred_class
from .files import list_files, qualified, reachable, read_files

# fixed values: extensions of images
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")


def files(spark: SparkSession, root: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path`` (relative to the root), ``location`` and ``length`` of the files with an extension, in any case; empty files are not listed."""
    base = qualified(spark, root)
    if reachable(base):
        found = list_files(spark, base, recursive)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select(F.col("path").alias("location"), "length")
    out = found.withColumn("path", F.expr(f"substring(location, {len(base) + 2})"))
    return out.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).select("path", "location", "length")


def with_suffix(rows: DataFrame, suffix: str) -> DataFrame:
    """Files whose name ends with a suffix; an empty result raises."""
    out = rows.filter(F.col("path").endswith(suffix))
    if out.isEmpty():
        raise FileNotFoundError(f"no file ends with {suffix}")
    return out


def preferred_inputs(rows: DataFrame, per_folder: bool = True, staged: bool = False) -> DataFrame:
    """Per folder (or in all) only ``*_im.png`` files where there are any, else ``Image_*.png``; with ``staged``, those at the top come before deeper ones."""
    name = F.lower(P.name(F.col("path")))
    deep = F.when(F.lit(staged) & F.col("path").contains("/"), 1).otherwise(0)
    rank = F.when(name.endswith("_im.png"), F.lit(0) + deep).when(name.startswith("image_") & name.endswith(".png"), F.lit(2) + deep)
    return preferred_class(rows.withColumn("__folder", P.parent(F.col("path")) if per_folder else F.lit("")), "__folder", rank).drop("__folder")


def by_mode(rows: DataFrame, segmented: bool) -> DataFrame:
    """In segmentation mode only stems that end with ``_im``."""
    return rows.filter(P.stem(F.col("path")).endswith("_im")) if segmented else rows


def by_format(rows: DataFrame, kind: str = "auto") -> DataFrame:
    """Ground truth of one raw format (dat or exr), or of both."""
    if kind not in ("auto", "dat", "exr"):
        raise ValueError("kind must be auto, dat or exr")
    return rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*(("dat", "exr") if kind == "auto" else (kind,))))


def scenes(rows: DataFrame) -> DataFrame:
    """Sub-folders at the top, each once."""
    return rows.filter(F.col("path").contains("/")).select(F.element_at(P.parts(F.col("path")), 1).alias("scene")).distinct()


def folders(rows: DataFrame) -> DataFrame:
    """Distinct folders that hold a file."""
    return rows.select(P.parent(F.col("path")).alias("folder")).distinct()


def completed(rows: DataFrame) -> DataFrame:
    """Outputs that exist and are not empty."""
    return rows.filter("length > 0")


def contents(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Bytes of chosen files, opened in the tasks that the files are dealt to; no other file is opened and no name passes through the driver.

    Of a file system that tasks can't open by themselves, the whole root is scanned by Spark and joined.
    """
    if reachable(root):
        return read_files(rows)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.join(scan.select(F.col("path").alias("location"), "content"), "location")
