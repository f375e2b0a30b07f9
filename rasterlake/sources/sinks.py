"""Writers of metric rows, summaries, logs, manifests and images.  All but the images are Spark writers; none leaves a partial file after a failed task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..operators.manifest import upsert
from .files import write_files
from .rasters import png, resized


def _sane(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _sane(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _sane(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_sane(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def sanitised(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null, also within structs, lists and maps."""
    return df.select(*[_sane(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_rows(df: DataFrame, path: str) -> None:
    """One CSV row for each image, with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """Summaries as JSON without non-finite numbers; nulls stay as fields."""
    sanitised(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_split(df: DataFrame, path: str, split: str = "split", kept: tuple[str, ...] = ("mainaxis", "stresstest")) -> None:
    """A folder for each split; rows of any other split are not written."""
    df.filter(F.col(split).isin(*kept)).write.mode("overwrite").partitionBy(split).csv(path, header=True)


def append_lines(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def rewrite_manifest(old: DataFrame | None, new: DataFrame, path: str, keys: list[str], seq: str) -> None:
    """The upserted manifest as a new snapshot; ``path`` must not be the one that ``old`` is read from."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    upsert(both, keys, seq).write.mode("errorifexists").parquet(path)


#: Records of a manifest that is one list.
MOST_RECORDS = 100_000


def manifest_rows(df: DataFrame) -> DataFrame:
    """Records cut to (sample_id, image_path, physical_properties), a row each."""
    return df.select("sample_id", "image_path", "physical_properties")


def manifest_projection(df: DataFrame) -> DataFrame:
    """Such records as one list, for a small manifest; over ``MOST_RECORDS`` it raises: write ``manifest_rows`` instead."""
    if df.limit(MOST_RECORDS + 1).count() > MOST_RECORDS:
        raise ValueError(f"a manifest of one list holds at most {MOST_RECORDS} records")
    return manifest_rows(df).groupBy().agg(F.array_sort(F.collect_list(F.struct("sample_id", "image_path", "physical_properties"))).alias("records"))


def failure_rows(df: DataFrame, error: str = "error") -> DataFrame:
    """What is logged of failed scenes: scene, images, error."""
    return df.filter(F.col(error).isNotNull()).select("scene", "images", error)


def write_metrics(df: DataFrame, path: str) -> None:
    """A run's metrics as JSON and as a one-row summary."""
    write_summary(df, f"{path}/metrics")
    write_rows(df, f"{path}/summary")


def write_images(
    df: DataFrame, root: str, raster: str | None = "raster", content: str | None = None, path: str = "path", size: tuple[int, int] | None = None, overwrite: bool = True
) -> dict[str, int]:
    """A PNG file below ``root`` for each row: of a raster struct (resized to (height, width) where a size is given), or of bytes that are an image already.

    Encoded and written in tasks (``files.write_files``); rows without a raster or bytes
    write none.  Returns the numbers of ``files`` and ``bytes`` written and of files ``kept``.
    """
    if content is not None:
        made = F.col(content)
    else:
        image = F.col(raster) if size is None else resized(F.col(raster), *size)
        made = png(image)
        df = df.filter(F.col(f"{raster}.data").isNotNull())  # a Python function in a branch would run for all rows
    return write_files(df.select(path, made.alias("__content")), root, path, "__content", overwrite)
