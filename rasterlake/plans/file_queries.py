"""Registered queries over files: scans, decoders, JSON reads and sinks, each with its SQL.

Each query writes a small file for every supplier to the shared folder, in tasks, with
names and contents that the SQL can work out, so its work grows with the table.
"""

from __future__ import annotations

import io
import json
import struct
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources import json_files, rasters, scan, sinks, staging
from ..sources.files import delete_folder, write_files, write_made
from ..sources.tables import embedding_maps, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 5).cast("int").alias("region"))


def made_files(spark: SparkSession, sf_dir: str, make, name, chosen: Column | None = None) -> str:
    """A folder with a file for every supplier (or every ``chosen`` one), made and written in tasks: ``make`` and ``name`` (or a pattern) take key, name and region."""
    named = name if callable(name) else lambda k, n, r: name.format(k=k, name=n.replace("#", "_"), region=r)
    root = staging.new_folder(spark)
    rows = suppliers(spark, sf_dir) if chosen is None else suppliers(spark, sf_dir).filter(chosen)
    write_made(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k"), lambda *x: (named(*x), make(*x)), root)
    return root


# names

EXTENSION = {4: ".PNG", 5: ".jpg", 6: ".txt"}
NAMES = """
n AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN 'r' || (s_nationkey % 5) || '/s' || s_suppkey % 3 || '/' ELSE '' END AS folder,
         CASE s_suppkey % 4 WHEN 1 THEN 'Image_' ELSE '' END || replace(s_name, '#', '_') || CASE s_suppkey % 4 WHEN 0 THEN '_im' WHEN 2 THEN '_depth' ELSE '' END AS stem,
         CASE s_suppkey % 7 WHEN 4 THEN '.PNG' WHEN 5 THEN '.jpg' WHEN 6 THEN '.txt' ELSE '.png' END AS ext FROM supplier
), f AS (SELECT k, folder, stem, lower(stem || ext) AS low, folder || stem || ext AS path FROM n WHERE ext <> '.txt')"""


def file_name(k: int, name: str, region: int) -> str:
    folder = f"r{region}/s{k % 3}/" if k % 5 else ""
    stem = ("Image_" if k % 4 == 1 else "") + name.replace("#", "_") + {0: "_im", 2: "_depth"}.get(k % 4, "")
    return f"{folder}{stem}{EXTENSION.get(k % 7, '.png')}"


def named_files(spark, sf_dir) -> DataFrame:
    """A file of one byte for every supplier: for results that have names alone."""
    return scan.files(spark, made_files(spark, sf_dir, lambda k, n, r: b"x", file_name))


#: Bytes of sized files that are on disk at a time, about.
PORTION = 4 << 30


def sized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of k + 1 bytes for every supplier.

    Such files grow with the square of the table.  So a portion of the suppliers is
    written, what is found there is staged, and the files go before the next portion.
    """
    total = suppliers(spark, sf_dir).agg(F.coalesce(F.sum(F.col("k").cast("long") + 1), F.lit(0))).first()[0]
    parts, found = total // PORTION + 1, []
    for i in range(parts):
        if found:
            delete_folder(root)
        root = made_files(spark, sf_dir, lambda k, n, r: b"x" * (k + 1), file_name, F.pmod(F.hash("k"), F.lit(parts)) == i)
        found.append(staging.staged(scan.files(spark, root), "portion"))
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {NAMES} SELECT path, (k + 1)::BIGINT AS length FROM f")
def scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.completed(sized_files(spark, sf_dir)).select("path", "length")


@query(f"WITH {NAMES} SELECT path FROM f WHERE path LIKE '%\\_im.png' ESCAPE '\\'")
def scan_with_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_suffix(named_files(spark, sf_dir), "_im.png").select("path")


_RANK = "CASE WHEN ends_with(low, '_im.png') THEN 0 WHEN starts_with(low, 'image_') AND ends_with(low, '.png') THEN 2 END"


@query(f"WITH {NAMES}, q AS (SELECT path, folder, {_RANK} AS rank FROM f) SELECT path FROM q WHERE rank = (SELECT min(rank) FROM q b WHERE b.folder = q.folder)")
def scan_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.preferred_inputs(named_files(spark, sf_dir)).select("path")


@query(f"""
WITH {NAMES}, q AS (SELECT path, {_RANK} + CASE WHEN folder <> '' THEN 1 ELSE 0 END AS rank FROM f WHERE NOT ends_with(low, '_im.png')) SELECT path FROM q
       WHERE rank = (SELECT min(rank) FROM q)
""")
def scan_preferred_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without files that end with _im, the next class is that of Image_ at the top, then deeper."""
    rows = named_files(spark, sf_dir).filter(~F.lower("path").endswith("_im.png"))
    return scan.preferred_inputs(rows, per_folder=False, staged=True).select("path")


@query(f"WITH {NAMES} SELECT path FROM f WHERE ends_with(stem, '_im')")
def scan_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_mode(named_files(spark, sf_dir), True).select("path")


@query(f"WITH {NAMES} SELECT DISTINCT split_part(path, '/', 1) AS scene FROM f WHERE folder <> ''")
def scan_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scenes(named_files(spark, sf_dir))


@query(f"WITH {NAMES} SELECT DISTINCT rtrim(folder, '/') AS folder FROM f")
def scan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.folders(named_files(spark, sf_dir))


@query(f"WITH {NAMES} SELECT path, repeat('x', k + 1) AS text FROM f WHERE ends_with(path, '.jpg')")
def scan_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the matched files alone; the others, which are not opened, hold one byte."""
    root = made_files(spark, sf_dir, lambda k, n, r: b"x" * (k + 1 if EXTENSION.get(k % 7) == ".jpg" else 1), file_name)
    chosen = scan.files(spark, root).filter(F.col("path").endswith(".jpg"))
    return scan.contents(spark, chosen, root).select("path", F.col("content").cast("string").alias("text"))


# rasters: 4 x 6 images of (31 k + 17 y + 7 x + 3 c) mod 256

H, W = 4, 6
PIXELS = f"p AS (SELECT s_suppkey AS k, y, x, c, (31 * s_suppkey + 17 * y + 7 * x + 3 * c) % 256 AS v FROM supplier, range({H}) a(y), range({W}) b(x), range(3) d(c))"
GRAY = f"g AS (SELECT k, y, x, floor((299 * max(v) FILTER (WHERE c = 0) + 587 * max(v) FILTER (WHERE c = 1) + 114 * max(v) FILTER (WHERE c = 2) + 500) / 1000) AS v FROM p GROUP BY k, y, x)"
GT = f"z AS (SELECT s_suppkey AS k, y, x, (s_suppkey % 25 + 1) * 0.5 + y + x * 0.25 AS v FROM supplier, range({H}) a(y), range({W}) b(x))"


def image(k: int, channels: int = 3) -> np.ndarray:
    y, x, c = np.mgrid[0:H, 0:W, 0:channels]
    return ((31 * k + 17 * y + 7 * x + 3 * c) % 256).astype(np.uint8)


def depths(k: int) -> np.ndarray:
    y, x = np.mgrid[0:H, 0:W]
    return (k % 25 + 1) * 0.5 + y + x * 0.25


def bitmap(pixels: np.ndarray) -> bytes:
    rows = b"".join(row.tobytes() + bytes(-row.size % 4) for row in pixels[::-1, :, ::-1])
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, pixels.shape[1], pixels.shape[0], 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def raster_files(spark, sf_dir, make, extension: str) -> DataFrame:
    root = made_files(spark, sf_dir, lambda k, n, r: make(k), f"{{k}}.{extension}")
    rows = scan.files(spark, root, extensions=(extension,))
    return scan.contents(spark, rows, root).select(F.regexp_extract("path", r"^(\d+)", 1).cast("int").alias("k"), "content")


def pixel_rows(rows: DataFrame, raster: str = "r") -> DataFrame:
    """``k``, ``y``, ``x``, ``c`` and ``v`` of every value."""
    size = F.col(f"{raster}.width") * F.col(f"{raster}.channels")
    out = rows.select("k", size.alias("s"), F.col(f"{raster}.channels").alias("n"), F.posexplode(f"{raster}.data").alias("i", "v"))
    return out.select("k", F.expr("i div s").alias("y"), F.expr("i % s div n").alias("x"), F.expr("i % n").cast("long").alias("c"), (F.round("v", 6) + 0.0).alias("v"))


def decoded_files(spark, sf_dir, make, extension: str, kind: str) -> DataFrame:
    return raster_files(spark, sf_dir, make, extension).select("k", rasters.decoded(F.col("content"), kind).alias("r"))


def png(k: int) -> bytes:
    return rasters.encode_png(image(k))


@query(f"WITH {PIXELS} SELECT k, y, x, c, round(v / 255, 6) + 0.0 AS v FROM p")
def read_rgb_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(decoded_files(spark, sf_dir, png, "png", "rgb"))


@query(f"WITH {PIXELS} SELECT k, y, x, c, round(v / 255, 6) + 0.0 AS v FROM p")
def read_rgb_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(decoded_files(spark, sf_dir, lambda k: bitmap(image(k)), "bmp", "rgb"))


@query(f"WITH {PIXELS}, {GRAY} SELECT k, y, x, 0::BIGINT AS c, round(v / 255, 6) + 0.0 AS v FROM g")
def read_gray_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(decoded_files(spark, sf_dir, png, "png", "gray"))


@query(f"WITH {PIXELS} SELECT k, y, x, 0::BIGINT AS c, v::DOUBLE AS v FROM p WHERE c = 0")
def read_depth_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(decoded_files(spark, sf_dir, lambda k: rasters.encode_png(image(k, 1)[..., 0]), "png", "depth"))


def npy(k: int) -> bytes:
    out = io.BytesIO()
    np.save(out, depths(k)[..., None] if k % 2 else depths(k) if k % 3 else depths(k)[:, :, None, None].repeat(2, 3))
    return out.getvalue()


@query(f"""
WITH {GT} SELECT k, y, x, round(v, 6)::DOUBLE AS v, NULL AS error FROM z WHERE k % 2 = 1 OR k % 3 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL, NULL,
       'ValueError: expected a 2-D array, found shape (4, 6, 2)' FROM supplier WHERE s_suppkey % 6 = 0
""")
def read_npy_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of one channel, and those that aren't, with the error in place of values."""
    rows = decoded_files(spark, sf_dir, npy, "npy", "npy")
    good = pixel_rows(rows.filter("r.error is null")).select("k", "y", "x", "v", F.lit(None).cast("string").alias("error"))
    return good.unionByName(rows.filter("r.error is not null").select("k", F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("double").alias("v"), "r.error"))


def dat(k: int) -> bytes:
    return struct.pack("<II", H, W + (k % 5 == 0)) + (depths(k) * (1000 if k % 2 else 1)).astype("<f4").tobytes()


@query(f"""
WITH {GT} SELECT k, y, x, v::DOUBLE AS v, NULL AS error FROM z WHERE k % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, NULL, NULL,
       'ValueError: header says 4 x 7, the file has 24 values' FROM supplier WHERE s_suppkey % 5 = 0
""")
def read_dat_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw depths with a header; millimetres are recognised, a wrong size is an error of that file alone."""
    rows = decoded_files(spark, sf_dir, dat, "dat", "dat")
    metres = rows.filter("r.error is null").select("k", F.col("r").withField("data", rasters.depth_in_metres(F.col("r.data"))).alias("r"))
    good = pixel_rows(metres).select("k", "y", "x", F.round("v", 6).alias("v"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(rows.filter("r.error is not null").select("k", F.lit(None).cast("long").alias("y"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("double").alias("v"), "r.error"))


@query("SELECT s_suppkey AS k, 'ValueError: EXR files need the OpenEXR library' AS error FROM supplier")
def read_exr_without_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_files(spark, sf_dir, lambda k: b"v/1\x01", "exr", "exr").select("k", "r.error")


@query(f"WITH {PIXELS}, {GRAY} SELECT k, count(*) FILTER (WHERE v / 255 >= 0.5) AS loose, count(*) FILTER (WHERE v / 255 > 128 / 255) AS strict FROM g GROUP BY k")
def mask_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded_files(spark, sf_dir, png, "png", "gray")
    count = lambda m: F.size(F.filter(m, lambda v: v)).cast("long")
    return rows.select("k", count(rasters.masked(F.col("r.data"))).alias("loose"), count(rasters.masked(F.col("r.data"), 128 / 255, strict=True)).alias("strict"))


def _axis(size: int, target: int, name: str, kind: str = "bilinear") -> str:
    """SQL of the weights of an axis: bilinear, bicubic or Lanczos; wider where it shrinks."""
    scale = size / target
    wide = max(1.0, scale)
    x = f"abs((j + 0.5 - (i + 0.5) * {scale}) / {wide})"
    sinc = lambda z: f"(CASE WHEN {z} = 0 THEN 1 ELSE sin(pi() * {z}) / (pi() * {z}) END)"
    weight = {
        "bilinear": f"greatest(0, 1 - {x})",
        "bicubic": f"CASE WHEN {x} < 1 THEN (1.5 * {x} - 2.5) * {x} * {x} + 1 WHEN {x} < 2 THEN ((-0.5 * {x} + 2.5) * {x} - 4) * {x} + 2 ELSE 0 END",
        "lanczos": f"CASE WHEN {x} < 3 THEN {sinc(x)} * {sinc(f'({x} / 3)')} ELSE 0 END",
    }[kind]
    return f"""{name}0 AS (SELECT i, j, ({weight})::DOUBLE AS w FROM range({target}) a(i), range({size}) b(j)
), {name} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {name}0 WHERE w <> 0)"""


@query(
    f"WITH {PIXELS}, {_axis(H, 2, 'wy')}, {_axis(W, 3, 'wx')} SELECT k, wy.i AS y, wx.i AS x, c, round(sum(v / 255 * wy.w * wx.w), 6) + 0.0 AS v FROM p JOIN wy ON wy.j = p.y JOIN wx ON wx.j = p.x GROUP BY k, wy.i, wx.i, c"
)
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded_files(spark, sf_dir, png, "png", "rgb")
    return pixel_rows(rows.select("k", rasters.resized(F.col("r"), 2, 3).alias("r")))


def _bytes_resized(height: int, width: int, kind: str) -> str:
    """SQL of 8-bit resampling: weights of 22 bits, rounded to bytes after each pass."""
    whole = lambda w: f"(sign({w}) * floor(abs({w}) * 4194304 + 0.5))::BIGINT"
    byte = lambda total: f"greatest(0, least(255, (({total}) + 2097152) >> 22))"
    return f"""WITH {PIXELS}, {_axis(H, height, 'wy', kind)}, {_axis(W, width, 'wx', kind)}, across AS (
  SELECT k, y, wx.i AS x, c, {byte(f"sum(v * {whole('w')})::BIGINT")} AS v FROM p JOIN wx ON wx.j = p.x GROUP BY k, y, wx.i, c
), down AS (SELECT k, wy.i AS y, x, c, {byte(f"sum(v * {whole('w')})::BIGINT")} AS v FROM across JOIN wy ON wy.j = across.y GROUP BY k, wy.i, x, c)
SELECT k, y, x, c, round(v / 255, 6) + 0.0 AS v FROM down"""  # fmt: skip


@query(_bytes_resized(7, 9, "bicubic"))
def resize_bytes_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger by a bicubic filter, in the whole numbers of 8-bit image libraries."""
    rows = decoded_files(spark, sf_dir, png, "png", "rgb")
    return pixel_rows(rows.select("k", rasters.resized(F.col("r"), 7, 9, "bicubic", eight_bit=True).alias("r")))


@query(_bytes_resized(3, 4, "lanczos"))
def resize_bytes_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smaller by a Lanczos filter, likewise."""
    rows = decoded_files(spark, sf_dir, png, "png", "rgb")
    return pixel_rows(rows.select("k", rasters.resized(F.col("r"), 3, 4, "lanczos", eight_bit=True).alias("r")))


@query(f"WITH {PIXELS} SELECT k, yy AS y, xx AS x, c, round(v / 255, 6) + 0.0 AS v FROM p JOIN range(8) a(yy) ON yy // 2 = y JOIN range(3) b(xx) ON 2 * xx + 1 = x")
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded_files(spark, sf_dir, png, "png", "rgb")
    return pixel_rows(rows.select("k", rasters.resized(F.col("r"), 8, 3, "nearest").alias("r")))


@query(f"WITH {PIXELS} SELECT k, yy AS y, xx AS x, c, round(v / 255, 6) + 0.0 AS v FROM p JOIN range(8) a(yy) ON greatest(0, least({H - 1}, yy - 2)) = y JOIN range({W}) b(xx) ON xx = x")
def letterbox_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted into a higher canvas of the same width: the border repeats the edge rows."""
    rows = decoded_files(spark, sf_dir, png, "png", "rgb")
    return pixel_rows(rows.select("k", rasters.letterboxed(F.col("r"), 8, W).alias("b")).select("k", F.col("b.raster").alias("r")))


@query(f"WITH {PIXELS} SELECT k, y, x, c, round(v / 255, 6) + 0.0 AS v FROM p")
def crop_back_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content's box cut from the canvas gives the image back."""
    rows = decoded_files(spark, sf_dir, png, "png", "rgb").select("k", rasters.letterboxed(F.col("r"), 8, W).alias("b"))
    return pixel_rows(rows.select("k", rasters.cropped_back(F.col("b.raster"), F.col("b.box"), (W, 8), H, W).alias("r")))


@query(f"WITH {PIXELS} SELECT k, y, x, c, round(v / 255, 6) + 0.0 AS v FROM p")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images decoded, encoded and decoded again."""
    rows = decoded_files(spark, sf_dir, png, "png", "rgb").select("k", rasters.png(F.col("r")).alias("content"))
    return pixel_rows(rows.select("k", rasters.decoded(F.col("content"), "rgb").alias("r")))


@query(f"WITH {PIXELS}, {GRAY} SELECT k, y, x, 0::BIGINT AS c, round(v / 255, 6) + 0.0 AS v FROM g")
def gray_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour answers written as gray images."""
    gray = decoded_files(spark, sf_dir, png, "png", "gray").select("k", rasters.png(F.col("r")).alias("content"))
    return pixel_rows(gray.select("k", rasters.decoded(F.col("content"), "gray").alias("r")))


@query(
    f"WITH {PIXELS}, {_axis(H, 2, 'wy', 'lanczos')}, {_axis(W, 3, 'wx', 'lanczos')} "
    "SELECT k, wy.i AS y, wx.i AS x, c, round(round(least(1, greatest(0, sum(v / 255 * wy.w * wx.w))) * 255) / 255, 6) + 0.0 AS v "
    "FROM p JOIN wy ON wy.j = p.y JOIN wx ON wx.j = p.x GROUP BY k, wy.i, wx.i, c"
)
def data_uri_downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of at most three pixels a side as data URIs, and the pixels that these decode to."""
    from ..functions.texts import data_uri

    rows = decoded_files(spark, sf_dir, png, "png", "rgb").select("k", rasters.limited(F.col("r"), 3).alias("r"))
    uris = rows.select("k", data_uri(F.lit("image/png"), rasters.png(F.col("r"))).alias("uri"))
    content = F.unbase64(F.regexp_extract("uri", r"^data:image/png;base64,(.*)$", 1))
    return pixel_rows(uris.select("k", rasters.decoded(content, "rgb").alias("r")))


@query(f"""
WITH {GT}, s AS (SELECT *, min(v) OVER (PARTITION BY k) AS lo, max(v) OVER (PARTITION BY k) AS hi FROM z) SELECT k, y, x, c, round((v - lo) / (hi - lo), 6)::DOUBLE AS v
       FROM s, range(3) t(c)
""")
def pseudo_rgb_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded_files(spark, sf_dir, lambda k: struct.pack("<II", H, W) + depths(k).astype("<f4").tobytes(), "dat", "dat")
    return pixel_rows(rows.select("k", F.col("r").withField("data", N.pseudo_rgb(F.col("r.data"))).withField("channels", F.lit(3)).alias("r")))


# JSON and text files


def text_files(spark, sf_dir, make, name: str = "{k}.json") -> str:
    return made_files(spark, sf_dir, lambda k, n, r: make(k, n, r).encode(), name)


def key_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.regexp_extract("path", r"/(\d+)\.[a-z]+$", 1).cast("int"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 0 END AS n_items FROM supplier")
def read_json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and lists, with nulls and empty lists for what is broken or of another shape."""
    root = text_files(spark, sf_dir, lambda k, n, r: ["{broken", json.dumps({"name": n, "items": ["a", "b"]}), json.dumps({"name": n, "items": "x"})][k % 3])
    rows = key_of(json_files.texts(spark, root)).withColumn("o", json_files.parsed_object(F.col("text"), "name string"))
    return rows.select("k", "o.name", F.size(json_files.parsed_list(F.get_json_object("text", "$.items"), "string")).alias("n_items"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS text FROM supplier")
def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts trimmed; blank ones are empty."""
    return key_of(
        json_files.texts(spark, text_files(spark, sf_dir, lambda k, n, r: "  \n" if k % 4 == 0 else f"  {n} ", "{k}.txt"))
    ).select("k", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))


def record(k: int, name: str, region: int) -> str:
    out = {"sample_id": f"sample_{k:08d}", "image_path": f"{name}.png", "physical_properties": {"albedo": name, "roughness": k / 8, "metallic": region / 4}}
    return json.dumps(out | ({"metadata": {"source": "synthetic"}} if k % 2 else {}))


@query("""
SELECT 'sample_' || lpad(s_suppkey::VARCHAR, 8, '0') AS sample_id, s_name || '.png' AS image_path, s_suppkey / 8 AS roughness, (s_nationkey % 5) / 4 AS metallic,
       s_suppkey % 2 AS n_metadata FROM supplier
""")
def load_annotation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_files.records(json_files.texts(spark, text_files(spark, sf_dir, record)))
    return rows.select("sample_id", "image_path", "physical_properties.roughness", "physical_properties.metallic", F.size("metadata").alias("n_metadata"))


@query("""
SELECT 'sample_' || lpad(s_suppkey::VARCHAR, 8, '0') AS id, s_name || '.png' AS image, s_name AS albedo, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 2 ELSE 0 END AS mae,
       0.0::DOUBLE AS rmse FROM supplier
""")
def baseline_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and metrics under the names that comparisons use; metrics that lack are 0."""
    from ..operators import records

    rows = json_files.records(json_files.texts(spark, text_files(spark, sf_dir, record)))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    text = F.when(number % 2 == 0, F.concat(F.lit('{"mae": '), (number / 2).cast("string"), F.lit("}"))).otherwise("{}")
    return records.baseline_records(rows).select("id", "image", "targets.albedo", *[c.alias(m) for m, c in records.baseline_metrics(text).items()])


@query("SELECT 'g' || (s_nationkey % 5) AS exp_group, s_name AS run_name, s_suppkey / 4 AS mae, row_number() OVER (ORDER BY 'g' || (s_nationkey % 5), s_name) - 1 AS place FROM supplier")
def collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metrics.json below a folder, in the order of group and run."""
    from ..operators.manifest import ranks

    root = text_files(spark, sf_dir, lambda k, n, r: json.dumps({"exp_group": f"g{r}", "run_name": n, "mae": k / 4}), "{region}/{k}/metrics.json")
    return ranks(json_files.metrics(spark, root), "exp_group", "run_name").select("exp_group", "run_name", "mae", F.col("position").alias("place"))


@query("SELECT 'r' || (s_nationkey % 5) AS relative_image_path, max_by('p' || s_suppkey, lpad(s_suppkey::VARCHAR, 8, '0')) AS prompt FROM supplier GROUP BY (s_nationkey % 5)")
def manifest_prompt_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by image from many manifests; of equal images the last counts."""
    root = text_files(
        spark, sf_dir, lambda k, n,
        r: json.dumps([{"relative_image_path": f"r{r}", "prompt": "early"}, {"relative_image_path": f"r{r}", "prompt": f"p{k}"}, {"prompt": "no path"}]), "{k:08d}.json"
    )
    return json_files.manifest_entries(json_files.texts(spark, root)).select("relative_image_path", F.get_json_object("entry", "$.prompt").alias("prompt"))


@query("SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'seed' ELSE 'eval,output_dir' END AS missing FROM supplier")
def config_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that configurations lack; those that lack none pass the check that raises."""
    full = {"dataset": {}, "model": {}, "train": {}, "eval": {}, "output_dir": "o", "seed": 1}
    lacks = [(), ("seed",), ("eval", "output_dir")]
    rows = key_of(json_files.texts(spark, text_files(spark, sf_dir, lambda k, n, r: json.dumps({c: v for c, v in full.items() if c not in lacks[k % 3]}))))
    checked = json_files.checked_configs(rows.filter("k % 3 = 0")).select("k", F.lit("").alias("missing"))
    return checked.unionByName(rows.filter("k % 3 <> 0").select("k", F.array_join(json_files.missing_config_keys(F.col("text")), ",").alias("missing")))


@query("""
SELECT s.split, 's' || s_suppkey AS sample_id FROM supplier, (VALUES ('train'), ('val'), ('test')) s(split) WHERE (s.split = 'train'
       AND s_suppkey % 25 < 20) OR (s.split = 'val' AND s_suppkey % 25 >= 15) OR (s.split = 'test' AND s_suppkey % 5 = 0)
""")
def read_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships of split files, one for each nation; splits overlap."""
    k = F.col("s_suppkey")
    names = lambda chosen: F.array_compact(F.collect_list(F.when(chosen, F.concat(F.lit("s"), k.cast("string")))))
    text = F.to_json(F.struct(names(k % 25 < 20).alias("train"), names(k % 25 >= 15).alias("val"), names(k % 5 == 0).alias("test")))
    listed = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(text.alias("content"))
    root = staging.new_folder(spark)
    write_files(listed.select(F.format_string("%d/split.json", "s_nationkey").alias("path"), "content"), root)
    return json_files.split_members(json_files.texts(spark, root))


# sinks: what was written is read again


def out_folder(spark) -> str:
    return staging.new_folder(spark) + "/out"


def metric_rows(spark, sf_dir) -> DataFrame:
    v = F.col("s_suppkey") / 8
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), "s_name", F.when(F.col("s_suppkey") % 4 == 0, float("inf")).otherwise(v).alias("psnr"),
        F.when(F.col("s_suppkey") % 2 == 0, "mainaxis").when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise("stresstest").alias("split")
    )


@query("SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey / 8 END AS psnr FROM supplier")
def sink_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out_folder(spark)
    sinks.write_rows(sinks.sanitised(metric_rows(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="k int, s_name string, psnr double, split string").drop("split")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey / 8 END AS psnr, 3 AS n_fields FROM supplier")
def sink_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in place of non-finite numbers, at any depth, and all fields present."""
    path = out_folder(spark)
    sinks.write_summary(metric_rows(spark, sf_dir).select("k", "s_name", F.struct(F.array("psnr").alias("values")).alias("inner")), path)
    rows = spark.read.text(path)
    return rows.select(
        F.get_json_object("value", "$.k").cast("int").alias("k"), F.get_json_object("value", "$.inner.values[0]").try_cast("double").alias("psnr"),
        F.size(F.json_object_keys("value")).alias("n_fields")
    )


@query("SELECT (s_nationkey % 5) AS region, count(*) AS n, max(s_suppkey) AS top FROM supplier GROUP BY (s_nationkey % 5)")
def sink_group_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out_folder(spark)
    sinks.write_rows(table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("region")).agg(F.count("*").alias("n"), F.max("s_suppkey").alias("top")), path)
    return spark.read.csv(path, header=True, schema="region int, n long, top int")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'mainaxis' ELSE 'stresstest' END AS split FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0")
def sink_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out_folder(spark)
    sinks.write_by_split(metric_rows(spark, sf_dir), path)
    return spark.read.schema("k int, s_name string, psnr double, split string").csv(path, header=True).select("k", "split")


@query("SELECT r_name, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT r_name FROM region WHERE r_regionkey > 1) GROUP BY r_name")
def sink_append_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out_folder(spark)
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    sinks.append_lines(rows, path)
    sinks.append_lines(rows.filter("r_regionkey > 1"), path)
    return spark.read.schema("r_name string").json(path).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM supplier")
def sink_manifest_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in which later entries took the place of earlier ones."""
    path = out_folder(spark)
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("old").alias("state"), F.lit(1).alias("seq"))
    sinks.rewrite_manifest(None, old, f"{path}/1", ["k"], "seq")
    first = spark.read.parquet(f"{path}/1")
    sinks.rewrite_manifest(first, old.filter("k % 3 = 0").withColumns({"state": F.lit("new"), "seq": F.lit(2)}), f"{path}/2", ["k"], "seq")
    return spark.read.parquet(f"{path}/2").select("k", "state")


@query("SELECT avg(s_suppkey % 8) / 8 AS mae, max(s_suppkey % 8) / 4 AS rmse, 'run' AS run_name FROM supplier")
def sink_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's metrics over all suppliers as JSON and as a summary of one row."""
    path = out_folder(spark)
    v = F.col("s_suppkey") % 8
    sinks.write_metrics(table(spark, sf_dir, "supplier").agg(F.lit("run").alias("run_name"), (F.avg(v) / 8).alias("mae"), (F.max(v) / 4).alias("rmse")), path)
    as_json = spark.read.schema("run_name string, mae double, rmse double").json(f"{path}/metrics")
    return as_json.join(spark.read.csv(f"{path}/summary", header=True, schema="run_name string, mae double, rmse double"), ["run_name", "mae", "rmse"]).select("mae", "rmse", "run_name")


@query("SELECT count(*)::INTEGER AS n_records, min(s_name) AS first_path, max(s_name) AS last_path FROM supplier")
def sink_manifest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("sample_id"), F.col("s_name").alias("image_path"), F.struct("s_nationkey").alias("physical_properties"), "s_suppkey")
    listed = sinks.manifest_projection(rows).select("records")
    return listed.select(F.size("records").alias("n_records"), F.array_min("records.image_path").alias("first_path"), F.array_max("records.image_path").alias("last_path"))


@query("SELECT s_suppkey AS scene, s_name AS images, 'failed' AS error FROM supplier WHERE s_suppkey % 3 = 0")
def sink_failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out_folder(spark)
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("scene"), F.col("s_name").alias("images"), F.when(F.col("s_suppkey") % 3 == 0, "failed").alias("error"), F.lit(1).alias("more")
    )
    sinks.append_lines(sinks.failure_rows(rows), path)
    return spark.read.schema("scene int, images string, error string").json(path)


# images written in tasks: the maps of ``embeddings`` as 8 x 8 gray images

_STORED = "u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE + 0.5 AS v FROM embeddings)"
_BYTES = "round(least(1, greatest(0, v)) * 255)::BIGINT"


def gray_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` (a folder for each label) and the vector as a gray raster around 0.5."""
    data = F.transform("embedding", lambda v: v.cast("double") + 0.5)
    size = lambda n, name: F.lit(n).alias(name)
    raster = F.struct(size(8, "height"), size(8, "width"), size(1, "channels"), data.alias("data"), F.lit(None).cast("string").alias("error"))
    path = F.format_string("label_%d/%08d.png", "label", "vec_id")
    return table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", path.alias("path"), raster.alias("raster"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """``vec_id`` and the decoded bytes of every image below a folder: their number, sum and sum weighted by place."""
    found = scan.contents(spark, scan.files(spark, root), root)
    rows = found.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id"), rasters.decoded(F.col("content"), "gray").alias("r"))
    values = rows.select("vec_id", F.posexplode("r.data").alias("i", "v")).withColumn("v", F.round(F.col("v") * 255).cast("long"))
    return values.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("i") + 1)).alias("weighted"))


@query(f"WITH {_STORED} SELECT vec_id, count(*) AS n, sum({_BYTES})::BIGINT AS total, sum({_BYTES} * (i + 1))::BIGINT AS weighted FROM u GROUP BY vec_id")
def sink_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps encoded and written by tasks, in a run that goes on where an earlier one ended, then scanned and decoded again."""
    root = out_folder(spark)
    maps = gray_maps(spark, sf_dir)
    first = sinks.write_images(maps.filter("vec_id % 3 = 0"), root)
    rest = sinks.write_images(maps, root, overwrite=False)
    if rest["kept"] != first["files"]:
        raise RuntimeError(f"{rest['kept']} of {first['files']} files were kept")
    return read_images(spark, root)


@query(f"""WITH {_STORED}, {_axis(8, 4, 'wy')}, {_axis(8, 4, 'wx')}, small AS (
  SELECT vec_id, wy.i * 4 + wx.i AS i, sum(v * wy.w * wx.w) AS v FROM u JOIN wy ON wy.j = u.i // 8 JOIN wx ON wx.j = u.i % 8 GROUP BY vec_id, wy.i, wx.i
) SELECT vec_id, count(*) AS n, sum({_BYTES})::BIGINT AS total, sum({_BYTES} * (i + 1))::BIGINT AS weighted FROM small GROUP BY vec_id""")  # fmt: skip
def sink_resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions dumped at half their size."""
    root = out_folder(spark)
    sinks.write_images(gray_maps(spark, sf_dir), root, size=(4, 4))
    return read_images(spark, root)
