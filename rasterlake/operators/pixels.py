"""Pixel tables: one row for each pixel of an image pair, and the metrics over them.

A pixel table has the image's key columns, ``y``, ``x``, ``gt``, ``pred`` and ``valid``.
Sums per image are partial aggregates: a map that is exploded and summed in one task
sends one row on.  What ranks or fits an image's pixels sees the image whole
(``images``), so that no pixel is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ANGLES
from ..functions.numeric import finite, psnr, safe_div
from .quantiles import quantiles, summarised


def explode_maps(maps: DataFrame, keys: list[str], width: int) -> DataFrame:
    """From rows of equally long arrays ``gt``, ``pred`` and ``valid`` to pixels."""
    return maps.select(*keys, F.posexplode(F.arrays_zip("gt", "pred", "valid"))).select(
        *keys, F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col("col.gt").alias("gt"), F.col("col.pred").alias("pred"), F.col("col.valid").alias("valid")
    )


def valid_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels in the mask with finite values."""
    return pixels.filter(F.col("valid") & finite(F.col("gt")).isNotNull() & finite(F.col("pred")).isNotNull())


def masked_errors(pixels: DataFrame, keys: list[str], channels: list[tuple[str, str]] | None = None) -> DataFrame:
    """Sums and means of absolute and squared error per image; an image without valid pixels keeps nulls.

    ``channels`` names pairs of ground truth and prediction (default: ``gt``, ``pred``);
    a pixel's errors are the means over its channels.
    """
    pairs = channels or [("gt", "pred")]
    ok = F.col("valid")
    for c in [c for pair in pairs for c in pair]:
        ok = ok & finite(F.col(c)).isNotNull()
    mean = lambda parts: sum(parts[1:], parts[0]) / len(parts) if len(parts) > 1 else parts[0]
    errors = [F.col(p) - F.col(g) for g, p in pairs]
    size, square = F.when(ok, mean([F.abs(e) for e in errors])), F.when(ok, mean([e * e for e in errors]))
    out = pixels.groupBy(*keys).agg(F.count(size).alias("valid_pixels"), F.sum(size).alias("sum_abs"), F.sum(square).alias("sum_sq"))
    mse = safe_div(F.col("sum_sq"), F.col("valid_pixels"))
    return out.withColumns({"mae": safe_div(F.col("sum_abs"), F.col("valid_pixels")), "mse": mse, "rmse": F.sqrt(mse), "psnr": psnr(mse)})


def macro(name: str, stats: str = "mean std") -> list[Column]:
    """Mean and population deviation of a metric over images, of its finite values."""
    v = finite(F.col(name))
    make = {"mean": F.avg(v), "std": F.stddev_pop(v)}
    return [make[s].alias(f"{name}_{s}") for s in stats.split()]


def error_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro means over images and micro means over pixels (sums over sums); of ``ssim`` and ``lpips``, where rows have them, the macro statistics."""
    more = [m for m in ("ssim", "lpips") if m in rows.columns]
    sums = [F.count("*").alias("n_images"), F.sum("valid_pixels").alias("valid_total"), F.sum("sum_abs").alias("__abs"), F.sum("sum_sq").alias("__sq")]
    macros = [*macro("mae"), *macro("rmse"), *macro("psnr", "mean"), *[c for m in more for c in macro(m)]]
    out = summarised(rows, [by], [*sums, *macros], ["mae", "rmse", *more])
    mse = safe_div(F.col("__sq"), F.col("valid_total"))
    return out.withColumns({"mae_micro": safe_div(F.col("__abs"), F.col("valid_total")), "mse_micro": mse, "psnr_micro": psnr(mse)}).drop("__abs", "__sq")


def macro_summary(rows: DataFrame, by: list[str], groups: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse", "psnr", "ssim", "lpips")) -> DataFrame:
    """Mean, median and deviation of each metric for every row of the fixed ``groups``, also the empty ones."""
    out = summarised(rows, [by], [F.count("*").alias("n_images"), *[c for m in metrics for c in macro(m)]], list(metrics))
    return groups.join(out, by, "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)).cast("long"))


# depth


#: Metrics of a depth row that summaries average.
DEPTH_MEANS = ("valid_pixels", "mask_excluded", "rho", "tau", "absrel", "rmse", "rms", "mae", "delta1", "delta2", "delta3", "delta05", "log10", "boundary_f1", "scale", "shift")


def depth_summary(rows: DataFrame, *levels: list[str]) -> DataFrame:
    """Macro means of the depth metrics that rows have, at several levels in one pass; a level's missing keys are null."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    means = [F.avg(finite(F.col(m).cast("double"))).alias(f"{m}_mean") for m in DEPTH_MEANS if m in rows.columns]
    return rows.groupingSets([list(level) for level in levels], *keys).agg(F.count("*").alias("n_images"), F.count_if("mask_used").alias("masks_used"), *means)


def unit_scale(values: DataFrame, keys: list[str], value: str = "depth") -> DataFrame:
    """Millimetres or metres: 0.001 where the 95th percentile of the valid values is over 100.

    An exact selection over the pixels: no image's values meet in one buffer.
    """
    v = F.when(finite(F.col(value)) > 0, F.col(value))
    found = quantiles(values.select(*keys, v.alias("__value")), {"p95": "__value"}, keys, q=0.95).drop("__level")
    every = values.select(*keys).distinct().alias("k")
    same = reduce(lambda a, b: a & b, [F.col(f"k.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    out = every.join(found.alias("p"), same, "left").select("k.*", "p95")
    return out.withColumn("unit_scale", F.when(F.col("p95") > 100, 0.001).otherwise(1.0))


# normals


def angular_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro means of the eight angular metrics, median and deviation of the mean angle, and micro values over all pixels."""
    shares = list(ANGLES)
    micro = [F.sum(F.col(a) * F.col("valid_pixels")).alias(f"__{a}") for a in shares]
    macros = [c for m in ("median_angle", "rms_angle", *shares) for c in macro(m, "mean")]
    sums = [F.count("*").alias("n_images"), F.sum("valid_pixels").alias("valid_total"), F.sum("sum_angle").alias("__s"), F.sum("sum_sq").alias("__q")]
    out = summarised(rows, [by], [*sums, *macro("mean_angle"), *macros, *micro], ["mean_angle"])
    n = F.col("valid_total")
    out = out.withColumns({"mean_angle_micro": safe_div(F.col("__s"), n), "rmse_angle_micro": F.sqrt(safe_div(F.col("__q"), n)), **{f"{a}_micro": safe_div(F.col(f"__{a}"), n) for a in shares}})
    return out.drop("__s", "__q", *[f"__{a}" for a in shares])


# metalness


#: Places of a sum of weights that count when it is compared with the minimum.
WEIGHT_DIGITS = 9


def metallic_errors(pixels: DataFrame, keys: list[str], min_weight: float = 10.0) -> DataFrame:
    """Masked regression, errors weighted by metalness and by its complement, and bias.

    Weighted means of images below the minimum weight are null; their sums stay for the totals.
    A weight is compared to ``WEIGHT_DIGITS`` places, so that the order of summation does not
    decide which images count.
    """
    ok = F.col("valid")
    g, p = F.when(ok, F.col("gt")), F.when(ok, F.col("pred"))
    e = p - g
    out = pixels.groupBy(*keys).agg(
        F.count(e).alias("valid_pixels"), F.sum(F.abs(e)).alias("sum_abs"), F.sum(e * e).alias("sum_sq"), F.sum(g).alias("metal_weight"), F.sum(1 - g).alias("nonmetal_weight"),
        F.sum(g * F.abs(e)).alias("metal_abs"), F.sum((1 - g) * F.abs(e)).alias("nonmetal_abs"), F.sum(e).alias("signed_sum"), F.sum(F.greatest(e, F.lit(0.0))).alias("over_sum"),
        F.sum(F.greatest(-e, F.lit(0.0))).alias("under_sum"), F.avg(p).alias("pred_mean"),
    ).filter("valid_pixels > 0")
    n = F.col("valid_pixels")
    gate = lambda s, w: F.when(F.round(F.col(w), WEIGHT_DIGITS) >= min_weight, safe_div(F.col(s), F.col(w)))
    mse = safe_div(F.col("sum_sq"), n)
    return out.withColumns(
        {"mae": safe_div(F.col("sum_abs"), n), "rmse": F.sqrt(mse), "psnr": psnr(mse), "gt_mean": safe_div(F.col("metal_weight"), n), "metal_mae": gate("metal_abs", "metal_weight"), "nonmetal_mae": gate("nonmetal_abs", "nonmetal_weight"),
         "signed_mean": safe_div(F.col("signed_sum"), n), "over_mean": safe_div(F.col("over_sum"), n), "under_mean": safe_div(F.col("under_sum"), n)}
    )


def metallic_summary(rows: DataFrame, groups: DataFrame | None, *levels: list[str]) -> DataFrame:
    """Macro and weighted micro means at several levels in one pass, such as overall, by split, by split and lighting.

    A level's missing keys are null.  ``groups`` are rows of keys that appear even where
    they are empty, and no others of theirs do: of ("mainaxis", null), nothing but that.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    present = [m for m in ("ssim", "lpips") if m in rows.columns]
    macros = [*macro("mae"), *[c for m in ("gt_mean", "pred_mean", "rmse", "psnr", *present, "metal_mae", "nonmetal_mae") for c in macro(m, "mean")]]
    counts = [F.count("*").alias("n"), F.sum("valid_pixels").alias("v"), F.count("metal_mae").alias("nm"), F.count("nonmetal_mae").alias("nn")]
    sums = [F.sum(c).alias(c) for c in ("metal_abs", "metal_weight", "nonmetal_abs", "nonmetal_weight", "over_sum", "under_sum")]
    out = summarised(rows, [list(level) for level in levels], [*counts, *macros, *sums], ["mae"])
    if groups is not None:
        same = F.lit(True)
        renamed = groups.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        for k in keys:
            same = same & F.col(f"__k_{k}").eqNullSafe(F.col(k))
        out = renamed.join(out, same, "left").select(*[F.col(f"__k_{k}").alias(k) for k in keys], *[c for c in out.columns if c not in keys])
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        *keys, count("n").alias("n_images"), count("v").alias("valid_total"), "gt_mean_mean", "pred_mean_mean", "mae_mean", "mae_median", "mae_std", "rmse_mean", "psnr_mean",
        *[f"{m}_mean" for m in present], "metal_mae_mean", "nonmetal_mae_mean",
        safe_div(F.col("metal_abs"), F.col("metal_weight")).alias("metal_mae_micro"), safe_div(F.col("nonmetal_abs"), F.col("nonmetal_weight")).alias("nonmetal_mae_micro"),
        safe_div(F.col("over_sum"), F.col("v")).alias("over_micro"), safe_div(F.col("under_sum"), F.col("v")).alias("under_micro"),
        count("nm").alias("n_metal_weighted"), count("nn").alias("n_nonmetal_weighted"),
    )


# lighting


def lighting_statistics(luma: DataFrame, by: list[str], linear: str = "y_lin", srgb: str = "y_srgb", bins: int = 1024) -> DataFrame:
    """Means, highlight and dark ratios, and histogram percentiles of pooled pixels.

    One aggregate by histogram bin; all that follows sees at most ``bins`` rows for each group.
    """
    cells = luma.withColumn("__bin", F.floor(F.col(linear) * (bins - 1)).cast("int")).groupBy(*by, "__bin").agg(
        F.count("*").alias("n"), F.sum(linear).alias("sl"), F.sum(srgb).alias("ss"), F.count_if(F.col(linear) >= 0.85).alias("hi"), F.count_if(F.col(linear) <= 0.10).alias("lo")
    )
    w = Window.partitionBy(*by)
    run = w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"cum": F.sum("n").over(run), "total": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("cum") >= F.col("total") * q, F.col("__bin"))) / (bins - 1)
    out = cells.groupBy(*by).agg(
        F.sum("n").alias("n_pixels"), F.sum("sl").alias("sl"), F.sum("ss").alias("ss"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), at(0.05).alias("p5"),
        at(0.95).alias("p95")
    )
    n = F.col("n_pixels")
    return out.select(
        *by, "n_pixels", (F.col("sl") / n).alias("mean_luminance"), (F.col("ss") / n).alias("mean_luma_srgb"), "p5", "p95",
        F.log2((F.col("p95") + 1e-6) / (F.col("p5") + 1e-6)).alias("stops"), (F.col("hi") / n).alias("highlight_ratio"), (F.col("lo") / n).alias("dark_ratio")
    )
