"""Column expressions on pixel values.  Doubles throughout; ANSI-safe (no expression raises on zero or NaN)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """``c``, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is not positive."""
    return F.when(den > 0, num / F.when(den > 0, den))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((F.greatest(c, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def gray(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 luma of 8-bit channels in thousandths, as gray conversion has it."""
    return (r * 299 + g * 587 + b * 114) / 1000


def psnr(mse: Column) -> Column:
    """Infinite for a mean squared error up to 1e-12; null and NaN pass through."""
    return F.when(mse <= 1e-12, F.lit(INF)).otherwise(F.log10(F.when(mse > 1e-12, mse)) * -10)


def inverse_depth(d: Column) -> Column:
    return 1.0 / F.greatest(d, F.lit(1e-6))


def pseudo_rgb(depth: Column) -> Column:
    """Three equal channels for each value of a depth map, scaled to 0..1 within the map (0 where it is constant)."""
    lo, hi = F.array_min(depth), F.array_max(depth)
    return F.flatten(F.transform(depth, lambda v: F.array_repeat(F.when(hi > lo, F.try_divide(v - lo, hi - lo)).otherwise(0.0), 3)))


def over(e: Column) -> Column:
    return F.greatest(e, F.lit(0.0))


def under(e: Column) -> Column:
    return F.greatest(-e, F.lit(0.0))


def unit_normal(x: Column, y: Column, z: Column, flip: tuple[bool, bool, bool] = (False, False, False)) -> tuple[Column, Column, Column, Column]:
    """Unit vector of an encoded normal (channels 0 to 1), and whether it is legal; zeros where it isn't."""
    parts = [(c * 2 - 1) * (-1 if f else 1) for c, f in zip((x, y, z), flip, strict=True)]
    norm = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])
    legal = F.coalesce(finite(norm) > 1e-6, F.lit(False))
    return (*[F.when(legal, p / F.when(legal, norm)).otherwise(0.0) for p in parts], legal)


def angle(dot: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


# buckets of lighting statistics


def brightness(mean_srgb: Column) -> Column:
    low, high = (linear_to_srgb(F.lit(v)) for v in (0.09, 0.36))
    return F.when(mean_srgb < low, "low").when(mean_srgb > high, "high").otherwise("medium")


def illumination(mean_linear: Column) -> Column:
    ev = F.log2((mean_linear + 1e-6) / 0.18)
    return F.when(ev <= -2, "very_low").when(ev <= -1, "low").when(ev <= 1, "medium").when(ev <= 2, "high").otherwise("very_high")


def dynamic_range(stops: Column) -> Column:
    return F.when(stops < 2, "low").when(stops < 4, "medium").otherwise("high")


def ratio_level(ratio: Column, low: float, high: float) -> Column:
    return F.when(ratio < low, "low").when(ratio < high, "medium").otherwise("high")
