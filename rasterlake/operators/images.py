"""Operators that see an image whole: rows hold the map as an array, and a batch of rows of one shape is one numpy stack.

Maps over rows, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from .settings import DepthSettings

#: Pixels up to which all pairs of an image are compared at once.
SMALL_IMAGE = 256
#: Pixels of a stack that is worked on at a time.
STACK = 4_000_000


def map_stacks(rows: DataFrame, keys: list[str], height: int, width: int, arrays: list[str], make: Callable[..., np.ndarray], out: T.StructField) -> DataFrame:
    """``make`` applied to stacks (n, height, width) of the array columns; one result for each image."""
    source = rows.select(*keys, *arrays)
    schema = T.StructType([*source.schema.fields[: len(keys)], out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stacks = [np.stack(pdf[a].to_numpy()).reshape(-1, height, width) if len(pdf) else np.zeros((0, height, width)) for a in arrays]
            result = make(*stacks)
            yield pdf[keys].assign(**{out.name: list(result) if isinstance(out.dataType, T.ArrayType) else result})

    return source.mapInPandas(run, schema)


def map_metrics(rows: DataFrame, keys: list[str], arrays: list[str], make: Callable[..., dict[str, np.ndarray]], out: dict[str, str]) -> DataFrame:
    """Columns ``out`` (name to type) of ``make``, applied to the first key's values and stacks (n, pixels) of images of one size."""
    source = rows.select(*keys, *arrays)
    schema = T.StructType([*source.schema.fields[: len(keys)], *T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in out.items())).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, same in pdf.groupby(pdf[arrays[0]].map(len), sort=False):
                step = max(1, STACK // max(1, int(size)))
                for k in range(0, len(same), step):
                    part = same.iloc[k : k + step]
                    found = make(part[keys[0]], *(np.stack(part[a].to_numpy()) for a in arrays))
                    yield part[keys].assign(**{c: found[c] for c in out})

    return source.mapInPandas(run, schema)


_ROW = dict.fromkeys(("rho", "scale", "shift", "absrel", "rmse", "rms", "mae", "delta1", "delta2", "delta3", "delta05", "log10", "mean_oriented"), "double")


def depth_metrics(rows: DataFrame, keys: list[str], settings: DepthSettings, full: bool = False) -> DataFrame:
    """Affine-invariant depth metrics of ``gt``, ``pred`` and ``valid`` arrays, a row for each image; an image with fewer than two valid pixels has an ``error``.

    ``full`` adds Kendall's ``tau`` of the oriented prediction, exact or over a sample
    as the settings say, and the boundary F1 of the aligned one.  A map over the rows.
    """

    def make(names, gt, pred, valid):
        found = kernels.depth_metrics(gt, pred, valid, settings.polarity, settings.delta05)
        found["error"] = np.where(found["valid_pixels"] < 2, "fewer than two valid pixels", None)
        if full:
            found["tau"] = _tau(gt, found["oriented"], found["ok"], names, settings.max_pixels, settings.seed)
            shape = (len(gt), settings.height, settings.width)
            found["boundary_f1"] = kernels.boundary_f1(
                found["aligned"].reshape(shape), np.where(found["ok"], gt, 1.0).reshape(shape), found["ok"].reshape(shape), settings.t_min, settings.t_max,
                settings.thresholds
            )
        return found

    more = {"tau": "double", "boundary_f1": "double"} if full else {}
    return map_metrics(rows, keys, ["gt", "pred", "valid"], make, {"valid_pixels": "long", "mask_excluded": "long", "polarity": "string", **_ROW, **more, "error": "string"})


def spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's rho of ``gt`` and ``pred`` per image, over finite pixels."""

    def make(_, gt, pred):
        ok = np.isfinite(gt) & np.isfinite(pred)
        return {"n": ok.sum(1), "rho": kernels.spearman(gt, pred, ok)}

    return map_metrics(rows, keys, ["gt", "pred"], make, {"n": "long", "rho": "double"})


def angular_metrics(rows: DataFrame, keys: list[str], valid: str | None = None, flip: tuple[bool, bool, bool] = (False, True, True), front_only: bool = False) -> DataFrame:
    """Angular errors of encoded normals ``gt`` and ``pred`` (three values a pixel) per image: mean, exact median, root mean square, sums and five accuracies."""
    out = {"valid_pixels": "long", **dict.fromkeys(("mean_angle", "median_angle", "rms_angle", "sum_angle", "sum_sq", *kernels.ANGLES), "double")}
    return map_metrics(rows, keys, ["gt", "pred", *([valid] if valid else [])], lambda _, g, p, v=None: kernels.angular_metrics(g, p, v, flip, front_only), out)


def _tau(gt: np.ndarray, pred: np.ndarray, ok: np.ndarray, names, max_pixels: int, seed: int) -> np.ndarray:
    """Tau-b of each row over its ``ok`` pixels: filtered first, then sampled where they are more than ``max_pixels`` (0: never)."""
    if gt.shape[1] <= min(SMALL_IMAGE, max_pixels or SMALL_IMAGE) and ok.all():
        return kernels.kendall_stack(gt, pred)
    out = []
    for g, p, use, name in zip(gt, pred, ok, names, strict=True):
        at = np.flatnonzero(use)
        if 0 < max_pixels < len(at):
            at = kernels.bottom_k(at, max_pixels, seed + zlib.crc32(str(name).encode()))
        out.append(kernels.kendall_tau_b(g[at], p[at]))
    return np.array(out, float)


def kendall(rows: DataFrame, keys: list[str], max_pixels: int = 20_000, seed: int = 12345, valid: str | None = None) -> DataFrame:
    """Exact tau-b of the finite pixels of ``gt`` and ``pred`` (within ``valid``) per image; over ``max_pixels`` (0: never), of those whose seeded hash is smallest (``kernels.bottom_k``), the seed with the first key's CRC."""

    def make(gt, pred, mask=None):
        ok = np.isfinite(gt) & np.isfinite(pred)
        return {"use": ok if mask is None else ok & mask.astype(bool), "gt": gt, "pred": pred}

    source = rows.select(*keys, "gt", "pred", *([valid] if valid else []))
    schema = T.StructType([*source.schema.fields[: len(keys)], T.StructField("tau", T.DoubleType())])
    arrays = source.columns[len(keys) :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, same in pdf.groupby(pdf["gt"].map(len), sort=False):
                found = make(*(np.stack(same[c].to_numpy()) for c in arrays))
                yield same[keys].assign(tau=_tau(found["gt"], found["pred"], found["use"], same[keys[0]], max_pixels, seed))

    return source.mapInPandas(run, schema)


def sampled_kendall(rows: DataFrame, name: str, pairs: int = 200_000, seed: int = 0, valid: str | None = None) -> DataFrame:
    """Mean agreement in sign over seeded random pairs of finite pixels (within ``valid``); an image's seed comes from its name."""
    source = rows.select(name, "gt", "pred", *([valid] if valid else []))
    schema = T.StructType([rows.schema[name], T.StructField("tau", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tau = []
            for image, g, p, *mask in pdf.itertuples(index=False):
                g, p = np.asarray(g, float), np.asarray(p, float)
                use = np.isfinite(g) & np.isfinite(p)
                if mask:
                    use &= np.asarray(mask[0], bool)
                tau.append(kernels.sampled_tau(g[use], p[use], pairs, seed + zlib.crc32(str(image).encode())))
            yield pdf[[name]].assign(tau=np.array(tau, float))

    return source.mapInPandas(run, schema)


def boundary_f1(rows: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Weighted multi-threshold boundary F1 of depths ``pred`` against ``gt`` within ``valid``."""

    def make(gt, pred, valid):
        return kernels.boundary_f1(pred, gt, valid.astype(bool) & np.isfinite(gt) & np.isfinite(pred) & (gt > 0))

    return map_stacks(rows, keys, height, width, ["gt", "pred", "valid"], make, T.StructField("boundary_f1", T.DoubleType()))


def _with_channels(valid: np.ndarray, channels: int, *stacks: np.ndarray) -> list[np.ndarray]:
    """Stacks as (n, h, w), or of several values a pixel as (n, h, w, c)."""
    return [s if channels == 1 else s.reshape(*valid.shape, channels) for s in stacks]


def ssim(rows: DataFrame, keys: list[str], height: int, width: int, channels: int = 1) -> DataFrame:
    """Full-frame structural similarity with pixels outside ``valid`` set to 0; of several ``channels`` (values a pixel), their mean."""

    def make(gt, pred, valid):
        gt, pred = _with_channels(valid, channels, gt, pred)
        ok = valid.astype(bool) if channels == 1 else valid.astype(bool)[..., None]
        return kernels.ssim(np.where(ok, gt, 0.0), np.where(ok, pred, 0.0))

    return map_stacks(rows, keys, height, width, ["gt", "pred", "valid"], make, T.StructField("ssim", T.DoubleType()))


def masked_ssim(rows: DataFrame, keys: list[str], height: int, width: int, channels: int = 1) -> DataFrame:
    """Structural similarity within the mask's bounding box; of several ``channels`` (values a pixel), their mean."""

    def make(gt, pred, valid):
        gt, pred = _with_channels(valid, channels, gt, pred)
        return np.array([kernels.masked_ssim(g, p, v.astype(bool)) for g, p, v in zip(gt, pred, valid, strict=True)], float)

    return map_stacks(rows, keys, height, width, ["gt", "pred", "valid"], make, T.StructField("ssim", T.DoubleType()))


def fill_regions(rows: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """``filled``: each 4-connected component of equal ``segment`` filled with its mean ``value``."""

    def make(value, segment):
        return np.array([kernels.fill_regions(v, s).ravel() for v, s in zip(value, segment, strict=True)]).reshape(len(value), -1).astype(np.int32)

    return map_stacks(rows, keys, height, width, ["value", "segment"], make, T.StructField("filled", T.ArrayType(T.IntegerType())))


def perceptual_distance(rows: DataFrame, keys: list[str], model: Callable | None = None) -> DataFrame:
    """A learnt perceptual distance where a model is given; null where none is installed."""
    if model is None:
        return rows.select(*keys, F.lit(None).cast("double").alias("lpips"))
    score = F.pandas_udf(model, T.DoubleType())
    return rows.select(*keys, score("gt", "pred").alias("lpips"))
