"""Checked settings of an evaluation, and what its metrics are for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: groups of the metalness metrics, and the metrics by their published names
METRIC_GROUPS = {
    "main_continuous_regression": ["mae", "rmse", "psnr"],
    "weighted_metallicity_diagnostics": ["metal_weighted_mae", "nonmetal_weighted_mae", "gt_metallic_mean", "pred_metallic_mean"],
    "bias_diagnostics": ["signed_error", "over_metal_error", "under_metal_error"],
    "auxiliary_visual_metrics": ["ssim", "lpips"],
}
#: The columns of ``pixels.metallic_errors`` that hold them, where they have another name.
METRIC_COLUMNS = {
    "metal_weighted_mae": "metal_mae", "nonmetal_weighted_mae": "nonmetal_mae", "gt_metallic_mean": "gt_mean", "pred_metallic_mean": "pred_mean",
    "signed_error": "signed_mean", "over_metal_error": "over_mean", "under_metal_error": "under_mean",
}
METRIC_NOTES = {
    "ssim_lpips": "Similarity of pictures; aids to reading, not measures of how physically right a metalness map is.",
    "gt_metallic_mean": "The mean of continuous values in 0..1, not the share of metal pixels.",
    "resize_interp_default": "Maps are continuous, so they are resized bilinearly.",
    "mask": "Over the valid pixels of the evaluation mask; ssim and lpips after all others are set to zero.",
}


def metric_groups(rows: DataFrame) -> DataFrame:
    """The groups with their metrics' means over images: ``name``, ``place``, ``metric``, ``mean`` (null where rows lack the metric) and ``note``."""
    listed = [(g, i, m, METRIC_COLUMNS.get(m, m), METRIC_NOTES.get("ssim_lpips" if m in ("ssim", "lpips") else m)) for g, ms in METRIC_GROUPS.items() for i, m in enumerate(ms)]
    means = rows.agg(*[F.avg(c).alias(c) for _, _, _, c, _ in listed if c in rows.columns])
    entry = lambda g, i, m, c, note: F.struct(
        F.lit(g).alias("name"), F.lit(i).alias("place"), F.lit(m).alias("metric"), (F.col(c) if c in means.columns else F.lit(None)).cast("double").alias("mean"), F.lit(note).cast("string").alias("note")
    )
    return means.select(F.explode(F.array(*[entry(*x) for x in listed])).alias("e")).select("e.*")


#: A rule's message, and the rule on a getter of values; it holds for values as for columns.
Rules = dict[str, Callable[[Any], Any]]


def _in(value: Any, *names: str) -> Any:
    return value.isin(*names) if isinstance(value, Column) else value in names


def _has(value: Any, part: str) -> Any:
    return F.contains(value, F.lit(part)) if isinstance(value, Column) else part in value


class _Checked:
    rules: Rules

    def __post_init__(self):
        for message, rule in self.rules.items():
            if not rule(self):
                raise ValueError(message)


def errors(kind: type[_Checked], columns: list[str]) -> Column:
    """The messages of all rules that a row of settings breaks; settings that have no column stand at their defaults."""

    class Row:
        pass

    row = Row()
    for f in fields(kind):
        setattr(row, f.name, F.col(f.name) if f.name in columns else F.lit(f.default))
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule(row), F.lit(False)), F.lit(message)) for message, rule in kind.rules.items()]))


_MATCH_RULES: Rules = {
    "mode must be stem or name": lambda s: _in(s.mode, "stem", "name"),
    "a suffix goes with mode stem": lambda s: (s.suffix == "") | (s.mode == "stem"),
    "a dropped part is one part of a path": lambda s: _has(s.dropped_part, "/") == False,  # noqa: E712
    "mask_threshold must be within 0..1": lambda s: (s.mask_threshold >= 0) & (s.mask_threshold <= 1),
    "backbone must be alex, vgg or squeeze": lambda s: _in(s.backbone, "alex", "vgg", "squeeze"),
}
_DEPTH_RULES: Rules = {
    "width and height must be positive": lambda s: (s.width > 0) & (s.height > 0),
    "mask_threshold must be within 0..1": lambda s: (s.mask_threshold >= 0) & (s.mask_threshold <= 1),
    "thresholds must rise from above 1": lambda s: (s.t_min > 1) & (s.t_min < s.t_max) & (s.thresholds > 0),
    "counts must not be negative": lambda s: (s.max_pixels >= 0) & (s.max_pairs >= 0) & (s.max_images >= 0),
    "delta05 must be over 1": lambda s: s.delta05 > 1,
    "polarity must be auto, far_white or near_white": lambda s: _in(s.polarity, "auto", "far_white", "near_white"),
    "resize must be nearest, bilinear, bicubic or lanczos": lambda s: _in(s.resize, "nearest", "bilinear", "bicubic", "lanczos"),
}


@dataclass(frozen=True)
class MatchSettings(_Checked):
    """Settings of how images are paired; a value out of range raises."""

    mode: str = "stem"
    suffix: str = ""
    dropped_part: str = ""
    mask_threshold: float = 0.5
    backbone: str = "alex"

    rules = _MATCH_RULES


@dataclass(frozen=True)
class DepthSettings(_Checked):
    """Settings of a depth evaluation; a value out of range raises.  A sample of 0 pixels is all of them."""

    width: int = 1280
    height: int = 720
    mask_threshold: float = 0.5
    t_min: float = 1.05
    t_max: float = 1.25
    thresholds: int = 10
    max_pixels: int = 20_000
    max_pairs: int = 200_000
    max_images: int = 0
    polarity: str = "auto"
    delta05: float = 1.25**0.5
    resize: str = "bilinear"
    seed: int = 12345

    rules = _DEPTH_RULES
