"""Box arithmetic of fitted and cropped images, as column expressions.  Rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return F.rint(c).cast("long")


def letterbox_box(w: Column, h: Column, width: int, height: int) -> dict[str, Column]:
    """The content's box of a (w, h) image centred in a canvas."""
    scale = F.least(width / w, height / h)
    rw = F.greatest(F.lit(1), F.least(F.lit(width), _int(w * scale)))
    rh = F.greatest(F.lit(1), F.least(F.lit(height), _int(h * scale)))
    left, top = F.floor((width - rw) / 2), F.floor((height - rh) / 2)
    return {"left": left, "top": top, "right": left + rw, "bottom": top + rh}


def scaled_box(left: str, top: str, right: str, bottom: str, ref_w: int, ref_h: int, w: Column, h: Column) -> dict[str, Column]:
    """A box on a reference canvas in pixels of a (w, h) image, at least one pixel wide and high."""
    sx, sy = w / ref_w, h / ref_h
    l = F.greatest(F.lit(0), F.least(_int(F.col(left) * sx), w - 1))
    t = F.greatest(F.lit(0), F.least(_int(F.col(top) * sy), h - 1))
    r = F.greatest(l + 1, F.least(_int(F.col(right) * sx), w))
    b = F.greatest(t + 1, F.least(_int(F.col(bottom) * sy), h))
    return {"crop_left": l, "crop_top": t, "crop_right": r, "crop_bottom": b}
