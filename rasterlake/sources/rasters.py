"""Decoders of raster files from bytes, in numpy: PNG, BMP, NPY and DAT.  JPEG, WebP, TIFF and EXR need libraries that may be missing."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RASTER = T.StructType(
    [
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())
    ]
)

#: Channels by PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """(h, w, c) of the stored samples (palettes resolved), as unsigned integers."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if interlace:
        raise ValueError("interlaced PNG")
    channels = _CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    step = max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, stride + 1)
    lines = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for i in range(step):
                line[i::step] = np.cumsum(line[i::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            left, corner = [0] * stride, above.tolist()
            up, cur = corner, line.tolist()
            for i in range(stride):
                a = left[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + up[i] - c
                    near = (abs(p - a), abs(p - up[i]), abs(p - c))
                    guess = a if near[0] <= near[1] and near[0] <= near[2] else up[i] if near[1] <= near[2] else c
                left[i] = (cur[i] + guess) & 255
            line = np.array(left, np.uint8)
        lines[y] = above = line
    if depth == 16:
        out = lines.reshape(height, width, channels, 2).astype(np.uint16)
        out = out[..., 0] << 8 | out[..., 1]
    elif depth == 8:
        out = lines.reshape(height, width, channels)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        out = (bits * (1 << np.arange(depth)[::-1])).sum(2, dtype=np.uint8)[..., None]
        if colour == 0:
            out = out * (255 // ((1 << depth) - 1))
    return palette[out[..., 0]] if colour == 3 else out


def encode_png(image: np.ndarray) -> bytes:
    """(h, w) or (h, w, 3) bytes as a PNG."""
    h, w = image.shape[:2]
    body = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1).astype(np.uint8)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def decode_bmp(content: bytes) -> np.ndarray:
    """(h, w, 3) of an uncompressed bitmap of 8 (palette), 24 or 32 bits."""
    start, _, width, height, _, bits, packed = struct.unpack("<10xIIiiHHI", content[:34])
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"bitmap of {bits} bits, compression {packed}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        (header,) = struct.unpack("<I", content[14:18])
        palette = np.frombuffer(content[14 + header : start], np.uint8).reshape(-1, 4)
        return palette[rows][..., 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[..., 2::-1]


def decode(content: bytes) -> np.ndarray:
    """(h, w, c) of an image file by its first bytes; formats beyond PNG and BMP by Pillow, where it is installed."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(content)
    if content[:2] == b"BM":
        return decode_bmp(content)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("image formats other than PNG and BMP need the Pillow library") from e
    image = np.asarray(Image.open(io.BytesIO(content)))
    return image if image.ndim == 3 else image[..., None]


def read_rgb(content: bytes) -> np.ndarray:
    """Three channels in 0..1."""
    image = decode(content)
    image = (image >> 8 if image.dtype == np.uint16 else image).astype(np.float64)
    image = image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, 2)
    return image / 255


def read_gray(content: bytes) -> np.ndarray:
    """One channel in 0..1 by the luma of 8-bit channels."""
    rgb = np.rint(read_rgb(content) * 255)
    return np.floor((rgb @ np.array([299, 587, 114]) + 500) / 1000)[..., None] / 255


def read_depth(content: bytes) -> np.ndarray:
    """The first channel as stored, of gray images; luma of colour ones without alpha."""
    image = decode(content)
    return image[..., :1].astype(np.float64) if image.shape[2] in (1, 2, 4) else read_gray(content) * 255


def read_npy(content: bytes) -> np.ndarray:
    image = np.squeeze(np.load(io.BytesIO(content), allow_pickle=False))
    if image.ndim != 2:
        raise ValueError(f"expected a 2-D array, found shape {image.shape}")
    return image.astype(np.float64)[..., None]


def read_dat(content: bytes) -> np.ndarray:
    """Height and width as little-endian uint32, then float32 values."""
    if len(content) < 8:
        raise ValueError("header is short")
    height, width = struct.unpack("<II", content[:8])
    values = np.frombuffer(content, "<f4", offset=8)
    if values.size != height * width:
        raise ValueError(f"header says {height} x {width}, the file has {values.size} values")
    return values.reshape(height, width, 1).astype(np.float64)


def read_exr(content: bytes) -> np.ndarray:
    try:
        import OpenEXR  # noqa: F401
    except ImportError as e:
        raise ValueError("EXR files need the OpenEXR library") from e
    with OpenEXR.File(io.BytesIO(content)) as f:
        channels = f.channels()
        name = next((c for c in ("R", "Y", "Z") if c in channels), next(iter(channels)))
        return np.asarray(channels[name].pixels, np.float64)[..., None]


READERS: dict[str, Callable[[bytes], np.ndarray]] = {"rgb": read_rgb, "gray": read_gray, "depth": read_depth, "npy": read_npy, "dat": read_dat, "exr": read_exr}


def decoded(content: Column, kind: str) -> Column:
    """A file's raster, or the reason why it can't be read: one bad file doesn't end the run."""
    read = READERS[kind]

    @F.pandas_udf(RASTER)
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                image = read(bytes(c))
                out.append((*image.shape, image.ravel(), None))
            except Exception as e:
                out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=RASTER.names)

    return run(content)


def depth_in_metres(data: Column) -> Column:
    """Ground truth in metres: millimetres recognised by the 95th percentile; non-finite and non-positive values null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rasters: pd.Series) -> pd.Series:
        out = []
        for v in rasters:
            v = np.array(v, float)
            good = np.isfinite(v) & (v > 0)
            scale = 0.001 if good.any() and np.percentile(v[good], 95) > 100 else 1.0
            out.append(np.where(good, v * scale, np.nan))
        return pd.Series(out)

    return run(data)


def masked(mask: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """Validity of each pixel of a gray mask: at or over the threshold, or strictly over it."""
    return F.transform(mask, lambda v: (v > threshold) if strict else (v >= threshold))


def resized(raster: Column, height: int, width: int, method: str = "bilinear", eight_bit: bool = False) -> Column:
    """A raster struct resized; with ``eight_bit`` as the bytes that its values in 0..1 stand for, in whole numbers."""
    from ..functions.kernels import resize, resize_bytes

    def sized(image: np.ndarray) -> np.ndarray:
        if not eight_bit:
            return resize(image, height, width, method)
        return resize_bytes(np.rint(np.clip(image, 0, 1) * 255).astype(np.uint8), height, width, method) / 255

    @F.pandas_udf(RASTER)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data, error in rows.itertuples(index=False):
            out.append((height, width, c, sized(np.array(data).reshape(int(h), int(w), int(c))).ravel(), None) if error is None else (None, None, None, None, error))
        return pd.DataFrame(out, columns=RASTER.names)

    return run(raster)


def limited(raster: Column, most: int) -> Column:
    """A raster struct whose longer side is at most ``most``."""
    from ..functions.kernels import resize

    @F.pandas_udf(RASTER)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data, error in rows.itertuples(index=False):
            if error is not None or max(h, w) <= most:
                out.append((h, w, c, data, error))
                continue
            scale = most / max(h, w)
            height, width = max(1, round(h * scale)), max(1, round(w * scale))
            out.append((height, width, c, resize(np.array(data).reshape(int(h), int(w), int(c)), height, width, "lanczos").ravel(), None))
        return pd.DataFrame(out, columns=RASTER.names)

    return run(raster)


BOXED = T.StructType([T.StructField("raster", RASTER), T.StructField("box", T.ArrayType(T.IntegerType()))])


def letterboxed(raster: Column, height: int, width: int) -> Column:
    """A raster struct fitted into a canvas with stretched edges, and the content's box (left, top, right, bottom)."""
    from ..functions.kernels import letterbox

    @F.pandas_udf(BOXED)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rasters, boxes = [], []
        for h, w, c, data, error in rows.itertuples(index=False):
            if error is None:
                canvas, box = letterbox(np.array(data).reshape(int(h), int(w), int(c)), height, width)
                rasters.append(dict(zip(RASTER.names, (height, width, int(c), canvas.ravel().tolist(), None), strict=True)))
                boxes.append(list(box))
            else:
                rasters.append(dict.fromkeys(RASTER.names[:4]) | {"error": error})
                boxes.append(None)
        return pd.DataFrame({"raster": rasters, "box": boxes})

    return run(raster)


def cropped_back(raster: Column, box: Column, canvas: tuple[int, int], height: int, width: int) -> Column:
    """The content's box cut from an answer of any size and resized to the source's; ``canvas`` is (width, height)."""
    from ..functions.kernels import crop_back

    @F.pandas_udf(RASTER)
    def run(rows: pd.DataFrame, boxes: pd.Series) -> pd.DataFrame:
        out = []
        for (h, w, c, data, error), b in zip(rows.itertuples(index=False), boxes, strict=True):
            out.append(
                (
                    height, width, c, crop_back(np.array(data).reshape(int(h), int(w), int(c)), tuple(map(int, b)), canvas, height, width).ravel(), None
                ) if error is None else (None, None, None, None, error)
            )
        return pd.DataFrame(out, columns=RASTER.names)

    return run(raster, box)


def png(raster: Column) -> Column:
    """A raster struct of values in 0..1 as PNG bytes."""

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.DataFrame) -> pd.Series:
        made = []
        for h, w, c, data, _ in rows.itertuples(index=False):
            image = np.rint(np.clip(np.array(data), 0, 1) * 255).reshape(int(h), int(w), int(c))
            made.append(encode_png(image[..., 0] if c == 1 else image))
        return pd.Series(made)

    return run(raster)
