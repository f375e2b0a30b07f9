"""Numpy kernels over one image, or over a stack of images of one shape."""

from __future__ import annotations

import math

import numpy as np

# fixed values: SSIM's window and constants
SSIM_WINDOW, SSIM_K1, SSIM_K2 = 7, 0.01, 0.03


def mixed(places: np.ndarray, seed: int) -> np.ndarray:
    """32 bits for each place of an image: a one-to-one mixing of its bits after adding the seed, so no two places below 2^32 share a value."""
    x = (places.astype(np.uint64) + np.uint64(seed % (1 << 32))) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def bottom_k(places: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The ``k`` places with the smallest seeded hash, ascending: a sample without replacement.

    Samples of parts of an image merge: the sample of the whole is that of the parts' samples.
    """
    if len(places) <= k:
        return places
    return np.sort(places[np.argpartition(mixed(places, seed), k - 1)[:k]])


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Exact tau-b in n log n: discordant pairs are inversions, counted by merging."""
    keep = np.isfinite(x) & np.isfinite(y)
    x, y = x[keep], y[keep]
    n = len(x)
    if n < 2:
        return math.nan

    def tied(*cols: np.ndarray) -> int:
        _, c = np.unique(np.stack(cols, 1), axis=0, return_counts=True)
        return int((c * (c - 1) // 2).sum())

    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1]
    discordant, width = 0, 1
    while width < n:  # bottom-up merge; equal values don't count
        for lo in range(0, n - width, 2 * width):
            left, right = rank[lo : lo + width], rank[lo + width : lo + 2 * width]
            discordant += int((len(left) - np.searchsorted(left, right, "right")).sum())
            rank[lo : lo + 2 * width] = np.sort(rank[lo : lo + 2 * width], kind="stable")
        width *= 2
    pairs = n * (n - 1) // 2
    tx, ty, both = tied(x), tied(y), tied(x, y)
    den = math.sqrt((pairs - tx) * (pairs - ty))
    return (pairs - tx - ty + both - 2 * discordant) / den if den > 0 else math.nan


def kendall_stack(x: np.ndarray, y: np.ndarray, block: int = 4_000_000) -> np.ndarray:
    """Tau-b of each row of (n, pixels) stacks by the signs of all pairs: for small images."""
    a, b = np.triu_indices(x.shape[1], 1)
    out = np.full(len(x), math.nan)
    if not len(a):
        return out
    step = max(1, block // len(a))
    for k in range(0, len(x), step):
        sx, sy = (np.sign(v[k : k + step][:, a] - v[k : k + step][:, b]) for v in (x, y))
        nx, ny = np.count_nonzero(sx, 1), np.count_nonzero(sy, 1)
        den = np.sqrt(nx.astype(float) * ny)
        out[k : k + step] = np.where(den > 0, (sx * sy).sum(1) / np.where(den > 0, den, 1), math.nan)
    return out


def sampled_tau(x: np.ndarray, y: np.ndarray, pairs: int, seed: int) -> float:
    """Mean agreement in sign over seeded random pairs that differ in both."""
    if len(x) < 2 or pairs <= 0:
        return math.nan
    a, b = np.random.default_rng(seed & 0xFFFFFFFF).integers(0, len(x), (2, pairs))
    s = np.sign(x[a] - x[b]) * np.sign(y[a] - y[b])
    return float(s[s != 0].mean()) if (s != 0).any() else math.nan


def boundary_f1(pred: np.ndarray, gt: np.ndarray, valid: np.ndarray, t_min: float = 1.05, t_max: float = 1.25, steps: int = 10) -> np.ndarray:
    """Boundary F1 of inverse depths for a stack (n, h, w), averaged over thresholds with weights in proportion to them."""
    inverse = [1.0 / np.maximum(d, 1e-6) for d in (pred, gt)]
    sides = []
    for a, b in (((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(1, None), slice(None)), (slice(None, -1), slice(None)))):
        ok = valid[:, *a] & valid[:, *b]
        for u, v in ((a, b), (b, a)):
            sides.append([np.where(ok, d[:, *u] / d[:, *v], 0.0) for d in inverse])
    thresholds = np.linspace(t_min, t_max, steps)
    total = np.zeros(len(gt))
    for t in thresholds:
        precision = recall = 0.0
        for p, g in sides:
            hits = ((p > t) & (g > t)).sum((1, 2))
            recall = recall + hits / np.maximum((g > t).sum((1, 2)), 1) / 4
            precision = precision + hits / np.maximum((p > t).sum((1, 2)), 1) / 4
        both = recall + precision
        total += t * np.where(both > 0, 2 * recall * precision / np.where(both > 0, both, 1), 0)
    total /= thresholds.sum()
    total[valid.sum((1, 2)) < 2] = math.nan
    return total


def ssim(a: np.ndarray, b: np.ndarray, data_range: float = 1.0) -> np.ndarray:
    """Mean structural similarity of stacks (n, h, w) or (n, h, w, c): uniform windows, sample covariance, window centres only; NaN below the window's size."""
    if a.ndim == 4:
        return np.mean([ssim(a[..., c], b[..., c], data_range) for c in range(a.shape[3])], 0)
    if min(a.shape[1:]) < SSIM_WINDOW:
        return np.full(len(a), math.nan)
    n = SSIM_WINDOW**2

    def mean(v: np.ndarray) -> np.ndarray:
        s = np.pad(v.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
        k = SSIM_WINDOW
        return (s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]) / n

    ma, mb = mean(a), mean(b)
    va, vb, vab = ((mean(u * v) - m) * n / (n - 1) for u, v, m in ((a, a, ma * ma), (b, b, mb * mb), (a, b, ma * mb)))
    c1, c2 = (SSIM_K1 * data_range) ** 2, (SSIM_K2 * data_range) ** 2
    return (((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean((1, 2))


def masked_ssim(gt: np.ndarray, pred: np.ndarray, mask: np.ndarray) -> float:
    """SSIM within the mask's bounding box, with gt in place of predictions outside the mask."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return math.nan
    box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
    inside = mask if gt.ndim == 2 else mask[..., None]
    return float(ssim(gt[box][None], np.where(inside, pred, gt)[box][None])[0])


def components(labels: np.ndarray) -> np.ndarray:
    """4-connected components of equal labels: the smallest flat place of each pixel's component."""
    h, w = labels.shape
    root = np.arange(h * w).reshape(h, w)
    down, right = labels[1:] == labels[:-1], labels[:, 1:] == labels[:, :-1]
    while True:
        before = root.copy()
        for near, a, b in ((down, np.s_[1:, :], np.s_[:-1, :]), (right, np.s_[:, 1:], np.s_[:, :-1])):
            least = np.where(near, np.minimum(before[a], before[b]), h * w)
            root[a] = np.minimum(root[a], least)
            root[b] = np.minimum(root[b], least)
        root = root.ravel()[root]  # jump to the root's root
        if (root == before).all():
            return root


def fill_regions(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Every component filled with its mean, rounded half to even, as bytes."""
    root = components(labels).ravel()
    sums, counts = np.bincount(root, values.ravel().astype(np.float64), root.size), np.bincount(root, minlength=root.size)
    means = np.clip(np.rint(sums / np.maximum(counts, 1)), 0, 255).astype(np.uint8)
    return means[root].reshape(values.shape)


def average_ranks(v: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """0-based ranks within each row of (n, pixels), of the pixels that are ``ok``; ties share the mean of theirs."""
    key = np.where(ok, v, np.inf)
    order = np.argsort(key, 1, kind="stable")
    ordered = np.take_along_axis(key, order, 1)
    change = ordered[:, 1:] != ordered[:, :-1]
    edge = np.ones((len(v), 1), bool)
    at = np.arange(v.shape[1])
    first = np.maximum.accumulate(np.where(np.concatenate([edge, change], 1), at, 0), 1)
    last = np.minimum.accumulate(np.where(np.concatenate([change, edge], 1), at, len(at))[:, ::-1], 1)[:, ::-1]
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + last) / 2, 1)
    return out


def _mean(v: np.ndarray, ok: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of the ``ok`` values of each row; NaN without any."""
    return np.where(ok, v, 0).sum(1) / np.where(n > 0, n, np.nan)


def spearman(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Rank correlation of each row: 0 without variance, NaN below two pixels."""
    n = ok.sum(1)
    dx, dy = (np.where(ok, average_ranks(v, ok) - (n[:, None] - 1) / 2, 0) for v in (x, y))  # ranks' mean is known
    den = np.sqrt((dx * dx).sum(1) * (dy * dy).sum(1))
    return np.where(n < 2, np.nan, np.where(den > 0, (dx * dy).sum(1) / np.where(den > 0, den, 1), 0.0))


def depth_metrics(gt: np.ndarray, pred: np.ndarray, valid: np.ndarray, polarity: str = "auto", delta05: float = 1.25**0.5) -> dict[str, np.ndarray]:
    """Affine-invariant depth metrics of (n, pixels) stacks, one for each image, and the ``oriented`` and ``aligned`` predictions.

    The prediction is scaled to 0..1 within the mask (a constant one to 0), reversed if
    that correlates strictly better (or as ``polarity`` says), and fitted to the ground
    truth by least squares of the smallest norm.  Fewer than two pixels give NaN.
    """
    valid = valid.astype(bool)
    ok = valid & np.isfinite(gt) & (gt > 0) & np.isfinite(pred)
    n = ok.sum(1)
    gt, pred = np.where(ok, gt, 1.0), np.where(ok, pred, 0.0)
    lo, hi = np.where(ok, pred, np.inf).min(1, initial=np.inf)[:, None], np.where(ok, pred, -np.inf).max(1, initial=-np.inf)[:, None]
    norm = np.where(ok & (hi > lo), (pred - np.where(ok, lo, 0)) / np.where(hi > lo, hi - lo, 1), 0.0)
    rho = spearman(gt, norm, ok)
    near = rho < 0 if polarity == "auto" else np.full(len(gt), polarity == "near_white")
    oriented = np.where(near[:, None], 1 - norm, norm)
    mg, mx = _mean(gt, ok, n), _mean(oriented, ok, n)
    dx, dg = np.where(ok, oriented - mx[:, None], 0), np.where(ok, gt - mg[:, None], 0)
    var = (dx * dx).sum(1)
    flat = ~(var > 0) | (hi <= lo)[:, 0]
    constant = near.astype(float)  # what a constant prediction is after scaling
    scale = np.where(flat, mg * constant / (constant**2 + 1), (dx * dg).sum(1) / np.where(flat, 1, var))
    shift = np.where(flat, mg / (constant**2 + 1), mg - scale * mx)
    aligned = scale[:, None] * oriented + shift[:, None]
    g, a, e = np.maximum(gt, 1e-6), np.maximum(aligned, 1e-6), np.abs(aligned - gt)
    ratio = np.maximum(a / g, g / a)
    rmse = np.sqrt(_mean(e * e, ok, n))
    out = {
        "valid_pixels": n, "mask_excluded": (~valid).sum(1), "polarity": np.where(near, "near_white", "far_white"), "rho": np.where(near, -rho, rho), "scale": scale,
        "shift": shift, "absrel": _mean(e / g, ok, n), "rmse": rmse, "rms": rmse, "mae": _mean(e, ok, n)
    }
    out |= {k: _mean(ratio < t, ok, n) for k, t in (("delta1", 1.25), ("delta2", 1.25**2), ("delta3", 1.25**3), ("delta05", delta05))}
    out |= {"log10": _mean(np.abs(np.log10(a) - np.log10(g)), ok, n), "mean_oriented": mx}
    few = n < 2
    for k, v in out.items():
        if v.dtype == float:
            out[k] = np.where(few, np.nan, v)
    return out | {"ok": ok, "oriented": oriented, "aligned": aligned}


#: Thresholds of angular accuracy, in degrees.
ANGLES = {"acc_5": 5.0, "acc_7_5": 7.5, "acc_11_25": 11.25, "acc_22_5": 22.5, "acc_30": 30.0}


def unit_normals(encoded: np.ndarray, flip: tuple[bool, bool, bool] = (False, False, False)) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of normals encoded in 0..1 (..., 3), and which are legal."""
    v = (encoded * 2 - 1) * np.where(flip, -1, 1)
    length = np.sqrt((v * v).sum(-1))
    legal = np.isfinite(length) & (length > 1e-6)
    return np.where(legal[..., None], v / np.where(legal, length, 1)[..., None], 0.0), legal


def angular_metrics(gt: np.ndarray, pred: np.ndarray, valid: np.ndarray | None = None, flip: tuple[bool, bool, bool] = (False, True, True), front_only: bool = False) -> dict[str, np.ndarray]:
    """Angles between encoded normals of (n, 3 * pixels) stacks, in degrees; with ``front_only``, where the ground truth faces the camera."""
    (g, g_ok), (p, p_ok) = (unit_normals(v.reshape(len(v), v.shape[1] // 3, 3), f) for v, f in ((gt, (False, False, False)), (pred, flip)))
    ok = g_ok & p_ok
    if valid is not None:
        ok &= valid.astype(bool)
    if front_only:
        ok &= g[..., 2] > 0
    angle = np.degrees(np.arccos(np.clip((g * p).sum(2), -1, 1)))
    n = ok.sum(1)
    total, squares = np.where(ok, angle, 0).sum(1), np.where(ok, angle * angle, 0).sum(1)
    some = np.where(n > 0, n, np.nan)
    ordered = np.sort(np.where(ok, angle, np.inf), 1)
    pick = lambda i: np.take_along_axis(ordered, np.clip(i, 0, max(0, angle.shape[1] - 1))[:, None], 1)[:, 0] if angle.shape[1] else np.full(len(n), np.nan)
    median = np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)
    out = {"valid_pixels": n, "mean_angle": total / some, "median_angle": median, "rms_angle": np.sqrt(squares / some), "sum_angle": total, "sum_sq": squares}
    return out | {k: (ok & (angle < t)).sum(1) / some for k, t in ANGLES.items()}


# resampling: a separable matrix for each axis, widened on reduction

_SUPPORT = {"bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def _kernel(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name == "bilinear":
        return np.maximum(0, 1 - x)
    if name == "bicubic":
        return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)


def axis_matrix(size: int, target: int, method: str) -> np.ndarray:
    """(target, size) weights of a resize along one axis."""
    scale = size / target
    if method == "nearest":
        return (np.arange(size)[None] == np.minimum(size - 1, ((np.arange(target) + 0.5) * scale).astype(int))[:, None]).astype(float)
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    reach = _SUPPORT[method] * wide
    cols = np.arange(size)
    first, last = np.maximum(0, (centre - reach + 0.5).astype(int)), np.minimum(size, (centre + reach + 0.5).astype(int))
    weights = _kernel(method, (cols[None] + 0.5 - centre[:, None]) / wide)
    weights[(cols[None] < first[:, None]) | (cols[None] >= last[:, None])] = 0
    return weights / weights.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """(h, w) or (h, w, c) in floating point."""
    if image.shape[:2] == (height, width):
        return image.astype(np.float64)
    rows = np.tensordot(axis_matrix(image.shape[0], height, method), image.astype(np.float64), (1, 0))
    return np.moveaxis(np.tensordot(axis_matrix(image.shape[1], width, method), rows, (1, 1)), 0, 1)


#: Bits of the whole numbers that stand for weights in 8-bit resampling: a byte, a weight and two spare bits fill 32.
WEIGHT_BITS = 22


def resize_bytes(image: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """(h, w) or (h, w, c) bytes resampled in whole numbers, as 8-bit image libraries do: across, rounded to bytes, then down.

    A weight is rounded to ``WEIGHT_BITS`` bits, halves away from zero, and a sum is
    rounded and clipped to a byte after each pass; an axis that keeps its length is left.
    """
    out = image.astype(np.int64)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            if method == "nearest":
                out = np.moveaxis(np.tensordot(axis_matrix(out.shape[axis], size, method).astype(np.int64), out, (1, axis)), 0, axis)
                continue
            exact = axis_matrix(out.shape[axis], size, method) * (1 << WEIGHT_BITS)
            weights = (np.sign(exact) * np.floor(np.abs(exact) + 0.5)).astype(np.int64)
            sums = np.moveaxis(np.tensordot(weights, out, (1, axis)), 0, axis) + (1 << WEIGHT_BITS - 1)
            out = np.clip(sums >> WEIGHT_BITS, 0, 255)
    return out.astype(np.uint8)


def letterbox(image: np.ndarray, height: int, width: int) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Fitted into a canvas, the border stretched from the edge pixels; and the content's box (left, top, right, bottom)."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    rw, rh = max(1, min(width, round(w * scale))), max(1, min(height, round(h * scale)))
    left, top = (width - rw) // 2, (height - rh) // 2
    inner = resize(image, rh, rw, "lanczos")
    pad = [(top, height - rh - top), (left, width - rw - left)] + [(0, 0)] * (image.ndim - 2)
    return np.pad(inner, pad, "edge"), (left, top, left + rw, top + rh)


def crop_back(image: np.ndarray, box: tuple[int, int, int, int], canvas: tuple[int, int], height: int, width: int) -> np.ndarray:
    """The content's box, scaled from the canvas (width, height) to the image's own size, cropped and resized to the source's."""
    h, w = image.shape[:2]
    sx, sy = w / canvas[0], h / canvas[1]
    l, t, r, b = round(box[0] * sx), round(box[1] * sy), round(box[2] * sx), round(box[3] * sy)
    l, t = max(0, min(l, w - 1)), max(0, min(t, h - 1))
    r, b = max(l + 1, min(r, w)), max(t + 1, min(b, h))
    return resize(image[t:b, l:r], height, width, "lanczos")
