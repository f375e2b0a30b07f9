import itertools
import math

import numpy as np
import pytest

from rasterlake.functions import kernels as K


def test_kendall_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 3, 9, 40, 65):
        x, y = rng.integers(0, 8, n).astype(float), rng.integers(0, 8, n).astype(float)
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(n), 2))
        nx, ny = (sum(v[i] != v[j] for i, j in itertools.combinations(range(n), 2)) for v in (x, y))
        if nx and ny:
            assert K.kendall_tau_b(x, y) == pytest.approx(s / math.sqrt(nx * ny))
            assert K.kendall_stack(np.stack([x, x]), np.stack([y, x]), 50) == pytest.approx([s / math.sqrt(nx * ny), 1])
    assert math.isnan(K.kendall_tau_b(np.ones(5), np.arange(5.0)))
    assert math.isnan(K.kendall_tau_b(np.array([1.0, np.nan]), np.array([1.0, 2.0])))


def test_sampled_tau_of_monotone_values_is_one():
    x = np.arange(100.0)
    assert K.sampled_tau(x, x * 3, 1000, 5) == 1.0
    assert math.isnan(K.sampled_tau(x[:1], x[:1], 10, 1))


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        labels = rng.integers(0, 3, (rng.integers(1, 12), rng.integers(1, 12)))
        root = K.components(labels)
        seen = -np.ones(labels.shape, int)
        for y, x in np.ndindex(labels.shape):
            if seen[y, x] < 0:
                stack, first = [(y, x)], y * labels.shape[1] + x
                seen[y, x] = first
                while stack:
                    a, b = stack.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < labels.shape[0] and 0 <= d < labels.shape[1] and seen[c, d] < 0 and labels[c, d] == labels[a, b]:
                            seen[c, d] = first
                            stack.append((c, d))
        assert (root == seen).all()


def test_fill_takes_means_half_to_even():
    out = K.fill_regions(np.array([[1, 2, 9]]), np.array([[0, 0, 1]]))
    assert out.tolist() == [[2, 2, 9]] and out.dtype == np.uint8


def test_ssim_of_equal_images_and_of_small_ones():
    a = np.random.default_rng(3).random((2, 9, 11))
    assert np.allclose(K.ssim(a, a), 1)
    assert np.isnan(K.ssim(a[:, :6], a[:, :6])).all()
    assert K.ssim(np.stack([a, a], -1), np.stack([a, a], -1)) == pytest.approx([1, 1])


def test_masked_ssim_ignores_what_is_outside():
    rng = np.random.default_rng(4)
    gt, pred, mask = rng.random((12, 12)), rng.random((12, 12)), np.zeros((12, 12), bool)
    assert math.isnan(K.masked_ssim(gt, pred, mask))
    mask[2:10, 2:10] = True
    pred[mask] = gt[mask]
    assert K.masked_ssim(gt, pred, mask) == pytest.approx(1)


def test_boundary_f1_of_a_perfect_and_a_flat_prediction():
    gt = np.ones((1, 6, 6))
    gt[:, :, 3:] = 2
    ok = np.ones((1, 6, 6), bool)
    assert 0 < K.boundary_f1(gt, gt, ok)[0] <= 0.5  # two of four directions have no edge
    assert K.boundary_f1(np.ones_like(gt), gt, ok)[0] == 0
    assert math.isnan(K.boundary_f1(gt, gt, np.zeros_like(ok))[0])


def test_resize_keeps_constants_and_identity():
    a = np.random.default_rng(5).random((7, 5, 3))
    assert (K.resize(a, 7, 5) == a).all()
    for method in ("nearest", "bilinear", "bicubic", "lanczos"):
        assert np.allclose(K.resize(np.full((7, 5), 0.25), 13, 3, method), 0.25)
    assert K.resize(np.arange(4.0)[None], 1, 2, "nearest").tolist() == [[1, 3]]
    assert np.allclose(K.resize(np.array([[0.0, 1.0]]), 1, 4), [[0, 0.25, 0.75, 1]])


def test_letterbox_and_back():
    a = np.full((10, 40), 3.0)
    canvas, box = K.letterbox(a, 100, 100)
    assert canvas.shape == (100, 100) and box == (0, 38, 100, 63) or box == (0, 37, 100, 62)
    assert np.allclose(canvas, 3)
    assert np.allclose(K.crop_back(canvas, box, (100, 100), 10, 40), 3)


def test_bytes_are_resampled_in_whole_numbers():
    step = np.array([[0, 255]], np.uint8)
    assert K.resize_bytes(step, 1, 4).tolist() == [[0, 64, 191, 255]]
    assert K.resize_bytes(np.array([[0, 255, 0, 255]], np.uint8), 1, 2).tolist() == [[109, 146]]  # weights 3, 3, 1 and 1, 3, 3 of 7
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (9, 13, 3)).astype(np.uint8)
    for method in ("nearest", "bilinear", "bicubic", "lanczos"):
        for shape in ((4, 5), (20, 31), (9, 7), (3, 13)):
            got = K.resize_bytes(image, *shape, method)
            assert got.shape == (*shape, 3)
            exact = np.clip(K.resize(image, *shape, method), 0, 255)
            assert np.abs(got - exact).max() <= (0 if method == "nearest" else 60 if method == "lanczos" else 45)
            assert np.mean(np.abs(got - exact)) < 1.5
        assert np.array_equal(K.resize_bytes(image, 9, 13, method), image)
    flat = np.full((5, 6), 77, np.uint8)
    assert all((K.resize_bytes(flat, h, w, m) == 77).all() for h, w in ((2, 3), (11, 14)) for m in ("bilinear", "bicubic", "lanczos"))
