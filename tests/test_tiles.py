"""Regions of tiled images against those of the whole image."""

import numpy as np
import pytest

from rasterlake.functions import kernels
from rasterlake.operators import tiles


def cut(image, values, segments, tall, wide, gone=()):
    rows = []
    for ty, y in enumerate(range(0, values.shape[0], tall)):
        for tx, x in enumerate(range(0, values.shape[1], wide)):
            v, s = values[y : y + tall, x : x + wide], segments[y : y + tall, x : x + wide]
            if (ty, tx) not in gone:
                rows.append((image, ty, tx, *v.shape, v.ravel().tolist(), s.ravel().tolist()))
    return rows


SCHEMA = "image string, ty int, tx int, height int, width int, value array<int>, segment array<int>"


def test_regions_cross_tiles(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    snake = np.zeros((9, 40), int)  # one winding region through many tiles
    snake[::4] = 1
    snake[2::8, :] = 1
    snake[:, 0][1:3] = 1
    snake[4:6, -1] = 1
    for name, segments, shape in (("noise", rng.integers(0, 2, (23, 17)), (5, 4)), ("flat", np.ones((12, 12), int), (3, 5)), ("snake", snake, (2, 7)), ("one", rng.integers(0, 3, (4, 4)), (9, 9))):
        values = rng.integers(0, 256, segments.shape)
        rows += cut(name, values, segments, *shape)
        want[name] = (kernels.fill_regions(values, segments), shape)
    got = tiles.fill_regions(spark.createDataFrame(rows, SCHEMA).repartition(3), ["image"]).collect()
    assert len(got) == len(rows)
    for r in got:
        filled, (tall, wide) = want[r.image]
        part = filled[r.ty * tall : (r.ty + 1) * tall, r.tx * wide : (r.tx + 1) * wide]
        assert r.filled == part.ravel().tolist()


def test_missing_tiles_are_holes(spark):
    values, segments = np.arange(36).reshape(4, 9), np.zeros((4, 9), int)
    rows = cut("a", values, segments, 4, 3, gone={(0, 1)})
    got = {r.tx: set(r.filled) for r in tiles.fill_regions(spark.createDataFrame(rows, SCHEMA), ["image"]).collect()}
    assert got == {0: {round(float(values[:, :3].mean()))}, 2: {round(float(values[:, 6:].mean()))}}
    assert tiles.fill_regions(spark.createDataFrame([], SCHEMA), ["image"]).count() == 0


@pytest.mark.parametrize("n", [2, 33])
def test_long_chains_are_connected(spark, n):
    links = [("k", i, i + 1) for i in range(n)] + [("other", 5, 6), ("k", 1000, 1001)]
    got = {(r.k, r.node): r.root for r in tiles.connected(spark.createDataFrame(links, "k string, a int, b int"), ["k"]).collect()}
    assert got == {("k", i): 0 for i in range(n + 1)} | {("other", 5): 5, ("other", 6): 5, ("k", 1000): 1000, ("k", 1001): 1000}
