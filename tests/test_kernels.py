"""Kernels against plain loops, on closed-form rasters."""

from __future__ import annotations

import numpy as np
import pytest

from markloom.operators import kernels as k

Y, X = np.mgrid[0:50, 0:60]
TEXTURE = ((X * 7 + Y * 13) % 31) * 4 + 60


def test_texture_sum():
    assert TEXTURE.sum() == 359980


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_windows_equal_loops(radius):
    a = TEXTURE[:14, :17]
    cut = lambda y, x: a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
    for y in range(14):
        for x in range(17):
            assert k.box_blur(a, radius)[y, x] == pytest.approx(cut(y, x).mean())
            assert k.erode(a, radius)[y, x] == cut(y, x).min() and k.dilate(a, radius)[y, x] == cut(y, x).max()


def test_constant_planes():
    flat = np.full((20, 30), 7.0)
    assert np.allclose(k.gaussian(flat, 2.0), 7) and np.allclose(k.resize(flat, 11, 9), 7) and np.allclose(k.resize(flat, 61, 50), 7)
    assert k.otsu(flat) == 7 and k.ncc(flat, TEXTURE[:20, :30]) == 0 and not k.top_hat(flat, 3).any()


def test_resize_by_area():
    assert np.allclose(k.resize(TEXTURE, 30, 25), TEXTURE.reshape(25, 2, 30, 2).mean((1, 3)))


def test_otsu_separates():
    assert 40 <= k.otsu(np.where(X % 8 < 4, 40, 210)) < 210


def test_components_and_holes():
    m = np.zeros((9, 12), bool)
    m[1:6, 1:6] = True
    m[2:5, 2:5] = False
    m[6, 6] = m[7, 7] = True
    m[0, 10] = True
    labels, found = k.components(m)
    assert [c["area"] for c in found] == [1, 18] and labels[0, 10] == 1 and labels[7, 7] == labels[1, 1] == 2
    assert k.fill_enclosed(m)[3, 3] and k.without_small(m, 2).sum() == 18
    assert k.hysteresis(np.where(m, 0.4, 0.0) + (labels == 1) * 0.5, 0.3, 0.8).sum() == 1


def test_distance_grow_shrink():
    m = np.zeros((11, 11), bool)
    m[5, 5] = True
    assert k.distance(m)[5, 0] == 5 and k.distance(m)[2, 2] == pytest.approx(3 * 2**0.5)
    assert k.grow(m, 1).sum() == 5 and k.shrink(k.grow(m, 1), 1).sum() == 1
    assert k.feather(m, 0).max() == 255 and k.feather(m, 2)[5, 6] == 128


def test_composite_never_leaves_the_mask():
    rgb = np.stack([TEXTURE] * 3, -1).astype(np.uint8)
    mask = np.zeros(TEXTURE.shape, np.uint8)
    mask[20:30, 15:45] = 128
    out = k.composite(rgb, np.zeros_like(rgb), mask)
    assert (out[mask == 0] == rgb[mask == 0]).all() and out[25, 20, 0] == (int(rgb[25, 20, 0]) * 127 + 127) // 255


def test_autocorrelation_finds_the_period():
    c = k.autocorrelation(np.where((X // 4) % 2 == 0, 40.0, 210.0))
    h, w = c.shape
    assert c[h // 2, w // 2] == pytest.approx(1) and c[h // 2, w // 2 + 8] > 0.95 and c[h // 2, w // 2 + 4] < -0.9


def test_shapes():
    assert k.polygon([(2, 2), (8, 2), (8, 6), (2, 6)], 12, 10).sum() == 24
    assert k.brush([(5, 5)], 1.0, 10, 10).sum() == 4
    assert k.hint_to_crop(np.full((4, 4), 9), (2, 2, 4, 4), 0, 0, 8, 8).sum() > 9 * 15
    gx, gy = k.sobel(X.astype(float))
    assert np.allclose(gx[:, 1:-1], 1) and np.allclose(gy, 0)
    assert k.paste(np.zeros((5, 5)), np.ones((3, 3)), 3, -1).sum() == 4 and k.crop(TEXTURE, -2, 48, 4, 9).shape == (2, 2)
