"""Raster kernels on numpy planes: what image rows run through Arrow-backed functions. Planes are (height, width)."""

from __future__ import annotations

import math

import numpy as np


def luma(rgba: np.ndarray) -> np.ndarray:
    """Brightness of colour planes (..., 3 or 4) by the BT.601 weights."""
    return rgba[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def saturation(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb[..., :3].max(-1).astype(float), rgb[..., :3].min(-1).astype(float)
    return np.where(high > 0, (high - low) / np.maximum(high, 1), 0.0)


def has_transparency(rgba: np.ndarray) -> bool:
    return rgba.shape[-1] == 4 and bool((rgba[..., 3] < 255).any())


def crop(a: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of the rectangle that lies in the plane."""
    return a[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def paste(a: np.ndarray, part: np.ndarray, x: int, y: int) -> np.ndarray:
    out = a.copy()
    h, w = min(part.shape[0], a.shape[0] - y), min(part.shape[1], a.shape[1] - x)
    if h > 0 and w > 0:
        out[max(0, y) : y + h, max(0, x) : x + w] = part[max(0, -y) : h, max(0, -x) : w]
    return out


def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and weights that bring n samples to m: means of areas when shrinking, a triangle when growing."""
    scale = n / m
    if scale > 1:
        low, high = np.arange(m) * scale, (np.arange(m) + 1) * scale
        width = math.ceil(scale) + 1
        at = np.floor(low).astype(int)[:, None] + np.arange(width)
        weight = np.clip(np.minimum(high[:, None], at + 1) - np.maximum(low[:, None], at), 0, None)
    else:
        place = (np.arange(m) + 0.5) * scale - 0.5
        at = np.floor(place).astype(int)[:, None] + np.arange(2)
        weight = np.stack([1 - (place - np.floor(place)), place - np.floor(place)], 1)
    return np.clip(at, 0, n - 1), weight / weight.sum(1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    rows, wr = _taps(a.shape[0], height)
    columns, wc = _taps(a.shape[1], width)
    tall = np.einsum("mk,mk...->m...", wr, a.astype(float)[rows])
    return np.einsum("mk,hmk...->hm...", wc, tall[:, columns])


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Means of squares, cut at the edges, by an integral image."""
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    total[1:, 1:] = a.astype(float).cumsum(0).cumsum(1)
    y0, y1 = (np.clip(np.arange(a.shape[0]) + d, 0, a.shape[0]) for d in (-radius, radius + 1))
    x0, x1 = (np.clip(np.arange(a.shape[1]) + d, 0, a.shape[1]) for d in (-radius, radius + 1))
    s = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return s / np.outer(y1 - y0, x1 - x0)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    radius = math.ceil(3 * sigma)
    tap = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    tap /= tap.sum()
    padded = np.pad(a.astype(float), radius, mode="edge")
    tall = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1, 0) @ tap
    return np.lib.stride_tricks.sliding_window_view(tall, 2 * radius + 1, 1) @ tap


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y, over 8, with clamped edges."""
    p = np.pad(a.astype(float), 1, mode="edge")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (smooth_y[:, 2:] - smooth_y[:, :-2]) / 8, (smooth_x[2:] - smooth_x[:-2]) / 8


def extreme(a: np.ndarray, radius: int, best) -> np.ndarray:
    """np.minimum or np.maximum over squares of side 2 radius + 1, cut at the edges: two passes of doubled spans."""
    fill = np.inf if best is np.minimum else -np.inf
    out = a.astype(float)
    for axis in (0, 1):
        p = np.moveaxis(np.pad(out, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], constant_values=fill), axis, 0)
        n, w, span = len(p) - 2 * radius, 2 * radius + 1, 1
        while 2 * span <= w:
            p = best(p[:-span], p[span:])
            span *= 2
        out = np.moveaxis(best(p[:n], p[w - span : w - span + n]), 0, axis)
    return out


def erode(a: np.ndarray, radius: int) -> np.ndarray:
    return extreme(a, radius, np.minimum)


def dilate(a: np.ndarray, radius: int) -> np.ndarray:
    return extreme(a, radius, np.maximum)


def top_hat(a: np.ndarray, radius: int, bright: bool = True) -> np.ndarray:
    """What is smaller than the square and brighter (or darker) than around it."""
    return a - dilate(erode(a, radius), radius) if bright else erode(dilate(a, radius), radius) - a


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distances (1, sqrt 2) to the nearest set pixel: rows forward, then backward."""
    far, diagonal = float(sum(mask.shape) * 2), math.sqrt(2)
    d = np.where(mask, 0.0, far)
    for flip in (False, True):
        v = d[::-1, ::-1] if flip else d
        step = np.arange(v.shape[1])
        for y in range(v.shape[0]):
            if y:
                up = np.pad(v[y - 1], 1, constant_values=far)
                v[y] = np.minimum(v[y], np.minimum(up[1:-1] + 1, np.minimum(up[:-2], up[2:]) + diagonal))
            v[y] = np.minimum.accumulate(v[y] - step) + step
    return d


def grow(mask: np.ndarray, radius: float) -> np.ndarray:
    return distance(mask) <= radius


def shrink(mask: np.ndarray, radius: float) -> np.ndarray:
    return mask & (distance(~mask) > radius)


def feather(mask: np.ndarray, radius: float) -> np.ndarray:
    """A soft mask, 255 inside, that falls to 0 over `radius` outside."""
    return np.clip(255 * (1 - distance(mask) / max(radius, 1e-6)), 0, 255).round().astype(np.uint8) if radius > 0 else mask.astype(np.uint8) * 255


def components(mask: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """8-connected components: labels from 1 in scan order, and area, rectangle and centroid of each.

    Runs of a row join the runs of the row above that they touch."""
    runs, up, above = [], [], []

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for y, row in enumerate(mask):
        turns = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0])).reshape(-1, 2).tolist()
        here = []
        for x0, x1 in turns:
            k = len(runs)
            runs.append((y, x0, x1))
            up.append(k)
            for j in above:
                if runs[j][1] <= x1 and runs[j][2] >= x0:
                    a, b = sorted((root(k), root(j)))
                    up[b] = a
            here.append(k)
        above = here
    labels, number, found = np.zeros(mask.shape, np.int32), {}, []
    for k, (y, x0, x1) in enumerate(runs):
        r = root(k)
        if r not in number:
            number[r] = len(found) + 1
            found.append({"area": 0, "x0": x0, "y0": y, "x1": x1, "y1": y + 1, "sx": 0.0, "sy": 0.0})
        c, n = found[number[r] - 1], x1 - x0
        labels[y, x0:x1] = number[r]
        c.update(area=c["area"] + n, x0=min(c["x0"], x0), x1=max(c["x1"], x1), y1=max(c["y1"], y + 1), sx=c["sx"] + (x0 + x1 - 1) / 2 * n, sy=c["sy"] + y * n)
    out = [{"area": c["area"], "x": c["x0"], "y": c["y0"], "w": c["x1"] - c["x0"], "h": c["y1"] - c["y0"], "cx": c["sx"] / c["area"], "cy": c["sy"] / c["area"]} for c in found]
    return labels, out


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels, found = components(mask)
    return np.r_[False, [c["area"] >= least for c in found]].astype(bool)[labels]


def hysteresis(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Pixels of `low` or more in components that reach `high`."""
    labels, found = components(a >= low)
    strong = np.zeros(len(found) + 1, bool)
    strong[np.unique(labels[a >= high])] = True
    strong[0] = False
    return strong[labels]


def fill_enclosed(mask: np.ndarray) -> np.ndarray:
    """Also what the mask surrounds: background that no path of background joins to the edge."""
    outside = np.pad(~mask, 1, constant_values=True)
    labels, _ = components(outside)
    return (labels != labels[0, 0])[1:-1, 1:-1] | mask


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold that separates two classes most; of constant values the value."""
    lo, hi = float(values.min()), float(values.max())
    if hi <= lo:
        return hi
    at = np.minimum((values.ravel() - lo) / (hi - lo) * bins, bins - 1).astype(int)
    n = np.bincount(at, minlength=bins).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(bins))
    w1 = w0[-1] - w0
    gap = s0 / np.maximum(w0, 1) - (s0[-1] - s0) / np.maximum(w1, 1)
    between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * gap * gap, -1)
    return lo + (int(between.argmax()) + 1) * (hi - lo) / bins


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross correlation; 0 if either is constant."""
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    d = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / d if d > 1e-9 else 0.0


def autocorrelation(a: np.ndarray) -> np.ndarray:
    """Correlations with shifts of itself, each over the pixels that overlap, 0 where fewer than a quarter do."""
    a = a - a.mean()
    h, w = a.shape
    size = (2 * h, 2 * w)
    power = np.abs(np.fft.rfft2(a, size)) ** 2
    seen = np.abs(np.fft.rfft2(np.ones_like(a), size)) ** 2
    sums, n = np.fft.irfft2(power, size), np.fft.irfft2(seen, size)
    out = np.where(n >= 0.25 * h * w, sums / np.maximum(n, 1), 0.0)
    return np.fft.fftshift(out / out[0, 0]) if out[0, 0] > 1e-9 else np.zeros(size)


def composite(original: np.ndarray, patch: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A patch laid over by a soft mask of bytes, rounded; where the mask is 0 nothing changes."""
    m = mask.astype(np.int64)[..., None] if original.ndim == 3 else mask.astype(np.int64)
    return ((original.astype(np.int64) * (255 - m) + patch.astype(np.int64) * m + 127) // 255).astype(np.uint8)


def polygon(points: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """Pixels whose centres are inside by the even-odd rule."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
        if y0 != y1:
            inside ^= ((y0 <= y) != (y1 <= y)) & (x < (y - y0) / (y1 - y0) * (x1 - x0) + x0)
    return inside


def brush(points: list[tuple[float, float]], radius: float, width: int, height: int) -> np.ndarray:
    """Pixels within `radius` of a stroke through the points."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    out = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:] or points[:1]):
        dx, dy = x1 - x0, y1 - y0
        t = np.clip(((x - x0) * dx + (y - y0) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        out |= (x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2 <= radius * radius
    return out


def hint_to_crop(hint: np.ndarray, box: tuple[float, float, float, float], x: int, y: int, w: int, h: int) -> np.ndarray:
    """A soft map that covers `box`, sampled at the pixels of a crop; 0 beyond the box."""
    bx, by, bw, bh = box
    u = (np.arange(x, x + w) + 0.5 - bx) / max(bw, 1e-9) * hint.shape[1] - 0.5
    v = (np.arange(y, y + h) + 0.5 - by) / max(bh, 1e-9) * hint.shape[0] - 0.5
    u0, v0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fu, fv = u - u0, v - v0
    at = lambda i, j: hint[np.ix_(np.clip(i, 0, hint.shape[0] - 1), np.clip(j, 0, hint.shape[1] - 1))].astype(float)
    top = at(v0, u0) * (1 - fu) + at(v0, u0 + 1) * fu
    low = at(v0 + 1, u0) * (1 - fu) + at(v0 + 1, u0 + 1) * fu
    inside = ((v >= -0.5) & (v <= hint.shape[0] - 0.5))[:, None] & ((u >= -0.5) & (u <= hint.shape[1] - 0.5))[None, :]
    return np.where(inside, top * (1 - fv[:, None]) + low * fv[:, None], 0.0)
