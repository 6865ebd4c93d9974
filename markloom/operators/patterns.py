"""Patterns that images of a batch share, patterns that repeat within one, and how well a repaired image turned out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import scalars
from markloom.operators import kernels as k
from markloom.sources import images

#: Longest side of the canvas that a batch is compared on; images to learn from, at least.
CANVAS, LEAST_SAMPLES = 512, 3


def canvas(gray: np.ndarray, side: int = CANVAS) -> np.ndarray:
    scale = side / max(gray.shape)
    return k.resize(gray, max(8, round(gray.shape[1] * scale)), max(8, round(gray.shape[0] * scale)))


def shared_gradient(planes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pixel the upper medians of the gradients of equally large planes, and what part of the planes agrees with
    them: at least 0.4 of the length, within an angle whose cosine is above 0.6."""
    grads = [k.sobel(p) for p in planes]
    gx, gy = (np.stack([g[i] for g in grads]) for i in (0, 1))
    middle = len(planes) // 2
    mx, my = np.partition(gx, middle, 0)[middle], np.partition(gy, middle, 0)[middle]
    size, each = np.hypot(mx, my), np.hypot(gx, gy)
    cosine = (gx * mx + gy * my) / np.maximum(each * size, 1e-6)
    return mx, my, ((each > 0.4 * size) & (cosine > 0.6)).mean(0)


def learn(planes: list[np.ndarray], most: int = 6) -> list[dict]:
    """Regions whose strokes all or most planes share: box, template gradients and confidence, best first.

    Strong pixels are those above Otsu's threshold of shared gradients that most planes agree on; nearby ones are one
    region. Confidence grows with the part of strong pixels that agree and with the number of planes."""
    if len(planes) < LEAST_SAMPLES:
        return []
    shape = planes[0].shape
    planes = [p if p.shape == shape else k.resize(p, shape[1], shape[0]) for p in planes]
    mx, my, agree = shared_gradient(planes)
    size = np.hypot(mx, my) * (agree >= 0.6)
    if size.max(initial=0) < 2:
        return []
    strong = size > max(2.0, k.otsu(size[size > 0]))
    _, found = k.components(k.grow(strong, max(3, shape[1] // 64)))
    out = []
    for c in found:
        y, x = slice(c["y"], c["y"] + c["h"]), slice(c["x"], c["x"] + c["w"])
        here = strong[y, x]
        if here.sum() < 24:
            continue
        area = c["w"] * c["h"] / (shape[0] * shape[1])
        share = float((agree[y, x][here] >= 0.8).mean())
        confidence = 0.55 + 0.42 * share * min(len(planes) / 6, 1.0) - (0.15 if area > 0.25 else 0.0) - (0.08 if float(size[y, x][here].mean()) < 4 else 0.0)
        confidence = min(0.97, max(0.3, confidence))
        if confidence >= 0.6:
            out.append({**{n: c[n] for n in "xywh"}, "width": shape[1], "height": shape[0], "confidence": confidence, "gx": mx[y, x] * here, "gy": my[y, x] * here, "support": here})
    return sorted(out, key=lambda r: -r["confidence"])[:most]


def match(profile: dict, plane: np.ndarray) -> tuple[float, tuple[int, int]]:
    """(score, shift) of a learned template on a canvas: the best correlation of gradients within 6 % around its place,
    coarse steps first."""
    gx, gy = k.sobel(plane)
    w, h, support = profile["w"], profile["h"], profile["support"]
    best = (-1.0, (0, 0))

    def look(at: list[tuple[int, int]]) -> None:
        nonlocal best
        for dy, dx in at:
            y, x = profile["y"] + dy, profile["x"] + dx
            if 0 <= y and 0 <= x and y + h <= plane.shape[0] and x + w <= plane.shape[1]:
                a, b = gx[y : y + h, x : x + w][support], gy[y : y + h, x : x + w][support]
                u, v = profile["gx"][support], profile["gy"][support]
                score = float((a * u + b * v).sum()) / math.sqrt(max(1e-9, float((a * a + b * b).sum()) * float((u * u + v * v).sum())))
                best = max(best, (score, (dy, dx)))

    reach = max(2, round(0.06 * max(plane.shape)))
    step = max(1, reach // 6)
    look([(dy, dx) for dy in range(-reach, reach + 1, step) for dx in range(-reach, reach + 1, step)])
    y, x = best[1]
    look([(y + dy, x + dx) for dy in range(-step, step + 1) for dx in range(-step, step + 1)])
    return best


def match_confidence(learned: float, score: float) -> float:
    return learned * (0.8 + 0.2 * min(1.0, max(0.0, (score - 0.3) / 0.3)))


def repeated(gray: np.ndarray) -> dict | None:
    """A tiled pattern: its shift (dx, dy), the strength there and at twice the shift, and a confidence below 0.92."""
    detail = gray - k.gaussian(gray, 3.0)
    c = k.autocorrelation(np.clip(detail, -3 * detail.std(), 3 * detail.std()))
    h, w = c.shape
    mid = c.copy()
    reach = max(8, min(gray.shape) // 24)
    mid[h // 2 - reach : h // 2 + reach + 1, w // 2 - reach : w // 2 + reach + 1] = -1
    mid[: h // 2] = -1
    peaks = (mid == k.dilate(mid, 3)) & (mid >= 0.18)
    best = None
    for y, x in np.argwhere(peaks):
        dy, dx = y - h // 2, x - w // 2
        twice = c[h // 2 + 2 * dy, w // 2 + 2 * dx] if abs(2 * dy) < h // 2 and abs(2 * dx) < w // 2 else 0.0
        if twice > 0.12 and (best is None or mid[y, x] > best["strength"]):
            best = {"dx": int(dx), "dy": int(dy), "strength": float(mid[y, x]), "twice": float(twice)}
    if best:
        best["confidence"] = min(0.92, max(0.0, 0.3 + 0.62 * min(1.0, (best["strength"] + best["twice"]) / 1.2)))
    return best


def quality(original: np.ndarray, result: np.ndarray, mask: np.ndarray, threshold: float = 0.6) -> dict:
    """Issues of a repaired colour image, each with a severity in 0..1, the score and whether it passes.

    Outside the mask nothing may change; inside, the old strokes must be gone, and detail, colour and the seam should be
    like the ring around."""
    inside = mask > 0
    issues: list[tuple[str, float]] = []
    unit = lambda v: min(1.0, max(0.0, v))
    changed = (np.abs(original.astype(int) - result.astype(int)).max(-1) > 1) & ~inside
    if changed.any():
        issues.append(("outside_change", min(1.0, max(0.05, 50 * changed.sum() / max(1, (~inside).sum())))))
    if inside.any():
        ring = k.grow(inside, 12) & ~k.grow(inside, 2)
        old, new = k.luma(original), k.luma(result)
        go, gn = (np.hypot(*k.sobel(p)) for p in (old, new))
        energy = lambda g, where: float(g[where].mean()) if where.any() else 0.0
        e_ring, e_old, e_new = energy(gn, ring), energy(go, inside), energy(gn, inside)
        if (np.abs(original.astype(int) - result.astype(int)).max(-1) <= 1)[inside].mean() > 0.5:
            issues.append(("residual", 1.0))
        elif e_old > e_ring + 1:
            left = unit((k.ncc(go[inside], gn[inside]) - 0.3) / 0.35) * unit((e_new / max(e_old, 1e-6) - 0.08) / 0.25)
            if left > 0.05:
                issues.append(("residual", left))
        if e_ring > 4 and e_new < 0.3 * e_ring:
            issues.append(("blur", 0.8 * (1 - e_new / (0.3 * e_ring))))
        if ring.sum() > 8:
            part = lambda c, where: result[..., c][where].astype(float)
            shift = max((abs(part(c, inside).mean() - part(c, ring).mean()) - 2 * part(c, ring).std() - 6) / 40 for c in range(3))
            if shift > 0:
                issues.append(("color_shift", unit(shift)))
        seam = k.grow(inside, 1) & ~k.shrink(inside, 1)
        edge = (energy(gn, seam) - 2.2 * max(e_ring, 2.0)) / 25
        if edge > 0:
            issues.append(("edge_artifact", unit(edge)))
    from markloom.functions.rules import BLOCKING_ISSUES, ISSUE_WEIGHTS

    score = max(0.0, 1 - sum(ISSUE_WEIGHTS[kind] * s for kind, s in issues))
    return {"score": score, "passed": score >= threshold and not any(kind in BLOCKING_ISSUES for kind, _ in issues), "issues": issues}


def overlay_alpha(planes: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """How opaque a constant overlay is at each pixel, and its brightness, from planes that all carry it: where the
    planes' means vary, a pixel under alpha a follows its surroundings with slope 1 - a."""
    stack = np.stack(planes)
    around = np.stack([k.box_blur(p, 8) for p in planes])
    centred = around - around.mean(0)
    sxx = (centred**2).sum(0)
    slope = np.where(sxx >= 200, (centred * (stack - stack.mean(0))).sum(0) / np.maximum(sxx, 1e-6), 1.0)
    alpha = np.clip(1 - slope, 0, 1)
    offset = stack.mean(0) - slope * around.mean(0)
    total = alpha[alpha > 0.05].sum()
    return alpha, float(offset[alpha > 0.05].sum() / total) if total > 0 else 0.0


_PROFILE = "group_key string, x int, y int, w int, h int, width int, height int, confidence double, sample_count int"


def learn_batches(files: DataFrame, samples: int = 30) -> DataFrame:
    """Regions that the PNG images of `files` (path, content) share, by group of aspect ratio.

    A group's sample of at most `samples` images, spread over its order of paths, is chosen from headers alone before
    any pixel is read, so a task holds that many canvases however large the group is. Images that can't be read are
    left out; groups of fewer than three give none."""
    from pyspark.sql import Window

    probed = images.probe_images(files).where("error is null and format = 'png'")
    keyed = probed.select("path", scalars.aspect_key(F.col("width").cast("double"), F.col("height").cast("double")).alias("group_key"))
    group = Window.partitionBy("group_key")
    placed = keyed.withColumns({"k": F.row_number().over(group.orderBy("path")) - 1, "n": F.count("*").over(group)})
    want = F.least(F.col("n"), F.lit(samples))
    spread = F.floor(F.col("k") * want / F.col("n")) != F.floor((F.col("k") - 1) * want / F.col("n"))
    chosen = placed.where(spread | (F.col("k") == 0)).select("path", "group_key")

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        planes = []
        for data in frame.sort_values("path")["content"]:
            try:
                planes.append(canvas(k.luma(images.read_png(bytes(data)))))
            except (images.Unreadable, ValueError, KeyError):
                continue
        rows = [{**{c: r[c] for c in ("x", "y", "w", "h", "width", "height", "confidence")}, "group_key": frame["group_key"].iloc[0], "sample_count": len(planes)} for r in learn(planes)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PROFILE.split(", ")])

    return files.select("path", "content").join(chosen, "path").groupBy("group_key").applyInPandas(learned, _PROFILE)


def mapped(files: DataFrame, detect: Callable[[np.ndarray], list[dict]], columns: str) -> DataFrame:
    """(path, *columns, error): rows that a detector makes of each PNG's pixels; one that fails is a row with its error,
    and the other files go on."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"]):
                try:
                    rows += [{"path": path, **r, "error": None} for r in detect(images.read_png(bytes(data)))]
                except Exception as e:  # noqa: BLE001  a detector's failure is that file's
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {columns}, error string")
