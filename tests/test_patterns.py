"""Patterns on synthetic images: found where they are, not found where they are not."""

from __future__ import annotations

import numpy as np
import pytest

from markloom.operators import kernels as k
from markloom.operators import patterns as p
from markloom.sources.images import write_png


def photo(seed, h=120, w=160):
    r = np.random.default_rng(seed)
    a = k.resize(r.uniform(40, 200, (6, 8)), w, h) + k.resize(r.uniform(-15, 15, (h // 4, w // 4)), w, h)
    return np.clip(a, 0, 255)


def stamp(a, alpha=0.6):
    out = a.copy()
    mark = np.zeros(a.shape, bool)
    for x in range(100, 148, 8):
        mark[98:112, x : x + 4] = True
    mark[104:107, 100:148] = True
    out[mark] = out[mark] * (1 - alpha) + 255 * alpha
    return out, mark


def test_learns_what_a_batch_shares():
    planes = [stamp(photo(s))[0] for s in range(6)]
    best = p.learn(planes)[0]
    assert best["confidence"] >= 0.85 and 85 <= best["x"] <= 102 and 140 <= best["x"] + best["w"] <= 160 and 85 <= best["y"] <= 100
    score, _ = p.match(best, stamp(photo(77))[0])
    assert score > 0.5 > p.match(best, photo(78))[0]
    assert p.match_confidence(0.9, 0.6) == pytest.approx(0.9)


def test_learns_nothing_from_unrelated_images():
    assert all(r["confidence"] < 0.85 for r in p.learn([photo(s) for s in range(20, 26)])) and p.learn([photo(1), photo(2)]) == []


def test_repeated_pattern():
    a = photo(3, 160, 160)
    for y in range(0, 160, 32):
        for x in range(0, 160, 40):
            a[y + 4 : y + 10, x + 4 : x + 18] += 60
    found = p.repeated(a)
    assert found and found["dx"] % 40 == 0 and found["dy"] % 32 == 0 and found["confidence"] > 0.45
    assert p.repeated(photo(4, 160, 160)) is None


def test_quality():
    rgb = np.stack([photo(5)] * 3, -1).astype(np.uint8)
    marked, mark = stamp(photo(5))
    marked = np.stack([marked] * 3, -1).astype(np.uint8)
    mask = k.grow(mark, 2)
    good = p.quality(marked, np.where(mask[..., None], rgb, marked), mask)
    assert good["passed"] and good["score"] > 0.8
    assert not p.quality(marked, marked, mask)["passed"] or p.quality(marked, marked, mask)["score"] < good["score"]
    spoiled = rgb.copy()
    spoiled[0, :] = 0
    assert ("outside_change" in dict(p.quality(marked, spoiled, mask)["issues"])) and not p.quality(marked, spoiled, mask)["passed"]


def test_batches(spark):
    rows = [(f"f{s}.png", write_png(stamp(photo(s))[0].astype(np.uint8))) for s in range(6)] + [("bad.png", b"\x89PNG\r\n\x1a\n")]
    files = spark.createDataFrame(rows, "path string, content binary")
    found = p.learn_batches(files).collect()
    assert found and found[0].sample_count == 6 and found[0].width == 512
    out = p.mapped(files, lambda a: [{"bright": float(k.luma(a).mean())}], "bright double").collect()
    assert sum(r.error is not None for r in out) == 1 and len(out) == 7
