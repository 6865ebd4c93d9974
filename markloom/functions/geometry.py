"""Boxes as structs (x, y, w, h): area, overlap, union, padding, anchors. All in one coordinate space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    """A box of doubles; negative sizes count as 0."""
    d = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.struct(d(x).alias("x"), d(y).alias("y"), F.greatest(d(w), F.lit(0.0)).alias("w"), F.greatest(d(h), F.lit(0.0)).alias("h"))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap(a: Column, b: Column) -> Column:
    """The area that both boxes cover."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    whole = area(a) + area(b) - overlap(a, b)
    return F.when(whole > 0, overlap(a, b) / F.when(whole > 0, whole).otherwise(1.0)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """The overlap as a part of the smaller box."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap(a, b) / F.when(small > 0, small).otherwise(1.0)).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"),
        (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"),
    )


def expand(b: Column, by: Column) -> Column:
    return box(b["x"] - by, b["y"] - by, b["w"] + 2 * by, b["h"] + 2 * by)


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The part of the box inside (0, 0, width, height)."""
    x, y = F.greatest(b["x"], F.lit(0.0)), F.greatest(b["y"], F.lit(0.0))
    return box(x, y, F.least(b["x"] + b["w"], width) - x, F.least(b["y"] + b["h"], height) - y)


def to_pixel_rect(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels that cover the box, within the image."""
    x0, y0 = (F.greatest(F.floor(b[k]), F.lit(0)) for k in ("x", "y"))
    x1 = F.least(F.ceil(b["x"] + b["w"]), width)
    y1 = F.least(F.ceil(b["y"] + b["h"]), height)
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), F.greatest(x1 - x0, F.lit(0)).cast("int").alias("w"), F.greatest(y1 - y0, F.lit(0)).cast("int").alias("h"))


def pad_rect(r: Column, by: Column, width: Column, height: Column) -> Column:
    """An integer rectangle padded on all sides and clipped to the image."""
    x0, y0 = F.greatest(r["x"] - by, F.lit(0)), F.greatest(r["y"] - by, F.lit(0))
    return F.struct(
        x0.alias("x"), y0.alias("y"), (F.least(r["x"] + r["w"] + by, width) - x0).alias("w"), (F.least(r["y"] + r["h"] + by, height) - y0).alias("h")
    )


def third(v: Column) -> Column:
    return F.when(v < 1 / 3, 0).when(v > 2 / 3, 2).otherwise(1)


def anchor(cx: Column, cy: Column) -> Column:
    """One of nine places, from a centre in 0..1."""
    names = F.array(*[F.lit(n) for n in ("top_left", "top", "top_right", "left", "center", "right", "bottom_left", "bottom", "bottom_right")])
    return F.element_at(names, third(cy) * 3 + third(cx) + 1)


def affine(m: Column, x: Column, y: Column) -> Column:
    """The point (x, y) under the matrix [a, b, c, d, e, f]."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def affine_product(m: Column, n: Column) -> Column:
    """First m, then n."""
    return F.array(
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )
