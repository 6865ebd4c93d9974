"""Rules at their boundaries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from markloom.functions import geometry, rules, scalars


@pytest.fixture(scope="module")
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return of


@pytest.mark.parametrize("confidence, mode, expected", [(0.85, "standard", "auto"), (0.7, "standard", "review"), (0.69, "standard", "ignore"), (0.95, "conservative", "auto"), (0.55, "aggressive", "review")])
def test_decide(value, confidence, mode, expected):
    assert value(rules.decide(F.lit(confidence), *rules.THRESHOLDS[mode])) == expected


@pytest.mark.parametrize("args, expected", [
    ((True, True, 0.9, True, 0.0, 0.0, 1.0, True), "pdf_object_remove"),
    ((False, True, 0.6, False, 0.5, 0.9, 20.0, True), "alpha_restore"),
    ((False, False, 0.0, False, 0.019, 0.34, 6.0, True), "fast_inpaint"),
    ((False, False, 0.0, False, 0.019, 0.34, 6.1, True), "ai_inpaint"),
    ((False, False, 0.0, False, 0.5, 0.9, 20.0, False), "texture_synthesis"),
])
def test_route(value, args, expected):
    assert value(rules.route(*map(F.lit, args))) == expected


@pytest.mark.parametrize("text, expected", [("12:30", True), ("9：05 am", True), ("2024-01-05", True), ("2024/1/5", True), ("2024-01/05", False), ("2024年3月8日", True), ("112:30", False), ("no time", False), ("1234", False)])
def test_time_or_date(value, text, expected):
    assert value(rules.time_or_date(F.lit(text))) is expected


def test_text_score_long_body_and_markers(value):
    score = lambda t, n=1: value(rules.text_score(F.lit(t), F.lit(0.0), F.lit(0.0), F.lit(n), F.lit(0.85)))
    assert score("x" * 41) == 0.0
    assert score("plain") == pytest.approx(0.15)
    assert score("www.shop.com") == pytest.approx(0.5)
    assert score("© photo by me 12:30", 4) == pytest.approx(0.98)


@pytest.mark.parametrize("state, following, allowed", [("queued", "scanning", True), ("queued", "processing", False), ("completed", "cancelled", False), ("failed", "cancelled", True), ("completed", "failed", False), ("ready", "ready", True)])
def test_transitions(value, state, following, allowed):
    assert value(rules.may_follow(F.lit(state), F.lit(following))) is allowed


def test_boxes(value):
    box = lambda *v: geometry.box(*map(F.lit, v))
    assert value(geometry.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    assert value(geometry.containment(box(0, 0, 4, 4), box(1, 1, 1, 1))) == 1.0
    assert value(geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert value(geometry.area(box(0, 0, -3, 5))) == 0.0
    assert value(geometry.anchor(F.lit(0.1), F.lit(0.9))) == "bottom_left"
    assert value(geometry.anchor(F.lit(1 / 3), F.lit(2 / 3))) == "center"


@pytest.mark.parametrize("name, ext", [("a/b.JPG", "jpg"), ("a.b/c", ""), ("x.tar.gz", "gz"), (".hidden", "")])
def test_lower_ext(value, name, ext):
    assert value(scalars.lower_ext(F.lit(name))) == ext


def test_natural_key_orders_numbers(spark):
    names = ["b2", "B10", "a9", "a10", "1", "02"]
    found = spark.createDataFrame([(n,) for n in names], "n string").orderBy(scalars.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in found] == ["1", "02", "a9", "a10", "b2", "B10"]
