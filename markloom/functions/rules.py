"""Decision rules as columns: thresholds, routes, states, quality, text marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (auto, review) by mode.
THRESHOLDS = {"conservative": (0.95, 0.60), "standard": (0.85, 0.70), "aggressive": (0.75, 0.55)}
#: Limits of the repair routes.
FAST_AREA, FAST_COMPLEXITY, FAST_THICKNESS, ALPHA_QUALITY = 0.02, 0.35, 6.0, 0.6
#: Weights of quality issues, and those that fail a result outright.
ISSUE_WEIGHTS = {"residual": 0.6, "blur": 0.3, "color_shift": 0.4, "edge_artifact": 0.3, "outside_change": 1.0, "structure": 1.0}
BLOCKING_ISSUES = ("outside_change", "structure")
#: Job states, those that end a job, and the steps between them beside failing and cancelling.
STATES = ("queued", "scanning", "ready", "processing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
STEPS = (
    ("queued", "scanning"), ("scanning", "ready"), ("ready", "processing"), ("processing", "completed"), ("ready", "scanning"), ("failed", "queued"),
    ("cancelled", "queued"), ("failed", "ready"), ("cancelled", "ready"), ("completed", "ready"), ("completed", "scanning"), ("processing", "ready"),
    ("queued", "ready"),
)
#: Progress at which a stage begins.
STAGE_PROGRESS = {"queued": 0.0, "decode": 0.05, "analyze": 0.1, "detect": 0.2, "segment": 0.35, "remove": 0.5, "evaluate": 0.8, "encode": 0.85, "commit": 0.95, "done": 1.0}
#: Error codes by kind, and the kinds that may be tried again as they are.
ERROR_CODES = {
    "io": "E_IO", "unsupported_format": "E_UNSUPPORTED_FORMAT", "decode": "E_DECODE", "encode": "E_ENCODE", "pdf": "E_PDF", "model": "E_MODEL",
    "inference": "E_INFERENCE", "out_of_memory": "E_OOM", "permission": "E_PERMISSION", "cancelled": "E_CANCELLED", "invalid_password": "E_INVALID_PASSWORD",
    "needs_confirmation": "E_NEEDS_CONFIRMATION", "internal": "E_INTERNAL",
}
RETRYABLE = ("io", "out_of_memory", "inference", "cancelled")
#: Marker strings of three kinds, looked for in lower case.
URL_MARKS = ("www.", "http", ".com", ".cn", ".net", ".org", ".io", ".co", ".me", ".xyz", ".shop", ".top")
COPYRIGHT_MARKS = ("©", "(c)", "copyright", "all rights reserved", "版权", "版權", "禁止转载", "未经授权", "仅供")
PLATFORM_MARKS = (
    "photo by", "photography", "摄影", "watermark", "水印", "水印相机", "打卡", "防伪", "真实时间", "sample", "preview", "proof", "shutterstock", "getty",
    "istock", "alamy", "dreamstime", "123rf", "depositphotos", "adobe stock", "小红书", "抖音", "快手", "微博", "weibo", "douyin", "xiaohongshu", "@", "id:", "id：",
)
#: Detectors whose evidence is of one kind, weights of further evidence, and caps.
HEURISTIC = ("overlay", "repeated", "info_stamp")
CORRELATED_WEIGHT, OTHER_WEIGHT, HEURISTIC_CAP, CONFIDENCE_CAP = 0.15, 0.6, 0.9, 0.99
CALIBRATION = {"text_ocr": 0.9, "ai": 0.95}
#: Clock times, dates of one separator, and dates in characters; a digit may not stand before them.
TIME_OR_DATE = (
    r"(^|[^0-9])([0-9]{1,2}[:：][0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]|[0-9]{4}-[0-9]{1,2}-[0-9]|[0-9]{4}\.[0-9]{1,2}\.[0-9]|[0-9]{4}年[0-9]{1,2}月[0-9])"
)


def decide(confidence: Column, auto: Column | float, review: Column | float) -> Column:
    return F.when(confidence >= auto, "auto").when(confidence >= review, "review").otherwise("ignore")


def should_remove(decision: Column, user_action: Column) -> Column:
    """What the user said, else whether the decision is automatic."""
    return F.when(user_action == "approve", True).when(user_action == "reject", False).otherwise(decision == "auto")


def awaiting_review(decision: Column, user_action: Column) -> Column:
    return (F.coalesce(user_action, F.lit("pending")) == "pending") & (decision == "review")


def route(native: Column, transparent: Column, alpha_quality: Column, fast: Column, area: Column, complexity: Column, thickness: Column, ai: Column) -> Column:
    """The first repair route that fits."""
    small = (area < FAST_AREA) & (complexity < FAST_COMPLEXITY) & (thickness <= FAST_THICKNESS)
    return (
        F.when(native, "pdf_object_remove")
        .when(transparent & (alpha_quality >= ALPHA_QUALITY), "alpha_restore")
        .when(fast | small, "fast_inpaint")
        .when(ai, "ai_inpaint")
        .otherwise("texture_synthesis")
    )


def may_follow(state: Column, following: Column) -> Column:
    """Whether a job in `state` may go to `following`; staying is always allowed."""
    ended = state.isin(*TERMINAL)
    step = F.lit(False)
    for a, b in STEPS:
        step = step | ((state == a) & (following == b))
    return (state == following) | F.when(following == "cancelled", ~ended | (state == "failed")).when(following == "failed", ~ended).otherwise(step)


def file_status(state: Column, review: Column, candidates: Column) -> Column:
    """What a list shows for a file."""
    asked = review == "needs_review"
    return (
        F.when(state.isin("queued", "cancelled"), "waiting")
        .when(state.isin("scanning", "processing", "failed"), state)
        .when(asked, "needs_review")
        .when(state == "completed", "completed")
        .when(candidates == 0, "clean")
        .otherwise("detected")
    )


def review_status(review: Column, pending: Column, failed_quality: Column, needs_password: Column, unsigned: Column) -> Column:
    """Asked for while anything is open; approved once nothing is."""
    return F.when(pending | failed_quality | needs_password | unsigned, "needs_review").when(review == "needs_review", "approved").otherwise(review)


def processable(state: Column, review: Column, to_remove: Column, manual: Column, needs_password: Column) -> Column:
    return (state == "ready") & (review != "needs_review") & ((to_remove > 0) | manual) & ~needs_password


def issue_weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in ISSUE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def has_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def time_or_date(text: Column) -> Column:
    return text.rlike(TIME_OR_DATE)


def text_score(text: Column, position: Column, rotation: Column, repeats: Column, opacity: Column) -> Column:
    """How likely a line of text is a mark laid over a page: markers, place, tilt, repetition, faintness."""
    low = F.lower(text)
    url, rights, platform, dated = has_any(low, URL_MARKS), has_any(low, COPYRIGHT_MARKS), has_any(low, PLATFORM_MARKS), time_or_date(text)
    worth = lambda c, w: F.when(c, w).otherwise(0.0)
    clamp01 = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    total = (
        F.lit(0.15) + worth(url, 0.35) + worth(rights, 0.35) + worth(platform, 0.3) + worth(dated, 0.3) + position * 0.15
        + worth((F.abs(rotation) % 180 > 10) & (F.abs(rotation) % 180 < 170), 0.1) + clamp01((repeats - 1) / 3.0) * 0.2 + clamp01((F.lit(0.85) - opacity) / 0.5) * 0.15
        - worth((F.length(text) > 40) & ~(url | rights | platform | dated), 0.25)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), total))


def object_score(pages: Column, all_pages: Column, consistent: Column, rotated: Column, alpha: Column, area: Column, banded: Column) -> Column:
    """How likely an object that pages repeat is a mark."""
    worth = lambda c, w: F.when(c, w).otherwise(0.0)
    total = (
        F.lit(0.3) + F.when(pages >= 2, F.lit(0.25) * pages / all_pages).otherwise(0.0) + worth(consistent & (pages >= 2), 0.08) + worth(rotated, 0.17)
        + worth(alpha < 0.9, 0.2) + worth(area > 0.08, 0.07) - worth(banded, 0.25)
    )
    return F.least(F.lit(0.95), F.when(rotated | (alpha < 0.9), total).otherwise(F.least(total, F.lit(0.6))))


def page_kind(cover: Column, visible_texts: Column, objects: Column) -> Column:
    return (
        F.when((cover >= 0.85) & (visible_texts <= 2), "scanned").when(cover >= 0.2, "mixed").when((visible_texts > 0) | (objects > 0), "native").otherwise("empty")
    )
