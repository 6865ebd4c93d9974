"""Small scalar functions on names, sizes, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings that can be read.
IMAGE_ENDINGS, DOCUMENT_ENDINGS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"), ("pdf",)
#: Media that is known and not read.
UNREAD_ENDINGS = ("heic", "heif", "gif", "raw", "cr2", "nef", "arw", "dng", "svg", "psd", "avif")


def lower_ext(path: Column) -> Column:
    """The ending of the last path part, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def media_kind(path: Column) -> Column:
    ext = lower_ext(path)
    return F.when(ext.isin(*IMAGE_ENDINGS), "image").when(ext.isin(*DOCUMENT_ENDINGS), "pdf").when(ext.isin(*UNREAD_ENDINGS), "unsupported")


def natural_key(name: Column) -> Column:
    """A string whose plain order is the natural order: numbers by value, other runs in lower case."""
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 39, "0")).otherwise(F.lower(p)))
    return F.array_join(padded, "\u0001")


def aspect_key(width: Column, height: Column) -> Column:
    """The bucket of the aspect ratio, a quarter octave wide."""
    return F.format_string("ar%+d", F.round(F.log2(width / height) / 0.25).cast("int"))


def sample_count(n: Column) -> Column:
    return F.when(n <= 10, n).when(n <= 100, 10).when(n <= 500, 20).otherwise(30)


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes in the largest unit of 1024, up to `largest`, that leaves a whole part, with one digit after the point.

    The digit is rounded in whole numbers, ties to even: exactly, as C's printf does."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    units = ("KB", "MB", "GB", "TB")
    exact = n.cast("double").cast("long")  # what a division by a power of two would keep
    for power, unit in enumerate(units[: units.index(largest) + 1], 1):
        of = F.lit(1024**power)
        tenths, rest = F.shiftright(exact % of * 10, 10 * power), 2 * (exact % of * 10 % of)
        tenths = F.shiftright(exact, 10 * power) * 10 + tenths
        tenths = tenths + F.when((rest > of) | ((rest == of) & (tenths % 2 == 1)), 1).otherwise(0)
        shown = F.format_string("%d.%d " + unit, ((tenths - tenths % 10) / 10).cast("long"), tenths % 10)
        out = F.when(n >= 1024**power, shown).otherwise(out)
    return out


def safe_suffix(text: Column) -> Column:
    """A file name suffix without path characters."""
    return F.translate(text, "/\\:", "___")


def scale_for(longest: Column) -> Column:
    return F.greatest(longest / 2048.0, F.lit(0.05))


def angle_difference(a: Column, b: Column) -> Column:
    """Of lines: between 0 and 90 degrees."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def retained_words(text: Column) -> Column:
    """The distinct words of two bytes or more, in lower case."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 2))


def sniffed(content: Column) -> Column:
    """The format that the first bytes tell, whatever the name says."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith("25504446"), "pdf")
    )
