"""Image headers, metadata and pixels: parsers of bytes, and the Arrow functions that run them over rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The standard's luminance and chrominance tables, in natural order.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


class Unreadable(ValueError):
    """The bytes are not an image that can be read; args[0] is the kind of error."""


def sniff(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:2] == b"BM":
        return "bmp"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return None


def segments(jpeg: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the first scan."""
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, jpeg[at + 4 : at + 2 + size]
        at += 2 + size


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        yield png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        at += 12 + size


def tiff_entries(data: bytes) -> tuple[str, list[dict[int, tuple[int, int, bytes]]]]:
    """(byte order, directories) of a TIFF structure: tag to (type, count, four value bytes)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise Unreadable("decode")
    at, out, seen = struct.unpack_from(order + "I", data, 4)[0], [], set()
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        rows = [struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * k) for k in range(n) if at + 14 + 12 * k <= len(data)]
        out.append({t: (kind, count, value) for t, kind, count, value in rows})
        end = at + 2 + 12 * n
        at = struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0
    return order, out


def _number(order: str, entry: tuple[int, int, bytes] | None) -> int | None:
    return None if entry is None else struct.unpack(order + ("H" if entry[0] == 3 else "I"), entry[2][: 2 if entry[0] == 3 else 4])[0]


def exif(data: bytes) -> bytes | None:
    """The EXIF block of a JPEG or PNG."""
    if sniff(data) == "jpeg":
        return next((p[6:] for m, p in segments(data) if m == 0xE1 and p[:6] == b"Exif\0\0"), None)
    if sniff(data) == "png":
        return next((p for name, p in chunks(data) if name == b"eXIf"), None)
    return None


def orientation(data: bytes) -> int:
    block = exif(data)
    if not block:
        return 1
    try:
        order, found = tiff_entries(block)
    except Unreadable:
        return 1
    value = _number(order, found[0].get(0x0112)) if found else None
    return value if value in range(1, 9) else 1


def oriented(a: np.ndarray, how: int) -> np.ndarray:
    """Pixels turned and mirrored as an orientation of 1 to 8 asks."""
    if how >= 5:
        a = a.swapaxes(0, 1)
    flip_y, flip_x = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}[how]
    return a[:: -1 if flip_y else 1, :: -1 if flip_x else 1]


def probe(data: bytes) -> dict:
    """(width, height, format, alpha, orientation) from the header alone; width and height as shown."""
    kind = sniff(data)
    size, alpha = None, False
    if kind == "png":
        w, h, depth, colour = struct.unpack(">IIBB", data[16:26])
        if depth == 16:
            raise Unreadable("unsupported_format")
        size, alpha = (w, h), colour in (4, 6) or any(name == b"tRNS" for name, _ in chunks(data))
    elif kind == "jpeg":
        for marker, p in segments(data):
            if marker in (0xC0, 0xC1, 0xC2, 0xC3):
                size = int.from_bytes(p[3:5], "big"), int.from_bytes(p[1:3], "big")
    elif kind == "bmp":
        w, h = struct.unpack("<ii", data[18:26])
        size = w, abs(h)
    elif kind == "webp":
        if data[12:16] == b"VP8X":
            if data[20] & 2:
                raise Unreadable("unsupported_format")
            size, alpha = (1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")), bool(data[20] & 16)
        elif data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            size, alpha = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)), bool(bits >> 28 & 1)
        elif data[12:16] == b"VP8 ":
            size = int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    elif kind == "tiff":
        order, found = tiff_entries(data)
        if len(found) != 1 or (_number(order, found[0].get(258)) or 8) > 8 and found[0][258][1] == 1:
            raise Unreadable("unsupported_format")
        size = _number(order, found[0].get(256)), _number(order, found[0].get(257))
    if kind is None or not size or not all(size):
        raise Unreadable("decode")
    how = orientation(data)
    return {"width": size[how >= 5], "height": size[how < 5], "format": kind, "alpha": alpha, "orientation": how}


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, colour, palette and alpha images, not interlaced, as (height, width, 4)."""
    w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlace:
        raise Unreadable("unsupported_format")
    parts = list(chunks(data))
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(p for name, p in parts if name == b"IDAT")), np.uint8).reshape(h, 1 + w * n)
    out, before = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        line, how = raw[y, 1:], raw[y, 0]
        if how == 1:
            line = np.add.accumulate(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line = line + before
        elif how in (3, 4):
            left, line = [0] * n, line.tolist()
            up = before.tolist()
            for i, v in enumerate(line):
                a, b, c = (line[i - n], up[i], up[i - n]) if i >= n else (0, up[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (v + ((a + b) // 2 if how == 3 else near)) & 255
            line = np.array(line, np.uint8)
        out[y] = before = line
    a = out.reshape(h, w, n)
    if colour == 3:
        palette = np.frombuffer(next(p for name, p in parts if name == b"PLTE"), np.uint8).reshape(-1, 3)
        opaque = np.full(len(palette), 255, np.uint8)
        for name, p in parts:
            if name == b"tRNS":
                opaque[: len(p)] = np.frombuffer(p, np.uint8)
        return np.concatenate([palette[a[..., 0]], opaque[a]], -1)
    rgb = a[..., :3] if n >= 3 else np.repeat(a[..., :1], 3, -1)
    return np.concatenate([rgb, a[..., -1:] if n in (2, 4) else np.full((h, w, 1), 255, np.uint8)], -1)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def write_png(a: np.ndarray, dpi: float | None = None) -> bytes:
    """Lossless PNG of a grey, colour or colour-with-alpha array of bytes."""
    a = a[..., None] if a.ndim == 2 else a
    h, w, n = a.shape
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(a, np.uint8).reshape(h, w * n)], 1)
    density = _chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + density + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def dpi(data: bytes) -> float | None:
    """Dots an inch from a PNG's pHYs or a JPEG's JFIF header."""
    if sniff(data) == "png":
        for name, p in chunks(data):
            if name == b"pHYs" and len(p) == 9 and p[8] == 1:
                return int.from_bytes(p[:4], "big") * 0.0254
    if sniff(data) == "jpeg":
        for marker, p in segments(data):
            if marker == 0xE0 and p[:5] == b"JFIF\0" and p[7] in (1, 2):
                x = int.from_bytes(p[8:10], "big")
                return float(x) if p[7] == 1 else x * 2.54
    return None


def jpeg_quality(data: bytes) -> int | None:
    """The quality of 1 to 100 whose luminance table is nearest in sum to the first table of the file."""
    for marker, p in segments(data):
        if marker == 0xDB and p and not p[0] >> 4:
            total = sum(p[1:65])
            scale = lambda q: 5000 // q if q < 50 else 200 - 2 * q
            table = lambda q: sum(min(255, max(1, (v * scale(q) + 50) // 100)) for v in LUMINANCE)
            return min(range(1, 101), key=lambda q: (abs(table(q) - total), -q))
    return None


_PROBED = "path string, width int, height int, format string, alpha boolean, orientation int, dpi double, error string"


def _probed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"]):
            data = bytes(data or b"")
            try:
                rows.append({"path": path, **probe(data), "dpi": dpi(data), "error": None})
            except (Unreadable, struct.error, IndexError, KeyError) as e:
                rows.append({"path": path, "error": e.args[0] if isinstance(e, Unreadable) else "decode"})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PROBED.split(", ")], dtype=object)  # Arrow takes no chunked text columns


def probe_images(files: DataFrame) -> DataFrame:
    """Size, format, alpha, orientation, density or an error of `files` (path, content); a bad file is a row, not a failure."""
    return files.select("path", "content").mapInPandas(_probed, _PROBED)
