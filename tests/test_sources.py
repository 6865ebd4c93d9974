"""Sources on files made here."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from markloom.sources import files, images

PIXELS = (np.arange(6 * 5 * 4).reshape(6, 5, 4) * 7 % 256).astype(np.uint8)


def test_png_round_trip():
    for n in (1, 3, 4):
        a = PIXELS[..., :n] if n > 1 else PIXELS[..., 0]
        back = images.read_png(images.write_png(a, dpi=300))
        assert (back[..., : max(n, 3)] == (a if n > 1 else a[..., None])).all()
    data = images.write_png(PIXELS, dpi=300)
    assert images.dpi(data) == pytest.approx(300, abs=0.1)
    assert images.probe(data) == {"width": 5, "height": 6, "format": "png", "alpha": True, "orientation": 1}


def exif_block(how):
    return b"Exif\0\0II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, how, 0, 0)


def jpeg(how=1, quality=80):
    scale = 200 - 2 * quality
    table = bytes(min(255, max(1, (v * scale + 50) // 100)) for v in images.LUMINANCE)
    seg = lambda m, p: bytes([0xFF, m]) + struct.pack(">H", len(p) + 2) + p
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\1\0\x48\0\x48\0\0") + seg(0xE1, exif_block(how)) + seg(0xDB, b"\0" + table) + seg(0xC0, b"\x08" + struct.pack(">HH", 40, 30) + b"\x01\x01\x11\0") + b"\xff\xda"


def test_jpeg_headers():
    assert images.probe(jpeg())["width"] == 30 and images.probe(jpeg(6))["width"] == 40 and images.orientation(jpeg(8)) == 8
    assert images.dpi(jpeg()) == 72 and images.jpeg_quality(jpeg(1, 87)) == 87


@pytest.mark.parametrize("how", range(1, 9))
def test_orientations_are_their_meaning(how):
    a = np.array([[1, 2, 3], [4, 5, 6]])
    meant = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}
    assert (images.oriented(a, how) == meant[how]).all()


def test_import(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"img10.png": images.write_png(PIXELS), "sub/img9.PNG": images.write_png(PIXELS), "x.pdf": b"%PDF-1.4", "bad.png": b"no", "a.gif": b"GIF89a", "notes.txt": b"t"}.items():
        (tmp_path / name).write_bytes(data)
    listed = files.listing(spark, str(tmp_path))
    rows = files.import_files(listed).orderBy("sort_key").collect()
    got = [(r.name, r.error) for r in rows]
    assert got == [("a.gif", "unsupported_format"), ("bad.png", "decode"), ("img9.PNG", None), ("img10.png", None), ("x.pdf", None)]
    known = listed.where("path like '%img%'").select("path")
    assert files.import_files(listed, known).count() == 3  # five less the two that are known
    probed = {r.path.rsplit("/", 1)[1]: r for r in images.probe_images(listed).collect()}
    assert probed["img10.png"].width == 5 and probed["bad.png"].error == "decode"
