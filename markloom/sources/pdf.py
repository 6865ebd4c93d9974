"""PDF pages as events: a content-stream reader for plain and Flate streams, and the rules that find native marks."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import rules

TOKEN = re.compile(rb"%[^\r\n]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[^\s()<>\[\]{}/%]+", re.S)
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def tokens(data: bytes) -> Iterator[tuple[str, object]]:
    """(kind, value): numbers, names, strings, marks of arrays and dictionaries, operators."""
    for m in TOKEN.finditer(data):
        t = m.group()
        if t[:1] == b"%":
            continue
        if t[:1] == b"/":
            yield "name", t[1:].decode("latin-1")
        elif t[:1] == b"(":
            yield "string", re.sub(rb"\\(.)", rb"\1", t[1:-1], flags=re.S)
        elif t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t in (b"<<", b">>", b"[", b"]"):
            yield "mark", t.decode()
        else:
            try:
                yield "number", float(t)
            except ValueError:
                yield "operator", t.decode("latin-1")


def events(data: bytes) -> list[dict]:
    """What a content stream shows, in order: texts, objects and marked ranges, with matrix, font size and alpha state.

    Understands q Q cm gs, BDC BMC EMC, BT ET Tf TL Tr Tm Td TD T* Tj TJ ' " and Do. A range is open from its begin to
    its end; `end` of one that is never closed is the number of operators."""
    out, stack, args = [], [], []
    state = {"ctm": IDENTITY, "gs": None, "font": 0.0, "leading": 0.0, "hidden": False}
    text = line = IDENTITY
    ranges: list[dict] = []
    index = 0
    for kind, value in tokens(data):
        if kind != "operator":
            args.append((kind, value))
            continue
        numbers = [v for k, v in args if k == "number"]
        names = [v for k, v in args if k == "name"]
        op = value
        if op == "q":
            stack.append(dict(state))
        elif op == "Q" and stack:
            state = stack.pop()
        elif op == "cm" and len(numbers) >= 6:
            state["ctm"] = times(tuple(numbers[-6:]), state["ctm"])
        elif op == "gs" and names:
            state["gs"] = names[-1]
        elif op in ("BDC", "BMC"):
            ranges.append({"kind": "range", "index": index, "tag": names[0] if names else "", "names": names, "end": None})
            out.append(ranges[-1])
        elif op == "EMC" and ranges:
            ranges.pop()["end"] = index
        elif op == "BT":
            text = line = IDENTITY
        elif op == "Tf" and numbers:
            state["font"] = numbers[-1]
        elif op == "TL" and numbers:
            state["leading"] = numbers[-1]
        elif op == "Tr" and numbers:
            state["hidden"] = numbers[-1] == 3
        elif op == "Tm" and len(numbers) >= 6:
            text = line = tuple(numbers[-6:])
        elif op in ("Td", "TD") and len(numbers) >= 2:
            if op == "TD":
                state["leading"] = -numbers[-1]
            text = line = times((1, 0, 0, 1, *numbers[-2:]), line)
        elif op in ("T*", "'", '"'):
            text = line = times((1, 0, 0, 1, 0, -state["leading"]), line)
        if op in ("Tj", "TJ", "'", '"'):
            raw = b"".join(v for k, v in args if k == "string")
            at = times(text, state["ctm"])
            out.append({"kind": "text", "index": index, "raw": raw, "matrix": at, "font": abs(state["font"]) * (at[2] ** 2 + at[3] ** 2) ** 0.5, "gs": state["gs"], "hidden": state["hidden"]})
        elif op == "Do" and names:
            out.append({"kind": "object", "index": index, "name": names[-1], "matrix": state["ctm"], "gs": state["gs"], "hidden": False})
        args = []
        index += 1
    for r in out:
        if r["kind"] == "range" and r["end"] is None:
            r["end"] = index
    return out


def streams(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(object number, dictionary, decoded stream) of a file's plain and Flate streams; others are left out."""
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\s*<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        body = m.group(3)
        if b"/FlateDecode" in m.group(2):
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in m.group(2):
            continue
        yield int(m.group(1)), m.group(2), body


def is_encrypted(data: bytes) -> bool:
    return b"/Encrypt" in data


def is_signed(data: bytes) -> bool:
    return bool(re.search(rb"/Type\s*/Sig\b|/ByteRange\s*\[", data))


_EVENTS = "path string, page int, op_index int, kind string, name string, raw binary, font double, x double, y double, rotation double, gs string, hidden boolean, range_end int, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _EVENTS.split(", "))])
    for batch in batches:
        rows = []
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            data = data or b""
            if is_encrypted(data):
                rows.append({"path": path, "error": "invalid_password"})
                continue
            page = 0
            for _, head, body in streams(data):
                if b"/Subtype" in head or b"/Type" in head:  # objects that pages use, not page contents
                    continue
                page += 1
                for e in events(body):
                    m = e.get("matrix", IDENTITY)
                    rows.append({
                        "path": path, "page": page, "op_index": e["index"], "kind": e["kind"], "name": e.get("name") or e.get("tag"), "raw": e.get("raw"), "font": e.get("font"), "x": m[4], "y": m[5],
                        "rotation": math.degrees(math.atan2(m[1], m[0])), "gs": e.get("gs"), "hidden": e.get("hidden", False), "range_end": e.get("end"),
                    })
            if not page:
                rows.append({"path": path, "error": "pdf"})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def page_events(files: DataFrame) -> DataFrame:
    """Events of the pages of `files` (path, content). A file that needs a password, or has no page that can be read, is
    one row with an error: nothing is opened without its password."""
    return files.select("path", "content").mapInArrow(_read, _EVENTS)


def repeated_texts(found: DataFrame) -> DataFrame:
    """Texts that several pages repeat at one size and tilt, with how many pages have them and a score."""
    texts = found.where("kind = 'text' and not hidden")
    key = ["path", "raw", F.round("font").alias("size"), F.round(F.col("rotation") / 5).alias("tilt")]
    per = texts.groupBy(*key).agg(F.count_distinct("page").alias("pages"), F.min_by("y", "op_index").alias("y"))
    all_pages = found.where("page is not null").groupBy("path").agg(F.count_distinct("page").alias("all_pages"))
    rotated = F.abs(F.col("tilt") * 5) % 90 > 2.5
    worth = lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.lit(0.25) + worth(F.col("pages") >= 2, 0.22) * F.col("pages") / F.col("all_pages") + worth(rotated, 0.2) + worth(F.col("size") >= 28, 0.12)
    rows = per.join(all_pages, "path")
    return rows.select("path", "raw", "size", "pages", F.when(rotated, score).otherwise(F.least(score, F.lit(0.55))).alias("score"))


def marked_objects(found: DataFrame) -> DataFrame:
    """Texts and objects inside a range of their page that is marked as an artifact: a join by page, the interval as its filter."""
    ranges = found.where("kind = 'range' and lower(name) in ('artifact', 'oc')").select("path", "page", F.col("op_index").alias("start"), F.col("range_end").alias("end"))
    return found.where("kind <> 'range'").join(ranges, ["path", "page"]).where("op_index >= start and op_index < end").drop("start", "end")


def page_kinds(found: DataFrame, cover: DataFrame) -> DataFrame:
    """The kind of each page, from its visible texts and objects and the area its images `cover` (path, page, cover)."""
    n = found.groupBy("path", "page").agg(F.count_if((F.col("kind") == "text") & ~F.col("hidden")).alias("texts"), F.count_if(F.col("kind") == "object").alias("objects"))
    rows = n.join(cover, ["path", "page"], "left")
    return rows.select("path", "page", rules.page_kind(F.coalesce("cover", F.lit(0.0)), F.col("texts"), F.col("objects")).alias("kind"))
