"""Document fingerprints: content-defined chunks by normalised gear-hash boundaries, compared by shared length."""

from __future__ import annotations

import base64
import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.blocks import squeeze
from markloom.llm.common import shared_dir, slices, text_bytes, width

#: Bytes of a chunk: at least, normally, at most. Below the normal length a cut needs STRICT zero bits, above it LOOSE.
LEAST, NORMAL, MOST = 16, 64, 256
STRICT, LOOSE = 7, 5
#: Bytes that the 32-bit gear hash sees; texts lie that far apart in a buffer, between bytes that UTF-8 lacks.
SEEN, APART = 32, b"\xff" * 31
PART_BYTES = 8 << 20

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)
_GEAR[0xFF] = 0


def gear(a: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 32 bytes' table values, each shifted by its age, by doubling."""
    h, span = _GEAR[a], 1
    while span < SEEN:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, ascending: 48 bits of each distinct chunk's digest, then 16 of its length. An empty text has none."""
    buffer = APART.join([b"", *texts])
    h = gear(np.frombuffer(buffer, np.uint8))
    strict = np.flatnonzero(h < np.uint32(1 << 32 - STRICT)).tolist()
    loose = np.flatnonzero(h < np.uint32(1 << 32 - LOOSE)).tolist()
    strict.append(len(buffer) + MOST), loose.append(len(buffer) + MOST)
    digest, out, at = xxhash.xxh3_64_intdigest, [], 0
    for text in texts:
        at += len(APART)
        end, chunks = at + len(text), set()
        while at < end:
            cut = strict[bisect_left(strict, at + LEAST - 1)] + 1
            if cut > at + NORMAL:
                cut = loose[bisect_left(loose, at + NORMAL)] + 1
            cut = min(cut, at + MOST, end)
            chunks.add((digest(buffer[at:cut]) >> 16) << 16 | cut - at)
            at = cut
        out.append(np.array(sorted(chunks), np.uint64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How much of `a`, by length of chunks, `b` contains; of an empty one, whether both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    length = lambda x: int((x & np.uint64(0xFFFF)).sum())
    return length(np.intersect1d(a, b, assume_unique=True)) / length(a)


def written(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = [x for x in (pa.compute.min(b.column(0)).as_py() for b in batches if b.num_rows) if x is not None]
    if least:
        yield pa.RecordBatch.from_arrays([pa.array([min(least)], pa.int64())], names=["doc_id"])


def _deal(batches: Iterable[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows packed by part; the first document of a part goes to the part before too, that of the first to the last."""
    last = max(0, len(bounds) - 1)
    for piece in slices(batches, most=PART_BYTES):
        parts: dict[int, list] = {}
        for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            k = 0 if doc is None else max(0, int(np.searchsorted(bounds, doc, "right")) - 1)
            parts.setdefault(k, []).append((False, doc, text))
            if doc is None or not len(bounds) or doc == bounds[k]:
                parts.setdefault(k - 1 if k else last, []).append((True, doc, text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([squeeze(pickle.dumps(x), 1) for x in parts.values()], pa.binary())], names=["part", "payload"]
        )


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(table: pa.Table) -> pa.Table:
    rows = [r for x in table.column("payload").to_pylist() for r in pickle.loads(zstandard.decompress(x))]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    mine = sorted((r for r in rows if not r[0]), key=order)
    out: list[tuple] = []
    if mine:
        after = min((r for r in rows if r[0]), key=order)
        texts, ids = [r[2] or "" for r in mine], [r[1] for r in mine]
        nexts = [*texts[1:], after[2] or ""]
        low = 0
        while low < len(texts):  # about 1 MB at once
            high, size = low, 0
            while high < len(texts) and (high == low or size < 1 << 20):
                size += len(texts[high])
                high += 1
            edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode("utf-8", "replace") for t, n in zip(texts[low:high], nexts[low:high])]
            whole = fingerprints([t.encode("utf-8", "replace") for t in [*texts[low:high], nexts[high - 1]]])
            for k, (e, f) in enumerate(zip(edited, fingerprints(edited))):
                own = whole[k]
                out.append((ids[low + k], len(texts[low + k]), hashlib.sha256(e).hexdigest(), written(own), written(f), likeness(own, f), likeness(own, whole[k + 1])))
            low = high
    names = [x.split()[0] for x in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out) if out else [[]] * len(names), kinds)})


def compare_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of `docs`.

    Next: the document of the next greater doc_id; after the last, the first. Edited: the last half of the code points
    (rounded down) replaced by the first as many of the next, or all. fingerprint: base64 of the chunk set; near_*: what
    part of it, by length of chunks, the edited text's and the next document's contain.

    Documents are dealt to ranges of doc_id whose starts come to the driver, one number a range; a range's first
    document goes to the range before as well, so each text is shuffled once, compressed, and nothing is joined.

    A null text is empty. Rows without doc_id come first; rows of one doc_id are ordered by text, and are each other's
    next; they lie in one range. Other columns are ignored; an empty table gives none."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(4 * width(spark), -(-text_bytes(text) // PART_BYTES))
    starts = text.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id").mapInArrow(_first, "doc_id long")
    bounds = np.array(sorted(r.doc_id for r in starts.collect()), np.int64)
    dealt = text.mapInArrow(lambda it: _deal(it, bounds), "part int, payload binary")
    return dealt.groupBy("part").applyInArrow(_compare, _OUT)
