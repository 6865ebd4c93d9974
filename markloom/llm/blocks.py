"""Blocks of whole documents and shards of keys: how operators count or look up what very many documents share.

A block holds documents by a hash of doc_id, a shard holds keys by a hash or a prefix. A block sends each shard the
distinct keys it has, packed into one row, and gets one row back: a key costs a shard an entry a block, however
often documents have it."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import slices, text_bytes, width

BLOCK_BYTES = 16 << 20
UNIT_BYTES = 256 << 10, 16 << 20
#: Text that is packed at once.
PACKED_BYTES = 8 << 20


def block_count(docs: DataFrame) -> int:
    """Blocks for `docs` (text): of BLOCK_BYTES on average, and four a shuffle partition at least."""
    return max(4 * width(docs.sparkSession), -(-text_bytes(docs) // BLOCK_BYTES))


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(blocks)).cast("int")


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as compressed differences, a plane a byte."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=PACKED_BYTES):
        block = np.array(part.column("block").to_pylist(), np.int64)
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        columns = [part.column(c).to_pylist() for c in part.schema.names if c != "block"]
        keys, rows = [], []
        for at in np.split(order, starts[1:]):
            keys.append(int(block[at[0]]))
            rows.append(squeeze(pickle.dumps([tuple(c[i] for c in columns) for i in at.tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.binary())], names=["block", "payload"])


def to_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, payload): rows of `docs` (doc_id, text, ...) packed by block, to be shuffled compressed."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))  # rows without doc_id lie in no one block
    return docs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).mapInArrow(_pack, "block int, payload binary")


def _unite(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, most=most):
        data = squeeze(pickle.dumps(list(zip(*(c.to_pylist() for c in part.columns)))))
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(data) >> 1], pa.int64()), pa.array([data], pa.binary())], names=["block", "payload"])


def to_units(docs: DataFrame) -> DataFrame:
    """(block, payload): rows of `docs` (doc_id, text, ...) packed as they are read, to be written and then read often.

    A unit holds about a quarter of a shuffle partition's share of the text, between UNIT_BYTES; block is its name."""
    share = text_bytes(docs) // (4 * width(docs.sparkSession))
    most = min(max(share, UNIT_BYTES[0]), UNIT_BYTES[1])
    return docs.mapInArrow(lambda it: _unite(it, most), "block long, payload binary")


def rows_of(table: pa.Table) -> list[tuple]:
    """The rows that `to_blocks` packed, in an order that doesn't depend on how they came."""
    rows = [r for data in table.column("payload").to_pylist() for r in pickle.loads(zstandard.decompress(data))]
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
