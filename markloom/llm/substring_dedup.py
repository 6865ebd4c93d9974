"""Suffix-array dedup: byte spans that repeat across documents, by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.blocks import pack_keys, rows_of, squeeze, to_units, unpack_keys
from markloom.llm.common import materialize, release, scratch, shared_dir, tidied, width

#: Bytes of an anchor: each window of the minimum length selects the anchors with the smallest hash in it.
ANCHOR = 24
#: Bytes hashed at once, and bytes whose suffixes are sorted at once.
HASHED, SORTED = 1 << 20, 2_000_000
#: Not in UTF-8: beyond a document's ends, and between strings.
PAD, GAP = 0xFF, 0xFE
NONE = np.iinfo(np.int64).max

_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w neighbours: doubled spans, two of which overlap to make w."""
    n, span = len(a) - w + 1, 1
    while 2 * span <= w:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:n], a[w - span : w - span + n]) if span < w else a[:n]


def rolled(a: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all strings of `length` bytes, by doubling."""
    out, done, have, power, base = None, 0, a.astype(np.uint64) + np.uint64(1), 1, int(_K)
    n = len(a) - length + 1
    while True:
        if length & power:
            out = have[:n] if out is None else out * np.uint64(pow(base, power, 1 << 64)) + have[done : done + n]
            done += power
        if 2 * power > length:
            return out
        have = have[:-power] * np.uint64(pow(base, power, 1 << 64)) + have[power:]
        power *= 2


def anchors(a: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of anchors in texts that lie end to end in `a`.

    A window of `least` bytes within a text selects those of its strings of ANCHOR bytes that have the smallest
    hash, so that equal windows select equal strings at equal places. Ties are all selected."""
    w = least - ANCHOR + 1
    starts = np.r_[0, ends[:-1]]
    found, keys = [], []
    for low in range(0, max(0, len(a) - least + 1), HASHED):
        high = min(low + HASHED, len(a) - least + 1)
        h = rolled(a[low : high + least - 1], ANCHOR)
        h ^= h >> np.uint64(29)
        h *= _M
        rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        smallest = sliding(rank, w, np.minimum)
        first = np.searchsorted(ends, low, "right")
        for s, e in zip(starts[first:].tolist(), ends[first:].tolist()):
            if s >= high:
                break
            smallest[max(0, max(s, e - least + 1) - low) : max(0, e - low)] = 0
        padded = np.r_[np.zeros(w - 1, np.uint32), smallest, np.zeros(w - 1, np.uint32)]
        at = np.flatnonzero(sliding(padded, w, np.maximum) == rank)
        found.append(at + low)
        keys.append(h[at])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pos, keep = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(keys)[keep] >> np.uint64(16)


def suffix_order(a: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `a` in the order of their first `depth` bytes or more, ties in any order."""
    n = len(a)
    padded = np.r_[a, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    del padded
    order, span = np.argsort(key), 8
    bits = 21 if n < 1 << 21 else 32  # ranks of three or two neighbours fit in a key
    while True:
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        if span >= depth or rank[order[-1]] == n:
            return order
        key = rank << np.uint64(64 - bits)
        for k in range(1, 64 // bits):
            key[: max(0, n - k * span)] |= rank[k * span :] << np.uint64(64 - bits * (k + 1))
        order = np.argsort(key)
        span *= 64 // bits


def repeated_prefixes(a: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix starts in order, whether each has `least` bytes or more in common with the one before it).

    Intervals of suffixes with a common prefix grow breadth first: an interval of length l, extended backward by each
    byte that its Burrows-Wheeler transform holds, gives intervals of length l + 1; the first to end at a place tells
    that the suffixes there have l bytes in common. Places that no interval shorter than `least` has ended at have
    `least` in common or more, and expansion stops there (Beller, Gog, Ohlebusch and Schnattinger, 2013). Intervals of
    one length don't overlap, so the rows of all of them are marked at the places they are mapped to, where runs of
    one interval and one byte are the new intervals: no sorting."""
    n = len(a)
    order = suffix_order(a, least)
    by_byte = np.argsort(a[order - 1], kind="stable")
    last_to_first = np.empty(n, np.int32)
    last_to_first[by_byte] = np.arange(n, dtype=np.int32)
    del by_byte
    byte = a[order]
    common = np.ones(n + 1, bool)
    common[0] = False
    low, high = np.array([0], np.int64), np.array([n], np.int64)
    came_from = np.full(n, -1, np.int32)
    for _ in range(least):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
        row = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        to = last_to_first[row]
        came_from[to] = owner
        place = np.flatnonzero(came_from >= 0)
        owner, kind = came_from[place], byte[place]
        came_from[to] = -1
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1])])
        low, high = place[cut], place[np.r_[cut[1:], len(place)] - 1] + 1
        new = common[high]
        low, high = low[new], high[new]
        common[high] = False
    return order, common[:n]


def smallest_owner(strings: np.ndarray, owner: np.ndarray, least: int, starts: int) -> np.ndarray:
    """For rows of bytes: of each window of `least` bytes that starts in the first `starts`, the smallest owner of a
    row that has it."""
    n, m = strings.shape
    if not n:
        return np.empty((0, starts), np.int64)
    a = np.full((n, m + 1), GAP, np.uint8)
    a[:, :m] = strings
    order, common = repeated_prefixes(a.ravel(), least)
    row, at = np.divmod(order, m + 1)
    real = at < starts
    group = np.cumsum(~common)[real]
    row, at = row[real], at[real]
    out = np.full((n, starts), NONE)
    if len(row):
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        low = np.minimum.reduceat(owner[row], cut)
        out[row, at] = np.repeat(low, np.diff(np.r_[cut, len(group)]))
    return out


def beyond(strings: np.ndarray, least: int, starts: int) -> np.ndarray:
    """Which windows of rows of bytes reach beyond their document."""
    outside = np.cumsum(np.c_[np.zeros(len(strings), np.int16), strings == PAD], axis=1, dtype=np.int16)
    return outside[:, least : least + starts] > outside[:, :starts]


class Block:
    """A block's texts and their anchors; `copies` have no part in the search."""

    def __init__(self, docs: pa.Table, copies: Iterable[int], least: int):
        gone = set(copies)
        self.rows = rows_of(docs) if docs.num_rows else []
        self.texts = [(r[1] or "").encode("utf-8", "replace") for r in self.rows]
        self.copy = [r[0] in gone for r in self.rows]
        self.least = least
        named = [(t, r[0], c) for t, r, c in zip(self.texts, self.rows, self.copy) if r[0] is not None]
        self.ids = np.array([i for _, i, _ in named], np.int64)
        self.apart = np.array([c for *_, c in named], bool)
        self.a = np.frombuffer(b"".join(t for t, *_ in named), np.uint8)
        self.ends = np.cumsum([len(t) for t, *_ in named], dtype=np.int64)

    def find(self) -> None:
        self.pos, self.key = anchors(self.a, self.ends, self.least)
        self.owner = np.searchsorted(self.ends, self.pos, "right")

    def strings(self, pos: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rows of the bytes around anchors that windows with them can hold; PAD beyond their text."""
        side = self.least - ANCHOR
        at = pos[:, None] + np.arange(-side, self.least)
        start = np.r_[0, self.ends][owner][:, None]
        inside = (at >= start) & (at < self.ends[owner][:, None])
        return np.where(inside, self.a[np.where(inside, at, 0)], np.uint8(PAD))


def by_shard(key: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its keys in ascending order of key)."""
    order = np.argsort(key, kind="stable")
    shard = (key % np.uint64(shards)).astype(np.int64)[order]
    order = order[np.argsort(shard, kind="stable")]
    ends = np.searchsorted(np.sort(shard), np.arange(shards + 1))
    return [(k, order[x:y]) for k, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]


def distinct_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes of a block, and whether two of its documents have each."""
    order = np.lexsort((block.owner, block.key))
    key, owner = block.key[order], block.ids[block.owner[order]] if len(order) else block.owner[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    if not len(cut):
        return key, np.empty(0, bool)
    return key[cut], np.minimum.reduceat(owner, cut) != np.maximum.reduceat(owner, cut)


_DIGESTS = "block long, doc_id long, digest binary"
_KEYS = "shard int, block long, keys binary"
_SHARED = "block long, shard int, doc_id long, payload binary"
_STRINGS = "shard int, block long, payload binary, held binary"
_OWNERS = "block long, shard int, doc_id long, payload binary, held binary"


def _units(batches: Iterable[pa.RecordBatch]) -> Iterable[tuple[int, pa.Table]]:
    for batch in batches:
        for i, name in enumerate(batch.column("block").to_pylist()):
            yield name, pa.Table.from_batches([batch.slice(i, 1)])


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for name, docs in _units(batches):
        rows = [(name, r[0], xxhash.xxh3_128_digest(r[1].encode("utf-8", "replace"))) for r in rows_of(docs) if r[0] is not None and r[1]]
        yield from _table(_DIGESTS, rows).to_batches()


def _key_rows(batches: Iterable[pa.RecordBatch], least: int, shards: int) -> Iterable[pa.RecordBatch]:
    """The different anchors of each block by shard, whether two of its documents have each or not."""
    for name, docs in _units(batches):
        block = Block(docs, [], least)
        block.find()
        keys, twice = distinct_keys(block)
        rows = [(k, name, pack_keys(keys[at] << np.uint64(1) | twice[at])) for k, at in by_shard(keys, shards)]
        yield from _table(_KEYS, rows).to_batches()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(fields, columns)})


@tidied
def _shared_rows(table: pa.Table) -> pa.Table:
    """For each block, which of its keys in this shard two documents have, in one block or in two."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    every = np.concatenate(keys)
    name, twice = every >> np.uint64(1), every & np.uint64(1)
    order = np.argsort(name, kind="stable")
    name, twice = name[order], twice[order]
    cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    shared = name[cut][(np.diff(np.r_[cut, len(name)]) > 1) | (np.add.reduceat(twice, cut) > 0)]
    rows = []
    for block, shard, k in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), keys):
        bits = np.isin(k >> np.uint64(1), shared, assume_unique=True)
        rows.append((block, shard, None, squeeze(np.packbits(bits).tobytes(), 1)))
    return _table(_SHARED, rows)


@tidied
def _string_rows(key, docs: pa.Table, other: pa.Table, least: int, shards: int) -> pa.Table:
    """The different strings around shared anchors with the smallest document that has each, by shard; and, only to
    come back with the answer, where in the block they are."""
    ids, shard_of, data = (other.column(c).to_pylist() for c in ("doc_id", "shard", "payload"))
    block = Block(docs, [i for i in ids if i is not None], least)
    block.find()
    keys, _ = distinct_keys(block)
    shared = np.zeros(len(keys), bool)
    bits = {k: d for k, d in zip(shard_of, data) if d is not None}
    for k, at in by_shard(keys, shards):
        shared[at] = np.unpackbits(np.frombuffer(zstandard.decompress(bits[k]), np.uint8), count=len(at)).astype(bool)
    keep = shared[np.searchsorted(keys, block.key)] & ~block.apart[block.owner] if len(keys) else np.empty(0, bool)
    pos, name, owner = block.pos[keep], block.key[keep], block.owner[keep]
    rows = []
    for k, at in by_shard(name, shards):
        strings = np.concatenate([block.strings(pos[x], owner[x]) for x in np.array_split(at, -(-len(at) // 20_000))])
        view = np.ascontiguousarray(np.c_[strings, np.zeros((len(strings), -strings.shape[1] % 8), np.uint8)]).view(np.uint64)
        digest, second = name[at].copy(), name[at] ^ _M
        for column in view.T:
            digest = (digest ^ column) * _K
            digest ^= digest >> np.uint64(31)
            second = (second + column) * _M
            second ^= second >> np.uint64(33)
        order = np.lexsort((block.ids[owner[at]], second, digest, name[at]))
        new = np.r_[True, (np.diff(digest[order]) != 0) | (np.diff(second[order]) != 0) | (np.diff(name[at][order]) != 0)]
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(new) - 1
        first = order[new]
        content = (name[at][first], strings[first].tobytes(), block.ids[owner[at[first]]])
        where = np.argsort(pos[at])
        held = pack_keys(pos[at][where].view(np.uint64)), index[where].astype("<u4").tobytes()
        rows.append((k, key[0].as_py(), squeeze(pickle.dumps(content)), squeeze(pickle.dumps(held), 1)))
    return _table(_STRINGS, rows)


@tidied
def _owner_rows(table: pa.Table, least: int) -> pa.Table:
    """For each block's strings in this shard, by start of a window: the smallest document that has the window."""
    m, starts = 2 * least - ANCHOR, least - ANCHOR + 1
    parts = [pickle.loads(zstandard.decompress(x)) for x in table.column("payload").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    name = np.concatenate([p[0] for p in parts])
    strings = np.concatenate([np.frombuffer(p[1], np.uint8).reshape(-1, m) for p in parts])
    owner = np.concatenate([p[2] for p in parts])
    del parts[:]
    view = np.ascontiguousarray(strings).view(f"V{m}").ravel()
    order = np.argsort(name, kind="stable")
    out = np.full((len(name), starts), NONE)
    cut = np.r_[np.flatnonzero(np.r_[True, np.diff(name[order]) != 0]), len(order)]
    most, low = SORTED // (m + 1), 0
    while low < len(cut) - 1:  # strings around one anchor stay together
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + most, "right")) - 1)
        at = order[cut[low] : cut[high]]
        _, first, back = np.unique(view[at], return_index=True, return_inverse=True)
        least_owner = np.full(len(first), NONE)
        np.minimum.at(least_owner, back, owner[at])
        found = np.repeat(least_owner[:, None], starts, axis=1)
        anchor, times = np.unique(name[at[first]], return_counts=True)
        differ = times[np.searchsorted(anchor, name[at[first]])] > 1  # the only string of its anchor has no other to meet
        found[differ] = smallest_owner(strings[at[first[differ]]], least_owner[differ], least, starts)
        found[beyond(strings[at[first]], least, starts)] = NONE
        out[at] = found[back]
        low = high
    rows, at = [], 0
    for block, shard, held, n in zip(*(table.column(c).to_pylist() for c in ("block", "shard", "held")), sizes):
        mine = out[at : at + n]
        at += n
        change = np.c_[np.ones(n, bool), np.diff(mine, axis=1) != 0].ravel()
        content = (np.flatnonzero(change).astype(np.uint32), mine.ravel()[change])
        rows.append((block, shard, None, squeeze(pickle.dumps(content), 1), held))
    return _table(_OWNERS, rows)


_SPANS = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


@tidied
def _span_rows(docs: pa.Table, other: pa.Table, least: int) -> pa.Table:
    ids, data, held = (other.column(c).to_pylist() for c in ("doc_id", "payload", "held"))
    block = Block(docs, [i for i in ids if i is not None], least)
    side, starts = least - ANCHOR, least - ANCHOR + 1
    edge = np.zeros(len(block.a) + 1, np.int32)
    for answer, asked in zip(data, held):
        if answer is None:
            continue
        pos, index = pickle.loads(zstandard.decompress(asked))
        pos, index = unpack_keys(pos).view(np.int64), np.frombuffer(index, "<u4")
        place, low = pickle.loads(zstandard.decompress(answer))
        row, begin = np.divmod(place.astype(np.int64), starts)
        end = np.r_[begin[1:], 0]
        end[end == 0] = starts
        runs = np.searchsorted(row, np.arange(row[-1] + 2))
        number = (runs[1:] - runs[:-1])[index]
        which = np.repeat(np.arange(len(index)), number)
        run = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + runs[index][which]
        mine = block.ids[np.searchsorted(block.ends, pos, "right")][which]
        cover = low[run] < mine
        run, at = run[cover], pos[which[cover]]
        np.add.at(edge, at - side + begin[run], 1)
        np.add.at(edge, at - side + end[run] - 1 + least, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out, low, n = [], 0, 0
    for (doc, *_), text, copy in zip(block.rows, block.texts, block.copy):
        if copy or doc is None:
            low += len(text) if doc is not None else 0
            whole = bool(copy) and len(text) >= least
            out.append((doc, len(text), [{"start": 0, "end": len(text)}] if whole else [], b"" if whole else text))
            continue
        mask = gone[low : low + len(text)]
        low += len(text)
        turns = np.flatnonzero(np.diff(np.r_[False, mask, False]))
        spans = [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()]
        out.append((doc, len(text), spans, np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "spans", "kept"), columns, (pa.int64(), pa.int64(), span, pa.binary()))})


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) for each row of `docs` (doc_id, text).

    spans: the maximal runs of bytes of the UTF-8 text covered by strings of `least` bytes that also start in a
    document with a smaller doc_id, judged on the input; kept: the other bytes, joined. Matches lie within documents.

    Of equal texts only the one with the smallest doc_id takes part; the others are covered whole, if long enough.
    Blocks of documents send shards their anchors, by which equal windows must meet; for anchors of two documents or
    more they then send the different strings around them, each with its smallest document. A shard sorts the
    suffixes of its strings, some anchors at a time, and answers for every window which document is the first to have
    it. A string that very many documents have costs a shard one entry a block.

    A null text is empty. Rows without doc_id neither cut nor are cut. Rows that repeat a doc_id don't cut each
    other. Other columns are ignored; an empty table gives none."""
    if least <= ANCHOR:
        raise ValueError(f"least must be above {ANCHOR}")
    spark = docs.sparkSession
    shared_dir(spark)
    shards = width(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(to_units(text))
    digests = materialize(packed.mapInArrow(_digest_rows, _DIGESTS))
    first = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    copies = digests.join(first, "digest").where("doc_id > first").select("block", F.lit(None).cast("int").alias("shard"), "doc_id", F.lit(None).cast("binary").alias("payload"))
    copies = materialize(copies.distinct())
    in_block = packed.groupBy("block")
    shared = packed.mapInArrow(lambda it: _key_rows(it, least, shards), _KEYS).groupBy("shard").applyInArrow(lambda t: _shared_rows(t), _SHARED)
    shared = materialize(shared)
    side = shared.unionByName(copies)
    strings = in_block.cogroup(side.groupBy("block")).applyInArrow(lambda k, l, r: _string_rows(k, l, r, least, shards), _STRINGS)
    owners = strings.groupBy("shard").applyInArrow(lambda t: _owner_rows(t, least), _OWNERS)
    answers = owners.unionByName(copies.withColumn("held", F.lit(None).cast("binary")))
    return in_block.cogroup(answers.groupBy("block")).applyInArrow(lambda l, r: _span_rows(l, r, least), _SPANS)


def _without(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without spans of its UTF-8 bytes, and without what is left of a character that a span cuts."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "replace")
    starts, ends = [0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(data)]
    return b"".join(data[x:y] for x, y in zip(starts, ends)).decode("utf-8", "ignore")


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_without(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """`docs` with the repeated spans of their texts removed, and n_chars, where there is one, counted anew.

    Bytes left of a character that a span cuts go too; a text may become empty, its row stays. Null texts stay null.
    Rows that repeat a doc_id must have one text. Only spans are written and met with the rows, so that each text is
    shuffled once; the join is by sort at every size."""
    spark = docs.sparkSession
    with scratch(spark):
        found = repeated_spans(docs.select("doc_id", "text"), least).where("size(spans) > 0")
        spans = materialize(found.groupBy("doc_id").agg(F.min("spans").alias("spans")), kept=True)
        del found
    release(spark)
    d, c = docs.alias("d"), spans.hint("merge").alias("c")
    joined = d.join(c, F.col("d.doc_id").cast("long") == F.col("c.doc_id"), "left")
    cut = F.arrow_udf(_cut, "string")(F.col("d.text").cast("string"), F.col("c.spans"))
    own = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("gone").isNull(), F.col("kept.n_chars")).otherwise(F.length("cut")).cast("long")
    joined = joined.select(F.struct("d.*").alias("kept"), F.col("c.doc_id").alias("gone"), cut.alias("cut"))
    return joined.select(*[own[c].alias(c) if c in own else F.col(f"kept.`{c}`") for c in docs.columns])
