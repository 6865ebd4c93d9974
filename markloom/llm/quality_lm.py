"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.blocks import block_count, block_of, pack_keys, rows_of, squeeze, to_blocks, unpack_keys
from markloom.llm.common import materialize, scratch, shared_dir, tidied, width

#: Bytes of an n-gram. The key of the n-gram b0..b4 is b3 b2 b1 b0 b4, so that each shorter context is a prefix.
ORDER = 5
#: Trusted documents whose crc32(doc_id as text) mod HELD is 0 set the thresholds and are not trained on.
HELD = 5
#: Bytes at the language's mean that are added to each document, so that short ones are judged with care.
PRIOR_BYTES = 50
QUANTILE, SLACK = 0.99, 1.03
#: Steps of a nat in which quantiles are counted, and in which logarithms of probabilities are sent: a byte's is at
#: most half of the latter off, so a text's perplexity by at most one part in 4000.
STEPS, FINE = 1000, 2048
#: Bytes of text whose n-grams are held at once.
HELD_BYTES = 1 << 19

_U8 = np.uint64(8)


def grams(texts: Iterable[bytes]) -> np.ndarray:
    """Keys of the n-grams that end at each byte of each text; zero bytes stand before a text."""
    pad = b"\0" * (ORDER - 1)
    data = [pad + t for t in texts]
    a = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    if not len(a):
        return a
    n = len(a) - ORDER + 1
    key = np.zeros(n, np.uint64)
    for k in range(1, ORDER):
        key = key << _U8 | a[ORDER - 1 - k : ORDER - 1 - k + n]
    key = key << _U8 | a[ORDER - 1 :]
    ends = np.cumsum([len(t) for t in data])
    real = np.ones(n, bool)
    for k in range(ORDER - 1):  # a text's keys start after its own padding
        late = ends[:-1] - k - 1
        real[late[late < n]] = False
    return key[real]


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD == 0


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes of the context: all orders from 3 up that a key needs are in its shard."""
    return ((keys >> np.uint64(8 * (ORDER - 2))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shards


def _texts(rows: list[tuple]) -> list[bytes]:
    return [(r[1] or "").encode("utf-8", "replace") for r in rows]


def parts_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys of n-grams, the text each is of), for HELD_BYTES of texts at a time; long texts come in parts."""
    keep = ORDER - 1
    held, owner, total = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), HELD_BYTES):
            cut = text[max(0, at - keep) : at + HELD_BYTES]
            new = min(len(text), at + HELD_BYTES) - at
            if total + new > HELD_BYTES and held:
                yield np.concatenate(held), np.repeat(*map(np.array, zip(*owner)))
                held, owner, total = [], [], 0
            key = grams([cut])[-new:]
            held.append(key)
            owner.append((i, new))
            total += new
    if held:
        yield np.concatenate(held), np.repeat(*map(np.array, zip(*owner)))


_TYPES = "shard int, block int, types binary, counts binary"


def _types(texts: list[bytes], known: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, and how often those that are `known` have each."""
    types, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    trained = np.array(known, bool)
    for key, owner in parts_of(texts):
        key = key << np.uint64(1) | trained[owner]
        key.sort()
        start = np.flatnonzero(np.r_[True, key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)])
        new, times = key[start] >> np.uint64(1), np.add.reduceat((key & np.uint64(1)).astype(np.int64), start)
        both = np.concatenate([types, new])
        order = np.argsort(both, kind="stable")
        types, counts = both[order], np.concatenate([counts, times])[order]
        start = np.flatnonzero(np.r_[True, types[1:] != types[:-1]])
        types, counts = types[start], np.add.reduceat(counts, start)
    return types, counts


@tidied
def _count(block: int, docs: pa.Table, trusted: pa.Table, shards: int) -> pa.Table:
    """All distinct n-grams of a block by shard, with how often trained-on documents have them."""
    good = set(trusted.column("doc_id").to_pylist())
    rows = rows_of(docs) if docs.num_rows else []
    types, counts = _types(_texts(rows), [r[0] in good and not held_out(r[0]) for r in rows])
    shard = shard_of(types, shards)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    cuts = [(k, order[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    return pa.table(
        {
            "shard": pa.array([k for k, _ in cuts], pa.int32()),
            "block": pa.array([block] * len(cuts), pa.int32()),
            "types": pa.array([pack_keys(types[at]) for _, at in cuts], pa.binary()),
            "counts": pa.array([squeeze(counts[at].astype("<u4").tobytes(), 1) for _, at in cuts], pa.binary()),
        }
    )


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A shard's types by block, and of all of them those trained on, with counts."""
    types = [unpack_keys(x) for x in table.column("types").to_pylist()]
    counts = [np.frombuffer(zstandard.decompress(x), "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
    keys, held = np.concatenate(types), np.concatenate(counts)
    keys, held = keys[held > 0], held[held > 0]
    order = np.argsort(keys, kind="stable")
    keys, held = keys[order], held[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return types, keys[start], np.add.reduceat(held, start) if len(keys) else held


def lower(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next lower order: keys without their first byte, and how many different bytes came before each."""
    return np.unique(keys >> np.uint64(16) << _U8 | keys & np.uint64(255), return_counts=True)


@tidied
def _statistics(table: pa.Table) -> pa.Table:
    """(kind, at, n): numbers of n-grams counted 1 to 4 times by order (kind 0), and continuation counts of order 2."""
    _, keys, counts = _merged(table)
    kind, at, n = [], [], []
    for order in range(ORDER, 2, -1):
        for times in range(1, 5):
            kind.append(0), at.append(10 * order + times), n.append(int((counts == times).sum()))
        keys, counts = lower(keys)
    return pa.table({"kind": pa.array(kind + [1] * len(keys), pa.int32()), "at": pa.array(at + keys.tolist(), pa.int64()), "n": pa.array(n + counts.tolist(), pa.int64())})


def discounts(n: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times (Chen and Goodman)."""
    n = [max(1, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0] + [float(min(i, max(0.1 * i, i - (i + 1) * y * n[i] / n[i - 1]))) for i in (1, 2, 3)]


def interpolate(asked: np.ndarray, below: np.ndarray, keys: np.ndarray, counts: np.ndarray, off: list[float]) -> np.ndarray:
    """Probabilities of one order for the n-grams `asked`, of which the next lower order gives `below`."""
    if not len(keys):
        return below
    d = np.array(off)[np.minimum(counts, 3)]
    contexts, start = np.unique(keys >> _U8, return_index=True)
    total = np.add.reduceat(counts, start).astype(float)
    left = np.add.reduceat(d, start) / total
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    j = np.minimum(np.searchsorted(contexts, asked >> _U8), len(contexts) - 1)
    seen = np.where(keys[i] == asked, counts[i] - d[i], 0.0)
    return np.where(contexts[j] == asked >> _U8, seen / total[j] + left[j] * below, below)


def order_two(continued: dict[int, int]) -> np.ndarray:
    """256 x 256 probabilities of orders 1 and 2, from continuation counts; uniform below."""
    keys = np.array(sorted(continued), np.uint64)
    counts = np.array([continued[k] for k in sorted(continued)], np.int64)
    every = np.arange(65536, dtype=np.uint64)
    first, times = np.unique(keys & np.uint64(255), return_counts=True)
    p = np.full(65536, 1 / 256)
    for k, c, at in ((first, times, every & np.uint64(255)), (keys, counts, every)):
        p = interpolate(at, p, k, c, discounts([int((c == i).sum()) for i in range(1, 5)]))
    return p


@tidied
def _score(table: pa.Table, off: dict[int, list[float]], two: np.ndarray) -> pa.Table:
    """Minus the natural logarithms of the probabilities of each block's n-grams in one shard, in steps of 1 / FINE."""
    types, keys, counts = _merged(table)
    asked = np.unique(np.concatenate(types))
    orders = []
    for order in range(ORDER, 2, -1):
        orders.append((order, keys, counts))
        keys, counts = lower(keys)
    cut = lambda x, order: x >> np.uint64(8 * (ORDER - order + 1)) << _U8 | x & np.uint64(255)
    p = two[cut(asked, 2).astype(np.int64)]
    for order, k, c in reversed(orders):
        p = interpolate(cut(asked, order), p, k, c, off[order])
    logs = np.minimum(np.rint(-np.log(p) * FINE), 65535).astype("<u2")
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "logs": pa.array([squeeze(logs[np.searchsorted(asked, t)].tobytes(), 1) for t in types], pa.binary())})


_SCORES = "doc_id long, lang string, trusted boolean, n_bytes long, nll double"


@tidied
def _sum(docs: pa.Table, logs: pa.Table, trusted: pa.Table, shards: int) -> pa.Table:
    rows = rows_of(docs)
    texts = _texts(rows)
    types, _ = _types(texts, [False] * len(texts))
    shard = shard_of(types, shards)
    log = np.zeros(len(types))
    for k, data in zip(logs.column("shard").to_pylist(), logs.column("logs").to_pylist()):
        log[shard == k] = np.frombuffer(zstandard.decompress(data), "<u2")
    sums = np.zeros(len(texts))
    for key, owner in parts_of(texts):
        order = np.argsort(key)
        new = np.r_[True, np.diff(key[order]) != 0]
        place = np.empty(len(key), np.int64)
        place[order] = np.searchsorted(types, key[order][new])[np.cumsum(new) - 1]
        sums += np.bincount(owner, log[place], len(texts))
    sums /= FINE
    good = set(trusted.column("doc_id").to_pylist())
    return pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "lang": pa.array([r[2] for r in rows], pa.string()),
            "trusted": pa.array([r[0] in good for r in rows], pa.bool_()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "nll": pa.array(sums, pa.float64()),
        }
    )


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, nll): minus the natural logarithm of each text's probability, for each row.

    Trusted: labels (doc_id, quality) gives quality 1. The model counts every trusted text that isn't held out. All
    of the corpus's distinct n-grams meet the counts in shards; what comes to the driver is the number of n-grams
    seen one to four times by order, and 65536 continuation counts at most."""
    spark = docs.sparkSession
    shared_dir(spark)
    shards, blocks = width(spark), block_count(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.withColumn("block", block_of("doc_id", blocks))

    def counted(key, left, right):
        return _count(key[0].as_py(), left, right, shards)

    types = materialize(to_blocks(text, blocks).groupBy("block").cogroup(good.groupBy("block")).applyInArrow(counted, _TYPES))
    found = types.groupBy("shard").applyInArrow(lambda t: _statistics(t), "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    seen = {r["at"]: r["n"] for r in found if r["kind"] == 0}
    off = {m: discounts([seen.get(10 * m + i, 0) for i in range(1, 5)]) for m in range(3, ORDER + 1)}
    two = order_two({r["at"]: r["n"] for r in found if r["kind"] == 1})
    logs = types.groupBy("shard").applyInArrow(lambda t: _score(t, off, two), "block int, shard int, logs binary")
    back = logs.select("block", "shard", "logs", F.lit(None).cast("long").alias("doc_id"))
    back = back.unionByName(good.select("block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("logs"), "doc_id"))

    def summed(left, right):
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "trusted": pa.array([], pa.bool_()), "n_bytes": pa.array([], pa.int64()), "nll": pa.array([], pa.float64())})
        return _sum(left, right.filter(pa.compute.is_valid(right.column("logs"))), right.filter(pa.compute.is_valid(right.column("doc_id"))), shards)

    return to_blocks(text, blocks).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(summed, _SCORES)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) for each row of `docs` (doc_id, text, lang).

    perplexity is by byte, with PRIOR_BYTES bytes at the mean of the held-out trusted texts of the language; the
    threshold is SLACK times their quantile QUANTILE; a language without such texts has both of all languages. keep:
    not above the threshold.

    A null or empty text has the mean's perplexity and is kept. A null language is one of its own. Without trusted
    texts nothing is rejected and the threshold is null. Rows without doc_id are scored, never trusted; equal rows
    score equal. Other columns are ignored; an empty table gives none."""
    scores = materialize(perplexities(docs, labels))
    held = scores.where(F.col("trusted") & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD)) == 0) & (F.col("n_bytes") > 0))
    means = materialize(held.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("n_bytes").alias("bytes")))
    own = means.select("lang", (F.col("nll") / F.col("bytes")).alias("own_mean"))
    rest = means.agg((F.sum("nll") / F.sum("bytes")).alias("all_mean"))
    every = F.lit(rest.first()["all_mean"]).cast("double")

    def with_rate(rows: DataFrame) -> DataFrame:
        r, o = rows.alias("r"), own.alias("o")
        joined = r.join(o, F.col("r.lang").eqNullSafe(F.col("o.lang")), "left")
        mean = F.coalesce(F.col("o.own_mean"), every, F.lit(0.0))
        return joined.select("r.*", ((F.col("nll") + PRIOR_BYTES * mean) / (F.col("n_bytes") + PRIOR_BYTES)).alias("rate"))

    steps = with_rate(held).groupBy("lang", F.floor(F.col("rate") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    steps = materialize(steps)

    def quantile(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        upto = rows.select(*by, "step", F.sum("n").over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
        return upto.where(F.col("upto") >= QUANTILE * F.col("all")).groupBy(*by).agg((SLACK * F.exp((F.min("step") + 1) / STEPS)).alias("limit"))

    by_lang = materialize(quantile(steps, ["lang"]))
    of_all = quantile(steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"]).first()
    s, q = with_rate(scores).alias("s"), by_lang.alias("q")
    limit = F.coalesce(F.col("q.limit"), F.lit(of_all["limit"] if of_all else None).cast("double"))
    out = s.join(q, F.col("s.lang").eqNullSafe(F.col("q.lang")), "left").select("s.doc_id", "s.lang", "n_bytes", F.exp("rate").alias("perplexity"), limit.alias("threshold"))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def quality_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge_quality` keeps, with all their columns; of rows that share a doc_id, all go if one does."""
    with scratch(docs.sparkSession):
        gone = materialize(judge_quality(docs, labels).where("not keep and doc_id is not null").select("doc_id").distinct(), kept=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
