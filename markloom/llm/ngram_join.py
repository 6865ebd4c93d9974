"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik, 2006)."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.blocks import pack_keys, squeeze, unpack_keys
from markloom.llm.common import materialize, scratch, shared_dir, slices, tidied, width
from markloom.llm.graph import components

#: A signature need hold no more features than this.
FEATURES = 16
#: Words whose hashes a worker keeps before it starts anew.
WORDS_KEPT = 400_000
#: Shingles and documents of a block of a large candidate group; a task holds two blocks.
BLOCK_SHINGLES, BLOCK_DOCS = 400_000, 1_200
#: By so much the bands of sizes in a large group are wider than linked sizes can differ, for rounding.
WIDER = 1 + 1e-9
#: Counters of shingles in large groups: between these, and by so many shingles each as long as that lies between.
LEAST_COUNTERS, MOST_COUNTERS, COUNTED = 1 << 16, 1 << 22, 8
#: Shingles in at least so many documents of a task are counted by matrix products, others by their pairs.
DENSE = 12

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def seed_of(*parts: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(repr(parts).encode()))


class Shingler:
    """Sets of hashed word shingles. Words are runs other than ASCII white space, A-Z in lower case."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes, ascending. Fewer than n words: the whole sequence is the one shingle; none: empty."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - n + 1, seed_of(n), np.uint64)
            for i in range(n):
                out = mix(out * _A + h[i : len(h) - n + 1 + i])
        return np.unique(out)


class PartEnum:
    """Signatures such that two sets with num/den or more of their union in common share at least one.

    Sizes fall into bands whose ends differ by that ratio at most, so linked sets are in one band or in neighbours;
    each set signs for its own band and the next. In a band, linked sets differ in at most k features. The feature
    domain is cut into n1 parts of n2 cells each; with at most k differences some part has at most k2 of them, hence
    some n2 - k2 of its cells are equal, and each such choice of cells is a signature. Choices with few features are met
    by chance, or by one passage that two texts share, and would chain texts that are not alike. So a set signs only
    with choices of at least so many features that k differences, spent in the fullest cells, cannot spoil them all;
    of two linked sets the one that asks for more is sure of a choice that both sign with. `spare` parts more, and one
    in 8, raise that number. A set whose choices can all be spoiled also signs with the features of its prefix in hash
    order, of which linked sets share one."""

    def __init__(self, num: int, den: int, spare: int = 6):
        self.num, self.den, self.spare = num, den, spare
        self.tops = [1]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    @lru_cache(maxsize=4096)
    def plan(self, band: int):
        """(k, parts, cells, k2, choices, seeds) of a band, or None if its linked sets are equal."""
        self.band(self.tops[-1] + 1) if band >= len(self.tops) else None
        k = (self.den - self.num) * 2 * self.tops[band] // (self.den + self.num)
        if not k:
            return None
        n2, k2 = (4, 2) if k >= 16 else (1, 0)
        n1 = k // (k2 + 1) + k // (k2 + 1) // 8 + self.spare
        choices = list(combinations(range(n2), n2 - k2))
        return k, n1, n2, k2, choices, [seed_of(self.num, self.den, band, i) for i in range(len(choices) + 1)]

    @staticmethod
    def least(filled: np.ndarray, k: int, k2: int) -> int:
        """The largest number of features, up to FEATURES, such that k differences leave some part a choice of equal
        cells with so many; 0 if not even one feature is sure. `filled`: features by part and cell."""
        chosen = filled.shape[1] - k2
        large = -np.sort(-filled, axis=1)
        # Differences do most harm in a part's fullest cells: best[:, h] is what a choice can hold after h of them.
        best = np.stack([large[:, h : h + chosen].sum(1) for h in range(k2 + 1)], axis=1)
        return min(FEATURES, int(np.partition(best, best.size - k - 1, axis=None)[best.size - k - 1])) if best.size > k else 0

    def sign(self, features: np.ndarray) -> np.ndarray:
        size, out = len(features), []
        if not size:
            return np.empty(0, np.uint64)
        own = self.band(size)
        for band in (own, own + 1):
            plan = self.plan(band)
            if plan is None:
                continue
            k, n1, n2, k2, choices, seeds = plan
            with np.errstate(over="ignore"):
                h = mix(features + seeds[0])
                cell = ((h >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(np.int64)
                sums, filled = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, np.int64)
                np.add.at(sums, cell, mix(h))
                filled = np.bincount(cell, minlength=n1 * n2)
                sums, filled = sums.reshape(n1, n2), filled.reshape(n1, n2)
                least = self.least(filled, k, k2)
                part = np.arange(n1, dtype=np.uint64)
                for choice, seed in zip(choices, seeds[1:]):
                    here = filled[:, choice].sum(1) >= max(least, 1)
                    out.append(mix(sums[:, choice].sum(1, dtype=np.uint64) + mix(part + seed))[here])
                if not least:
                    common = -(-self.num * size // self.den)
                    out.append(mix(np.sort(h)[: size - common + 1] ^ seeds[0]))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


_NODES = "doc_id long, n_shingles long, digest binary"
_SIGNED = "shard int, pairs boolean, payload binary"


def digest_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _nodes(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(n)
    for piece in slices(batches):
        sets = [shingle(t) for t in piece.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "digest"]
        )


def _by_shard(signed: list[tuple[int, np.ndarray]], shards: int) -> pa.RecordBatch:
    """Rows of _SIGNED for (document, signatures)."""
    sig = np.concatenate([x[1] for x in signed]) >> np.uint64(16)
    doc = np.repeat(np.array([x[0] for x in signed], np.int64), [len(x[1]) for x in signed])
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    low = doc[new][np.cumsum(new) - 1]
    keep = ~new & (doc != low)
    rows = []
    if keep.any():
        pairs = np.unique(np.stack([doc[keep], low[keep]], axis=1), axis=0)
        rows.append((int(sig[0] % np.uint64(shards)), True, pairs.tobytes()))
    sig, doc = sig[new], doc[new]
    shard = (sig >> np.uint64(20)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k, (x, y) in enumerate(zip(ends, ends[1:])):
        if y > x:
            at = order[x:y]
            docs, index = np.unique(doc[at], return_inverse=True)
            content = (pack_keys(sig[at]), pack_keys(docs.view(np.uint64)), index.astype(np.uint32 if len(docs) > 65535 else np.uint16).tobytes())
            rows.append((k, False, pickle.dumps(content)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["shard", "pairs", "payload"])


def _signed(batches: Iterable[pa.RecordBatch], n: int, num: int, den: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A slice's signatures by shard, each with the smallest document that has it; and, as pairs, the other documents
    with a signature, each linked to the smallest. 48 bits of a signature are kept: one more meeting costs a check."""
    shingle, enum = Shingler(n), PartEnum(num, den)
    for piece in slices(batches):
        first: dict[bytes, tuple[int, np.ndarray]] = {}
        for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            s = shingle(text) if doc is not None else np.empty(0, np.uint64)
            if len(s):
                key = digest_of(s)
                if key not in first:
                    first[key] = (doc, enum.sign(s))
                elif doc < first[key][0]:
                    first[key] = (doc, first[key][1])
        signed = [x for x in first.values() if len(x[1])]
        if not signed:
            continue
        yield _by_shard(signed, shards)


_COUNTERS = "piece int, counts binary"


def counter_of(shingles: np.ndarray, counters: int) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % counters


def _counters(batches: Iterable[pa.RecordBatch], n: int, counters: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """Of all texts of a task, how many shingles fall on each counter, by piece of the counters."""
    shingle, total = Shingler(n), np.zeros(counters, np.uint32)
    for part in slices(batches):
        for text in part.column("text").to_pylist():
            np.add.at(total, counter_of(shingle(text), counters), 1)
    rows = [(k, squeeze(x.astype("<u4").tobytes(), 1)) for k, x in enumerate(np.array_split(total, pieces)) if x.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["piece", "counts"])


@tidied
def _summed(table: pa.Table) -> pa.Table:
    """A piece of the counters, summed up, with 16 bits each: what exceeds them is frequent enough."""
    total = 0
    for data in table.column("counts").to_pylist():
        total = total + np.frombuffer(zstandard.decompress(data), "<u4").astype(np.int64)
    return pa.table({"piece": table.column("piece").cast(pa.int32())[:1], "counts": pa.array([squeeze(np.minimum(total, 65535).astype("<u2").tobytes(), 1)], pa.binary())})


def rare_prefix(shingles: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of a set that come first by (counter, hash), so many that sets with num/den of their union in
    common share one of them: both sets order by the same numbers, whatever these are."""
    first = len(shingles) + (-num * len(shingles) // den) + 1
    return shingles[np.lexsort((shingles, often[counter_of(shingles, len(often))]))[:first]]


def _prefixed(batches: Iterable[pa.RecordBatch], n: int, num: int, den: int, shards: int, often) -> Iterator[pa.RecordBatch]:
    """Rows of _SIGNED for documents of large groups: their rare prefixes, each group's for itself."""
    shingle, counts = Shingler(n), None
    for piece in slices(batches):
        counts = often.value if counts is None else counts
        signed = []
        for doc, part, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
            prefix = rare_prefix(shingle(text), counts, num, den)
            if len(prefix):
                signed.append((doc, mix(prefix ^ mix(np.array([part], np.int64).view(np.uint64)))))
        if signed:
            yield _by_shard(signed, shards)


def _meet(table: pa.Table, parts: int) -> pa.Table:
    """Of one shard's signatures in two slices or more: each document linked to the smallest that shares one, packed by
    the linked document."""
    sigs, docs, given = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
    for pairs, data in zip(table.column("pairs").to_pylist(), table.column("payload").to_pylist()):
        if pairs:
            given.append(np.frombuffer(data, np.int64).reshape(-1, 2))
            continue
        sig, names, index = pickle.loads(data)
        names = unpack_keys(names).view(np.int64)
        sigs.append(unpack_keys(sig))
        docs.append(names[np.frombuffer(index, np.uint32 if len(names) > 65535 else np.uint16)])
    sig, doc = np.concatenate(sigs), np.concatenate(docs)
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.r_[True, sig[1:] != sig[:-1]][: len(sig)]
    low = doc[new][np.cumsum(new) - 1]
    keep = ~new & (doc != low)
    pairs = np.unique(np.concatenate([np.stack([doc[keep], low[keep]], axis=1), *given]), axis=0)
    with np.errstate(over="ignore"):
        part = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(int)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    cuts = [(k, pairs[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
    return pa.table({"part": pa.array([k for k, _ in cuts], pa.int32()), "pairs": pa.array([x for _, x in cuts], pa.binary())})


def _pairs(table: pa.Table) -> pa.Table:
    """Different pairs from all shards."""
    pairs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("pairs").to_pylist()]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix. Memory: the square of len(sets), plus some MB."""
    n = len(sets)
    feature, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    starts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]]) if len(feature) else np.empty(0, int)
    held = np.diff(np.r_[starts, len(feature)])
    both = np.zeros((n, n), np.int32)
    for d in range(2, min(DENSE, n + 1)):
        rows = owner[starts[held == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(both, (rows[:, i], rows[:, j]), 1)
    both += both.T
    often = np.flatnonzero(held >= DENSE)
    step = max(64, (8 << 20) // max(n, 1))
    for at in range(0, len(often), step):
        some = often[at : at + step]
        here = np.zeros((n, len(some)), np.float32)
        which = np.repeat(np.arange(len(some)), held[some])
        place = np.arange(len(which)) - np.repeat(np.cumsum(held[some]) - held[some], held[some])
        here[owner[starts[some][which] + place], which] = 1
        both += (here @ here.T).astype(np.int32)  # less than 2 ** 24 columns at once: exact
    np.fill_diagonal(both, [len(s) for s in sets])
    return both.astype(np.int64)


def _linked(key: tuple, table: pa.Table, n: int, num: int, den: int) -> pa.Table:
    """Links of a candidate group, or between two of its blocks: a row (a, smallest document joined to a, copies linked)."""
    _, left, right = (k.as_py() if hasattr(k, "as_py") else k for k in key)  # blocks' names
    ids, copies = (np.array(table.column(c).to_pylist(), np.int64) for c in ("doc_id", "copies"))
    block = np.array(table.column("block").to_pylist())
    shingle = Shingler(n)
    sets = [shingle(t) for t in table.column("text").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    both = common_counts(sets)
    link = (den * both >= num * (size[:, None] + size[None, :] - both)) & (both > 0)
    np.fill_diagonal(link, False)
    if left != right:
        link &= block[:, None] != block[None, :]
    count = link @ copies
    low, before = ids.copy(), None
    while before is None or (before != low).any():
        before = low
        low = np.minimum(low, np.where(link, low[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
    return pa.table({"a": pa.array(ids), "b": pa.array(low), "links": pa.array(count.astype(np.int64))})


def _grouped(signed: DataFrame, shards: int) -> DataFrame:
    """(node, component): documents joined by the signatures of rows of _SIGNED."""
    met = signed.groupBy("shard").applyInArrow(lambda t: _meet(t, shards), "part int, pairs binary")
    return components(met.groupBy("part").applyInArrow(_pairs, "a long, b long"))


def _refined(text: DataFrame, large: DataFrame, shingles: int, n: int, num: int, den: int, shards: int) -> DataFrame:
    """(node, component) of the documents `large` (doc_id, part), which lie in large groups: those that share a shingle
    of their rare prefixes stay joined. `shingles`: how many they have."""
    spark = text.sparkSession
    with scratch(spark):
        texts = materialize(text.join(large, "doc_id").select("doc_id", "part", "text"))
        counters = min(max(LEAST_COUNTERS, 1 << (shingles // COUNTED).bit_length()), MOST_COUNTERS)
        counted = texts.mapInArrow(lambda it: _counters(it, n, counters, shards), _COUNTERS).groupBy("piece").applyInArrow(lambda t: _summed(t), _COUNTERS)
        often = [np.zeros(len(x), "<u2") for x in np.array_split(np.empty(counters, np.uint8), shards)]
        for row in counted.collect():
            often[row["piece"]] = np.frombuffer(zstandard.decompress(row["counts"]), "<u2")
        often = spark.sparkContext.broadcast(np.concatenate(often))
        found = materialize(_grouped(texts.mapInArrow(lambda it: _prefixed(it, n, num, den, shards, often), _SIGNED), shards), kept=True)
        often.destroy()
    return found


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) for each row of `docs` (doc_id, text).

    Documents link when their sets of n-word shingles share at least num/den of their union. component_id: the
    smallest doc_id reachable by links, itself included; n_links: other rows it links with.

    Equal sets are one class, held by its smallest doc_id. Slices of documents send each shard their signatures
    with the smallest document only, so a signature of very many documents costs a shard one entry a slice.
    Documents joined by shared signatures are a candidate group; no link leaves one. The more documents there are, the
    more of them chance chains into one group, so a group of more than a block is closed anew under another exact
    condition: linked sets share a shingle of their prefixes in the order of how often shingles come in large groups.
    Each group is joined exactly in one task by its shingles; a group of more than BLOCK_SHINGLES or BLOCK_DOCS is dealt into bands of sizes, in
    which linked documents lie in one band or in neighbours, and bands into blocks; blocks of one band or of
    neighbours meet in a task, so that no task holds more than two. Tasks return a row a document, not its pairs.

    A null, empty or blank text has the empty set and links with nothing. Rows without doc_id keep n_shingles, have
    no links and a null component. Rows that repeat a doc_id are texts of one document, in one component. Other
    columns are ignored; an empty table gives none."""
    spark = docs.sparkSession
    shared_dir(spark)
    shards = 2 * width(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = materialize(text.mapInArrow(lambda it: _nodes(it, n), _NODES))
    named = nodes.where("digest is not null and doc_id is not null")
    classes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")))
    group = _grouped(text.mapInArrow(lambda it: _signed(it, n, num, den, shards), _SIGNED), shards)
    reps = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("copies").alias("copies"), F.sum("n_shingles").alias("n_shingles"))
    asked = materialize(group.join(reps, "node").select(F.col("node").alias("doc_id"), F.col("component").alias("part"), "copies", "n_shingles"))

    def blocks(rows: DataFrame, *by: str) -> DataFrame:
        sums = rows.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
        return sums.select(*by, "docs", "shingles", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))

    def by_part(rows: DataFrame) -> DataFrame:
        return materialize(blocks(rows, "part").where("docs > 1").select("part", "shingles", (F.col("blocks") > 1).alias("large")))

    large = by_part(asked)
    shingles = large.where("large").agg(F.sum("shingles")).first()[0]
    if shingles:
        parts = large.where("large").select("part")
        finer = _refined(text, materialize(asked.join(parts, "part").select("doc_id", "part")), int(shingles), n, num, den, shards)
        finer = asked.drop("part").join(finer.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id")
        asked = materialize(asked.join(parts, "part", "left_anti").unionByName(finer))
        large = by_part(asked)
    large = large.drop("shingles")
    band = F.when(F.col("large"), F.floor(F.log("n_shingles") / float(np.log(den / num * WIDER)))).otherwise(0).cast("int")
    asked = materialize(asked.join(large, "part").withColumn("band", band))
    sizes = materialize(blocks(asked, "part", "band").select("part", "band", "blocks"))
    near = sizes
    for step, name in ((-1, "below"), (1, "above")):
        near = near.join(sizes.select("part", (F.col("band") - step).alias("band"), F.col("blocks").alias(name)), ["part", "band"], "left")
    near = materialize(near.fillna(0, ["below", "above"]))
    asked = asked.drop("n_shingles", "large").join(near, ["part", "band"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    name_of = lambda step, block: F.format_string("%d/%d", F.col("band") + step, block)
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meet = F.concat(
        F.transform(numbers("blocks"), lambda o: F.struct(name_of(0, F.least("own", o)).alias("left"), name_of(0, F.greatest("own", o)).alias("right"))),
        F.transform(numbers("above"), lambda o: F.struct(name_of(0, F.col("own")).alias("left"), name_of(1, o).alias("right"))),
        F.transform(numbers("below"), lambda o: F.struct(name_of(-1, o).alias("left"), name_of(0, F.col("own")).alias("right"))),
    )
    asked = materialize(asked.select("part", "doc_id", "copies", name_of(0, F.col("own")).alias("block"), meet.alias("meet")))
    tasks = text.join(asked, "doc_id").select("part", F.explode("meet").alias("task"), "block", "doc_id", "copies", "text").select("part", "task.left", "task.right", "block", "doc_id", "copies", "text")
    links = materialize(tasks.groupBy("part", "left", "right").applyInArrow(lambda key, t: _linked(key, t, n, num, den), "a long, b long, links long"))
    joined = components(links.select("a", "b"))
    counted = links.groupBy("a").agg(F.sum("links").alias("links"))
    known = materialize(counted.join(joined.withColumnRenamed("node", "a"), "a", "left").select(F.col("a").alias("rep"), "links", "component"))
    classes = materialize(classes.select("digest", "rep", "copies").join(known, "rep", "left"))
    out = nodes.join(classes, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull() | F.col("copies").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )
    return out


def near_duplicates_kept(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` whose doc_id is its component's smallest, with all their columns: one document of each group stays."""
    with scratch(docs.sparkSession):
        found = ngram_components(docs.select("doc_id", "text"), n, num, den)
        gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), kept=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
