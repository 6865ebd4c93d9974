"""Best-fit packing by minimum bin slack (Gupta and Ho, 1999), on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import materialize, shared_dir, slices

#: Parts of words whose ids a worker keeps, in each of two generations.
PARTS_KEPT = 150_000
#: Parts encoded at once, and what stands between them.
TOGETHER, MARK = 64, "\x01"
#: Pieces of one length that are numbered together.
RANKED = 100_000
#: Ends of words that are tokens apart after a letter or digit that lower case leaves one character.
ENDS = ".,!?;:"
ENDED = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,!?;:]+$"


class WordIds:
    """Ids of texts by a tokenizer that drops white space and splits at it.

    ASCII white space separates pre-tokens whatever stands around it, so a text's ids are its words' ids. The words of
    a slice are made distinct first; then each is looked up in lower case without its closing marks, and encoded if it
    is new. Parts last seen a generation ago go."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def parts(self, asked: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each of the different strings `asked`."""
        if len(self.young) > PARTS_KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(x) or old.get(x) for x in asked]
        new = [x for x, ids in zip(asked, out) if ids is None and x]
        found = dict(zip(new, self.encoded(new)))
        out = [found.get(x, b"") if ids is None else ids for x, ids in zip(asked, out)]
        young.update((x, ids) for x, ids in zip(asked, out) if ids)
        return out

    def encoded(self, new: list[str]) -> list[bytes]:
        """As many parts at once as TOGETHER, between marks that are one token each; a part with a mark in it alone."""
        plain = [x for x in new if MARK not in x]
        texts = [f" {MARK} ".join(plain[k : k + TOGETHER]) + f" {MARK}" for k in range(0, len(plain), TOGETHER)]
        ids = np.fromiter((i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids), "<u4")
        ends = np.flatnonzero(ids == self.mark)
        data = ids.tobytes()
        starts = np.r_[0, ends + 1]
        found = dict(zip(plain, (data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist()))))
        return [found[x] if x in found else array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in new]

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end`; where each text's ids stop)."""
        split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        whole = pa.compute.ascii_lower(words.dictionary)
        ended = pa.compute.match_substring_regex(whole, ENDED)
        core = pa.compute.if_else(ended, pa.compute.ascii_rtrim(whole, ENDS), whole)
        tail = pa.compute.if_else(ended, pa.compute.replace_substring_regex(whole, f"(?s)^.*[^{ENDS}]", ""), "")
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids = self.parts(both.dictionary.to_pylist())
        ids.append(np.array([end], "<u4").tobytes())
        held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        core_at, tail_at = both.indices.to_numpy().reshape(2, -1)
        of_words = words.indices.to_numpy()
        counts = np.diff(split.offsets.to_numpy())
        ends = 2 * np.cumsum(counts) + np.arange(1, len(counts) + 1)
        order = np.full(2 * len(of_words) + len(counts), len(ids) - 1, np.int32)
        there = np.ones(len(order), bool)
        there[ends - 1] = False
        order[there] = np.stack([core_at[of_words], tail_at[of_words]], axis=1).ravel()
        taken = held.take(pa.array(order))
        return taken.flatten().to_numpy(), (taken.offsets.to_numpy()[1:] - taken.offsets[0].as_py())[ends - 1]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterable[pa.RecordBatch], path: str, most: int, last: int) -> Iterator[pa.RecordBatch]:
    ids_of = WordIds(path)
    for part in slices(batches, most=2 << 20):
        rows, begin = [], 0
        ids, ends = ids_of(part.column(1), last)
        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        for doc, stop in zip(part.column(0).to_pylist(), ends.tolist()):
            for k, at in enumerate(range(begin, stop, most)):
                n = min(most, stop - at)
                rows.append((doc, k, at - begin, n, zlib.crc32(view[4 * at : 4 * (at + n)])))
            begin = stop
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def fullest(room: int, held: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of lengths, at most as many of each as `held` (length, number) has, whose sum is nearest below room.

    Bit i of a Python integer is set when some multiset sums to i. Powers of two of a length's number are added one
    by one, larger lengths first; the sets before each addition lead back to the multiset."""
    if room <= 0:
        return {}
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, number in held:
        if length > room:
            continue
        number, chunk = min(number, room // length), 1
        while number:
            take = min(chunk, number)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            number -= take
            chunk *= 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def minimum_slack(lengths: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number}) of bins: each takes the largest length left and the fullest multiset beside it, and
    is repeated while its lengths last. Repeating uses up a length nearly each time, so there are few thousand."""
    left, out = {k: v for k, v in lengths.items() if v}, []
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        left[top] -= 1
        bin_ = fullest(size - top, [(k, left[k]) for k in order if left[k]])
        left[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        out.append((times, bin_))
        for k, n in bin_.items():
            left[k] -= times * n
        order = [k for k in order if left[k]]
    return out


def _places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, number in a sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches: Iterable[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = np.searchsorted(places[:, 0], np.arange(places[-1, 0] + 2)) if len(places) else None
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        at = np.empty(len(length), np.int64)
        for k in np.unique(length):
            here, low, high = length == k, starts[k], starts[k + 1]
            at[here] = low + np.searchsorted(places[low:high, 1], rank[here], "right") - 1
        row = places[at]
        step, slot = np.divmod(rank - row[:, 1], row[:, 3])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(row[:, 2] + step), pa.array(row[:, 4] + slot * length)],
            names=[*batch.schema.names[:5], "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of `docs` (doc_id, text).

    A document's ids are the tokenizer's, without special tokens, then `end`; longer ones are cut into pieces of
    `size`, of which the last may be shorter. Pieces lie in sequences of at most `size` ids, without gaps from
    offset 0. Only the numbers of pieces by length, at most `size` of them, come to the driver; the bins made there
    say for each rank of a length its sequence and offset, at most some ten rows a bin kind. Ranks are counted by
    (length, salt), a salt for RANKED pieces of a length, so that a length of very many pieces is numbered by many
    tasks and the table of first ranks has at most `size` rows and one for each RANKED pieces.

    A null or empty text is the piece (end). Null and repeated doc_id are kept as they are; equal rows get any of
    their places. An empty table gives none; other columns are ignored. `tokenizer` must be at that path, or under
    that name in the installed public vocabularies, on every executor."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(text.mapInArrow(lambda it: _pieces(it, tokenizer, size, end), _PIECES))
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(minimum_slack(lengths, size))
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in lengths.items()], "length long, salts int")
    salted = pieces.join(F.broadcast(salts), "length")  # a row a length, `size` at most
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first")))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(lambda it: _place(it, places), f"{_PIECES}, sequence_id long, offset long")
