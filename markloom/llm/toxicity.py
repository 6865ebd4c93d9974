"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import slices

#: Labelled documents of each class that the model learns from, smallest hashes of doc_id first.
SAMPLE = 4000
#: Of FOLDS parts of the sample, the last calibrates; each part's lexicon densities come from the others' words.
FOLDS = 4
#: Toxic documents with an entry, and its log odds, at least; lengths of word beginnings that are entries too.
LEAST_DOCS, LEAST_ODDS, BEGINNINGS = 3, 1.6, (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 8
WORDS_KEPT = 400_000

#: Words of the second person.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch tu te toi ton ta tes vous votre vos ti usted ustedes vosotros tus".split())
#: Characters written for letters.
WRITTEN_FOR = str.maketrans("013457@$", "oieastas")

WORD = re.compile(r"\w[\w@$]*")
HIDDEN = re.compile(r"[^\W\d_](?:[\d@$*#]+|[.\-_*](?=[^\W\d_][.\-_*]))[^\W\d_]")
NAMES = ("word_density", "word_count", "word_most", "beginning_density", "beginning_count", "beginning_most", "near_second_person", "second_person", "capitals", "shouts", "symbols", "hidden", "words")


def plain(word: str) -> str:
    return word if word.isalpha() else word.translate(WRITTEN_FOR)


class Lexicon:
    """Log odds of words, and of their beginnings, to stand in toxic documents."""

    def __init__(self, entries: dict[str, float], beginnings: dict[str, float]):
        self.entries, self.beginnings, self.known = entries, beginnings, {}

    @classmethod
    def of(cls, texts: Iterable[str], toxic: Iterable[int]) -> Lexicon:
        seen, docs = (Counter(), Counter()), [0, 0]
        parts = (Counter(), Counter())
        for text, label in zip(texts, toxic):
            words = {plain(w) for w in WORD.findall(text.lower())}
            seen[label].update(words)
            parts[label].update({w[:n] for w in words for n in BEGINNINGS if len(w) > n})
            docs[label] += 1

        def odds(found: tuple[Counter, Counter]) -> dict[str, float]:
            out = {}
            for w, n in found[1].items():
                if n >= LEAST_DOCS:
                    x = math.log((n + 0.5) / (docs[1] + 1)) - math.log((found[0][w] + 0.5) / (docs[0] + 1))
                    if x >= LEAST_ODDS:
                        out[w] = x
            return out

        return cls(odds(seen), odds(parts))

    def __call__(self, words: list[str]) -> tuple[list[float], list[float]]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                p = plain(w)
                known[w] = (self.entries.get(p, 0.0), max((self.beginnings.get(p[:n], 0.0) for n in BEGINNINGS if len(p) > n), default=0.0))
        found = [known[w] for w in words]
        return [x for x, _ in found], [x for _, x in found]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The values of NAMES; all 0 for an empty text."""
    lower = text.lower()
    words = WORD.findall(lower)
    n, size = max(1, len(words)), max(1, len(text))
    whole, begun = lexicon(words)
    hits = [i for i, (x, y) in enumerate(zip(whole, begun)) if x or y]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = sum((k := bisect_left(second, i - 5)) < len(second) and second[k] <= i + 5 for i in hits)
    counted, started = sum(x > 0 for x in whole), sum(x > 0 for x in begun)
    letters = sum(map(str.isupper, text)) if lower != text else 0
    plain_marks = text.count(".") + text.count(",") + text.count(" ") + text.count("\n")
    return [
        counted / n, math.log1p(counted), max(whole, default=0.0), started / n, math.log1p(started), max(begun, default=0.0), near / max(1, len(hits)), len(second) / n,
        letters / size, (text.count("!") + text.count("?")) / size, max(0, size - plain_marks - sum(map(len, words))) / size, len(HIDDEN.findall(lower)) / n, math.log1p(len(words)),
    ]


class Trees:
    """Gradient boosting for the logistic loss: trees of fixed depth over features cut into quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self.bins(x)
        rate = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        self.base, self.trees = math.log(rate / (1 - rate)), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += self.value(tree, binned)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)])

    def grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin) of the inner nodes in heap order, -1 for no split, and the leaves' values."""
        inner = 2**DEPTH - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, int)
        node = np.zeros(len(grad), int)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-6
            for f in range(len(binned)):
                b = binned[f, at]
                g, h, n = (np.cumsum(np.bincount(b, w, BINS)) for w in (grad[at], hess[at], np.ones(len(at))))
                ok = (n >= LEAST_LEAF) & (n[-1] - n >= LEAST_LEAF)
                gain = np.where(ok, g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1), 0)
                if gain.max(initial=0) > best:
                    best, feature[k], cut[k] = gain.max(), f, int(gain.argmax())
            right = binned[feature[k], at] > cut[k] if feature[k] >= 0 else np.zeros(len(at), bool)
            node[at] = 2 * k + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, w, inner + 1) for w in (grad, hess))
        return feature, cut, RATE * g / (h + 1)

    @staticmethod
    def value(tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(binned.shape[1], int)
        for _ in range(DEPTH):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (binned[np.maximum(f, 0), np.arange(len(node))] > cut[node]))
        return leaf[node - len(feature)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        return self.base + sum(self.value(t, binned) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone step fit by pooling adjacent violators; between them it is taken as linear."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i], x[i], y[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, _, s, w = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], blocks[-1][2] + s, blocks[-1][3] + w]
    at, level = [], []
    for low, high, s, w in blocks:
        at += [low, high]
        level += [s / w, s / w]
    return np.array(at), np.array(level)


class Model:
    """Learned from texts with labels; share: what part of all labelled documents is toxic."""

    def __init__(self, ids: list[int], texts: list[str], labels: list[int], share: float):
        fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids])
        y = np.array(labels, float)
        both = lambda m: 0 < y[m].sum() < m.sum()
        self.lexicon, self.trees = Lexicon.of(texts, labels), None
        self.points = (np.zeros(1), np.array([share]))
        if not len(y) or not both(np.ones(len(y), bool)):
            return
        x = np.empty((len(y), len(NAMES)))
        for k in range(FOLDS):
            rest = [i for i in range(len(y)) if fold[i] != k]
            other = Lexicon.of([texts[i] for i in rest], [labels[i] for i in rest])
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], other)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        learn, fit = fold != FOLDS - 1, fold == FOLDS - 1
        if not both(learn) or not both(fit):
            learn = fit = np.ones(len(y), bool)
        self.trees = Trees(x[learn], y[learn], weight[learn])
        raw = self.trees(x[fit])
        at, level = isotonic(raw, y[fit], weight[fit])
        # ranks stay apart where the fit is flat
        self.points = at, np.clip(level, 0, 1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.points[1][0])
        raw = self.trees(np.array([features(t, self.lexicon) for t in texts]))
        flat = np.interp(raw, *self.points)
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


_OUT = "doc_id long, score double"


def _scored(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model([t or "" for t in piece.column(1).to_pylist()]))], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text).

    Learns from labels (doc_id, toxic) of documents for which crc32(doc_id as text) mod `folds` is not `held`, on the
    driver: from SAMPLE documents of each class at most, weighted to the classes' shares. score: the calibrated
    probability; predicted: 1 if it is `limit` or more. Texts alone are features; no row moves to be scored.

    A null or empty text has features 0. Rows without doc_id aren't held out; rows that repeat a doc_id score by their
    texts. With labels of one class or none, all scores are the toxic share. Other columns are ignored; an empty table
    gives none."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(fold != held).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])
    rows = sorted({(r.doc_id, r.text or "", r.toxic) for r in text.join(F.broadcast(chosen), "doc_id").collect()})
    model = Model([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], float(share))
    out = text.mapInArrow(lambda it: _scored(it, model), _OUT)
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
