"""Language ID: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.llm.common import slices

#: Documents of a language to learn from, smallest hashes of doc_id first.
SAMPLE = 160
#: Units of each direction. Texts are read in strips of STRIP bytes; each way begins CONTEXT bytes before its strip, so
#: that the state at a strip's first byte knows what stands before it.
UNITS, STRIP, CONTEXT = 10, 512, 64
#: Bytes of a training strip, steps, strips a step, and the rate of Adam.
TRAINED, STEPS, BATCH, RATE = 256, 260, 96, 0.02
#: Strips run at once, and a multiple of how many, so that products of matrices have few shapes.
TOGETHER, MULTIPLE = 1024, 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Direction:
    """One gated recurrent layer over byte columns; arrays are (units, strips), so that each step is one product."""

    def __init__(self, rng: np.random.Generator):
        self.p = {
            "e": rng.normal(0, 0.3, (3 * UNITS, 256)).astype(np.float32),
            "u": rng.normal(0, 0.3, (2 * UNITS, UNITS)).astype(np.float32),
            "c": rng.normal(0, 0.3, (UNITS, UNITS)).astype(np.float32),
        }

    def states(self, data: np.ndarray, real: np.ndarray, kept: list | None = None) -> Iterator[np.ndarray]:
        """The state after each column of `data` (steps, strips); kept: gets what backpropagation needs.

        Where `real` (steps, strips) is 0 stands padding: the state is 0 after it, so whichever way it is read, a
        strip's states don't depend on how much padding it has."""
        e, u, c = self.p["e"], self.p["u"], self.p["c"]
        h = np.zeros((UNITS, data.shape[1]), np.float32)
        for column, mask in zip(data, real):
            x = e.take(column, axis=1)
            gates = u @ h
            gates += x[: 2 * UNITS]
            _sigmoid(gates)
            z, r = gates[:UNITS], gates[UNITS:]
            rh = r * h
            new = c @ rh
            new += x[2 * UNITS :]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((column, h, z, r, rh, new, mask))
            h = h + z * (new - h)
            h *= mask
            yield h

    def backward(self, kept: list, outer: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, from those of the loss by each state."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(outer[0])
        for t in range(len(kept) - 1, -1, -1):
            column, h, z, r, rh, new, mask = kept[t]
            dh = (dh + outer[t]) * mask
            dnew = dh * z * (1 - new * new)
            drh = self.p["c"].T @ dnew
            dz = dh * (new - h) * z * (1 - z)
            dr = drh * h * r * (1 - r)
            gates = np.concatenate([dz, dr])
            g["c"] += dnew @ rh.T
            g["u"] += gates @ h.T
            np.add.at(g["e"].T, column, np.concatenate([gates, dnew]).T)
            dh = dh * (1 - z) + drh * r + self.p["u"].T @ gates
        return g


class Network:
    """Both directions, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = (Direction(rng), Direction(rng))
        self.out = {"w": rng.normal(0, 0.3, (len(languages), 2 * UNITS)).astype(np.float32), "b": np.zeros((len(languages), 1), np.float32)}

    def train(self, strips: list[list[bytes]], seed: int = 11) -> None:
        """By Adam, on the mean over bytes of the cross entropy; a strip is drawn from those of a language drawn first."""
        rng = np.random.default_rng(seed)
        taught = [k for k, own in enumerate(strips) if own]
        weights = [*self.ways[0].p.values(), *self.ways[1].p.values(), *self.out.values()]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, STEPS + 1):
            want = np.array(taught)[rng.integers(0, len(taught), BATCH)]
            data, mask = padded([strips[k][rng.integers(0, len(strips[k]))] for k in want.tolist()], TRAINED, BATCH)
            kept: tuple[list, list] = ([], [])
            there = np.stack(list(self.ways[0].states(data, mask, kept[0])))
            back = np.stack(list(self.ways[1].states(data[::-1], mask[::-1], kept[1])))[::-1]
            both = np.concatenate([there, back], axis=1)
            logits = np.einsum("lu,tun->tln", self.out["w"], both) + self.out["b"]
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[:, want, np.arange(len(want))] -= 1
            p *= (mask / max(1, mask.sum()))[:, None, :]
            d = np.einsum("lu,tln->tun", self.out["w"], p).astype(np.float32)
            grads = [*self.ways[0].backward(kept[0], d[:, :UNITS]).values(), *self.ways[1].backward(kept[1], d[::-1, UNITS:]).values()]
            grads += [np.einsum("tln,tun->lu", p, both), p.sum((0, 2))[:, None]]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
            for w, g, m, v in zip(weights, grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the mean over its bytes of the probabilities of languages."""
        strips, owner, before, counted = [], [], [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), STRIP):
                low = max(0, at - CONTEXT)
                strips.append(t[low : at + STRIP + CONTEXT])
                owner.append(i)
                before.append(at - low)
                counted.append(min(STRIP, len(t) - at))
        before, counted, owner = (np.array(x, np.int64) for x in (before, counted, owner))
        sums, n = np.zeros((len(texts), len(self.languages))), np.maximum(1, [len(t) for t in texts])
        order = sorted(range(len(strips)), key=lambda k: -len(strips[k]))
        for low in range(0, len(order), TOGETHER):
            some = np.array(order[low : low + TOGETHER])
            data, real = padded([strips[k] for k in some], len(strips[some[0]]), -(-len(some) // MULTIPLE) * MULTIPLE)
            # logits of the backward states are kept, the forward ones meet them
            w, b = self.out["w"], self.out["b"]
            held = np.empty((len(data), len(self.languages), data.shape[1]), np.float32)
            for t, h in zip(range(len(data) - 1, -1, -1), self.ways[1].states(data[::-1], real[::-1])):
                held[t] = w[:, UNITS:] @ h
            total = np.zeros((len(self.languages), data.shape[1]))
            own = np.zeros((len(data) + 1, data.shape[1]), np.int8)
            at = np.arange(len(some))
            own[before[some], at] = 1
            own[before[some] + counted[some], at] -= 1
            for t, (h, mine) in enumerate(zip(self.ways[0].states(data, real), np.cumsum(own[:-1], axis=0, dtype=np.int8))):
                logits = held[t]
                logits += w[:, :UNITS] @ h
                logits += b
                np.exp(logits, out=logits)
                logits *= mine / logits.sum(0)
                total += logits
            np.add.at(sums, owner[some], total[:, : len(some)].T)
        return sums / n[:, None]


def padded(strips: list[bytes], steps: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, 1 where they are real): columns of `steps` bytes, `width` of them."""
    data = np.zeros((width, steps), np.uint8)
    data[: len(strips)] = np.frombuffer(b"".join(s.ljust(steps, b"\0") for s in strips), np.uint8).reshape(-1, steps)
    length = np.zeros(width, np.int64)
    length[: len(strips)] = [len(s) for s in strips]
    return np.ascontiguousarray(data.T).astype(np.intp), (np.arange(steps)[:, None] < length).astype(np.float32)


def learn(rows: list[tuple[str, str]]) -> Network | None:
    """From (language, text): all strips of all texts may be drawn."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    strips: list[list[bytes]] = [[] for _ in languages]
    for lang, text in rows:
        data = text.encode("utf-8", "replace")
        strips[languages.index(lang)] += [data[at : at + TRAINED] for at in range(0, len(data), TRAINED)]
    network = Network(languages)
    if sum(map(bool, strips)) > 1:
        network.train(strips)
    return network


_OUT = "doc_id long, lang_pred string, score double"


def _predicted(batches: Iterable[pa.RecordBatch], network: Network | None) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        texts = [t or "" for t in piece.column(1).to_pylist()]
        said, sure = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if network and any(map(str.isalpha, t))]
        if at:
            p = network.pooled([texts[i].encode("utf-8", "replace") for i in at])
            for i, k, x in zip(at, p.argmax(1), p.max(1)):
                said[i], sure[i] = network.languages[k], float(min(1.0, x))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(said), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify_languages(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, lang).

    Learns, on the driver, from text and lang of documents for which crc32(doc_id as text) mod `folds` is not `held`:
    SAMPLE of each language at most, their whole texts. Predicts from whole texts alone: every byte gets
    probabilities of languages, of which a document's mean decides; score is that of the language said. What a byte
    gets depends on its strip and CONTEXT bytes on either side, not on the texts beside it. No row moves to be
    predicted.

    `und`, with score 0, for a null text, one without a letter, or if nothing was learned. Rows without doc_id aren't
    held out and not learned from; equal texts get equal answers. Other columns are ignored; an empty table gives none."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = text.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold != held) & F.col("text").isNotNull())
    ids = known.select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE).drop("nth")
    picked = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text").collect()
    network = learn([(r.lang, r.text) for r in sorted(picked)])
    out = text.select("doc_id", "text").mapInArrow(lambda it: _predicted(it, network), _OUT)
    return out.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
