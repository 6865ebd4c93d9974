"""Token counts: pre-tokens that are proven whole tokens count one each, and only the others are merged."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import slices

#: Units whose counts a worker keeps.
UNITS_KEPT = 500_000
#: A word with the one space before it, white space before white space or the end, or one white-space character: the
#: byte-level pattern never joins characters of two units.
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Characters whose class no Unicode version has changed, and no other white space than tab, line ends and the space.
#: Texts with others, or with an added token, are encoded whole by the library.
ODD = re.compile("[^\t\n\r -~¡-¬®-ſ‐-‧€]")
#: Marks that are a pre-token of their own after a letter or digit.
MARKS = ".,!?;:|"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that are one unit without odd characters and encode, alone, as one token.

    A unit's encoding doesn't depend on its neighbours, so such a unit is one token wherever it stands."""
    tokenizer = _tokenizer(path)
    strings = [s for s in tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False) if s and not ODD.search(s)]
    strings = [s for s in strings if UNIT.findall(s) == [s]]
    return frozenset(s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Numbers of tokens of texts, equal to the library's."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = _tokenizer(path), whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, units: set[str]) -> None:
        known, whole, parts, merged = self.known, self.whole, {}, set()
        for u in units:
            if u in whole:
                known[u] = 1
                continue
            core = u.rstrip(MARKS)
            tail = u[len(core) :] if core and core[-1].isalnum() else ""
            core = u if not tail else core
            parts[u] = (core, tail)
            merged.update(x for x in (core, tail) if x and x not in whole and x not in known)
        some = list(merged)
        found = dict(zip(some, self.library(some)))
        count = lambda x: 1 if x in whole else known[x] if x in known else found[x]
        for u, (core, tail) in parts.items():
            known[u] = count(core) + (count(tail) if tail else 0)
        known.update(found)

    def __call__(self, texts: list[str]) -> list[int]:
        out, split = [0] * len(texts), {}
        odd = [i for i, t in enumerate(texts) if ODD.search(t) or any(a in t for a in self.added)]
        for i, n in zip(odd, self.library([texts[i] for i in odd])):
            out[i] = n
        for i in set(range(len(texts))).difference(odd):
            split[i] = UNIT.findall(texts[i])
        every = set().union(*split.values())
        new = {u for u in every if u not in self.known}
        if len(self.known) + len(new) > UNITS_KEPT:
            self.known.clear()
            new = every
        self.learn(new)
        get = self.known.__getitem__
        for i, units in split.items():
            out[i] = sum(map(get, units))
        return out


_OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counted(batches: Iterable[pa.RecordBatch], path: str, whole: frozenset[str], limit: int) -> Iterator[pa.RecordBatch]:
    count = Counter(path, whole)
    for piece in slices(batches):
        texts = [t or "" for t in piece.column(1).to_pylist()]
        n = count(texts)
        size = pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(piece.column(1)), pa.int64()), 0)
        yield pa.RecordBatch.from_arrays([piece.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text); over_limit: more than `limit`.

    Counts are the library's for the byte-level file `tokenizer`, without begin and end tokens, truncation or padding;
    strings of added tokens in a text count as the library counts them. No row moves: each is counted where it is
    read. What comes from the driver are the whole tokens, at most the vocabulary.

    A null or empty text has no token. Null and repeated doc_id are kept. Other columns are ignored; an empty table
    gives none. The file must be at that path on every executor."""
    whole = whole_tokens(tokenizer)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(lambda it: _counted(it, tokenizer, whole, limit), _OUT)
