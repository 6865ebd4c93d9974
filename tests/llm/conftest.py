from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, payload string, block int, shard int, rank int, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with columns whose names operators use themselves, from (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", 1, 2, 3, 0.5) for i, t, lang, src in full], SCHEMA).repartition(3)

    return make


WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing loud songs in green old trees near cold water".split()


def words(n, seed):
    import random

    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, other scripts."""
    return [
        (None, "no name here at all", None, None),
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, "one", "en", "b"),
        (4, "one", "en", "b"),
        (5, "one", None, None),
        (6, " ".join(words(30_000, 1)), "en", "b"),
        (7, " ".join(words(60, 2)), "de", "c"),
        (8, " ".join(words(60, 2)), "de", "c"),
        (9, "中文 текст ñandú 😀 <|endoftext|> x²\x1c\xa0é" * 5, "zz", "d"),
        (2**40, "far away " * 12, "en", None),
    ]
