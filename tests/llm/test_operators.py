"""Each operator against a plain version of itself, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from markloom.llm import bm25, fingerprints, language_id, mixing, ngram_join, packing, quality_lm, substring_dedup, token_counts, toxicity
from markloom.llm.common import materialize, scratch
from markloom.llm.graph import components
from tests.llm.conftest import words


def near_copies(n=14, seed=5):
    """Texts, their copies with a few words changed, and unrelated ones."""
    r, out = random.Random(seed), []
    for k in range(n):
        base = words(r.randrange(5, 90), 100 + k)
        out.append(base)
        for _ in range(r.randrange(0, 4)):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = f"new{r.randrange(99)}"
            out.append(copy)
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def joined(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: (len(s), links[i], root(i)) for i, s in sets}


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join_equals_brute_force(docs_of, n, num, den):
    rows = near_copies()
    found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_components(docs_of(rows), n, num, den).collect()}
    assert found == joined(rows, n, num, den)


def test_ngram_join_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    rows = near_copies(6, 8)
    found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_components(docs_of(rows), 3, 9, 10).collect()}
    assert found == joined(rows, 3, 9, 10)


def test_ngram_join_in_bands(docs_of, monkeypatch):
    """Chains of texts that grow by a word or lose one reach over many bands of sizes."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2)
    base = words(120, 77)
    rows = [(i, " ".join(base[: 4 + 3 * i])) for i in range(38)] + [(100 + i, " ".join(base[i : i + 8 + 2 * i])) for i in range(30)]
    for n, num, den in ((3, 9, 10), (5, 4, 5)):
        found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_components(docs_of(rows), n, num, den).collect()}
        assert found == joined(rows, n, num, den)


def test_large_groups_are_closed_anew(spark):
    """Texts that one frequent passage chains part; each keeps the copy that it links with, in its own group only."""
    rows = []
    for k in range(60):
        text = "the same five words again " + " ".join(words(30, k))
        rows += [(k, text), (100 + k, text + " end")]
    table = spark.createDataFrame([*rows, (7, None)], "doc_id long, text string")
    large = spark.createDataFrame([(i, int(i == 103)) for i, _ in rows], "doc_id long, part long")
    found = {r.node: r.component for r in ngram_join._refined(table, large, 3000, 5, 4, 5, 4).collect()}
    assert found == {i: i % 100 for i, _ in rows if i % 100 != 3}


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark):
        gone = materialize(spark.range(3))
        with scratch(spark):
            inner = materialize(spark.range(4), kept=True)
        kept = materialize(inner, kept=True)
    assert kept.count() == 4
    left = [os.path.exists(f.inputFiles()[0].removeprefix("file://")) for f in (gone, inner, kept)]
    assert left == [False, False, True]


def test_partenum_signatures_meet():
    r, enum = random.Random(3), ngram_join.PartEnum(4, 5)
    for _ in range(300):
        size = r.randrange(1, 400)
        common = np.array([r.getrandbits(63) for _ in range(size)], np.uint64)
        extra = int(size / 0.8 - size)
        cut = r.randrange(0, extra + 1)
        other = [np.array([r.getrandbits(63) for _ in range(k)], np.uint64) for k in (cut, extra - cut)]
        a, b = (np.unique(np.concatenate([common, o])) for o in other)
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) and not np.array_equal(a, b):
            assert len(np.intersect1d(enum.sign(a), enum.sign(b)))


def test_partenum_differences_in_the_fullest_cells():
    rng = np.random.default_rng(5)
    for num, den, size in ((4, 5, 9), (4, 5, 40), (4, 5, 80), (4, 5, 700), (9, 10, 300)):
        enum = ngram_join.PartEnum(num, den)
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        own = enum.band(size)
        k, n1, n2, _, _, seeds = enum.plan(own)
        with np.errstate(over="ignore"):
            h = ngram_join.mix(base + seeds[0])
        cell = ((h >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)).astype(int)
        held = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        # One feature out of each of the fullest cells, as many as a linked set may lack.
        lacking = size - -(-num * size // den)
        cells = [p * n2 + c for p in np.argsort(-held.max(1)) for c in np.argsort(-held[p])[:3] if held[p, c]][:lacking]
        other = np.delete(base, [int(np.flatnonzero(cell == c)[0]) for c in cells])
        assert len(np.intersect1d(enum.sign(base), enum.sign(other))), (num, den, size)


def test_ngram_join_odd(docs_of, odd_rows):
    rows = ngram_join.ngram_components(docs_of(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    at = {r.doc_id: r for r in rows}
    assert at[None].component_id is None and at[1].n_shingles == 0 and at[3].component_id == 3
    assert at[5].component_id == 4 and at[8].component_id == 7 and at[8].n_links == 1
    kept = [r.doc_id for r in ngram_join.near_duplicates_kept(docs_of(odd_rows)).collect()]
    assert 8 not in kept and 7 in kept and kept.count(4) == 2


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 40) if i != 20] + [(7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    from markloom.llm import graph

    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or keep(df))
    found = components(spark.createDataFrame([(i + 1, i) for i in range(1000)], "a long, b long")).collect()
    assert {r.component for r in found} == {0} and len(found) == 1001 and len(written) <= 16
    order = [(k * 619) % 1000 for k in range(1000)]
    found = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert {r.component for r in found} == {0} and len(found) == 1000


def brute_spans(rows, least):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover, new = bytearray(len(b)), set()
        for j in range(len(b) - least + 1):
            s = b[j : j + least]
            if s in seen:
                cover[j : j + least] = b"\1" * least
            new.add(s)
        for s in new:
            seen.setdefault(s, i)
        out[i] = (len(b), bytes(x for x, c in zip(b, cover) if not c), sum(bool(cover[j]) and (not j or not cover[j - 1]) for j in range(len(b))))
    return out


def test_spans_equal_brute_force(docs_of):
    r = random.Random(9)
    shared = [" ".join(words(30, 200 + k)) for k in range(3)]
    rows = []
    for i in range(30):
        text = " ".join(words(r.randrange(0, 40), 300 + i))
        for s in shared:
            if r.random() < 0.4:
                a, b = sorted((r.randrange(len(s)), r.randrange(len(s))))
                text = text[: len(text) // 2] + s[a:b] + "ñ" * r.randrange(3) + text[len(text) // 2 :]
        rows.append((i, text))
    rows += [(40, "ab" * 60), (41, "ab" * 30), (42, "abab" * 24 + "x"), (43, rows[3][1]), (44, "short"), (45, "short")]
    found = {x.doc_id: (x.n_bytes, bytes(x.kept), len(x.spans)) for x in substring_dedup.repeated_spans(docs_of(rows)).collect()}
    assert found == brute_spans(rows, 50)


def test_repeated_prefixes_equal_sorting():
    r = random.Random(4)
    for n in (1, 2, 60, 700):
        data = bytes(r.choice(b"ab") for _ in range(n)) + b"\xfe"
        order, common = substring_dedup.repeated_prefixes(np.frombuffer(data, np.uint8), 6)
        groups = {}
        for k, at in enumerate(order.tolist()):
            if at + 6 <= len(data):
                groups.setdefault(data[at : at + 6], []).append(k)
        for places in groups.values():
            assert places == list(range(places[0], places[-1] + 1))
            assert all(common[places[1:]])


def test_spans_odd(docs_of, odd_rows):
    found = substring_dedup.repeated_spans(docs_of(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    at = {x.doc_id: x for x in found}
    assert at[8].kept == b"" and at[7].spans == [] and at[1].n_bytes == 0 and at[5].kept == b"one"
    clean = {x.doc_id: x for x in substring_dedup.without_repeats(docs_of(odd_rows)).collect()}
    assert clean[8].text == "" and clean[8].n_chars == 0 and clean[1].text is None


def test_cut_characters_go(docs_of):
    base = "x" * 49 + "é" + "y" * 10
    rows = [(0, base), (1, base[:49] + "è" + "tail of another kind")]
    clean = {x.doc_id: x.text for x in substring_dedup.without_repeats(docs_of(rows)).collect()}
    assert clean[1] == "tail of another kind"


def test_fingerprints(docs_of):
    rows = near_copies(6, 2) + [(100, None), (101, ""), (102, "é" * 301), (103, " ".join(words(4000, 6)))]
    found = {x.doc_id: x for x in fingerprints.compare_fingerprints(docs_of(rows)).collect()}
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [fingerprints.fingerprints([x.encode()])[0] for x in (t, edited, nxt)]
        assert found[i].fingerprint == fingerprints.written(prints[0]) and found[i].edited_fingerprint == fingerprints.written(prints[1])
        assert found[i].near_edited == fingerprints.likeness(prints[0], prints[1]) and found[i].near_next == fingerprints.likeness(prints[0], prints[2])
    assert 0.3 < found[103].near_edited < 0.7


def test_fingerprints_resist_shifts():
    text = " ".join(words(3000, 7)).encode()
    a, b = fingerprints.fingerprints([text, b"moved by this " + text])
    assert fingerprints.likeness(a, b) > 0.9
    assert fingerprints.gear(np.frombuffer(text, np.uint8))[500] == fingerprints.gear(np.frombuffer(text[400:], np.uint8))[100]


def test_fingerprints_odd(docs_of, odd_rows):
    assert len(fingerprints.compare_fingerprints(docs_of(odd_rows)).collect()) == len(odd_rows)


def test_token_counts(docs_of, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "The", ".", ",", "'s", "'ll", "1", "12", "é", "!?", "\n\n", " \n", "<|endoftext|>", "中", "\xa0", "x²", "--", "\r\n", "can't", "\x1c", "😀", "\x0b"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(3000)]
    count = token_counts.Counter(path, token_counts.whole_tokens(path))
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    found = token_counts.count_tokens(docs_of(odd_rows), path, 100).collect()
    assert sorted((x.doc_id or -1, x.n_bytes, x.n_tokens, x.over_limit) for x in found) == sorted(
        (i or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, *_ in odd_rows
    )


def test_packing(docs_of, odd_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*odd_rows, *[(100 + i, " ".join(words(random.Random(i).randrange(1, 60), i))) for i in range(80)]]
    found = packing.pack(docs_of(rows), path, size=64).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            cut = ids[k : k + 64]
            expected[i, k // 64, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in found) == expected
    bins = {}
    for x in found:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= math.ceil(sum(x.length for x in found) / 64) * 1.05 + 1


def test_fullest_is_fullest():
    r = random.Random(1)
    for _ in range(200):
        held = sorted({r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}.items(), reverse=True)
        room = r.randrange(0, 60)
        sums = {0}
        for length, n in held:
            sums |= {s + length * k for s in sums for k in range(1, n + 1)}
        chosen = packing.fullest(room, held)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= dict(held)[k] for k, n in chosen.items())


def mixed_by_hand(rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        capped |= over


def test_mixing(docs_of):
    r = random.Random(2)
    rows = [(i, " ".join(words(r.randrange(0, 50), i)), None, r.choice(["b", "a", "a", "a", "a", "c", "d", None])) for i in range(300)] + [(900, "w " * 9, None, "tiny"), (901, None, None, "zero")]
    found = mixing.mix(docs_of(rows)).collect()
    sizes, target = mixed_by_hand(rows)
    taken, most = Counter(), Counter()
    for x in found:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source]) and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
        most[x.source] = max(most[x.source], x.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    again = mixing.mix(docs_of(rows)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in found)


def test_mixing_odd(docs_of, odd_rows, spark):
    assert len(mixing.mix(docs_of(odd_rows)).collect()) == len(odd_rows)
    assert all(x.taken == 0 for x in mixing.mix(docs_of([(1, "", None, "a"), (2, None, None, None)])).collect())


def test_mixed_rows_keep_their_copies(docs_of, spark):
    r = random.Random(3)
    rows = [(i, " ".join(words(r.randrange(1, 40), i)), None, r.choice("abbbb")) for i in range(60)]
    rows += [(None, f"no name {i} " + "w " * i, None, "a") for i in range(5)] + [(None, "no name twice", None, "b")] * 2
    rows += [(7000, "said again and again", None, s) for s in "ab" for _ in range(20)] + [(7001, f"one name, text {i}", None, "a") for i in range(3)]
    docs, labels = docs_of(rows), spark.createDataFrame([(1, 1), (7000, 0), (None, 1)], "doc_id long, quality int")
    weighted = mixing.label_quality(docs, labels)
    expected = Counter()
    for x in mixing.mix(weighted, quality=weighted["mix_quality"]).collect():
        expected[x.doc_id, x.source, x.size] += x.copies
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((x.doc_id, x.source, len(x.text.split())) for x in got) == +expected
    assert any(x.doc_id is None for x in got) and {(x.doc_id, x.text) for x in got} <= {x[:2] for x in rows}
    by_row = Counter((x.doc_id, x.source, x.text) for x in got)
    assert 20 <= by_row[7000, "a", "said again and again"] <= 60 and all(by_row[7001, "a", f"one name, text {i}"] in (1, 2, 3) for i in range(3))


def test_mixing_equals_sql(same):
    from markloom.llm import queries

    same(queries.QUERIES["op4_mix_sources"], queries.ORACLE_SQL["op4_mix_sources"])


def test_kneser_ney_sums_to_one():
    text = ("the cat sat on the mat and the dog sat on the log " * 5).encode()
    keys, counts = np.unique(quality_lm.grams([text]), return_counts=True)
    orders, k, c = [], keys, counts
    for m in range(quality_lm.ORDER, 1, -1):
        orders.append((k, c))
        k, c = quality_lm.lower(k)
    context = int(keys[len(keys) // 2]) >> 8 << 8
    asked = np.array([context + b for b in range(256)], np.uint64)
    p = quality_lm.order_two(dict(zip(orders[-1][0].tolist(), orders[-1][1].tolist())))[(asked >> np.uint64(32) << np.uint64(8) | asked & np.uint64(255)).astype(int)]
    assert p.sum() == pytest.approx(1)
    for m, (k, c) in zip(range(3, quality_lm.ORDER + 1), reversed(orders[:-1])):
        cut = asked >> np.uint64(8 * (quality_lm.ORDER - m + 1)) << np.uint64(8) | asked & np.uint64(255)
        p = quality_lm.interpolate(cut, p, k, c, quality_lm.discounts([int((c == i).sum()) for i in range(1, 5)]))
        assert p.sum() == pytest.approx(1)


def plain_kneser_ney(trained):
    """log p(byte | four bytes before it) of an interpolated modified Kneser-Ney model, by dictionaries of byte strings."""
    tables = {5: Counter(x[i : i + 5] for t in trained for x in [b"\0" * 4 + t] for i in range(len(t)))}
    for m in (4, 3, 2, 1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])
    off, total, left = {}, {}, {}
    for m, table in tables.items():
        n = [max(1, sum(c == i for c in table.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        off[m] = [0, *(min(i, max(0.1 * i, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3))]
        total[m], left[m] = Counter(), Counter()
        for g, c in table.items():
            total[m][g[:-1]] += c
            left[m][g[:-1]] += off[m][min(c, 3)]

    def p(gram, m):
        if not m:
            return 1 / 256
        g = gram[-m:]
        below = p(gram, m - 1)
        if not total[m][g[:-1]]:
            return below
        c = tables[m][g]
        return ((c - off[m][min(c, 3)] if c else 0) + left[m][g[:-1]] * below) / total[m][g[:-1]]

    return lambda text: [math.log(p((b"\0" * 4 + text)[i : i + 5], 5)) for i in range(len(text))]


def test_ngrams_of_parts_are_those_of_whole_texts(monkeypatch):
    texts = [b"", b"abc", b"long text " * 40, b"x", b"tail"]
    known = [True, False, True, True, False]
    whole = quality_lm._types(texts, known)
    assert whole[0].tolist() == np.unique(quality_lm.grams(texts)).tolist()
    monkeypatch.setattr(quality_lm, "HELD_BYTES", 7)
    for a, b in zip(whole, quality_lm._types(texts, known)):
        assert a.tolist() == b.tolist()
    keys, owner = (np.concatenate(x) for x in zip(*quality_lm.parts_of(texts)))
    assert keys.tolist() == quality_lm.grams(texts).tolist() and np.bincount(owner, minlength=5).tolist() == [len(t) for t in texts]


def test_perplexity_equals_a_plain_model(docs_of, spark):
    r = random.Random(12)
    rows = [(i, " ".join(words(r.randrange(0, 40), i)) + "ñß"[: i % 3], "en") for i in range(60)] + [(None, "no name", None), (100, None, "en"), (100, "twice", "en"), (101, "x" * 9000, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(101, 1)], "doc_id long, quality int")
    found = quality_lm.perplexities(docs_of(rows), labels).collect()
    trained = [(t or "").encode() for i, t, _ in rows if i is not None and (i == 101 or i < 40 and i % 3 > 0) and zlib.crc32(str(i).encode()) % 5]
    logs = plain_kneser_ney(trained)
    expected = sorted((i or -1, len((t or "").encode()), -sum(logs((t or "").encode()))) for i, t, _ in rows)
    got = sorted((x.doc_id or -1, x.n_bytes, x.nll) for x in found)
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    for (_, n, a), (_, _, b) in zip(got, expected):
        assert abs(a - b) <= n * 0.51 / quality_lm.FINE
    again = quality_lm.perplexities(docs_of(rows).repartition(7), labels).collect()
    assert sorted((x.doc_id or -1, x.n_bytes, x.nll) for x in again) == got


def test_quality(docs_of, spark):
    r = random.Random(1)
    good = [(i, " ".join(words(r.randrange(20, 60), i)), "en" if i % 2 else None) for i in range(300)]
    bad = [(1000 + i, "".join(chr(r.randrange(33, 126)) for _ in range(200)), "en") for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 260)] + [(None, 1)], "doc_id long, quality int")
    found = {x.doc_id: x for x in quality_lm.judge_quality(docs_of(good + bad + [(5000, None, None), (5001, "", "en")]), labels).collect()}
    assert len(found) == 312
    assert not any(found[1000 + i].keep for i in range(10)) and found[5000].keep
    assert sum(found[i].keep for i in range(260, 300)) >= 38


def test_quality_thresholds_are_of_the_language(docs_of, spark):
    r = random.Random(4)
    rows = [(i, " ".join(words(r.randrange(20, 60), i)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(r.choice(("uno", "dos", "tres")) for _ in range(60)), "es") for i in range(60)] + [(2000, "ein zwei drei", "de")]
    labels = spark.createDataFrame([(x[0], 1) for x in rows[:-1]], "doc_id long, quality int")
    found = quality_lm.judge_quality(docs_of(rows), labels).collect()
    limit = {}
    for lang in ("en", "es"):
        held = [x.perplexity for x in found if x.lang == lang and quality_lm.held_out(x.doc_id)]
        assert 0 < len(held) < 100  # so the quantile is the largest
        limit[lang] = {x.threshold for x in found if x.lang == lang}.pop()
        assert limit[lang] == pytest.approx(1.03 * max(held), rel=0.002)
    assert limit["es"] < limit["en"] and {x.threshold for x in found if x.lang == "de"} <= {limit["en"]}


def test_quality_odd(docs_of, odd_rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_lm.judge_quality(docs_of(odd_rows), none).collect()
    assert len(found) == len(odd_rows) and all(x.keep for x in found)


def test_toxicity(docs_of, spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w, toxic = words(r.randrange(10, 60), i), i % 4 == 0
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["vileword", "badname", "nastything"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {x.doc_id: x for x in toxicity.score_toxicity(docs_of([*rows, (700, None), (None, "vileword")]), known).collect()}
    assert len(found) == 602 and all(0 <= x.score <= 1 for x in found.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (i in held) for i, _ in rows)
    assert sum(found[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)


def test_hits_near_the_second_person():
    r = random.Random(3)
    for _ in range(50):
        text = " ".join(r.choice(["you", "vile", "plain", "word", "your"]) for _ in range(r.randrange(0, 60)))
        got = toxicity.features(text, toxicity.Lexicon({"vile": 2.0}, {}))
        w = text.split()
        hits, second = ([i for i, x in enumerate(w) if x in s] for s in (("vile",), ("you", "your")))
        assert got[6] == sum(any(abs(i - j) <= 5 for j in second) for i in hits) / max(1, len(hits))


def test_toxicity_odd(docs_of, odd_rows, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs_of(odd_rows), none).collect()
    assert len(found) == len(odd_rows) and all(x.score == 0 and x.predicted == 0 for x in found)


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x = r.random(200)
    at, level = toxicity.isotonic(x, (r.random(200) < x).astype(float), np.ones(200))
    assert (np.diff(at) >= 0).all() and (np.diff(level) >= -1e-12).all()


def test_languages(spark, sf_dir, docs_of, odd_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language_id.identify_languages(docs).collect()
    held = [x for x in found if x.held_out]
    assert held and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.9 * len(held)
    at = {x.doc_id: x for x in language_id.identify_languages(docs_of(odd_rows)).collect()}
    assert at[1].lang_pred == at[2].lang_pred == at[3].lang_pred == "und" and at[1].score == 0


def test_every_language_is_learned(docs_of, monkeypatch):
    learned, learn = [], language_id.learn
    monkeypatch.setattr(language_id, "learn", lambda rows: learned.extend(rows) or learn([]))
    rows = [(200 * k + i, f"text {k} {i}", f"l{k:02}") for k in range(70) for i in range(5)] + [(50_000 + i, f"more {i}", "l00") for i in range(300)]
    assert len(language_id.identify_languages(docs_of(rows)).collect()) == len(rows)
    by_lang = Counter(lang for lang, _ in learned)
    assert set(by_lang) == {x[2] for x in rows} and by_lang["l00"] == language_id.SAMPLE


def test_gradients():
    rng = np.random.default_rng(0)
    way = language_id.Direction(rng)
    data = rng.integers(0, 256, (5, 3)).astype(np.intp)
    outer = rng.normal(size=(5, language_id.UNITS, 3))
    for k in way.p:
        way.p[k] = way.p[k].astype(np.float64)
    real = (np.arange(5)[:, None] >= np.array([0, 2, 1])).astype(np.float32)  # padding comes first, as it does for the backward way
    loss = lambda: sum(float((o * h).sum()) for o, h in zip(outer, way.states(data, real)))
    kept: list = []
    list(way.states(data, real, kept))
    grads = way.backward(kept, outer)
    for name, place in (("u", (1, 2)), ("c", (0, 3)), ("e", (4, int(data[1, 1])))):
        was = way.p[name][place]
        way.p[name][place] = was + 1e-3
        up = loss()
        way.p[name][place] = was - 1e-3
        down = loss()
        way.p[name][place] = was
        assert grads[name][place] == pytest.approx((up - down) / 2e-3, rel=1e-2, abs=1e-3)


def ranked_by_hand(rows, every, k):
    """{query: [(doc_id, score)]}: every document scored, terms in the order of their hashes, ties by doc_id."""
    tf = [(i, Counter((t or "").encode().lower().split())) for i, t in rows]
    n, df = len(tf), Counter(w for _, c in tf for w in c)
    mean = sum(sum(c.values()) for _, c in tf) / n
    out = {}
    for q, asked in tf:
        if q is None or q % every:
            continue
        scores = []
        terms = sorted(asked, key=lambda w: xxhash.xxh3_64_intdigest(w) >> 1)
        for i, c in tf:
            norm = 1.2 * (1 - 0.75 + 0.75 * sum(c.values()) / mean)
            s = sum(asked[w] * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + norm)) for w in terms if w in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_search(docs_of, odd_rows):
    rows = [*[(i, " ".join(words(10 + i % 40, i // 2))) for i in range(200)], *[(300 + i, None) for i in range(3)], (None, "fox1 dog2")]
    found = bm25.top_documents(docs_of(rows), every=20, k=5).collect()
    for q, best in ranked_by_hand(rows, 20, 5).items():
        got = sorted((x.rank, x.doc_id, x.score) for x in found if x.query_id == q)
        assert [round(s, 6) for _, s in best] == [round(s, 6) for _, _, s in got]
    assert bm25.top_documents(docs_of(odd_rows)).collect() is not None


def test_search_ranks_equal_texts_by_doc_id(docs_of):
    r = random.Random(8)
    texts = [" ".join(words(r.randrange(3, 60), k)) for k in range(30)]
    rows = [(i, texts[(i * 7 + i // 60) % 30]) for i in range(400)] + [(1000 + i, " ".join(r.sample(texts[i].split(), 3))) for i in range(30)]
    expected = ranked_by_hand(rows, 20, 10)
    for parts in (1, 9):  # units are dealt into several indexes
        found = bm25.top_documents(docs_of(rows).repartition(parts), every=20, k=10).collect()
        got = {q: [(x.doc_id, x.score) for x in sorted((x for x in found if x.query_id == q), key=lambda x: x.rank)] for q in expected}
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
        assert all(a == pytest.approx(b) for q in got for (_, a), (_, b) in zip(got[q], expected[q]))


def test_search_sends_documents_and_queries_once(docs_of, monkeypatch):
    """However many batches and indexes there are, no copies of documents or queries are made for their pairs."""
    rows, sent, answered = [(i, " ".join(words(20, i // 2))) for i in range(200)], [], bm25._answered
    monkeypatch.setattr(bm25, "ASKED", 40)
    monkeypatch.setattr(bm25, "_answered", lambda stored, asked, *a: sent.append((stored.count(), asked.count())) or answered(stored, asked, *a))
    found = bm25.top_documents(docs_of(rows).repartition(4), every=20, k=5).collect()
    assert len(sent) > 2 and {n for n, _ in sent} == {4} and sum(n for _, n in sent) <= 4
    for q, best in ranked_by_hand(rows, 20, 5).items():
        assert [i for i, _ in best] == [x.doc_id for x in sorted((x for x in found if x.query_id == q), key=lambda x: x.rank)]


def test_search_skips_postings(monkeypatch):
    r = random.Random(5)
    common = [f"often{k}" for k in range(8)]
    rows = [(i, " ".join([*r.sample(common, 6), *words(12, i // 30)])) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    units = pa.Table.from_batches(list(bm25._units([batch], 20, 3)))
    docs = [x["payload"] for x in units.to_pylist() if x["kind"] == bm25.DOCUMENTS]
    index = bm25.Index(docs, 18.0)
    df = Counter(w for _, t in rows for w in set(t.split()))
    text = rows[60][1].split()
    names = sorted({xxhash.xxh3_64_intdigest(w.encode()) >> 1: w for w in text}.items())
    weight = np.array([math.log(1 + (1500 - df[w] + 0.5) / (df[w] + 0.5)) for _, w in names])
    _, doc, score = index.search(np.zeros(len(names), int), np.array([h for h, _ in names], np.uint64), weight, 1, 10)
    assert index.skipped > 5 * index.read > 0
    plain = sorted(((-sum(x * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t.split()) / 18)) for (_, w), x in zip(names, weight) if w in t.split())), i) for i, t in rows)[:10]
    assert [round(-s, 9) for s, _ in plain] == [round(s, 9) for s in score.tolist()]


def looped(network, text):
    """The network's mean probabilities for a text, byte by byte and unit by unit."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    n = language_id.UNITS

    def run(way, data):
        e, u, c = (way.p[k].astype(float) for k in "euc")
        h, out = [0.0] * n, []
        for x in data:
            gate = [sigmoid(e[k, x] + sum(u[k, i] * h[i] for i in range(n))) for k in range(2 * n)]
            new = [math.tanh(e[2 * n + k, x] + sum(c[k, i] * gate[n + i] * h[i] for i in range(n))) for k in range(n)]
            h = [a + z * (b - a) for a, z, b in zip(h, gate, new)]
            out.append(h)
        return out

    total = [0.0] * len(network.languages)
    for at in range(0, len(text), language_id.STRIP):
        low, high = max(0, at - language_id.CONTEXT), min(len(text), at + language_id.STRIP + language_id.CONTEXT)
        there, back = run(network.ways[0], text[low:high]), run(network.ways[1], text[low:high][::-1])[::-1]
        for t in range(at - low, min(len(text), at + language_id.STRIP) - low):
            x = np.exp(network.out["w"].astype(float) @ np.array(there[t] + back[t]) + network.out["b"][:, 0])
            total += x / x.sum()
    return np.array(total) / len(text)


def test_network_equals_loops_and_forgets_its_neighbours():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcdef \xc3\xa9") for _ in range(n)) for n in (1, 7, 63, 300, 512, 513, 700, 1200)]
    network = language_id.Network(["a", "b", "c"])
    for way in network.ways:
        way.p["u"] *= 3
    together = network.pooled(texts)
    for text, p in zip(texts, together):
        assert p == pytest.approx(looped(network, text), abs=1e-4)
        assert p == pytest.approx(network.pooled([text])[0], abs=1e-6)
        assert p == pytest.approx(network.pooled([text, b"x" * 5000, b"y"])[0], abs=1e-6)


def test_languages_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, other = ({x.doc_id: (x.lang_pred, round(x.score, 5)) for x in language_id.identify_languages(d).collect()} for d in (docs.coalesce(1), docs.repartition(6)))
    assert one == other


@pytest.mark.parametrize("run", [
    lambda d, e: ngram_join.ngram_components(d),
    lambda d, e: substring_dedup.repeated_spans(d),
    lambda d, e: fingerprints.compare_fingerprints(d),
    lambda d, e: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    lambda d, e: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    lambda d, e: mixing.mix(d),
    lambda d, e: quality_lm.judge_quality(d, e),
    lambda d, e: toxicity.score_toxicity(d, e),
    lambda d, e: language_id.identify_languages(d),
    lambda d, e: bm25.top_documents(d),
])
def test_empty_tables(run, docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs_of([(1, "x")]).where("doc_id = 0"), labels).collect() == []
