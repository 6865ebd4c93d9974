"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from markloom.llm.common import documents, materialize
from markloom.llm.substring_dedup import repeated_spans, without_repeats


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[1] >= 0.8 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert max(r.offset + r.length for r in packed) <= 2048


def test_repeats_go_from_rows(spark):
    passage = "Passage ünï that repeats in many texts and is long enough to go away. "
    rows = [(1, "a " + passage, 9, None), (2, passage + "b é", 9, 1), (2, passage + "b é", 9, 1), (3, None, None, 2), (None, passage, 3, 3), (4, "", 0, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans int")
    got = sorted(map(tuple, without_repeats(df).collect()), key=lambda r: r[3] or 0)
    assert got == [(1, "a " + passage, 9, None), (2, "b é", 3, 1), (2, "b é", 3, 1), (3, None, None, 2), (None, passage, 3, 3), (4, "", 0, 4)]
    assert without_repeats(df.limit(0)).columns == df.columns and not without_repeats(df.limit(0)).count()


def test_repeats_are_what_the_operator_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in repeated_spans(docs).collect()}
    got = without_repeats(docs).select("doc_id", "text", "n_chars").collect()
    assert len(got) == docs.count() and all((r.text or "") == kept[r.doc_id] and (r.text is None or r.n_chars == len(r.text)) for r in got)
