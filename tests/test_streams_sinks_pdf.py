"""Streams, sinks and the PDF reader."""

from __future__ import annotations

import datetime as dt
import json
import zlib

from pyspark.sql import functions as F

from markloom.sources import pdf, sinks
from markloom.streaming import jobs

PAGE = b"q 1 0 0 1 50 60 cm /G1 gs /Im1 Do Q /Artifact <</Type /Pagination>> BDC BT /F1 12 Tf 0.707 0.707 -0.707 0.707 100 200 Tm (DRAFT) Tj ET EMC BT /F1 10 Tf 14 TL 72 700 Td [(Hello) -20 ( world)] TJ T* (next \\(line\\)) Tj 3 Tr (hidden) Tj ET"


def make_pdf(pages, extra=b""):
    body = b"".join(b"%d 0 obj <</Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream endobj\n" % (i + 1, len(z), z) for i, z in enumerate(zlib.compress(p) for p in pages))
    return b"%PDF-1.4\n" + body + extra


def test_events():
    found = pdf.events(PAGE)
    assert [e["kind"] for e in found] == ["object", "range", "text", "text", "text", "text"]
    assert found[0]["matrix"][4:] == (50.0, 60.0) and found[0]["gs"] == "G1"
    assert found[3]["raw"] == b"Hello world" and found[4]["raw"] == b"next (line)" and found[4]["matrix"][5] == 686.0
    assert found[5]["hidden"] and found[1]["index"] < found[2]["index"] < found[1]["end"]


def test_page_events(spark):
    rows = [("a.pdf", make_pdf([PAGE, PAGE])), ("b.pdf", b"%PDF-1.4 /Encrypt 5 0 R"), ("c.pdf", b"%PDF-1.4 nothing")]
    files = spark.createDataFrame(rows, "path string, content binary")
    found = pdf.page_events(files).cache()
    assert {r.path: r.error for r in found.where("error is not null").collect()} == {"b.pdf": "invalid_password", "c.pdf": "pdf"}
    assert {bytes(r.raw) for r in pdf.marked_objects(found).collect()} == {b"DRAFT"}
    best = {bytes(r.raw): r for r in pdf.repeated_texts(found).collect()}
    assert best[b"DRAFT"].pages == 2 and best[b"DRAFT"].score > best[b"Hello world"].score
    cover = spark.createDataFrame([("a.pdf", 1, 0.9)], "path string, page int, cover double")
    assert {r.page: r.kind for r in pdf.page_kinds(found.where("error is null"), cover).collect()} == {1: "mixed", 2: "native"}
    assert pdf.is_signed(b"/Type /Sig") and not pdf.is_signed(b"/Type /Page")


def items(*rows):
    return [dict(zip(("id", "job_id", "input", "fingerprint", "state", "stage", "output", "error", "updated_at", "seq"), r)) for r in rows]


def test_job_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 12)
    at = lambda s: (start + dt.timedelta(seconds=s)).isoformat()
    first = items(("1", "j", "a.png", "f1", "scanning", "detect", None, None, at(0), 1), ("2", "j", "b.png", "f2", "queued", "queued", None, None, at(0), 2))
    second = items(("1", "j", "a.png", "f1", "completed", "done", "a_clean.png", None, at(9), 3), ("2", "j", "b.png", "f2", "processing", "remove", None, None, at(9), 4))
    source, log, checkpoint = (str(tmp_path / p) for p in ("in", "log", "check"))
    (tmp_path / "in").mkdir()
    for k, rows in enumerate((first, second)):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        jobs.append(jobs.item_log(spark, source), log, checkpoint).awaitTermination()
    jobs.append(jobs.item_log(spark, source), log, checkpoint).awaitTermination()
    written = spark.read.parquet(log)
    assert written.count() == 4
    assert {r.id: r.state for r in jobs.latest(written).collect()} == {"1": "completed", "2": "processing"}
    state = jobs.job_states(written).first()
    assert (state.total, state.completed, state.state, state.progress) == (2, 1, "processing", 0.75)
    files = spark.createDataFrame([("a.png", "f1"), ("b.png", "other")], "path string, fingerprint string")
    assert {r.id: r.action for r in jobs.to_resume(written, files).collect()} == {"1": "done", "2": "changed"}
    assert jobs.throughput(written).first().finished == 1


def test_export_is_gated_and_clobbers_nothing(spark, tmp_path):
    root = str(tmp_path / "in")
    gate = "approved boolean, passed boolean, forced boolean, needs_password boolean, signed boolean, signature_confirmed boolean"
    rows = [(f"{root}/x/{n}", root, "png", bytes([i]), i != 1, i != 2, False, False, i == 3, False) for i, n in enumerate(["a.jpg", "b.jpg", "c.jpg", "d.jpg", "a.bmp"])]
    results = spark.createDataFrame(rows, f"path string, root string, ext string, content binary, {gate}")
    out = str(tmp_path / "out")
    existing = spark.createDataFrame([(f"{out}/in/x/a_clean.png",)], "path string")
    plan = sinks.planned(results, existing, out)
    assert {r.path.rsplit("/", 1)[1]: r.target.rsplit("/", 1)[1] for r in plan.collect()} == {"a.bmp": "a_clean (2).png", "a.jpg": "a_clean (3).png", "b.jpg": "b_clean.png", "c.jpg": "c_clean.png", "d.jpg": "d_clean.png"}
    done = {r.target.rsplit("/", 1)[1]: r.outcome for r in sinks.export(plan).collect()}
    assert done == {"a_clean (2).png": "written", "a_clean (3).png": "written"}
    assert sinks.commit(f"{out}/in/x/a_clean (2).png", b"other") == "exists"
    same = sinks.planned(results.withColumn("ext", F.lit("jpg")).limit(1), existing, "", suffix="").first()
    assert same.action == "refuse"
