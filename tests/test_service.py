"""The service's stateful routes, stage bookkeeping, and what an answer tells of itself."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill import service
from pagemill.functions import tokens
from pagemill.operators import ocrbench, pages, stages
from pagemill.plugins import HashedEmbedder
from pagemill.sources import files

DOCS = "id string, filename string, sha256 string, storage_path string, byte_size long, page_count int, language string, review_required boolean, review_note string, uploaded_at timestamp"
RUNS = "document_id string, stage string, status string, attempt int"


@pytest.fixture
def svc(spark, tmp_path):
    docs = spark.createDataFrame([("d", "d.pdf", "aa", "/d", 1, 2, "bn", False, None, datetime(2024, 1, 1))], DOCS)
    texts = [("c1", "নদী আছে গ্রামে"), ("c2", "পাহাড় দূরে নীল"), ("c3", "নদী দূরে")]
    points = HashedEmbedder().embed(spark.createDataFrame(texts, "chunk_id string, text string"), "text").selectExpr("*", "'d' as document_id", "'d.pdf' as filename", "1 as page_no", "0 as char_start", "9 as char_end", "'fake:256' as model")
    collections = spark.createDataFrame([("pages_main", "fake:256", 256)], "name string, model string, dim int")
    page = spark.createDataFrame([("d", 1, "ocr", "নদী", "নদী", True)], "document_id string, page_no int, source string, raw_text string, text string, trustworthy boolean")
    return service.Service(spark, docs, page, spark.createDataFrame([], RUNS), points, collections, storage=str(tmp_path / "store"))


def ok(rows):
    return rows.withColumns({"result": F.lit("succeeded"), "metrics": F.lit('{"n": 1}')})


def boom(rows):
    raise ValueError("no engine")


def test_advance_runs_until_a_stage_fails(svc):
    svc.stage_functions = {"extract": ok, "ocr": ok, "normalize": boom}
    assert service.handle(svc, "POST", "/documents/d/advance", {"max_stages": 1}) == (200, {"ran": ["extract"]})
    status, out = service.handle(svc, "POST", "/documents/d/advance")
    assert status == 500 and "no engine" in out["error"]
    status, out = service.handle(svc, "GET", "/documents/d")
    rows = {r["stage"]: r for r in out["stages"]}
    assert status == 200 and [rows[s]["status"] for s in stages.STAGES[:4]] == ["succeeded", "succeeded", "failed", "pending"]
    assert rows["extract"]["metrics"] == '{"n": 1}' and rows["extract"]["triggered_by"] == "manual" and rows["extract"]["finished_at"] >= rows["extract"]["started_at"]
    assert rows["normalize"]["error"].startswith("ValueError") and rows["normalize"]["attempt"] == 1 and rows["extract"]["implemented"] and not rows["chunk"]["implemented"]
    assert out["next_runnable"] == "normalize"
    assert service.handle(svc, "POST", "/documents/d/stages/chunk/run")[0] == 501
    assert service.handle(svc, "POST", "/documents/d/stages/extract/run")[0] == 409
    assert service.handle(svc, "POST", "/documents/none/stages/extract/run")[0] == 404
    svc.stage_functions["normalize"] = ok
    assert service.handle(svc, "POST", "/documents/d/stages/normalize/run")[0] == 200
    assert {r["stage"]: r["error"] for r in svc._stage_rows("d")}["normalize"] is None


def test_artifacts_stay_inside_the_storage(svc, spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "a.json").write_text("{}")
    (tmp_path / "secret").write_text("x")
    refs = {"extract": tmp_path / "store" / "a.json", "ocr": tmp_path / "store" / ".." / "secret", "chunk": tmp_path / "store" / "gone"}
    svc.runs = spark.createDataFrame([("d", s, "succeeded", 1, str(p)) for s, p in refs.items()], RUNS + ", output_ref string")
    assert service.handle(svc, "GET", "/documents/d/artifacts/extract") == (200, {"text": "{}"})
    for stage in ("ocr", "chunk", "embed"):
        assert service.handle(svc, "GET", f"/documents/d/artifacts/{stage}")[0] == 404


def test_uploads_are_stored_once(svc, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in {"a.pdf": b"one", "b.pdf": b"one", "empty.pdf": b"", "c.txt": b"x"}.items():
        (folder / name).write_bytes(body)
    status, out = service.handle(svc, "POST", "/documents", {"folder": str(folder)})
    assert status == 200 and {(r["filename"], r["created"]) for r in out} == {("a.pdf", True), ("b.pdf", False), ("empty.pdf", True)}
    assert len({r["id"] for r in out}) == 2 and svc.documents.count() == 3
    again = service.handle(svc, "POST", "/documents", {"folder": str(folder)})[1]
    assert not any(r["created"] for r in again) and {r["id"] for r in again} == {r["id"] for r in out} and svc.documents.count() == 3
    new = next(r["id"] for r in out if r["filename"] == "empty.pdf")
    detail = service.handle(svc, "GET", f"/documents/{new}")[1]
    assert [r["status"] for r in detail["stages"]] == ["pending"] * 6 and detail["next_runnable"] == "extract"


class Echo:
    """A generator that quotes its first span and a text that is nowhere."""

    def generate(self, df):
        return df.withColumn("payload", F.lit('{"sufficient": true, "answer": "yes", "claims": [{"claim": "a", "span_id": "S1", "quote": "নদী"}, {"claim": "b", "span_id": "S1", "quote": "nowhere at all"}]}'))


def test_answers_tell_what_decided_them(svc):
    out = svc.ask("নদী", threshold=2.0)
    assert not out["answered"] and out["diagnostics"]["threshold"] == 2.0 and len(out["diagnostics"]["candidates"]) == 3
    first = out["diagnostics"]["candidates"][0]
    assert set(first) == {"chunk_id", "document_id", "filename", "page_no", "dense_score", "rerank_score", "gate_score", "preview"} and round(first["gate_score"], 4) == first["gate_score"]
    svc.generator = Echo()
    svc.points = svc.points.where("chunk_id = 'c1'")
    out = svc.ask("নদী", threshold=-1.0)
    assert out["answered"] and out["citations"] == [{"chunk_id": "c1", "filename": "d.pdf", "page_no": 1, "char_start": 0, "char_end": 9}]
    assert [c["grounded"] for c in out["diagnostics"]["claims"]] == [True, False] and len(out["warnings"]) == 2


def test_error_rates_are_of_composed_texts(spark):
    df = spark.createDataFrame([("\u0995\u09cb", "\u0995\u09c7\u09be"), ("\u00e9  x", "e\u0301 x")], "a string, b string")
    for r in df.select(tokens.cer(df.a, df.b).alias("c"), tokens.wer(df.a, df.b).alias("w"), tokens.similarity(df.a, df.b).alias("s")).collect():
        assert (r["c"], r["w"], r["s"]) == (0, 0, 1)


def test_edit_distance_of_words():
    assert tokens.edit_distance("a b c d".split(), "a x c".split()) == 2
    assert tokens.edit_distance([str(i) for i in range(70_000)], [str(i) for i in range(1, 70_000)]) == 1


def test_ranking_leaves_the_baseline_out(spark):
    out = spark.createDataFrame([(1, "a", "one two"), (1, "textlayer", "one two")], "page_no int, engine string, text string")
    gold = spark.createDataFrame([(1, "one two")], "page_no int, gold_text string")
    keys = ["page_no"]
    pairs = ocrbench.consensus(out, keys)
    ranked = ocrbench.ranking(ocrbench.quality_signals(out, keys), ocrbench.mean_agreement(pairs, keys), ocrbench.page_scores(out, gold, keys), out.select("engine", F.lit(1.0).alias("seconds")), keys)
    assert [(r["engine"], r["place"]) for r in ranked.collect()] == [("a", 1), ("textlayer", None)]
    assert "--- a ---\none two" in ocrbench.side_by_side(out, keys).collect()[0]["compared"]


def test_run_totals_and_notes(spark):
    rows = [("d", n, 1.04, None if n > 4 else "timeout") for n in range(1, 8)] + [("e", 1, 2.0, None)]
    got = {r["document_id"]: r for r in ocrbench.run_totals(spark.createDataFrame(rows, "document_id string, page_no int, seconds double, error string")).collect()}
    assert (got["d"]["pages_read"], got["d"]["total_seconds"], got["d"]["failed"], got["d"]["failed_pages"], got["d"]["status"]) == (3, 3.1, 4, "1,2,3", "failed")
    assert got["e"]["status"] == "succeeded"
    gated = spark.createDataFrame([("d", n, n > 9, False, 5) for n in range(1, 12)] + [("e", n, True, n < 8, 5) for n in range(1, 9)], "document_id string, page_no int, trustworthy boolean, latin_suspect boolean, chars int")
    held = {r["document_id"]: r for r in pages.document_hold(gated).collect()}
    assert "1, 2, 3, 4, 5, 6, 7, 8)" in held["d"]["review_note"] and held["d"]["failed"] == 9
    assert held["e"]["review_note"] is None and held["e"]["note"].startswith("8 of 8") and "1, 2, 3, 4, 5)" in held["e"]["note"]


def test_migrations(spark, tmp_path):
    (tmp_path / "001_a.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW made_one AS SELECT 1 AS x;\nCREATE OR REPLACE TEMPORARY VIEW made_two AS SELECT x + 1 AS x FROM made_one;\n")
    (tmp_path / "002_b.sql").write_text("SELECT nothing FROM nowhere")
    none = spark.createDataFrame([], "filename string, applied_at timestamp")
    with pytest.raises(Exception, match="nowhere") as failed:
        files.migrate(spark, str(tmp_path), none)
    assert any("001_a" in note for note in failed.value.__notes__)
    done = files.migrate(spark, str(tmp_path), spark.createDataFrame([("002_b.sql", datetime(2024, 1, 1))], "filename string, applied_at timestamp"))
    assert spark.table("made_two").collect()[0]["x"] == 2 and {r["filename"] for r in done.collect()} == {"001_a.sql", "002_b.sql"}
