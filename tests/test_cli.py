"""Command lines and the local implementations behind them, on small fixtures."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill import cli
from pagemill.operators import answering, pages
from pagemill.plugins import Extractive, LocalPdfReader, Textlayer

AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    docs = [("d", "d.pdf", "aa", False, AT)]
    spark.createDataFrame(docs, "id string, filename string, sha256 string, review_required boolean, uploaded_at timestamp").write.parquet(f"{d}/documents.parquet")
    texts = ["নদী আছে গ্রামে। মাছ আছে।", "পাহাড় দূরে নীল।"]
    chunks = [(f"d:1:{i}", "d", 1, i, 0, len(t), t, t, AT) for i, t in enumerate(texts)]
    spark.createDataFrame(chunks, "id string, document_id string, page_no int, ordinal int, char_start int, char_end int, text string, embed_text string, created_at timestamp").write.parquet(f"{d}/chunks.parquet")
    rows = [("d", 1, " ".join(texts) * 3, json.dumps({"fonts_ok": True}), AT), ("e", 1, "িভুল " * 9, None, AT)]
    spark.createDataFrame(rows, "document_id string, page_no int, raw_text string, quality string, updated_at timestamp").write.parquet(f"{d}/document_pages.parquet")
    return str(d)


def test_ask(spark, data, capsys):
    assert cli.main(["ask", "নদী আছে গ্রামে। মাছ আছে।", "--data", data, "--threshold", "-2"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["answered"] and out["citations"][0]["chunk_id"] == "d:1:0" and out["diagnostics"]["claims"][0]["quote"] == "নদী আছে গ্রামে।"
    assert cli.main(["ask", "নদী", "--data", data, "--retrieval-only", "--threshold", "3"], spark) == 0
    assert "ABSTAIN (best" in capsys.readouterr().out


def test_sweep(spark, data, tmp_path, capsys):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"question": "নদী আছে গ্রামে। মাছ আছে।", "answerable": True}, {"question": "zzz", "answerable": False}]))
    with pytest.raises(RuntimeError):
        cli.main(["sweep", str(q), "--data", data], spark)
    assert cli.main(["sweep", str(q), "--data", data, "--uncalibrated", "--out", str(tmp_path / "s.json")], spark) == 0
    out = capsys.readouterr().out
    assert "    1.000         1         1       0" in out and "lowest cutoff without a leak" in out
    assert {r["question"] for r in json.loads((tmp_path / "s.json").read_text())} == {"নদী আছে গ্রামে। মাছ আছে।", "zzz"}


def test_probe(spark, data, capsys):
    assert cli.main(["probe", "--data", data], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["d  plausible", "e  UNTRUSTWORTHY"]


def test_ocr_bench(spark, tmp_path, capsys):
    rows = [(1, "a", "one two", 1.0), (1, "b", "one twx yyyyyyyyyyyyyyyyyyy", 2.0), (2, "a", "x", 1.0)]
    spark.createDataFrame(rows, "page_no int, engine string, text string, seconds double").write.parquet(str(tmp_path / "o"))
    assert cli.main(["ocr-bench", str(tmp_path / "o"), "--out", str(tmp_path / "gold"), "--make-gold-template"], spark) == 0
    (tmp_path / "gold" / "page_0001.txt").write_text("# page 1\none two\n")
    assert cli.main(["ocr-bench", str(tmp_path / "o"), "--gold", str(tmp_path / "gold"), "--out", str(tmp_path / "r")], spark) == 0
    out = capsys.readouterr().out
    assert "| a |" in out and "page 1, b: CER above 1" in out
    assert (tmp_path / "r" / "page_0002.compare.txt").read_text() == "--- a ---\nx"


def test_db(spark, tmp_path, capsys):
    (tmp_path / "001.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW cli_made AS SELECT 1 AS x")
    args = [str(tmp_path), "--applied", str(tmp_path / "applied")]
    assert cli.main(["db", "status", *args], spark) == 1
    assert cli.main(["db", "migrate", *args], spark) == 0 and cli.main(["db", "status", *args], spark) == 0
    assert spark.table("cli_made").count() == 1


class FakePage:
    def __init__(self, text):
        self.text = text

    def get_text(self, kind="text"):
        return self.text if kind == "text" else {"blocks": [{"lines": [{"spans": [{"font": "AB+Old", "text": self.text}]}]}]}

    def get_fonts(self, full=True):
        return [(7, "", "", "AB+Old")]

    def get_pixmap(self, dpi):
        class Image:
            def save(self, path):
                open(path, "w").write(str(dpi))

        return Image()


class FakePdf:
    key = "k"

    def __init__(self, content):
        if not content:
            raise ValueError("no bytes")
        self.rows = content.decode().split("|")
        self.page_count = len(self.rows)

    def __getitem__(self, n):
        return FakePage(self.rows[n])

    def xref_object(self, xref):
        return "<< /Encoding /Identity-H >>"


def test_pdf_reader_and_textlayer(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([("a.pdf", bytearray("নদী|two".encode())), ("bad.pdf", bytearray(b""))], "path string, content binary")
    reader = LocalPdfReader(FakePdf)
    got = sorted(tuple(r) for r in reader.pages(df).collect())
    assert got == [("a.pdf", 1, "নদী"), ("a.pdf", 2, "two")]
    assert [tuple(r) for r in reader.faults(df).collect()] == [("bad.pdf", "ValueError: no bytes")]
    fonts = reader.fonts(df).withColumnRenamed("path", "document_id")
    verdict = {r["page_no"]: r["fonts_ok"] for r in pages.page_font_verdict(reader.spans(df).withColumnRenamed("path", "document_id"), fonts).collect()}
    assert verdict == {1: False, 2: True}
    assert [r["encoding"] for r in pages.font_classes(fonts).collect()] == ["Identity-H"]
    images = [r["image"] for r in reader.render(df, str(tmp_path / "png"), 72).collect()]
    assert sorted(images) == [str(tmp_path / "png" / f"k_000{n}_72.png") for n in (1, 2)]
    assert {r["text"] for r in Textlayer().run(reader.pages(df)).collect()} == {"নদী", "two"}


def test_extractive_generator(spark):
    block = "[S1] (page 1)\nনদী আছে। মাছ আছে।\n\n[S2] (page 2)\nplain words\n\n[S3] (page 2)\nthird."
    made = Extractive().generate(spark.createDataFrame([("q", block), ("none", "")], "question string, span_block string"))
    got = {r["question"]: r["p"] for r in made.select("question", F.from_json("payload", answering.PAYLOAD).alias("p")).collect()}
    assert [(c["span_id"], c["quote"]) for c in got["q"]["claims"]] == [("S1", "নদী আছে।"), ("S2", "plain words")]
    assert not got["none"]["sufficient"] and got["none"]["claims"] == []
