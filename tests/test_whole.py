"""Queries and routes that must cover the whole input, against brute force on small fixtures."""

from __future__ import annotations

import json
import re
import socket
import threading
import time
import urllib.request
from datetime import datetime, timedelta

from pagemill import service
from pagemill.plans import queries as core

AT = datetime(2024, 1, 1)
_TOKEN = re.compile(r"[^\W_]{2,}")


def tables(spark, folder, texts: dict[str, tuple[str, str]], byte: str = "ff") -> str:
    """A data directory of one document with a page and a chunk for each (page text, chunk text)."""
    docs = [("d", "other words.pdf", byte * 32, AT)]
    spark.createDataFrame(docs, "id string, filename string, sha256 string, uploaded_at timestamp").write.parquet(f"{folder}/documents.parquet")
    pages = [("d", n, page, AT) for n, (page, _) in enumerate(texts.values(), 1)]
    spark.createDataFrame(pages, "document_id string, page_no int, text string, updated_at timestamp").write.parquet(f"{folder}/document_pages.parquet")
    chunks = [(key, "d", n, 0, 0, chunk, AT) for n, (key, (_, chunk)) in enumerate(texts.items(), 1)]
    spark.createDataFrame(chunks, "id string, document_id string, page_no int, ordinal int, char_start int, text string, created_at timestamp").write.parquet(f"{folder}/chunks.parquet")
    return str(folder)


def test_token_overlap_takes_the_whole_chunk(spark, tmp_path):
    page = " ".join(f"word{i}" for i in range(60))
    texts = {"fresh": (page, page[:300]), "stale": (page, page[:100] + " gone" * 40), "short": (page, "word1 gone")}
    want = {}
    for key, (span, claim) in texts.items():
        ct, st = _TOKEN.findall(claim), set(_TOKEN.findall(span))
        want[key] = (len(ct), round(sum(t in st for t in ct) / len(ct), 6))
    assert want["stale"][1] < 0.5
    got = {r["id"]: (r["tokens"], r["overlap"]) for r in core.token_overlap(spark, tables(spark, tmp_path, texts)).collect()}
    assert got == want


def test_quotes_are_whole_spans(spark, tmp_path):
    late = "- " * 50 + "first words of the chunk"  # no token within 80 code points
    d = tables(spark, tmp_path, {"late": (late, late), "long": ("word " * 90, "word " * 90)})
    _, spans, payloads = core._questions(spark, d)
    quotes = {c["quote"] for c in payloads.collect()[0]["payload"]["claims"]}
    assert quotes == {late, "word " * 90}
    assert {(r["chunk_id"], r["quote_overlap"], r["grounded"]) for r in core.citation_check(spark, d).collect()} == {("late", 1.0, True), ("long", 1.0, True)}
    assert [(r["answered"], r["claims_grounded"]) for r in core.answer_outcome(spark, d).collect()] == [(True, 2)]


def test_routes_answer_all_rows(spark, tmp_path):
    n = 1203
    rows = [(f"doc{i}", f"{i}.pdf", "f" * 64, 5, 1, "bn", True, "নোট", AT + timedelta(minutes=i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "id string, filename string, sha256 string, byte_size long, page_count int, language string, review_required boolean, review_note string, uploaded_at timestamp")
    s = service.Service(spark, docs.repartition(5), docs, docs, docs, docs)
    newest_first = [f"doc{i}" for i in reversed(range(n))]
    for route in ("/documents", "/review"):
        status, out = service.handle(s, "GET", route)
        assert status == 200 and [r["id"] for r in out] == newest_first
    for i in range(n):
        (tmp_path / f"{i}.pdf").write_text(f"file {i}")
    status, out = service.handle(s, "POST", "/documents", {"folder": str(tmp_path)})
    assert status == 200 and {r["filename"] for r in out} == {f"{i}.pdf" for i in range(n)}
    assert service.handle(s, "POST", "/documents", {"folder": str(tmp_path / "none")})[0] == 500

    with socket.socket() as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    threading.Thread(target=service.serve, args=(s, port), daemon=True).start()
    time.sleep(1)
    with urllib.request.urlopen(f"http://127.0.0.1:{port}/review", timeout=60) as answer:
        out = json.loads(answer.read())
    assert [r["id"] for r in out] == newest_first and out[0]["review_note"] == "নোট"
