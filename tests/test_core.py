from __future__ import annotations

import hashlib
import json
import random
import re
import unicodedata
import uuid
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import hashing, script, tokens
from pagemill.operators import answering, chunking, ocrbench, pages, retrieval, stages
from pagemill.plans import queries
from pagemill.plugins import CrossEncoder, HashedEmbedder, ModelEmbedder, Passthrough, embedder
from pagemill.sources import files
from pagemill.streaming import stage_log


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(*columns).collect()[0]


# --- script and spelling ---------------------------------------------------------------------------------

DEPENDENT = "".join(map(chr, [0x9BC, 0x9BE, 0x9BF, 0x9C0, 0x9C1, 0x9C2, 0x9C3, 0x9C4, 0x9C7, 0x9C8, 0x9CB, 0x9CC, 0x9CD, 0x9D7]))


def brute_orthography(t):
    tok = [w for w in t.split() if any("ঀ" <= c < "਀" for c in w)]
    bad = [w for w in tok if w[0] in DEPENDENT]
    return len(tok), len(bad), bad[:8], len(re.findall(r"([অ-হ])\1\1", t)), len(re.findall(r"\s[া-ৌ্]", t))


@pytest.mark.parametrize("sign", DEPENDENT)
def test_every_dependent_sign_counts_at_a_word_start(spark, sign):
    o = one(spark, f"{sign}ক ({sign}খ গ", script.orthography(F.col("t")).alias("o"))["o"]
    assert (o["tokens"], o["initial_dependent"], list(o["samples"])) == (3, 1, [f"{sign}ক"])


def test_orthography_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", " ", "ককক", "কককককক", "a b", "ক\x1cখ", "াক"] + ["".join(rng.choice("কখগািেো্ abz।\n\t\x1c১") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    o = script.orthography(F.col("t"))
    latin = script.latin_intrusion(F.col("t"))
    for r in df.select("i", "t", o.alias("o"), script.script_ratio(F.col("t")).alias("ratio"), latin.alias("latin")).collect():
        tok, bad, samples, triples, orphans = brute_orthography(r["t"])
        assert (r["o"]["tokens"], r["o"]["initial_dependent"], list(r["o"]["samples"]), r["o"]["triples"], r["o"]["orphaned"]) == (tok, bad, samples, triples, orphans)
        assert r["o"]["rate"] == bad / max(tok, 1)
        visible = [c for c in r["t"] if not c.isspace()]
        assert r["ratio"] == pytest.approx(sum("ঀ" <= c < "਀" for c in visible) / len(visible) if visible else 0.0)
        assert r["latin"]["latin"] == len(re.findall(r"\b[A-Za-z]{2,}\b", r["t"]))


def test_nfc(spark):
    got = [one(spark, t, script.nfc(F.col("t")).alias("n"))["n"] for t in ("ো", "য়", "é")]
    assert got == [unicodedata.normalize("NFC", t) for t in ("ো", "য়", "é")]


@pytest.mark.parametrize("raw,fonts,source", [("ছোট", True, "empty"), (None, None, "empty"), ("একটি বড় নদী আছে এখানে আজ", True, "textlayer"), ("একটি বড় নদী আছে এখানে আজ", False, "needs_ocr"), ("াএকটি িবড় নদী আছে এখানে আজ", True, "needs_ocr"), ("কককটি বড় নদী আছে এখানে আজ", None, "textlayer")])
def test_triage(spark, raw, fonts, source):
    df = spark.createDataFrame([(raw, fonts)], "raw string, ok boolean")
    if raw and raw.startswith("কক"):
        source = "needs_ocr"
    assert df.select(script.triage(F.col("raw"), F.col("ok")).alias("s")).collect()[0]["s"] == source


def test_fonts(spark):
    fonts = spark.createDataFrame(
        [("d", 1, "BCDEEE+NikoshBAN", "<< /Font >>", 1), ("d", 1, "ABCDEF+Good", "<< /ToUnicode 3 0 R /Encoding /Identity-H >>", 2), ("d", 2, "SutonnyMJ", "<< /ToUnicode 1 0 R /WinAnsiEncoding >>", 3)],
        "document_id string, page_no int, font_name string, font_object string, xref int")
    spans = spark.createDataFrame([("d", 1, "NikoshBAN", "latin only"), ("d", 1, "Good", "বাংলা"), ("d", 2, "SutonnyMJ", "বাংলা"), ("d", 3, "Good", None)], "document_id string, page_no int, font string, text string")
    got = {r["page_no"]: (r["fonts_ok"], list(r["bad_fonts"])) for r in pages.page_font_verdict(spans, fonts).collect()}
    assert got == {1: (True, []), 2: (False, ["SutonnyMJ"]), 3: (True, [])}
    drawn = spans.unionByName(spark.createDataFrame([("d", 1, "XYZABC+NikoshBAN", "নদী")], spans.schema))
    assert {r["page_no"]: r["fonts_ok"] for r in pages.page_font_verdict(drawn, fonts).collect()}[1] is False
    assert {(r["encoding"], r["fonts"]) for r in pages.font_classes(fonts).collect()} == {("other", 1), ("Identity-H", 1), ("WinAnsiEncoding", 1)}


def test_gate_and_hold(spark):
    rows = [("a", 1, "একটি নদী আছে"), ("a", 2, "িভুল শব্দ"), ("b", 1, "একটি নদী আছে"), ("b", 2, "নদী some latin words here"), ("c", 1, None)]
    g = pages.gate(spark.createDataFrame(rows, "document_id string, page_no int, raw_text string"))
    assert {(r["document_id"], r["page_no"]): (r["trustworthy"], r["latin_suspect"]) for r in g.collect()} == {("a", 1): (True, False), ("a", 2): (False, False), ("b", 1): (True, False), ("b", 2): (True, True)}
    hold = {r["document_id"]: r for r in pages.document_hold(g).collect()}
    assert hold["a"]["status"] == "held" and list(hold["a"]["failed_pages"]) == [2] and hold["b"]["status"] == "succeeded" and hold["b"]["review_note"] is None


def test_quality_decoding(spark):
    rows = [("a", 1, '{"tokens": "85", "fonts_ok": true, "bad_fonts": ["x"]}'), ("b", 1, '{"tokens": 8'), ("c", 1, None), ("d", 1, "{}")]
    df = spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in rows], "document_id string, page_no int, quality string, updated_at timestamp")
    got = {r["document_id"]: r for r in pages.decoded_quality(df).collect()}
    assert got["a"]["tokens"] == 85 and got["a"]["bad_fonts"] == ["x"] and not got["b"]["valid"] and not got["c"]["valid"] and got["d"]["valid"] and got["d"]["tokens"] is None


def test_probe_verdict(spark):
    long = "একটি নদী আছে এখানে " * 5
    rows = [("ok", 1, long, True), ("bad", 1, long, False), ("latin", 1, "only latin words " * 9, True), ("none", 1, "x", True), ("none", 9, long, True), ("wrong", 2, "িভুল " * 9, None)]
    df = spark.createDataFrame(rows, "document_id string, page_no int, raw_text string, fonts_ok boolean")
    assert {r["document_id"]: r["verdict"] for r in pages.probe_verdict(df).collect()} == {"ok": "plausible", "bad": "UNTRUSTWORTHY", "latin": "NOT BENGALI", "none": "NO TEXT LAYER", "wrong": "UNTRUSTWORTHY"}


def test_dedupe(spark):
    rows = [("b", "h", datetime(2024, 1, 2)), ("a", "h", datetime(2024, 1, 3)), ("c", None, None), ("d", None, None), ("e", "h", None)]
    got = {r["id"]: (r["kept_id"], r["created"]) for r in pages.dedupe_uploads(spark.createDataFrame(rows, "id string, sha256 string, uploaded_at timestamp")).collect()}
    assert got == {"a": ("b", False), "b": ("b", True), "c": ("c", True), "d": ("d", True), "e": ("b", False)}


# --- chunks ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,ends", [("ক। খ?", [2, 5]), ("ক [খ। গ] ঘ।", [11]), ("০অ০৩০।মং০৩", []), ("ক।। খ", [3]), (") ক।", [4]), ("“ক। খ” গ।", [9]), ("", [])])
def test_sentence_ends(text, ends):
    assert chunking.sentence_ends(text) == [e for e in ends if e <= len(text)]


def test_paragraph_spans():
    t = "এক\n\nদুই\n\n\n  \n\nতিন"
    assert [t[a:b].strip() for a, b in chunking.paragraph_spans(t)] == ["এক", "দুই", "তিন"]
    assert chunking.paragraph_spans("   \n\n  ") == [] and len(chunking.paragraph_spans("একই\n\nএকই")) == 2


@pytest.mark.parametrize(
    "text,spans", [("ক" * 1500, [(0, 700), (700, 1400), (1400, 1500)]), ("ক" * 1450, [(0, 700), (700, 1450)])])
def test_worked_examples(text, spans):
    assert [(a, b) for _, a, b, _ in chunking.chunk_text(text)] == spans


def test_sentence_closed_piece():
    t = list("ক" * 1000)
    for e in (300, 600, 900):
        t[e - 1], t[e] = "।", " "
    assert [(a, b) for _, a, b, _ in chunking.chunk_text("".join(t))][0] == (0, 700)
    assert chunking.chunk_text("".join(t))[1][3] == 640


def test_hard_split():
    pieces = chunking.split_oversized("ক" * 500, 0, 500, 200)
    assert pieces == [(0, 200), (200, 400), (400, 500)] and chunking.split_oversized("ক", 0, 1, 200) == [(0, 1)]


def test_chunk_invariants():
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice(["নদী ", "পথ। ", "\n\n", "[১। ২] ", "শব্দ", "\n", "দীর্ঘ " * 9]) for _ in range(rng.randrange(80)))
        chunks = chunking.chunk_text(t, 300, 500, 80, 50)
        at = 0
        for o, a, b, e in chunks:
            assert t[a:b].strip() == t[a:b] != "" and a >= at and not t[at:a].strip() and a - e <= 50
            at = b
        assert not t[at:].strip() and [c[0] for c in chunks] == sorted({c[0] for c in chunks})
    assert chunking.chunk_text(None) == chunking.chunk_text("") == chunking.chunk_text(" \n ") == []


def test_chunk_pages_and_metrics(spark):
    rows = [("d", 1, "ক" * 1500, True), ("d", 2, None, True), ("d", 3, "x", False), ("e", 1, " ", None)]
    p = spark.createDataFrame(rows, "document_id string, page_no int, text string, trustworthy boolean")
    c = chunking.chunk_pages(chunking.usable_pages(p))
    assert [r["id"] for r in c.orderBy("id").collect()] == ["d:1:0", "d:1:1", "d:1:2"]
    m = {r["document_id"]: r for r in chunking.chunk_metrics(p, c).collect()}
    assert (m["d"]["chunks"], m["d"]["mean_chars"], m["d"]["pages_skipped"], list(m["d"]["skipped"])) == (3, 500.0, 2, [2, 3]) and m["e"]["chunks"] == 0 and m["e"]["max_chars"] == 0
    assert list(chunking.page_report(p, c).collect()[0]["sizes"]) == [700, 700, 100]
    again = chunking.replace_documents(c, c.where("ordinal = 0"))
    assert again.count() == 1


# --- hashing, tokens, distances --------------------------------------------------------------------------


def test_uuid5(spark):
    for name in ["a:1:0", "", "নদী"]:
        assert one(spark, name, hashing.uuid5(F.col("t")).alias("u"))["u"] == str(uuid.uuid5(uuid.UUID(hashing.POINT_NAMESPACE), name))


def test_hashed_vector(spark):
    text, dim = "একটি নদী", 256
    stream = b"".join(hashlib.sha256(text.encode() + i.to_bytes(2, "big")).digest() for i in range(16))
    v = np.frombuffer(stream, ">u2")[:dim] / 32767.5 - 1
    got = one(spark, text, hashing.l2(hashing.hashed_vector(F.col("t"), dim)).alias("v"))["v"]
    assert np.allclose(got, v / np.linalg.norm(v), atol=1e-12)


def test_l2_and_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(hashing.l2(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    assert df.select(hashing.dot(F.col("v"), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).collect()[0]["d"] == 11.0


@pytest.mark.parametrize("claim,span,share", [("একটি নদী", "একটি নদী আছে", 1.0), ("abc def", "ghi", 0.0), ("", "x y", 0.0), ("ab ab zz", "ab", 2 / 3), ("a b", "a b", 0.0), (None, "x", 0.0)])
def test_overlap(spark, claim, span, share):
    df = spark.createDataFrame([(claim, span)], "a string, b string")
    assert df.select(tokens.overlap(F.col("a"), F.col("b")).alias("o")).collect()[0]["o"] == pytest.approx(share)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_error_rates_against_brute_force(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("", "x"), ("নদী আছে", ""), ("a  b", "a b")] + [tuple("".join(rng.choice(["নদী ", "ক", " ", "abc ", "😀"]) for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("i", tokens.cer(a, b).alias("cer"), tokens.wer(a, b).alias("wer"), tokens.similarity(a, b).alias("sim")).collect():
        x, y = (" ".join(t.split()) for t in pairs[r["i"]])
        assert r["cer"] == (pytest.approx(lev(x, y) / len(x)) if x else None)
        assert r["wer"] == (pytest.approx(lev(x.split(), y.split()) / len(x.split())) if x else None)
        assert r["sim"] == pytest.approx(1 - lev(x, y) / max(len(x), len(y)) if x or y else 1.0)


def test_ocr_bench(spark):
    out = spark.createDataFrame([(1, "a", "one two"), (1, "b", "one twx"), (1, "textlayer", "zzz"), (2, "a", "long text here"), (2, "b", None)], "page_no int, engine string, text string")
    gold = spark.createDataFrame([(1, "one two"), (2, "")], "page_no int, gold_text string")
    scores = {(r["page_no"], r["engine"]): r["cer"] for r in ocrbench.page_scores(out, gold, ["page_no"]).collect()}
    assert scores[1, "a"] == 0 and scores[2, "a"] is None
    pairs = ocrbench.consensus(out, ["page_no"])
    assert pairs.count() == 4
    assert {r["engine"] for r in ocrbench.mean_agreement(pairs, ["page_no"]).collect()} == {"a", "b"}
    assert ocrbench.worst_pairs(pairs, ["page_no"]).where("page_no = 1").collect()[0]["engine_a"] == "a"
    seconds = out.select("engine", F.lit(1.0).alias("seconds"))
    ranked = ocrbench.ranking(ocrbench.quality_signals(out, ["page_no"]), ocrbench.mean_agreement(pairs, ["page_no"]), ocrbench.page_scores(out, gold, ["page_no"]), seconds, ["page_no"])
    assert [r["engine"] for r in ranked.collect()] == ["a", "b", "textlayer"]
    assert ocrbench.uncached(out.select("page_no", "engine"), out.where("page_no = 1"), ["page_no"]).count() == 2


# --- search ----------------------------------------------------------------------------------------------


def vec(seed, dim=8):
    v = np.array([((seed * 7 + i * 13) % 100) / 100 - 0.5 for i in range(dim)])
    return [float(x) for x in v / np.linalg.norm(v)]


@pytest.fixture
def points(spark):
    rows = [(f"docA:1:{i}", "docA", vec(i), "m") for i in range(5)] + [(f"docB:1:{i}", "docB", vec(50 + i), "") for i in range(3)] + [("x", "docB", None, "m"), ("y", "docB", [1.0], "other")]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, dense array<float>, model string").withColumn("text", F.col("chunk_id")).withColumn("filename", F.lit("f")).withColumn("page_no", F.lit(1)).withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(5))


def test_search(points):
    hits = retrieval.dense_search(points, vec(2), 4).collect()
    assert hits[0]["chunk_id"] == "docA:1:2" and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert {r["document_id"] for r in retrieval.dense_search(points, vec(2), 9, "docB").collect()} == {"docB"}
    assert retrieval.model_guard(points, "m").count() == 9


def test_knn_batch_against_brute_force(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(300, 16)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<double>").repartition(5)
    asked = df.where("id % 50 = 0")
    got: dict[int, list] = {}
    for r in retrieval.knn_batch(asked, df, 7, "id", "id", "v").collect():
        got.setdefault(r["q"], []).append((-r["score"], r["p"]))
    for q in range(0, 300, 50):
        s = x @ x[q]
        s[q] = -np.inf
        assert [p for _, p in sorted(got[q])] == list(np.argsort(-s, kind="stable")[:7])
    assert retrieval.knn_batch(asked.limit(0), df, 7, "id", "id", "v").count() == 0


def test_rerank_and_retrieve(spark, points):
    collections = spark.createDataFrame([("c", "m", 8, None, None)], "name string, model string, dim int, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = retrieval.retrieve(points, collections, "c", "q", vec(1), "m", Passthrough(), 0, 3).collect()
    assert len(got) == 3 and got[0]["gate_score"] == got[0]["score"]
    backwards = CrossEncoder(lambda: lambda q, texts: [float(t[-1]) for t in texts])
    assert retrieval.rerank(retrieval.dense_search(points, vec(1), 5, "docA"), "q", backwards, 2).collect()[0]["chunk_id"] == "docA:1:4"
    with pytest.raises(LookupError):
        retrieval.check_collection(collections, "none", "m")
    with pytest.raises(RuntimeError):
        retrieval.check_collection(collections, "c", "n")


def test_collections(spark):
    c = spark.createDataFrame([("a", "m", 8, None, None)], "name string, model string, dim int, created_at timestamp_ntz, updated_at timestamp_ntz")
    same, made = retrieval.ensure_collection(c, "a", "m", 8)
    assert not made and same.count() == 1
    other, made = retrieval.ensure_collection(c, "a", "m", 16)
    assert made and [r["dim"] for r in other.collect()] == [16]
    info = retrieval.collection_info(c, "zz").collect()[0]
    assert not info["found"] and info["dim"] is None


def test_points(points):
    fresh = points.where("chunk_id = 'x'").withColumn("model", F.lit("new"))
    once = retrieval.upsert_points(points, fresh, "chunk_id")
    twice = retrieval.upsert_points(once, fresh, "chunk_id")
    assert sorted(map(str, once.select("chunk_id", "model").collect())) == sorted(map(str, twice.select("chunk_id", "model").collect())) and once.count() == points.count()
    assert retrieval.delete_document(points, "docA").count() == 5


@pytest.fixture
def sources(spark):
    """Vectors, chunks, embeddings and documents of build_points with signed zeros and missing values."""
    day = [datetime(2024, 1, i) for i in range(1, 4)]
    vectors = [("f", 0, "a", [-0.0, 0.5]), ("f", 1, "b", [0.25, 0.0]), ("f", None, "b", [-0.0, None]), ("f", 2, "c", [1.0]), ("g", 0, "c", [-0.5, -0.0]), ("h", 0, "d", [1.0, 1.0]), ("f", 3, "e", [-0.0, 1.0])]
    embeddings = [("f", "old", 2, day[0]), ("f", "m", None, day[1]), ("f", None, 2, day[2]), ("f", "undated", 1, None), ("g", None, 2, day[0]), ("h", "m", 2, None)]
    chunks = [(c, "docB" if c == "e" else "docA", 1, 0, 0, 5, "t", day[0]) for c in "abcde"]
    return (
        spark.createDataFrame(vectors, "vectors_path string, row_no int, chunk_id string, dense array<float>"),
        spark.createDataFrame(chunks, "id string, document_id string, page_no int, ordinal int, char_start int, char_end int, text string, created_at timestamp_ntz"),
        spark.createDataFrame(embeddings, "vectors_path string, model string, dim int, created_at timestamp_ntz"),
        spark.createDataFrame([("docA", "x.pdf", "bn"), ("docB", "y.pdf", "bn")], "id string, filename string, language string"))


def test_built_points_have_unsigned_zeros_and_the_last_known_values(sources):
    built = retrieval.build_points(*sources)
    assert dict(built.dtypes)["dense"] == "array<float>"
    got = {r["chunk_id"]: (str(list(r["dense"])), r["model"]) for r in built.collect()}
    assert got == {"a": ("[0.0, 0.5]", "m"), "b": ("[0.0, None]", "m"), "c": ("[-0.5, 0.0]", None), "e": ("[0.0, 1.0]", "m")}


def test_points_left_after_a_deletion_have_unsigned_zeros(spark, sources, tmp_path):
    for name, table in zip(("vector_rows", "chunks", "document_embeddings", "documents"), sources):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    left = queries.delete_document(spark, str(tmp_path)).collect()
    assert [(r["chunk_id"], r["document_id"], str(list(r["dense"]))) for r in left] == [("e", "docB", "[0.0, 1.0]")]


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    rows = [r["dense"] for r in HashedEmbedder(16).embed(df, "t").collect()]
    assert rows[0] == rows[1] != rows[2] and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in rows)
    model = ModelEmbedder("n", 2, lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert model.model_id == "n:2" and len(model.embed(df, "t").collect()) == 4
    with pytest.raises(KeyError, match="fake"):
        embedder("none")


# --- answers ---------------------------------------------------------------------------------------------


def outcome(spark, payload, scores=(0.9, 0.8), threshold=0.5):
    hits = spark.createDataFrame([("q", f"c{i}", 1, f"span number {i} tells of rivers", s) for i, s in enumerate(scores, 1)], "question string, chunk_id string, page_no int, text string, gate_score double")
    q = spark.createDataFrame([("q",)], "question string")
    gated = answering.gate(q, retrieval.score_summary(hits, ["question"]), threshold)
    spans = answering.number_spans(hits)
    made = spark.createDataFrame([("q", json.dumps(payload))], "question string, payload string").withColumn("payload", F.from_json("payload", answering.PAYLOAD))
    return answering.outcomes(gated, made, answering.check_claims(made, spans)).collect()[0]


def claim(span, quote):
    return {"claim": quote, "span_id": span, "quote": quote}


@pytest.mark.parametrize(
    "payload,answered,reason,grounded",
    [
        ({"sufficient": True, "answer": "x", "claims": [claim("S1", "number tells rivers")]}, True, None, 1),
        ({"sufficient": False, "answer": "", "claims": []}, False, answering.INSUFFICIENT, 0),
        ({"sufficient": True, "answer": "x", "claims": []}, False, answering.NO_CLAIMS, 0),
        ({"sufficient": True, "answer": "x", "claims": [claim("S99", "rivers")]}, False, "answer cited span id(s) that were not supplied: ['S99'] - treating the answer as unfounded", 0),
        ({"sufficient": True, "answer": "x", "claims": [claim("S1", "wholly invented words")]}, False, answering.UNGROUNDED, 0),
        ({"sufficient": True, "answer": "x", "claims": [claim("S2", "tells rivers"), claim("S1", "made up")]}, True, None, 1),
        ({"sufficient": True, "answer": "x", "claims": [{"span_id": "S1"}]}, False, answering.UNGROUNDED, 0),
    ])
def test_outcomes(spark, payload, answered, reason, grounded):
    r = outcome(spark, payload)
    assert (r["answered"], r["abstain_reason"], r["claims_grounded"]) == (answered, reason, grounded)
    assert bool(r["warnings"]) == (answered and grounded < len(payload["claims"]))


def test_gate(spark):
    good = {"sufficient": True, "answer": "x", "claims": [claim("S1", "rivers")]}
    assert outcome(spark, good, (0.49,))["abstain_reason"] == "best score 0.4900 is below the threshold 0.5"
    assert outcome(spark, good, (0.5,))["answered"]
    q = spark.createDataFrame([("z",)], "question string")
    none = answering.gate(q, spark.createDataFrame([], "question string, best_score double"), 0.5).collect()[0]
    assert none["abstain_reason"] == answering.NO_HITS


def test_sweep_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.6, None if rng.random() < 0.1 else round(rng.uniform(-1, 1), rng.choice([1, 2, 5]))) for _ in range(300)]
    got = [tuple(r) for r in answering.threshold_sweep(spark.createDataFrame(rows, "answerable boolean, best double")).collect()]
    cuts = sorted({round(b, 3) for _, b in rows if b is not None})
    want = [(c, sum(a and b is not None and b >= c for a, b in rows), sum(a for a, b in rows if not (b is not None and b >= c)), sum(not a for a, b in rows if not (b is not None and b >= c)), sum((not a) and b is not None and b >= c for a, b in rows)) for c in [cuts[0] - 0.5, *cuts]]
    assert [g[1:] for g in got] == [w[1:] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
    best = answering.best_cutoff(answering.threshold_sweep(spark.createDataFrame(rows, "answerable boolean, best double"))).collect()
    assert [tuple(b)[1:] for b in best] == [w[1:] for w in want if w[4] == 0][:1]
    with pytest.raises(ValueError):
        answering.check_sweep(spark.createDataFrame([(True, 0.1)], "answerable boolean, best double"), True)


# --- stages ----------------------------------------------------------------------------------------------


def runs(spark, status):
    return spark.createDataFrame([("d", s, *(x if isinstance(x, tuple) else (x, 0))) for s, x in zip(stages.STAGES, status)], "document_id string, stage string, status string, attempt int")


@pytest.mark.parametrize(
    "status,following",
    [
        (["pending"] * 6, "extract"),
        (["succeeded", "skipped", "pending", "pending", "pending", "pending"], "normalize"),
        (["succeeded", "succeeded", "held", "pending", "pending", "pending"], None),
        ([("failed", 1)] + ["pending"] * 5, "extract"),
        ([("failed", 3)] + ["pending"] * 5, None),
        (["running"] + ["pending"] * 5, None),
        (["succeeded"] * 5 + ["stale"], "index"),
    ])
def test_next_runnable(spark, status, following):
    got = stages.next_runnable(runs(spark, status)).collect()
    assert [r["stage"] for r in got] == ([following] if following else [])


def test_blocker_messages(spark):
    got = {r["stage"]: r for r in stages.with_blockers(runs(spark, ["succeeded", "held", "failed", "pending", "pending", "pending"])).collect()}
    assert list(got["chunk"]["blockers"]) == ["`ocr` is held for review", "`normalize` is failed"] and got["ocr"]["manual"] and not got["extract"]["manual"] and got["extract"]["forced"]


def test_run_and_advance(spark):
    docs = spark.createDataFrame([("d",), ("e",)], "id string")
    r = stages.ensure_stage_runs(docs, runs(spark, ["succeeded", "succeeded", "succeeded", "succeeded", "pending", "failed"]))
    assert r.count() == 12 and stages.ensure_stage_runs(docs, r).count() == 12
    ok = lambda w: w.withColumn("result", F.lit("succeeded"))
    forced = stages.run_stage(r, spark.createDataFrame([("d", "ocr")], "document_id string, stage string"), ok, force=True)
    assert {x["stage"]: (x["status"], x["attempt"]) for x in forced.where("document_id = 'd'").collect()} == {
        "extract": ("succeeded", 0), "ocr": ("succeeded", 1), "normalize": ("stale", 0), "chunk": ("stale", 0), "embed": ("pending", 0), "index": ("stale", 0)}
    refused = stages.run_stage(r, spark.createDataFrame([("d", "ocr")], "document_id string, stage string"), ok)
    assert refused.where("attempt > 0").count() == 0
    assert all(x["done"] for x in stages.summary(stages.advance(r, ok)).collect())
    failing = stages.advance(r, lambda w: w.withColumn("result", F.when(F.col("stage") == "ocr", "failed").otherwise("succeeded")))
    assert {x["stage"]: x["status"] for x in failing.where("document_id = 'e'").collect()}["normalize"] == "pending"


def test_cascade(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int")
    kept, rest = pages.delete_documents(docs, {"c": child}, docs.where("id = 'a'"))
    assert [r["id"] for r in kept.collect()] == ["b"] and [r["n"] for r in rest["c"].collect()] == [2]


# --- files and streams -----------------------------------------------------------------------------------


def test_uploads(spark, tmp_path):
    for name, body in {"a.pdf": b"one", "b.PDF": b"one", "c.txt": b"x", "d.pdf": b""}.items():
        (tmp_path / name).write_bytes(body)
    up = files.read_uploads(spark, str(tmp_path))
    assert {r["filename"]: (r["sha256"], r["byte_size"]) for r in up.collect()} == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in {"a.pdf": b"one", "b.PDF": b"one", "d.pdf": b""}.items()}
    stored = spark.createDataFrame([(hashlib.sha256(b"").hexdigest(),)], "sha256 string")
    assert [r["filename"] for r in files.new_uploads(up, stored).collect()] == ["a.pdf"]


def test_small_files(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question": "a?", "answerable": true}, {"question": "b?", "answerable": false}]')
    assert files.read_questions(spark, str(tmp_path / "q.json")).count() == 2
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "p1.txt").write_text("# note\n\nএকটি নদী\nদুই\n")
    assert len(files.write_gold_templates(str(gold), ["p1", "p2"], "type here")) == 1
    assert [r["gold_text"] for r in files.read_gold(spark, str(gold)).collect()] == ["একটি নদী\nদুই"]
    assert files.unpack(files.pack([[0.5, -0.25]]), 2).tolist() == [[0.5, -0.25]] and files.pack([]) == b"" and len(files.pack([[0.0] * 1024])) == 4096
    with pytest.raises(ValueError):
        files.unpack(b"12345", 1)
    (tmp_path / "v.f32").write_bytes(files.pack([[1, 2], [3, 4]]))
    assert [(r["row_no"], list(r["dense"])) for r in files.read_float32(spark, str(tmp_path / "v.f32"), 2).orderBy("row_no").collect()] == [(0, [1, 2]), (1, [3, 4])]
    files.write_report(spark.range(2), str(tmp_path / "r"), "T")
    assert "| 1 |" in (tmp_path / "r.md").read_text()
    files.write_artifact(spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int"), str(tmp_path / "art"))
    files.write_artifact(spark.createDataFrame([("a", 5)], "document_id string, n int"), str(tmp_path / "art"))
    assert {(r["document_id"], r["n"]) for r in spark.read.json(str(tmp_path / "art")).collect()} == {("a", 5), ("b", 2)}
    assert files.pending_migrations(spark, ["002", "001", "003"], spark.createDataFrame([("001",)], "filename string")) == ["002", "003"]
    assert files.health(spark)["ok"]


@pytest.mark.parametrize("spec,numbers", [("2,3,5", [2, 3, 5]), ("4-6", [4, 5, 6]), ("all", list(range(1, 10))), ("1, 3-4", [1, 3, 4])])
def test_page_selection(spec, numbers):
    assert files.read_pages_selection(spec, 9) == numbers
    with pytest.raises(ValueError):
        files.read_pages_selection("8-12", 9)


def test_event_fold():
    s = [("pending", 0)] * 6
    for stage in stages.STAGES[:3]:
        s = stage_log.apply_event(stage_log.apply_event(s, stage, "start"), stage, "succeed")
    s = stage_log.apply_event(stage_log.apply_event(s, "extract", "start"), "extract", "succeed")
    assert s == [("succeeded", 2), ("stale", 1), ("stale", 1), ("pending", 0), ("pending", 0), ("pending", 0)]
    assert stage_log.apply_event(s, "none", "start") == s


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("d", "extract", "start", datetime(2024, 1, 1), 1), ("d", "extract", "succeed", datetime(2024, 1, 1), 2), ("e", "extract", "fail", datetime(2024, 1, 2), 3)], "document_id string, stage string, event string, ts timestamp, seq long")
    log.write.parquet(str(tmp_path / "log"))
    stage_log.run_to_end(stage_log.stage_runs(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))), "runs_now", "update", str(tmp_path / "cp1"))
    got = {(r["document_id"], r["stage"]): r["status"] for r in spark.table("runs_now").collect()}
    assert got["d", "extract"] == "succeeded" and got["e", "extract"] == "failed" and len(got) == 12
    p = spark.createDataFrame([("d", 1, "ocr", "x", datetime(2024, 1, 1)), ("d", 1, "ocr", "x", datetime(2024, 1, 2)), ("d", 2, "ocr", None, datetime(2024, 1, 2))], "document_id string, page_no int, source string, raw_text string, updated_at timestamp")
    p.write.parquet(str(tmp_path / "pages"))
    stream = stage_log.page_stream(spark, str(tmp_path / "pages"), "document_id string, page_no int, source string, raw_text string, updated_at timestamp")
    stage_log.run_to_end(stream, "pages_now", checkpoint=str(tmp_path / "cp2"))
    assert spark.table("pages_now").count() == 2


def test_service(spark, points):
    from pagemill.service import Service, handle

    docs = spark.createDataFrame([("docA", "a.pdf", "f" * 64, 5, 1, "bn", True, "note", datetime(2024, 1, 1))], "id string, filename string, sha256 string, byte_size long, page_count int, language string, review_required boolean, review_note string, uploaded_at timestamp")
    own = spark.createDataFrame([("docA", 1, "ocr", True, "raw", "text")], "document_id string, page_no int, source string, trustworthy boolean, raw_text string, text string")
    collections = spark.createDataFrame([("pages_main", "fake:8", 8, None, None)], "name string, model string, dim int, created_at timestamp_ntz, updated_at timestamp_ntz")
    ok = lambda w: w.withColumn("result", F.lit("succeeded"))
    s = Service(spark, docs, own, stages.ensure_stage_runs(docs, runs(spark, [])), points.withColumn("model", F.lit("fake:8")), collections, embedder=HashedEmbedder(8), stage_functions={"extract": ok}, threshold=2.0)
    assert handle(s, "GET", "/health")[0] == 200
    assert handle(s, "GET", "/documents")[1][0]["sha12"] == "f" * 12
    assert handle(s, "GET", "/documents/docA/pages/1?raw=1") == (200, {"text": "raw"})
    assert handle(s, "GET", "/documents/none")[0] == 404
    assert handle(s, "POST", "/documents/docA/stages/extract/run", {})[0] == 200
    assert handle(s, "POST", "/documents/docA/stages/extract/run", {})[0] == 409
    assert handle(s, "POST", "/documents/docA/stages/ocr/run", {})[0] == 501
    status, answer = handle(s, "POST", "/ask", {"question": "what?"})
    assert status == 200 and "below the threshold" in answer["abstain_reason"]
    assert len(handle(s, "GET", "/review")[1]) == 1


def test_entry_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "pagemill.llm", None)
    assert "chunk_pages" in entry.queries() and not any(re.match(r"p\d+_", n) for n in entry.queries())
