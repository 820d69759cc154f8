"""The queries of the core operators. Each takes (spark, data directory) and reads whole tables.

Pages and chunks come with repeated deliveries; queries that must count them once take the latest of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import hashing as H
from pagemill.functions import script as S
from pagemill.functions import tokens as T
from pagemill.operators import answering as A
from pagemill.operators import chunking as C
from pagemill.operators import ocrbench as O
from pagemill.operators import pages as P
from pagemill.operators import retrieval as R
from pagemill.operators import stages as G
from pagemill.plugins import HashedEmbedder, Passthrough
from pagemill.sources.tables import read_table

_KEYS = ["document_id", "page_no"]


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of each page, with these columns alone."""
    return P.latest(read_table(spark, d, "document_pages").select(*_KEYS, "updated_at", *columns), _KEYS, "updated_at")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of each chunk, with these columns alone."""
    return P.latest(read_table(spark, d, "chunks").select("id", "created_at", *columns), ["id"], "created_at")


def _embeddings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return P.latest(read_table(spark, d, "document_embeddings").select("document_id", "created_at", *columns), ["document_id"], "created_at")


# --- documents and pages ---------------------------------------------------------------------------------


def dedupe_uploads(spark, d):
    return P.dedupe_uploads(read_table(spark, d, "documents"))


def document_listing(spark, d):
    return P.listing(read_table(spark, d, "documents"))


def review_queue(spark, d):
    return P.review_queue(read_table(spark, d, "documents"))


def page_details(spark, d):
    return _pages(spark, d, "source", "ocr_engine", "trustworthy", "text").select(*_KEYS, "source", "ocr_engine", "trustworthy", F.length("text").cast("long").alias("chars"))


def page_text(spark, d):
    """The two views of a page: raw and normalised, null as empty."""
    return _pages(spark, d, "raw_text", "text").select(*_KEYS, F.coalesce("raw_text", F.lit("")).alias("raw"), F.coalesce("text", F.lit("")).alias("normal"))


def decode_quality(spark, d):
    q = P.decoded_quality(_pages(spark, d, "quality"))
    return q.select(*_KEYS, "valid", "bengali_ratio", "initial_dependent_rate", "triple_letter_runs", "tokens", "chars", "fonts_ok")


def pages_needing_ocr(spark, d):
    return _pages(spark, d, "source").where(F.col("source").isin("needs_ocr", "empty")).select(*_KEYS, "source")


def documents_without_text(spark, d):
    """Documents that normalising must refuse: pages without text, with the first five of them."""
    bad = _pages(spark, d, "source").where(F.col("source").isin("needs_ocr", "empty")).select(*_KEYS)
    counts = bad.groupBy("document_id").agg(F.count("*").alias("pages"))
    return counts.join(P.first_pages(bad, 5), "document_id").select("document_id", "pages", F.array_join("first_pages", ",").alias("first_pages"))


def pages_by_source(spark, d):
    return _pages(spark, d, "source", "trustworthy").groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.when(F.col("trustworthy"), 1).otherwise(0)).alias("usable"))


def usable_pages(spark, d):
    return C.usable_pages(_pages(spark, d, "text", "trustworthy")).select(*_KEYS)


# --- script and spelling ---------------------------------------------------------------------------------


def script_ratio(spark, d):
    return _pages(spark, d, "raw_text").where("raw_text is not null").select(*_KEYS, F.round(S.script_ratio(F.col("raw_text")), 6).alias("ratio"))


def orthographic_report(spark, d):
    o = S.orthography(F.col("raw_text"))
    rows = _pages(spark, d, "raw_text").where("raw_text is not null").select(*_KEYS, o.alias("o"))
    return rows.select(*_KEYS, "o.tokens", "o.initial_dependent", F.round("o.rate", 6).alias("rate"), F.array_join("o.samples", " ").alias("samples"), "o.triples", "o.orphaned", S.looks_corrupt(F.col("o.rate"), F.col("o.triples")).alias("corrupt"))


def latin_intrusion(spark, d):
    x = S.latin_intrusion(F.col("raw_text"))
    rows = _pages(spark, d, "raw_text").where("raw_text is not null").select(*_KEYS, x.alias("x"))
    return rows.select(*_KEYS, "x.latin", "x.total", F.round("x.rate", 6).alias("rate"), F.array_join("x.samples", " ").alias("samples"))


def nfc_normalize(spark, d):
    rows = _pages(spark, d, "raw_text").where("raw_text is not null").select(*_KEYS, "raw_text", S.nfc(F.col("raw_text")).alias("normal"))
    return rows.select(*_KEYS, "normal", (F.col("normal") != F.col("raw_text")).alias("changed"))


def triage_source(spark, d):
    rows = P.decoded_quality(_pages(spark, d, "raw_text", "quality"), "raw_text")
    source = S.triage(F.col("raw_text"), F.col("fonts_ok"))
    return rows.select(*_KEYS, source.alias("source"), F.when(source == "textlayer", F.col("raw_text")).alias("kept_text"))


def triage_counts(spark, d):
    return triage_source(spark, d).groupBy("source").agg(F.count("*").alias("pages"))


def page_measures(spark, d):
    m = P.page_measures(_pages(spark, d, "raw_text"))
    return m.select(*_KEYS, "tokens", "initial_dependent", "triple_letter_runs", "orphaned_signs", "chars")


def validity_gate(spark, d):
    return P.gate(_pages(spark, d, "raw_text"))


def document_hold(spark, d):
    h = P.document_hold(P.gate(_pages(spark, d, "raw_text")))
    return h.withColumn("failed_pages", F.array_join("failed_pages", ","))


def probe_verdict(spark, d):
    return P.probe_verdict(P.decoded_quality(_pages(spark, d, "raw_text", "quality"), "raw_text"))


def bad_fonts(spark, d):
    """Font keys that a page's quality names, with the number of pages."""
    q = P.decoded_quality(_pages(spark, d, "quality")).select(F.explode("bad_fonts").alias("font"))
    return q.groupBy(S.font_key(F.col("font")).alias("font")).agg(F.count("*").alias("pages"), F.max(F.when(S.legacy_font(F.col("font")), 1).otherwise(0)).alias("legacy"))


# --- chunks ----------------------------------------------------------------------------------------------


def paragraph_counts(spark, d):
    """Paragraphs (spans between blank lines that aren't blank) of each page."""
    parts = F.split("text", r"\n(?U:[\s\x1c-\x1f])*\n", -1)
    filled = F.filter(parts, lambda p: p.rlike(S.NOT_WS))
    return _pages(spark, d, "text").where("text is not null").select(*_KEYS, F.size(filled).cast("long").alias("paragraphs"), F.coalesce(F.array_max(F.transform(filled, F.length)), F.lit(0)).cast("long").alias("longest"))


def sentence_ends(spark, d):
    return C.sentence_counts(_pages(spark, d, "text"))


def chunk_pages(spark, d):
    return C.chunk_pages(C.usable_pages(_pages(spark, d, "text", "trustworthy"))).select("id", "ordinal", "char_start", "char_end", "text", "embed_text", "n_chars")


def chunk_metrics(spark, d):
    m = C.chunk_metrics(_pages(spark, d, "text", "trustworthy"), _chunks(spark, d, "document_id", "page_no", "char_start", "char_end").select("document_id", "page_no", (F.col("char_end") - F.col("char_start")).alias("n_chars")))
    return m.withColumn("skipped", F.array_join("skipped", ","))


def page_report(spark, d):
    r = C.page_report(_pages(spark, d, "text"), _chunks(spark, d, "document_id", "page_no", "ordinal", "char_start", "char_end").select("document_id", "page_no", "ordinal", (F.col("char_end") - F.col("char_start")).alias("n_chars")))
    return r.withColumn("sizes", F.array_join("sizes", ","))


def lead_ins(spark, d):
    return C.lead_ins(_chunks(spark, d, "document_id", "page_no", "ordinal", "char_start"))


def replace_chunks(spark, d):
    """The stored chunks with those of documents under review replaced by one chunk for each of their pages."""
    held = read_table(spark, d, "documents").where("review_required").select(F.col("id").alias("document_id"))
    stored = _chunks(spark, d, "document_id", "page_no", "char_end").select("id", *_KEYS, "char_end")
    whole = _pages(spark, d, "text").where("text is not null").join(held, "document_id", "left_semi")
    fresh = whole.select(F.concat_ws(":", "document_id", F.col("page_no").cast("string"), F.lit("0")).alias("id"), *_KEYS, F.length("text").alias("char_end"))
    return C.replace_documents(stored, fresh).select("id", *_KEYS, "char_end")


# --- vectors and search ----------------------------------------------------------------------------------


def hashed_embed(spark, d):
    """Every chunk's hashed vector."""
    rows = HashedEmbedder().embed(_chunks(spark, d, "embed_text").select("id", "embed_text"), "embed_text")
    return rows.select("id", F.transform("dense", lambda x: F.round(x, 6)).alias("dense"), F.size("dense").cast("long").alias("dim"))


def l2_normalize(spark, d):
    rows = read_table(spark, d, "vector_rows").where("dense is not null").distinct()
    return rows.select("vectors_path", "row_no", F.transform(H.l2(F.col("dense")), lambda x: F.round(x, 5)).alias("unit"))


def embed_stage(spark, d):
    """Per vector file: rows, distinct widths and whether its manifest agrees with the metadata."""
    v = read_table(spark, d, "vector_rows").distinct()
    e = _embeddings(spark, d, "vectors_path", "model", "dim", "n_chunks").select("vectors_path", "document_id", "model", "dim", "n_chunks")
    agg = v.groupBy("vectors_path").agg(F.count("*").alias("rows"), F.countDistinct(F.size("dense")).alias("widths"), F.max(F.size("dense")).alias("width"))
    return e.join(agg, "vectors_path").select("document_id", "model", "rows", "widths", ((F.col("rows") == F.col("n_chunks")) & (F.col("widths") == 1) & (F.col("width") == F.col("dim"))).alias("sound"))


def point_ids(spark, d):
    return R.point_ids(_chunks(spark, d))


def collection_info(spark, d):
    c = read_table(spark, d, "vector_collections")
    return R.collection_info(c, "pages_main").select(F.lit("pages_main").alias("name"), "found", "dim").unionByName(R.collection_info(c, "absent").select(F.lit("absent").alias("name"), "found", "dim"))


def ensure_collection(spark, d):
    same, _ = R.ensure_collection(read_table(spark, d, "vector_collections"), "pages_main", "bhashaki-small:64", 64)
    changed, made = R.ensure_collection(same, "pages_old", "bhashaki-small:64", 128)
    return changed.select("name", "model", "dim", F.lit(made).alias("created"))


def _points(spark, d) -> DataFrame:
    return R.build_points(*(read_table(spark, d, t) for t in ("vector_rows", "chunks", "document_embeddings", "documents")))


def build_points(spark, d):
    return _points(spark, d).select("point_id", "dense", "chunk_id", "document_id", "filename", "language", "page_no", "ordinal", "char_start", "char_end", "text", "model")


def index_checks(spark, d):
    return R.index_checks(read_table(spark, d, "vector_rows"), read_table(spark, d, "document_embeddings"), read_table(spark, d, "chunks"))


def model_changes(spark, d):
    return R.model_changes(read_table(spark, d, "document_embeddings"), "bhashaki-small:64")


def upsert_points(spark, d):
    """Vectors of label 3 written again under label 13; all others stay."""
    stored = read_table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    fresh = stored.where("label = 3").select("vec_id", F.lit(13).alias("label"), "embedding")
    return R.upsert_points(stored, fresh, "vec_id")


def delete_document(spark, d):
    """The points without those of the first document."""
    first = read_table(spark, d, "documents").agg(F.min("id").alias("id")).collect()[0]["id"]
    return R.delete_document(_points(spark, d), first).select("point_id", "document_id", "chunk_id", "dense")


def point_counts(spark, d):
    return _points(spark, d).groupBy("document_id").agg(F.count("*").alias("points"))


def citations(spark, d):
    """Every point as the citation of a candidate."""
    return R.citations(_points(spark, d)).select("citation.*")


def retrieve(spark, d):
    """The candidates of one question over all vectors, without a re-ranker's score."""
    points = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), F.lit("bhashaki-small:64").alias("model"), "label")
    hits = R.retrieve(points, read_table(spark, d, "vector_collections"), "pages_main", "q", _query_vector(spark, d, 7), "bhashaki-small:64", Passthrough())
    return hits.select("chunk_id", "label", F.round("gate_score", 6).alias("gate_score"))


def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    rows = read_table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").limit(1).collect()
    return list(rows[0][0]) if rows else [0.0] * 64


def dense_topk(spark, d):
    hits = R.dense_search(read_table(spark, d, "embeddings"), _query_vector(spark, d), 20, id_col="vec_id", vector="embedding")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def dense_topk_filtered(spark, d):
    points = read_table(spark, d, "embeddings").withColumn("document_id", F.col("label").cast("string"))
    hits = R.dense_search(points, _query_vector(spark, d), 20, "2", "vec_id", "embedding")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_batch(spark, d):
    """Every vector whose id is divisible by 50, against all vectors."""
    e = read_table(spark, d, "embeddings")
    return R.knn_batch(e.where("vec_id % 50 = 0"), e, 10, "vec_id", "vec_id", "embedding").select("q", "p", F.round("score", 6).alias("score"))


def _candidates(spark, d) -> DataFrame:
    """Hits of the knn queries as candidates of questions: the point's label parity is its model, half of them have a re-ranker's score."""
    e = read_table(spark, d, "embeddings")
    hits = R.knn_batch(e.where("vec_id % 50 = 0"), e, 20, "vec_id", "vec_id", "embedding")
    model = F.when(F.col("label") % 5 == 0, "").when(F.col("label") % 2 == 0, "m-even").otherwise("m-odd")
    return hits.join(e.select(F.col("vec_id").alias("p"), "label", model.alias("model")), "p").select(
        F.col("q").alias("question"), F.col("p").alias("chunk_id"), "model", "label", F.round("score", 6).alias("score"), F.when(F.col("p") % 2 == 0, F.round(1 - F.col("score"), 6)).alias("rerank_score"))


def model_guard(spark, d):
    return R.model_guard(_candidates(spark, d), "m-even").groupBy("question").agg(F.count("*").alias("kept"))


def rerank_sort(spark, d):
    return R.rerank_all(_candidates(spark, d), ["question"]).select("question", "place", "chunk_id", "gate_score")


def score_range(spark, d):
    c = _candidates(spark, d).withColumn("gate_score", F.coalesce("rerank_score", "score"))
    return R.score_summary(c, ["question"])


# --- answers ---------------------------------------------------------------------------------------------


def _questions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, spans, payloads) made from the chunks: each document is a question, its first chunks are the spans, and the claims quote them.

    The first byte of a document's sha256 decides what the generator does: 0-31 finds the spans insufficient, 32-63 makes no claim, 64-95 cites a span that wasn't given, 96-127 quotes the
    file name instead of a span, 128-159 mixes one true and one false quote; else it quotes each span truly. A quote is the span's whole text. Scores fall with the page.
    """
    docs = read_table(spark, d, "documents").select(F.col("id").alias("question"), "filename", F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int").alias("byte"))
    c = _chunks(spark, d, "document_id", "page_no", "ordinal", "char_start", "text").where("text is not null").select(
        F.col("document_id").alias("question"), F.col("id").alias("chunk_id"), "page_no", "char_start", "text", (1 / (F.lit(1.0) + F.col("page_no") + F.col("ordinal"))).alias("gate_score"))
    spans = A.number_spans(c)
    given = spans.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("span_id", F.col("text").alias("quote")))).alias("s"))
    b, s = F.col("byte"), F.col("s")

    def claim(span: Column, quote: Column) -> Column:
        return F.struct(quote.alias("claim"), span.alias("span_id"), quote.alias("quote"))

    true = F.transform(s, lambda x: claim(x["span_id"], x["quote"]))
    first = F.element_at(s, 1)
    claims = (
        F.when(b < 64, F.slice(true, 1, 0)).when(b < 96, F.array(claim(F.lit("S99"), first["quote"]))).when(b < 128, F.array(claim(first["span_id"], F.col("filename"))))
        .when(b < 160, F.array(claim(first["span_id"], first["quote"]), claim(first["span_id"], F.col("filename")))).otherwise(true))
    payloads = docs.join(given, "question").select("question", F.struct((b >= 32).alias("sufficient"), F.lit("see claims").alias("answer"), claims.alias("claims")).alias("payload"))
    return docs, spans, payloads


def token_overlap(spark, d):
    """Overlap of each chunk's whole text with its page text."""
    c = _chunks(spark, d, "document_id", "page_no", "text").where("text is not null").select("id", *_KEYS, F.col("text").alias("claim"))
    p = _pages(spark, d, "text").where("text is not null").select(*_KEYS, F.col("text").alias("span"))
    return c.join(p, _KEYS).select("id", F.size(T.claim_tokens(F.col("claim"))).cast("long").alias("tokens"), F.round(T.overlap(F.col("claim"), F.col("span")), 6).alias("overlap"))


def span_numbers(spark, d):
    _, spans, _ = _questions(spark, d)
    return spans.select("question", "span_id", "chunk_id")


def span_blocks(spark, d):
    _, spans, _ = _questions(spark, d)
    return A.span_block(spans)


def abstain_gate(spark, d):
    docs, spans, _ = _questions(spark, d)
    return A.gate(docs, R.score_summary(spans, ["question"]), 0.45).select("question", F.round("best_score", 6).alias("best_score"), "abstain_reason")


def citation_check(spark, d):
    _, spans, payloads = _questions(spark, d)
    return A.check_claims(payloads, spans).select("question", F.col("pos").cast("long").alias("pos"), "span_id", "chunk_id", "quote_overlap", "grounded")


def answer_outcome(spark, d):
    docs, spans, payloads = _questions(spark, d)
    gated = A.gate(docs, R.score_summary(spans, ["question"]), 0.45)
    out = A.outcomes(gated, payloads, A.check_claims(payloads, spans))
    return out.select("question", "answered", "claims_total", "claims_grounded", "abstain_reason", F.array_join("warnings", "; ").alias("warnings"))


def outcome_counts(spark, d):
    return answer_outcome(spark, d).groupBy("answered").agg(F.count("*").alias("questions"), F.sum("claims_grounded").alias("claims_grounded"))


def _scored(spark, d) -> DataFrame:
    """A question for each document: answerable unless it is under review; its best score is the mean position of its chunks, null without chunks."""
    docs = read_table(spark, d, "documents").select(F.col("id").alias("document_id"), (~F.col("review_required")).alias("answerable"))
    best = _chunks(spark, d, "document_id", "page_no").groupBy("document_id").agg((F.count("*") / (F.lit(1.0) + F.max("page_no") + F.count("*"))).alias("best"))
    return docs.join(best, "document_id", "left").select("answerable", "best")


def threshold_sweep(spark, d):
    return A.threshold_sweep(_scored(spark, d))


def best_cutoff(spark, d):
    return A.best_cutoff(A.threshold_sweep(_scored(spark, d)))


# --- OCR bench -------------------------------------------------------------------------------------------


def _outputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(outputs, gold): for each gold page its stored OCR text under the engine's name, the same text after normalising as ``normal``, and the text without its first line as ``textlayer``."""
    gold = read_table(spark, d, "gold_pages").where("gold_text is not null")
    p = _pages(spark, d, "raw_text", "text").join(gold.select(*_KEYS), _KEYS, "left_semi").where("raw_text is not null")
    made = {"scan": F.col("raw_text"), "normal": F.col("text"), "textlayer": F.regexp_replace("raw_text", r"^[^\n]*\n", "")}
    each = F.explode(F.array(*[F.struct(F.lit(engine).alias("engine"), text.alias("text")) for engine, text in made.items()])).alias("o")
    return p.select(*_KEYS, each).select(*_KEYS, "o.engine", "o.text"), gold


def cer_wer(spark, d):
    outputs, gold = _outputs(spark, d)
    return O.page_scores(outputs, gold, _KEYS).select(*_KEYS, "engine", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


def cer_scores(spark, d):
    outputs, gold = _outputs(spark, d)
    return O.page_scores(outputs, gold, _KEYS).select(*_KEYS, "engine", F.round("cer", 6).alias("cer"))


def high_error(spark, d):
    outputs, gold = _outputs(spark, d)
    return O.high_error(O.page_scores(outputs, gold, _KEYS)).select(*_KEYS, "engine", F.round("cer", 6).alias("cer"))


def side_by_side(spark, d):
    """The first lines of each engine's output of a page, together."""
    return O.side_by_side(_outputs(spark, d)[0], _KEYS)


def ocr_signals(spark, d):
    outputs, _ = _outputs(spark, d)
    return O.quality_signals(outputs, _KEYS).select(*_KEYS, "engine", "chars", "tokens", F.round("ratio", 6).alias("ratio"), F.round("rate", 6).alias("rate"), "triples")


def consensus(spark, d):
    outputs, _ = _outputs(spark, d)
    return O.consensus(outputs, _KEYS).select(*_KEYS, "engine_a", "engine_b", F.round("similarity", 6).alias("similarity"))


def worst_pairs(spark, d):
    return O.worst_pairs(consensus(spark, d), _KEYS)


def mean_agreement(spark, d):
    return O.mean_agreement(consensus(spark, d), _KEYS).select(*_KEYS, "engine", F.round("agreement", 6).alias("agreement"))


def engine_ranking(spark, d):
    outputs, gold = _outputs(spark, d)
    pairs = O.consensus(outputs, _KEYS)
    seconds = outputs.select("engine", F.length("text").cast("double").alias("seconds"))
    return O.ranking(O.quality_signals(outputs, _KEYS), O.mean_agreement(pairs, _KEYS), O.page_scores(outputs, gold, _KEYS), seconds, _KEYS).select(
        "place", "engine", "pages", *[F.round(c, 4).alias(c) for c in ("chars", "rate", "agreement", "cer", "wer")])


def engine_means(spark, d):
    """Pages and mean characters by the engine that read them."""
    p = _pages(spark, d, "source", "ocr_engine", "raw_text").where("source = 'ocr'")
    return p.groupBy(F.coalesce("ocr_engine", F.lit("none")).alias("engine")).agg(F.count("*").alias("pages"), F.round(F.avg(F.length("raw_text")), 4).alias("mean_chars"))


def ocr_totals(spark, d):
    """Per document: its OCR run's pages, time, failures and status; a page's time stands for its characters, an OCR page without a text for a failure."""
    p = _pages(spark, d, "source", "raw_text").where("source = 'ocr'")
    failed = F.coalesce(F.length(S.trim_ws(F.col("raw_text"))), F.lit(0)) == 0
    return O.run_totals(p.select(*_KEYS, (F.length("raw_text") / 1000).alias("seconds"), F.when(failed, "no text").alias("error")))


def ocr_uncached(spark, d):
    """Pages that no engine has read yet, against the stored results."""
    p = _pages(spark, d, "source", "ocr_engine")
    wanted = p.where(F.col("source").isin("ocr", "needs_ocr", "empty")).select(*_KEYS, F.lit("tesseract").alias("engine"))
    have = p.where("source = 'ocr'").select(*_KEYS, F.col("ocr_engine").alias("engine"))
    return O.uncached(wanted, have, _KEYS).select(*_KEYS)


# --- stages ----------------------------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """A run for each document and stage whose byte of the sha256 is below 235, its status and attempt drawn from that byte."""
    docs = read_table(spark, d, "documents").where("sha256 is not null")
    parts = F.array(*[F.struct(F.lit(s).alias("stage"), F.conv(F.substring("sha256", 2 * i + 1, 2), 16, 10).cast("int").alias("b")) for i, s in enumerate(G.STAGES)])
    rows = docs.select(F.col("id").alias("document_id"), F.explode(parts).alias("x")).select("document_id", "x.stage", "x.b").where("b < 235")
    b = F.col("b")
    status = F.when(b < 150, "succeeded").when(b < 160, "skipped").when(b < 175, "failed").when(b < 185, "held").when(b < 205, "stale").when(b < 215, "running").otherwise("pending")
    return rows.select("document_id", "stage", status.alias("status"), (b % 5).alias("attempt"))


def ensure_stage_runs(spark, d):
    return G.ensure_stage_runs(read_table(spark, d, "documents"), _runs(spark, d))


def stage_blockers(spark, d):
    b = G.with_blockers(G.ensure_stage_runs(read_table(spark, d, "documents"), _runs(spark, d)))
    return b.select("document_id", "stage", "status", F.array_join("blockers", ", ").alias("blockers"), "auto", "manual", "forced")


def next_runnable(spark, d):
    return G.next_runnable(G.ensure_stage_runs(read_table(spark, d, "documents"), _runs(spark, d)))


def mark_stale(spark, d):
    """After every document's normalize stage gave a result."""
    runs = _runs(spark, d)
    return G.mark_stale(runs, runs.where("stage = 'normalize'").select("document_id", "stage"))


def stage_counts(spark, d):
    return _runs(spark, d).groupBy("stage", "status").agg(F.count("*").alias("runs"), F.sum("attempt").cast("long").alias("attempts"))


def run_stage(spark, d):
    """The normalize stage run by hand for every document that may run it, with success."""
    runs = G.ensure_stage_runs(read_table(spark, d, "documents"), _runs(spark, d))
    wanted = read_table(spark, d, "documents").select(F.col("id").alias("document_id"), F.lit("normalize").alias("stage"))
    return G.run_stage(runs, wanted, lambda w: w.withColumn("result", F.lit("succeeded"))).select("document_id", "stage", "status", "attempt")


def advance_stages(spark, d):
    """Every document advanced as far as it goes, when each stage succeeds."""
    runs = G.ensure_stage_runs(read_table(spark, d, "documents"), _runs(spark, d))
    return G.summary(G.advance(runs, lambda w: w.withColumn("result", F.lit("succeeded"))))


def latest_events(spark, d):
    """The latest event of each user: the view of an append-only run log by key."""
    return read_table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"), F.count("*").alias("events")).select("user_id", "e.event_id", "e.event_type", "events")


def delete_cascade(spark, d):
    """What is left of the child tables when the documents under review are deleted."""
    docs = read_table(spark, d, "documents")
    kept, children = P.delete_documents(docs, {"document_pages": _pages(spark, d), "chunks": _chunks(spark, d, "document_id"), "document_embeddings": _embeddings(spark, d)}, docs.where("review_required"))
    out = kept.agg(F.lit("documents").alias("table"), F.count("*").alias("rows"))
    for name, t in children.items():
        out = out.unionByName(t.agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    return out


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == __name__ and n != "queries"}
