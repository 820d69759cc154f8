"""Documents and pages: deduplication, listings, quality decoding, the validity gate and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import script as S


def latest(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """One row per key: the latest by ``stamp`` (nulls last); equal stamps by the smallest of the other columns that can be compared, so that the choice is stable."""
    rest = [c for c, t in rows.dtypes if c not in keys and c != stamp and not t.startswith(("map", "variant"))]
    w = Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_uploads(documents: DataFrame) -> DataFrame:
    """id, kept_id, created: each upload with the id of the document that its content is stored under (the earliest upload of the same sha256; a null hash is nobody's copy)."""
    w = Window.partitionBy("sha256").orderBy(F.col("uploaded_at").asc_nulls_last(), "id")
    hashed = documents.where("sha256 is not null").select("id", F.first("id").over(w).alias("kept_id"))
    bare = documents.where("sha256 is null").select("id", F.col("id").alias("kept_id"))
    return hashed.unionByName(bare).withColumn("created", F.col("id") == F.col("kept_id"))


def listing(documents: DataFrame) -> DataFrame:
    """The summary projection, newest first."""
    return documents.select("id", "filename", F.substring("sha256", 1, 12).alias("sha12"), "byte_size", "page_count", "language", "review_required", "review_note", "uploaded_at").orderBy(F.col("uploaded_at").desc_nulls_last(), "id")


def review_queue(documents: DataFrame) -> DataFrame:
    return documents.where("review_required").select("id", "filename", "review_note", "uploaded_at").orderBy(F.col("uploaded_at").desc_nulls_last(), "id")


def decoded_quality(pages: DataFrame, *keep: str) -> DataFrame:
    """document_id, page_no, updated_at, the columns ``keep``, valid, and the members of quality: numbers as double (numbers in strings too), fonts_ok, bad_fonts, samples. Invalid JSON leaves valid false and the rest null."""
    parsed = F.try_parse_json("quality")

    def member(name: str, kind: str):
        return F.try_variant_get(parsed, f"$.{name}", kind).alias(name)

    return pages.select(
        "document_id", "page_no", "updated_at", *keep, (F.col("quality").isNotNull() & parsed.isNotNull()).alias("valid"),
        *[member(n, "double") for n in ("bengali_ratio", "initial_dependent_rate", "triple_letter_runs", "tokens", "chars")],
        member("fonts_ok", "boolean"), member("bad_fonts", "array<string>"), member("samples", "array<string>"))


def page_measures(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """The quality members computed afresh for each page with a text: ratio and rate to four decimals, tokens, triples, chars, samples."""
    t = F.col(text)
    o = S.orthography(t)
    return pages.where(t.isNotNull()).select(
        "document_id", "page_no", F.bround(S.script_ratio(t), 4).alias("bengali_ratio"), F.bround(o["rate"], 4).alias("initial_dependent_rate"),
        o["tokens"].alias("tokens"), o["initial_dependent"].alias("initial_dependent"), o["triples"].alias("triple_letter_runs"), o["orphaned"].alias("orphaned_signs"), F.length(t).cast("long").alias("chars"),
        o["samples"].alias("samples"))


def gate(pages: DataFrame) -> DataFrame:
    """document_id, page_no, trustworthy, latin_suspect, chars: the validity gate on the NFC text of pages with a raw_text. A page that fails is never latin_suspect."""
    normal = pages.where("raw_text is not null").select("document_id", "page_no", S.nfc(F.col("raw_text")).alias("t"))
    o, latin = S.orthography(F.col("t")), S.latin_intrusion(F.col("t"))
    good = ~S.looks_corrupt(o["rate"], o["triples"])
    return normal.select("document_id", "page_no", good.alias("trustworthy"), (good & (latin["rate"] > S.LATIN_RATE)).alias("latin_suspect"), F.length("t").alias("chars"))


def first_pages(pages: DataFrame, most: int) -> DataFrame:
    """document_id, first_pages: the first page numbers of each document, at most ``most``. Only so many of a document are ever together."""
    w = Window.partitionBy("document_id").orderBy("page_no")
    few = pages.select("document_id", "page_no").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return few.groupBy("document_id").agg(F.array_sort(F.collect_list("page_no")).alias("first_pages"))


def document_hold(gated: DataFrame) -> DataFrame:
    """Per document: pages, trustworthy, failed, total_chars, latin_suspect pages, failed_pages (the first 50), status (held when any page failed), review_required, review_note
    (how many pages failed and the first 8 of them; null when none) and note (the same, or how many passed and the first 5 pages that Latin words intrude on).
    """
    bad = ~F.col("trustworthy")
    kind = F.when(bad, "failed").when(F.col("latin_suspect"), "latin").otherwise("good")
    order = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("page_no"))
    listed = lambda name, most: F.array_sort(F.collect_list(F.when((F.col("kind") == name) & (F.col("n") <= most), F.col("page_no"))))
    # the gate is worked out once; of a document only the page numbers that are listed come together
    out = gated.withColumn("kind", kind).withColumn("n", order).groupBy("document_id").agg(
        F.count("*").alias("pages"), F.sum(F.col("trustworthy").cast("long")).alias("trustworthy"), F.sum(bad.cast("long")).alias("failed"),
        F.sum("chars").alias("total_chars"), F.sum(F.col("latin_suspect").cast("long")).alias("latin_suspect"), listed("failed", 50).alias("failed_pages"), listed("latin", 5).alias("latin_pages"))
    held = F.col("failed") > 0
    numbers = lambda c: F.array_join(c, ", ")
    review = F.concat(F.col("failed").cast("string"), F.lit(" page(s) failed the text check (pages "), numbers(F.slice("failed_pages", 1, 8)), F.lit(")"))
    passed = F.concat(
        F.col("trustworthy").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages passed the text check"),
        F.when(F.col("latin_suspect") > 0, F.concat(F.lit("; Latin words intrude on "), F.col("latin_suspect").cast("string"), F.lit(" page(s) (pages "), numbers(F.col("latin_pages")), F.lit(")"))).otherwise(F.lit("")))
    return out.select(
        "document_id", "pages", "trustworthy", "failed", "total_chars", "latin_suspect", "failed_pages",
        F.when(held, "held").otherwise("succeeded").alias("status"), held.alias("review_required"), F.when(held, review).alias("review_note"), F.when(held, review).otherwise(passed).alias("note"))


def probe_verdict(pages: DataFrame, most: int = 6) -> DataFrame:
    """document_id, verdict over the text of the first six pages (joined by line feeds): UNTRUSTWORTHY for a bad font or corrupt spelling, NOT BENGALI, NO TEXT LAYER, plausible."""
    first = pages.where(F.col("page_no") <= most)
    joined = first.groupBy("document_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("raw_text", F.lit("")).alias("t"))))["t"], "\n").alias("t"),
        F.max(F.length(S.trim_ws(F.coalesce("raw_text", F.lit(""))))).alias("longest"), F.bool_or(~F.coalesce("fonts_ok", F.lit(True))).alias("bad_font"))
    o = S.orthography(F.col("t"))
    ratio, visible = S.script_ratio(F.col("t")), S.visible_chars(F.col("t"))
    verdict = (
        F.when(F.col("bad_font") | S.looks_corrupt(o["rate"], o["triples"]), "UNTRUSTWORTHY")
        .when((ratio < 0.4) & (visible > 50), "NOT BENGALI")
        .when(F.col("longest") < 20, "NO TEXT LAYER")
        .otherwise("plausible"))
    return joined.select("document_id", verdict.alias("verdict"))


def page_font_verdict(spans: DataFrame, fonts: DataFrame) -> DataFrame:
    """document_id, page_no, fonts_ok, bad_fonts: fonts without a Unicode map or of a legacy encoding that draw text of the script.

    ``fonts`` has document_id, page_no, font_name, font_object; ``spans`` has document_id, page_no, font, text.
    """
    suspects = fonts.where(S.suspect_font(F.col("font_name"), F.col("font_object"))).select("document_id", "page_no", S.font_key(F.col("font_name")).alias("key")).distinct()
    drawn = spans.where(F.coalesce(F.col("text").rlike(f"[{S.BENGALI.block}]"), F.lit(False))).select("document_id", "page_no", S.font_key(F.col("font")).alias("key"))
    bad = drawn.join(suspects, ["document_id", "page_no", "key"], "left_semi").groupBy("document_id", "page_no").agg(F.array_sort(F.collect_set("key")).alias("bad_fonts"))
    every = spans.select("document_id", "page_no").union(fonts.select("document_id", "page_no")).distinct()
    return every.join(bad, ["document_id", "page_no"], "left").select(
        "document_id", "page_no", F.col("bad_fonts").isNull().alias("fonts_ok"), F.coalesce("bad_fonts", F.array().cast("array<string>")).alias("bad_fonts"))


def font_classes(fonts: DataFrame) -> DataFrame:
    """document_id, encoding, fonts: distinct fonts (by xref) of each encoding class."""
    return fonts.select("document_id", "xref", S.font_encoding(F.coalesce("font_object", F.lit(""))).alias("encoding")).distinct().groupBy("document_id", "encoding").agg(F.count("*").alias("fonts"))


def delete_documents(documents: DataFrame, children: dict[str, DataFrame], doomed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents and child tables without the documents of ``doomed`` (id): a delete that cascades."""
    kept = documents.join(doomed.select("id"), "id", "left_anti")
    gone = doomed.select(F.col("id").alias("document_id"))
    return kept, {name: t.join(gone, "document_id", "left_anti") for name, t in children.items()}
