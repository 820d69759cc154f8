"""Cutting pages into chunks with exact character offsets.

The greedy fold over sentence and paragraph offsets is sequential within a page, so it runs as one Arrow batch function over pages; everything
around it (ids, metrics, reports) is declarative. No shuffle is needed to chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.pages import first_pages

TARGET, MAX_CHARS, MIN_CHARS, OVERLAP = 400, 700, 80, 60
#: Sentence terminators and brackets. Fixed values.
TERMINATORS = "।৤৥?!"
OPENERS, CLOSERS = "[(‘“", "])’”"

_GAP = re.compile(r"\n\s*\n")
_EVENT = re.compile("[" + re.escape(TERMINATORS + OPENERS + CLOSERS) + "]")


def sentence_ends(text: str) -> list[int]:
    """Offsets just past a terminator that white space or the text's end follows, outside brackets. A closing bracket without its opener changes nothing."""
    ends, depth = [], 0
    for m in _EVENT.finditer(text):
        ch = m.group()
        if ch in OPENERS:
            depth = min(depth + 1, 255)
        elif ch in CLOSERS:
            depth = max(depth - 1, 0)
        elif depth == 0 and (m.end() == len(text) or text[m.end()].isspace()):
            ends.append(m.end())
    return ends


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Untrimmed spans between blank lines, without blank spans."""
    edges = [0]
    for m in _GAP.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if not text[a:b].isspace() and a < b]


def split_oversized(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """A span as pieces: closed at the first sentence end that lies ``limit`` or more past the piece's start, then cut hard every ``limit`` characters."""
    if end - start <= limit:
        return [(start, end)]
    cuts = [start]
    for at in sentence_ends(text[start:end]):
        if start + at - cuts[-1] >= limit:
            cuts.append(start + at)
    if cuts[-1] < end:
        cuts.append(end)
    return [(a, min(a + limit, hi)) for lo, hi in zip(cuts, cuts[1:]) for a in range(lo, hi, limit)]


def chunk_text(text: str | None, target: int = TARGET, limit: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(ordinal, char_start, char_end, embed_start) of the chunks of a page; none for a null, empty or blank page.

    Units (paragraphs, or the pieces of long ones) are gathered while the group stays within ``target``; a last group shorter than ``least`` joins the one before it, even beyond
    ``limit``. Chunks are trimmed; one that becomes empty leaves its ordinal unused.
    """
    if not text or text.isspace():
        return []
    groups: list[list[int]] = []
    for a, b in (u for s, e in paragraph_spans(text) for u in split_oversized(text, s, e, limit)):
        if groups and b - groups[-1][0] <= target:
            groups[-1][1] = b
        else:
            groups.append([a, b])
    if len(groups) > 1 and groups[-1][1] - groups[-1][0] < least:
        last = groups.pop()
        groups[-1][1] = last[1]
    out: list[tuple[int, int, int, int]] = []
    for ordinal, (a, b) in enumerate(groups):
        body = text[a:b]
        start = a + len(body) - len(body.lstrip())
        end = a + len(body.rstrip())
        if start < end:
            out.append((ordinal, start, end, max(out[-1][1], start - overlap) if out else start))
    return out


def chunk_pages(pages: DataFrame, target: int = TARGET, limit: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """id (doc:page:ordinal), document_id, page_no, ordinal, char_start, char_end, text, embed_text, n_chars, n_tokens (null) of pages (document_id, page_no, text).

    Repeated page rows give repeated chunks; deduplicate before. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, page, o, a, b, text[a:b], text[e:b])
                for doc, page, text in zip(pdf["document_id"], pdf["page_no"], pdf["text"])
                for o, a, b, e in chunk_text(text, target, limit, least, overlap)
            ]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "ordinal", "char_start", "char_end", "text", "embed_text"]).astype({"page_no": "Int32"})

    cut = pages.select("document_id", "page_no", "text").where("text is not null").mapInPandas(
        run, "document_id string, page_no int, ordinal int, char_start int, char_end int, text string, embed_text string")
    return cut.select(
        F.concat_ws(":", "document_id", F.col("page_no").cast("string"), F.col("ordinal").cast("string")).alias("id"),
        "*", F.length("text").alias("n_chars"), F.lit(None).cast("int").alias("n_tokens"))


def sentence_counts(pages: DataFrame) -> DataFrame:
    """document_id, page_no, ends: the number of sentence ends of each page with a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["document_id", "page_no"]].assign(ends=[len(sentence_ends(t)) for t in pdf["text"]])

    return pages.where("text is not null").select("document_id", "page_no", "text").mapInPandas(run, "document_id string, page_no int, ends long")


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages with a text that passed the validity gate (null counts as not passed)."""
    return pages.where(F.col("text").isNotNull() & F.coalesce("trustworthy", F.lit(False)))


def skipped_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("text").isNull() | ~F.coalesce("trustworthy", F.lit(False)))


def chunk_metrics(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks, pages_chunked, pages_skipped, skipped (the first 50 page numbers), and mean (one decimal), least and most characters of its chunks (0 when none)."""
    out = F.col("text").isNull() | ~F.coalesce("trustworthy", F.lit(False))
    counts = pages.groupBy("document_id").agg(F.sum(out.cast("long")).alias("pages_skipped"))
    numbers = first_pages(pages.where(out).select("document_id", "page_no").distinct(), 50)
    own = counts.join(numbers, "document_id", "left").withColumn("skipped", F.coalesce("first_pages", F.array().cast("array<int>")))
    sizes = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("page_no").alias("pages_chunked"), F.avg("n_chars").alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(sizes, "document_id", "left").select(
        "document_id", zero("chunks").alias("chunks"), zero("pages_chunked").alias("pages_chunked"), "pages_skipped", "skipped",
        F.bround(zero("mean_chars").cast("double"), 1).alias("mean_chars"), zero("min_chars").alias("min_chars"), zero("max_chars").alias("max_chars"))


def page_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per page with chunks: its characters, number of chunks and their sizes in order."""
    sizes = chunks.groupBy("document_id", "page_no").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("ordinal", "n_chars"))).alias("s"))
    return pages.select("document_id", "page_no", F.length("text").alias("page_chars")).join(sizes, ["document_id", "page_no"]).select(
        "document_id", "page_no", "page_chars", "chunks", F.col("s.n_chars").alias("sizes"))


def lead_ins(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """id, embed_start: where each stored chunk's embed_text begins by the overlap rule, in order of the ordinals of a page."""
    w = Window.partitionBy("document_id", "page_no").orderBy("ordinal", "id")
    before = F.lag("char_start").over(w)
    return chunks.select("id", F.when(before.isNull(), F.col("char_start")).otherwise(F.greatest(before, F.col("char_start") - overlap)).alias("embed_start"))


def replace_documents(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """The stored rows with those of every document in ``fresh`` replaced: delete, then insert."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
