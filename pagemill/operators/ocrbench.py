"""Scoring OCR engines against gold text and against each other. Outputs are rows (page key, engine, text, seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import script as S
from pagemill.functions.tokens import error_rates, similarity
from pagemill.operators.pages import first_pages

#: The engine that isn't one: it takes no part in agreement.
BASELINE = "textlayer"


def page_scores(outputs: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine, cer, wer for pages with a gold text; null where the gold text is empty."""
    both = outputs.join(gold.select(*keys, "gold_text"), keys).select(*keys, "engine", error_rates(F.col("gold_text"), F.col("text")).alias("e"))
    return both.select(*keys, "engine", "e.cer", "e.wer")


def quality_signals(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine and the signals of each output's normalised text (NFC, white space collapsed): chars, tokens, ratio, rate, triples."""
    t = outputs.select(*keys, "engine", S.collapse_ws(S.nfc(F.coalesce("text", F.lit("")))).alias("t"))
    o = S.orthography(F.col("t"))
    return t.select(*keys, "engine", F.length("t").cast("long").alias("chars"), o["tokens"].alias("tokens"), S.script_ratio(F.col("t")).alias("ratio"), o["rate"].alias("rate"), o["triples"].alias("triples"))


def consensus(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine_a, engine_b, similarity of each two outputs of a page (engine_a < engine_b)."""
    texts = outputs.groupBy(*keys).agg(F.collect_list(F.struct("engine", "text")).alias("own"))  # as many as there are engines
    pair = lambda x, y: F.struct(x["engine"].alias("engine_a"), y["engine"].alias("engine_b"), x["text"].alias("ta"), y["text"].alias("tb"))
    pairs = F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y["engine"] > x["engine"]), lambda y: pair(x, y)))
    each = texts.select(*keys, F.explode(F.flatten(pairs)).alias("p"))
    return each.select(*keys, "p.engine_a", "p.engine_b", similarity(F.col("p.ta"), F.col("p.tb")).alias("similarity"))


def worst_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine_a, engine_b, similarity of the least similar pair of each page; the baseline takes no part, equal values by name."""
    own = pairs.where((F.col("engine_a") != BASELINE) & (F.col("engine_b") != BASELINE))
    return own.groupBy(*keys).agg(F.min(F.struct("similarity", "engine_a", "engine_b")).alias("m")).select(*keys, "m.engine_a", "m.engine_b", "m.similarity")


def mean_agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine, agreement: an engine's mean similarity to the others of the page, the baseline aside."""
    own = pairs.where((F.col("engine_a") != BASELINE) & (F.col("engine_b") != BASELINE))
    sides = F.explode(F.array("engine_a", "engine_b")).alias("engine")
    return own.select(*keys, sides, "similarity").groupBy(*keys, "engine").agg(F.avg("similarity").alias("agreement"))


def ranking(signals: DataFrame, agreement: DataFrame, scores: DataFrame, seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Per engine: place, pages, and the means of its signals, agreement, error rates and seconds.

    Where any engine has a CER, those that have one are placed by it; else all by illegal first signs, agreement (none counts as 0) and characters. The baseline has no
    place. One row per engine from here on.
    """
    s = signals.groupBy("engine").agg(F.count("*").alias("pages"), F.avg("chars").alias("chars"), F.avg("ratio").alias("ratio"), F.avg("rate").alias("rate"), F.avg("triples").alias("triples"))
    a = agreement.groupBy("engine").agg(F.avg("agreement").alias("agreement"))
    c = scores.groupBy("engine").agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"))
    t = seconds.groupBy("engine").agg(F.avg("seconds").alias("seconds"))
    out = s.join(a, "engine", "left").join(c, "engine", "left").join(t, "engine", "left")
    ranked = F.col("engine") != BASELINE
    scored = F.coalesce(F.max(F.when(ranked, F.col("cer").isNotNull())).over(Window.partitionBy()), F.lit(False))
    takes_part = ranked & (~scored | F.col("cer").isNotNull())
    order = Window.partitionBy("takes_part").orderBy("cer", "rate", F.coalesce("agreement", F.lit(0.0)).desc(), F.desc("chars"), "engine")
    placed = out.withColumn("takes_part", takes_part).withColumn("place", F.when(F.col("takes_part"), F.row_number().over(order)))
    return placed.drop("takes_part").orderBy(F.col("place").asc_nulls_last(), "engine")


def high_error(scores: DataFrame) -> DataFrame:
    """Outputs longer than their gold text allows: CER above 1."""
    return scores.where("cer > 1")


def uncached(pages: DataFrame, results: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Pages and engines without a stored result; all of them with force."""
    return pages if force else pages.join(results.select(*keys, "engine"), [*keys, "engine"], "left_anti")


def side_by_side(outputs: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """keys, compared: the first ``most`` lines of each engine's output of a page, engines in order of their names."""
    lines = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, most), "\n")
    part = F.concat(F.lit("--- "), F.col("engine"), F.lit(" ---\n"), lines)
    return outputs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("engine", part.alias("t"))))["t"], "\n\n").alias("compared"))


def run_totals(results: DataFrame, document: str = "document_id") -> DataFrame:
    """Per document of OCR results (document_id, page_no, seconds, error): pages_read, total_seconds (of the pages read, one decimal), failed, failed_pages (the first three) and status: failed when
    any page failed, else succeeded. What was read is kept either way."""
    bad = F.col("error").isNotNull()
    counts = results.groupBy(document).agg(
        F.sum((~bad).cast("long")).alias("pages_read"), F.bround(F.coalesce(F.sum(F.when(~bad, F.col("seconds"))), F.lit(0.0)), 1).alias("total_seconds"), F.sum(bad.cast("long")).alias("failed"))
    pages = first_pages(results.where(bad), 3)
    return counts.join(pages, document, "left").select(
        document, "pages_read", "total_seconds", "failed", F.array_join(F.coalesce("first_pages", F.array().cast("array<int>")), ",").alias("failed_pages"),
        F.when(F.col("failed") > 0, "failed").otherwise("succeeded").alias("status"))
