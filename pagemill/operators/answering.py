"""The abstention gate, citation checks and answer outcomes, and the calibration of the threshold; over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.tokens import overlap

#: Spans given to the generator, and the share of a quote's tokens its span must hold.
SPANS, GROUNDED = 5, 0.6
#: The generator's payload.
PAYLOAD = "struct<sufficient:boolean,answer:string,claims:array<struct<claim:string,span_id:string,quote:string>>>"
NO_HITS, INSUFFICIENT, NO_CLAIMS, UNGROUNDED = (
    "nothing retrieved", "model judged the spans insufficient", "answer carried no cited claims", "no claim's quote could be found in the span it cited")
UNCALIBRATED = "the re-ranker's scores are not calibrated for a threshold"


def number_spans(candidates: DataFrame, question: str = "question", most: int = SPANS) -> DataFrame:
    """The first ``most`` candidates of each question by gate score as spans S1, S2, ...; equal scores by chunk id."""
    w = Window.partitionBy(question).orderBy(F.desc("gate_score"), "chunk_id")
    return candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).withColumn("span_id", F.concat(F.lit("S"), F.col("n").cast("string"))).drop("n")


def span_block(spans: DataFrame, question: str = "question") -> DataFrame:
    """question, span_block: the spans of a question as the generator sees them."""
    text = F.concat(F.lit("["), F.col("span_id"), F.lit("] (page "), F.col("page_no").cast("string"), F.lit(")\n"), F.col("text"))
    order = F.array_sort(F.collect_list(F.struct(F.substring("span_id", 2, 9).cast("int").alias("n"), text.alias("t"))))
    return spans.groupBy(question).agg(F.array_join(order["t"], "\n\n").alias("span_block"))


def below_threshold(best: Column, threshold: float) -> Column:
    return F.concat(F.lit("best score "), F.format_string("%.4f", best), F.lit(f" is below the threshold {threshold}"))


def gate(questions: DataFrame, summary: DataFrame, threshold: float, question: str = "question") -> DataFrame:
    """question, best_score, abstain_reason (null when the question may go to the generator). A score equal to the threshold passes."""
    best = questions.select(question).join(summary.select(question, "best_score"), question, "left")
    return best.select(question, "best_score", F.when(F.col("best_score").isNull(), NO_HITS).when(F.col("best_score") < threshold, below_threshold(F.col("best_score"), threshold)).alias("abstain_reason"))


def check_claims(payloads: DataFrame, spans: DataFrame, question: str = "question") -> DataFrame:
    """One row per claim: question, pos, claim, span_id, quote, chunk_id (null for a span that wasn't given), quote_overlap and claim_overlap (three decimals), grounded."""
    claims = payloads.select(question, F.posexplode("payload.claims").alias("pos", "c")).select(
        question, "pos", *[F.coalesce(F.col(f"c.{x}"), F.lit("")).alias(x) for x in ("claim", "span_id", "quote")])
    joined = claims.join(spans.select(question, "span_id", "chunk_id", F.col("text").alias("span_text")), [question, "span_id"], "left")
    raw = overlap(F.col("quote"), F.col("span_text"))
    return joined.select(
        question, "pos", "claim", "span_id", "quote", "chunk_id",
        F.bround(raw, 3).alias("quote_overlap"), F.bround(overlap(F.col("claim"), F.col("span_text")), 3).alias("claim_overlap"),
        (F.col("chunk_id").isNotNull() & (raw >= GROUNDED)).alias("grounded"))


def candidate_details(hits: DataFrame, question: str = "question", preview: int = 80) -> DataFrame:
    """question, chunk_id, page_no, document_id and filename where given, dense_score, rerank_score and gate_score to four decimals, preview (the first ``preview`` characters on one line), best first."""
    known = [c for c in ("document_id", "filename", "page_no") if c in hits.columns]
    return hits.orderBy(F.desc("gate_score"), F.desc("score"), "chunk_id").select(
        question, "chunk_id", *known, F.bround("score", 4).alias("dense_score"), F.bround("rerank_score", 4).alias("rerank_score"), F.bround("gate_score", 4).alias("gate_score"),
        F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), 1, preview).alias("preview"))


def citation(hits: DataFrame) -> Column:
    """What an answer says of a chunk it cites."""
    return F.struct("chunk_id", *[c for c in ("filename", "page_no", "char_start", "char_end") if c in hits.columns]).alias("citation")


def outcomes(gated: DataFrame, payloads: DataFrame, claims: DataFrame, thresholdable: bool = True, question: str = "question") -> DataFrame:
    """question, answered, text, claims_total, claims_grounded, unresolved, ungrounded, abstain_reason, warnings; reasons in order of precedence."""
    made = payloads.select(question, "payload")
    agg = claims.groupBy(question).agg(
        F.count("*").alias("claims_total"), F.sum(F.col("grounded").cast("long")).alias("claims_grounded"),
        F.array_sort(F.collect_set(F.when(F.col("chunk_id").isNull(), F.col("span_id")))).alias("unresolved"),
        F.sum((~F.col("grounded")).cast("long")).alias("ungrounded"))
    all_ = gated.join(made, question, "left").join(agg, question, "left")
    unknown = F.coalesce(F.size("unresolved"), F.lit(0)) > 0
    names = F.concat(F.lit("["), F.array_join(F.transform("unresolved", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))
    reason = (
        F.when(F.col("abstain_reason").isNotNull(), F.col("abstain_reason"))
        .when(~F.coalesce("payload.sufficient", F.lit(False)), INSUFFICIENT)
        .when(F.coalesce("claims_total", F.lit(0)) == 0, NO_CLAIMS)
        .when(unknown, F.concat(F.lit("answer cited span id(s) that were not supplied: "), names, F.lit(" - treating the answer as unfounded")))
        .when(F.col("claims_grounded") == 0, UNGROUNDED)
    )
    partial = reason.isNull() & (F.col("ungrounded") > 0)
    warnings = F.array_compact(F.array(
        F.lit(None if thresholdable else UNCALIBRATED).cast("string"),
        F.when(partial, F.concat(F.col("ungrounded").cast("string"), F.lit(" claim(s) could not be found in their span and were dropped")))))
    return all_.select(
        question, reason.isNull().alias("answered"), F.when(reason.isNull(), F.col("payload.answer")).alias("text"),
        F.coalesce("claims_total", F.lit(0)).alias("claims_total"), F.coalesce("claims_grounded", F.lit(0)).alias("claims_grounded"), reason.alias("abstain_reason"), warnings.alias("warnings"))


# --- calibration -----------------------------------------------------------------------------------------


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """cutoff, answered, missed, rejected, leaked for every candidate threshold, in order.

    ``scored`` has answerable (boolean) and best (double, null when nothing was retrieved). Candidates are the distinct best scores at three decimals and the
    smallest of them less 0.5. Counted from cumulative sums over the distinct scores instead of comparing every cutoff with every question; a question whose
    score was rounded up misses its own cutoff.
    """
    good = scored.where("best is not null")
    cut = F.bround("best", 3)
    low = good.agg((F.min(cut) - 0.5).alias("cutoff")).where("cutoff is not null")
    cuts = good.select(cut.alias("cutoff")).distinct().unionByName(low).distinct()
    # events in one order: at equal values a cutoff stands before the scores it lets pass
    events = cuts.select(F.col("cutoff").alias("v"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("u")).unionByName(
        good.groupBy(F.col("best").alias("v")).agg(F.sum(F.col("answerable").cast("long")).alias("a"), F.sum((~F.col("answerable")).cast("long")).alias("u")).select("v", F.lit(1).alias("kind"), "a", "u"))
    # the running sum is made in value buckets, so that no task orders all scores
    bucket = F.floor(F.col("v") * 256)
    events = events.withColumn("b", bucket)
    sums = events.groupBy("b").agg(F.sum("a").alias("ba"), F.sum("u").alias("bu"))
    after = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select("b", F.coalesce(F.sum("ba").over(after), F.lit(0)).alias("above_a"), F.coalesce(F.sum("bu").over(after), F.lit(0)).alias("above_u"))
    inner = Window.partitionBy("b").orderBy(F.desc("v"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = events.join(above, "b").withColumns({"pa": F.col("above_a") + F.sum("a").over(inner), "pu": F.col("above_u") + F.sum("u").over(inner)}).where("kind = 0")
    totals = scored.agg(F.sum(F.col("answerable").cast("long")).alias("na"), F.sum((~F.col("answerable")).cast("long")).alias("nu"))
    return at.crossJoin(F.broadcast(totals)).select(  # one row
        F.col("v").alias("cutoff"), F.col("pa").alias("answered"), (F.col("na") - F.col("pa")).alias("missed"), (F.col("nu") - F.col("pu")).alias("rejected"), F.col("pu").alias("leaked")).orderBy("cutoff")


def best_cutoff(sweep: DataFrame) -> DataFrame:
    """The lowest cutoff that lets no unanswerable question pass."""
    return sweep.where("leaked = 0").orderBy("cutoff").limit(1)


def check_sweep(scored: DataFrame, thresholdable: bool) -> None:
    """Fails without both kinds of questions, or when scores can't be thresholded."""
    if not thresholdable:
        raise RuntimeError("the re-ranker's scores can't be compared with a threshold")
    kinds = {r[0] for r in scored.select("answerable").distinct().limit(3).collect()}
    if not {True, False} <= kinds:
        raise ValueError("both answerable and unanswerable questions are needed")
