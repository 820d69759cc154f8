"""The stage state machine of documents, as joins and Column expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.shared import write_through

#: Stages in order, statuses, and attempts after which a failed stage is no longer retried by itself. Fixed values.
STAGES = ("extract", "ocr", "normalize", "chunk", "embed", "index")
STATUSES = ("pending", "running", "succeeded", "failed", "skipped", "held", "stale")
MAX_ATTEMPTS = 3
#: What is written down of a run beside its status and attempt.
BOOK = {"triggered_by": "string", "started_at": "timestamp", "finished_at": "timestamp", "error": "string", "metrics": "string", "output_ref": "string"}


def position(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int")


def stage_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(STAGES, 1)], "stage string, pos int")


def ensure_stage_runs(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs with a pending row added for every document and stage that has none. Running it again changes nothing."""
    due = documents.select(F.col("id").alias("document_id")).crossJoin(F.broadcast(stage_order(documents.sparkSession).select("stage")))  # six rows
    new = due.join(runs, ["document_id", "stage"], "left_anti").select("document_id", "stage", F.lit("pending").alias("status"), F.lit(0).alias("attempt"))
    return runs.select("document_id", "stage", "status", "attempt", *[c for c in BOOK if c in runs.columns]).unionByName(new, allowMissingColumns=True)


def with_book(runs: DataFrame) -> DataFrame:
    """The runs with all columns of BOOK, null where nothing was written down."""
    return runs.withColumns({c: F.lit(None).cast(t) for c, t in BOOK.items() if c not in runs.columns})


def _by_document(runs: DataFrame) -> DataFrame:
    """One row per document with its (at most six) stage rows in order. A stage delivered twice counts by the highest attempt."""
    one = runs.where(position(F.col("stage")) > 0).groupBy("document_id", "stage").agg(F.max(F.struct("attempt", "status")).alias("r"))
    return one.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct(position(F.col("stage")).alias("pos"), "stage", F.col("r.status").alias("status"), F.col("r.attempt").alias("attempt")))).alias("stages"))


def blocking(stage: Column) -> Column:
    return ~stage["status"].isin("succeeded", "skipped")


def with_blockers(runs: DataFrame) -> DataFrame:
    """document_id, stage, status, attempt, blockers (messages of the earlier stages that aren't done, in order), auto (advance may run it), manual, forced (a person may run it, without or with force).

    No self join: the stages of a document are one array.
    """
    def message(s: Column) -> Column:
        return F.when(s["status"] == "held", F.concat(F.lit("`"), s["stage"], F.lit("` is held for review"))).otherwise(F.concat(F.lit("`"), s["stage"], F.lit("` is "), s["status"]))

    rows = _by_document(runs).select("document_id", "stages", F.explode("stages").alias("s"))
    before = F.filter("stages", lambda x: (x["pos"] < F.col("s.pos")) & blocking(x))
    out = rows.select("document_id", "s.stage", "s.pos", "s.status", "s.attempt", F.transform(before, message).alias("blockers"))
    free = F.size("blockers") == 0
    runnable = F.col("status").isin("pending", "stale") | ((F.col("status") == "failed") & (F.col("attempt") < MAX_ATTEMPTS))
    return out.withColumns({
        "auto": runnable & free,
        "manual": ~F.col("status").isin("running", "succeeded") & free,
        "forced": (F.col("status") != "running") & free,
    })


def next_runnable(runs: DataFrame) -> DataFrame:
    """document_id, stage: the first stage that advance may run; documents without one are absent."""
    return with_blockers(runs).where("auto").groupBy("document_id").agg(F.min_by("stage", "pos").alias("stage"))


def mark_stale(runs: DataFrame, changed: DataFrame) -> DataFrame:
    """The runs after the stages of ``changed`` (document_id, stage) gave a result: later stages that had finished or failed are stale; pending and running ones stay."""
    first = changed.groupBy("document_id").agg(F.min(position(F.col("stage"))).alias("from_pos"))
    later = F.coalesce(position(F.col("stage")) > F.col("from_pos"), F.lit(False)) & F.col("status").isin("succeeded", "failed", "held", "skipped")
    return runs.join(first, "document_id", "left").withColumn("status", F.when(later, "stale").otherwise(F.col("status"))).drop("from_pos")


def _written(rows: DataFrame, mark: str, values: dict[str, Column]) -> DataFrame:
    """The rows with ``values`` where ``mark`` is set (columns that the rows lack are left out), without it."""
    here = {c: F.when(F.col(mark).isNotNull(), v).otherwise(F.col(c)) for c, v in values.items() if c in rows.columns}
    return rows.withColumns(here).drop(mark)


def start(runs: DataFrame, wanted: DataFrame, triggered_by: str = "auto") -> DataFrame:
    """The runs with the ``wanted`` ones (document_id, stage) running, one attempt further; who started them and when is written down where there are columns for it."""
    go = wanted.select("document_id", "stage", F.lit(True).alias("_go")).distinct()
    none = F.lit(None)
    return _written(runs.join(go, ["document_id", "stage"], "left"), "_go", {
        "status": F.lit("running"), "attempt": F.col("attempt") + 1, "triggered_by": F.lit(triggered_by), "started_at": F.current_timestamp(), "finished_at": none, "error": none})


def finish(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The runs with results written (document_id, stage, result, and if given error, metrics, output_ref): succeeded, skipped and held make later stages stale, failed does not. A failed run keeps
    the metrics and the output of the one before."""
    given = [c for c in ("error", "metrics", "output_ref") if c in results.columns]
    got = results.select("document_id", "stage", "result", *[F.col(c).alias(f"_{c}") for c in given]).dropDuplicates(["document_id", "stage"])
    failed = F.col("result") == "failed"
    values = {"status": F.col("result"), "finished_at": F.current_timestamp(), "error": F.when(failed, F.col("_error")) if "error" in given else F.lit(None)}
    values |= {c: F.when(failed, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("metrics", "output_ref") if c in given}
    written = _written(runs.join(got, ["document_id", "stage"], "left"), "result", values).drop(*[f"_{c}" for c in given])
    return mark_stale(written, got.where("result in ('succeeded', 'skipped', 'held')"))


def run_stage(runs: DataFrame, wanted: DataFrame, stage: Callable[[DataFrame], DataFrame], force: bool = False, triggered_by: str = "manual") -> DataFrame:
    """Run ``stage`` for the wanted (document_id, stage) rows that may run. ``stage`` maps (document_id, stage) to (document_id, stage, result), and may add error, metrics and output_ref.

    The result has the columns of BOOK. An exception of the stage makes its runs failed, with the message as their error.
    """
    allowed = with_blockers(runs).where("forced" if force else "manual").join(wanted.select("document_id", "stage"), ["document_id", "stage"], "left_semi").select("document_id", "stage")
    allowed = write_through(allowed, "allowed")
    begun = start(with_book(runs), allowed, triggered_by)
    try:
        results = write_through(stage(allowed), "results")
    except Exception as problem:  # whatever the stage raised is what its runs failed of
        results = allowed.withColumns({"result": F.lit("failed"), "error": F.lit(f"{type(problem).__name__}: {problem}")})
    return finish(begun, results)


def advance(runs: DataFrame, stage: Callable[[DataFrame], DataFrame], most: int = len(STAGES)) -> DataFrame:
    """Run each document's next stage until nothing moves, at most once a stage: one pass per level over all documents, not a loop over documents.

    Each pass is written to the shared folder, so that the plan doesn't grow with the passes.
    """
    runs = write_through(runs, "runs")
    for _ in range(most):
        wanted = write_through(next_runnable(runs), "wanted")
        runs = write_through(finish(start(runs, wanted), stage(wanted)), "runs")
    return runs


def summary(runs: DataFrame) -> DataFrame:
    """Per document: done (all six succeeded or skipped), held, failed, attempts."""
    return runs.groupBy("document_id").agg(
        (F.sum(F.col("status").isin("succeeded", "skipped").cast("int")) == len(STAGES)).alias("done"), F.bool_or(F.col("status") == "held").alias("held"),
        F.sum((F.col("status") == "failed").cast("long")).alias("failed"), F.sum("attempt").alias("attempts"))
