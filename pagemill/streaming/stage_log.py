"""Streaming extensions: page ingestion with duplicate deliveries dropped, and the stage runs folded from a log of events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.stages import STAGES
from pagemill.sources.shared import ship

#: What each event does to its stage; results make later stages stale.
EVENTS = {"start": "running", "succeed": "succeeded", "skip": "skipped", "hold": "held", "fail": "failed"}
_STALE = {"succeeded", "failed", "held", "skipped"}


def page_stream(spark: SparkSession, folder: str, schema: str, late: str = "30 days") -> DataFrame:
    """Pages as they arrive in a folder of Parquet files; a page delivered again within the watermark with the same text is dropped."""
    ship(spark)
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late).withColumn("h", F.xxhash64("raw_text")).dropDuplicatesWithinWatermark(["document_id", "page_no", "h"]).drop("h")


def counts_by_source(pages: DataFrame, window: str = "1 day") -> DataFrame:
    """Pages of each source in tumbling windows of their update time, late pages included up to the watermark."""
    return pages.groupBy(F.window("updated_at", window), "source").agg(F.count("*").alias("pages")).select(F.col("window.start").alias("start"), "source", "pages")


def apply_event(states: list[tuple[str, int]], stage: str, event: str) -> list[tuple[str, int]]:
    """The (status, attempt) of all stages after one event. An unknown stage or event changes nothing."""
    if stage not in STAGES or event not in EVENTS:
        return states
    at = STAGES.index(stage)
    out = list(states)
    status, attempt = out[at]
    out[at] = (EVENTS[event], attempt + (event == "start"))
    if event in ("succeed", "skip", "hold"):
        out[at + 1 :] = [("stale" if s in _STALE else s, a) for s, a in out[at + 1 :]]
    return out


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    states = list(zip(state.get[0], state.get[1])) if state.exists else [("pending", 0)] * len(STAGES)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    for stage, event in zip(rows["stage"], rows["event"]):
        states = apply_event(states, stage, event)
    state.update(([s for s, _ in states], [int(a) for _, a in states]))
    yield pd.DataFrame({"document_id": key[0], "stage": STAGES, "status": [s for s, _ in states], "attempt": [int(a) for _, a in states]})


def stage_runs(events: DataFrame) -> DataFrame:
    """document_id, stage, status, attempt after each batch of events (document_id, stage, event, ts, seq): the latest rows of a document count."""
    return events.groupBy("document_id").applyInPandasWithState(
        _fold, "document_id string, stage string, status string, attempt int", "status array<string>, attempt array<int>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> Any:
    """Run a stream over what is there now into a memory table; for tests and backfills."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
