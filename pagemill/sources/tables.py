"""Readers for the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.shared import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
