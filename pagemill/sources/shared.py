"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this process alone (tests, a laptop) a temporary
    folder of this machine is made, and removed when Python ends; on a cluster its unset name is an error, for executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = os.environ.get("PAGEMILL_SHARED_DIR")
    if not local:
        local = tempfile.mkdtemp(prefix="pagemill-")
        os.environ["PAGEMILL_SHARED_DIR"] = local
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return "file://" + local


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a Spark context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="pagemill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    context._pagemill_shipped = True


def write_path(df: DataFrame, label: str, codec: str = "zstd") -> str:
    """Write ``df`` as a Parquet table in the shared folder; gives its path. The table is deleted when the session's Java process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def read_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A Parquet table of the shared folder in batches of at most ``rows``, as a Python worker reads it."""
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    for batch in dataset.dataset(name, filesystem=system, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch


def write_through(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only tasks that read the table, and the rows (ids made by
    hashing included) are the same for every reader. The table is deleted when the session's Java process ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_path(df, label, codec))
