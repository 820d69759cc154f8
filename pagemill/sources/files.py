"""File connectors: uploads, question lists, gold texts, float32 vector files and JSON artifacts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, sha256, byte_size of the PDF files (by name, any case) under a folder. The files are hashed where they are read; those without a byte, which no reader is
    given, are taken from the folder's listing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing, bare = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True), []
    while listing.hasNext():
        entry = listing.next()
        if entry.getLen() == 0 and entry.getPath().getName().lower().endswith(".pdf"):
            bare.append((entry.getPath().toString(),))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").like("%.pdf")).select("path", "content")
    files = files.unionByName(spark.createDataFrame(bare, "path string").withColumn("content", F.lit(b"")))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("byte_size"))


def new_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Uploads whose content isn't stored yet, one of each content (the first path)."""
    fresh = uploads.join(documents.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min(F.struct("path", "filename", "byte_size")).alias("u")).select("u.path", "u.filename", "sha256", "u.byte_size")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question, answerable from a JSON list."""
    return spark.read.schema("question string, answerable boolean").json(path, multiLine=True)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """path, gold_text of gold text files: lines beginning with # left out, stripped; empty files are no gold."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#"))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")
    return files.select("path", text.alias("gold_text")).where("gold_text != ''")


def write_gold_templates(folder: str, names: list[str], header: str) -> list[str]:
    """Write an empty gold file for each name that has none; gives the files written."""
    made = []
    for name in names:
        path = Path(folder) / f"{name}.txt"
        if not path.exists():
            path.write_text("".join(f"# {x}\n" for x in header.splitlines()))
            made.append(str(path))
    return made


def read_pages_selection(spec: str, page_count: int) -> list[int]:
    """Sorted page numbers (from 1) of ``"2,3,5"``, ``"4-9"`` or ``"all"``; a page out of range is an error."""
    if spec.strip() == "all":
        return list(range(1, page_count + 1))
    pages: set[int] = set()
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        pages.update(range(int(lo), int(hi or lo) + 1))
    outside = [p for p in pages if not 1 <= p <= page_count]
    if outside or not pages:
        raise ValueError(f"pages {sorted(outside)} of a document of {page_count} pages")
    return sorted(pages)


def pack(vectors: list[list[float]]) -> bytes:
    """Row-major float32 bytes."""
    return np.asarray(vectors, dtype="<f4").tobytes()


def unpack(raw: bytes, dim: int) -> np.ndarray:
    """The vectors of a float32 file; a size that isn't a whole number of rows is an error."""
    if dim <= 0 or len(raw) % (4 * dim):
        raise ValueError(f"{len(raw)} bytes are no rows of {dim} floats")
    return np.frombuffer(raw, dtype="<f4").reshape(-1, dim)


def read_float32(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """path, row_no, dense of float32 vector files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                rows = unpack(raw, dim)
                yield pd.DataFrame({"path": name, "row_no": np.arange(len(rows), dtype="i4"), "dense": list(rows)})

    return files.mapInPandas(run, "path string, row_no int, dense array<float>")


def write_artifact(df: DataFrame, folder: str, partition: str = "document_id") -> None:
    """A stage's result as JSON lines, a folder for each document; a document written again replaces its own folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).json(folder)


def write_report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small aggregate as a Markdown table beside its rows as JSON. More than ``most`` rows are an error: a report is no export."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = [df.columns, ["---"] * len(df.columns)] + [["" if x is None else str(x) for x in r] for r in rows]
    Path(f"{path}.md").write_text(f"# {title}\n\n" + "\n".join("| " + " | ".join(c) + " |" for c in cells) + "\n")
    Path(f"{path}.json").write_text(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str))


def pending_migrations(spark: SparkSession, names: list[str], applied: DataFrame) -> list[str]:
    """Names not applied yet, in order."""
    have = spark.createDataFrame([(n,) for n in names], "filename string").join(applied.select("filename"), "filename", "left_anti")
    return sorted(r[0] for r in have.collect())


def migrate(spark: SparkSession, folder: str, applied: DataFrame) -> DataFrame:
    """Run the statements of the ``.sql`` files of a folder that aren't in ``applied`` (filename, applied_at), in order of their names; gives ``applied`` with them. A statement ends with a
    semicolon at a line's end. A file that fails stops the run; those before it count as applied."""
    done: list[tuple[str, datetime]] = []
    try:
        for name in pending_migrations(spark, [p.name for p in Path(folder).glob("*.sql")], applied):
            for statement in re.split(r";[ \t]*(?:\n|$)", (Path(folder) / name).read_text(encoding="utf-8")):
                if statement.strip():
                    spark.sql(statement)
            done.append((name, datetime.now()))
    except Exception as problem:
        problem.add_note(f"applied before: {[n for n, _ in done]}")
        raise
    return applied.unionByName(spark.createDataFrame(done, "filename string, applied_at timestamp"), allowMissingColumns=True)


def read_artifact(root: str, path: str) -> str:
    """The text of an artifact; a path outside ``root``, whatever names it, or without a file is a LookupError."""
    target = Path(path).resolve()
    if not target.is_relative_to(Path(root).resolve()) or not target.is_file():
        raise LookupError("artifact missing")
    return target.read_text(encoding="utf-8")


def health(spark: SparkSession) -> dict:
    """Whether the engine answers, and what it runs on."""
    return {"ok": spark.range(1).count() == 1, "spark": spark.version, "shared": spark.conf.get("spark.checkpoint.dir", None) is not None}
