"""Vector collections, exact cosine search, the model guard, re-ranking and the gate score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.hashing import dot, unsigned_zeros, uuid5
from pagemill.plugins import Reranker
from pagemill.sources.shared import read_batches, write_path

DENSE_K, RERANK_K = 30, 8
#: Queries and points of a block that are compared by one matrix product.
QUERY_BLOCK, POINT_BLOCK = 2048, 16_384


# --- collections -----------------------------------------------------------------------------------------


def collection_info(collections: DataFrame, name: str) -> DataFrame:
    """One row: found (whether the collection exists) and dim (null when not)."""
    return collections.where(F.col("name") == name).agg((F.count("*") > 0).alias("found"), F.max("dim").alias("dim"))


def ensure_collection(collections: DataFrame, name: str, model: str, dim: int, recreate: bool = False) -> tuple[DataFrame, bool]:
    """(collections, created): nothing happens when the collection exists with this dim and isn't to be recreated; else its row is replaced (its points must be dropped)."""
    found = collections.where((F.col("name") == name) & (F.col("dim") == dim)).limit(1).count() > 0
    if found and not recreate:
        return collections, False
    now = F.current_timestamp().cast("timestamp_ntz")
    row = collections.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(model).alias("model"), F.lit(dim).cast("int").alias("dim"), now.alias("created_at"), now.alias("updated_at"))
    return collections.where(F.col("name") != name).unionByName(row), True


def point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", uuid5(F.col("id")).alias("point_id"))


def upsert_points(stored: DataFrame, fresh: DataFrame, key: str = "point_id") -> DataFrame:
    """The stored points with those of ``fresh`` inserted or put in their place. ``fresh`` must have one row per key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete_document(points: DataFrame, document_id: str) -> DataFrame:
    return points.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def build_points(vectors: DataFrame, chunks: DataFrame, embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Points with their payload: the vectors of known chunks joined to chunk, file and document. One row per chunk: duplicate deliveries are taken once.

    A file's model and dim are each the latest one stated with a date. A chunk's vector is its last one by file and row (a row without a number is the last of its file), its model that of its
    last vector of a known model. Zeros of ``dense`` have no sign. The wide sides (vectors, chunks) meet once on the chunk id, after each was reduced to one row per key.
    """

    def last(value: str, *order: str | Column) -> Column:
        return F.max(F.when(F.col(value).isNotNull(), F.struct(*order)))[value].alias(value)

    files = embeddings.where("created_at is not null").groupBy("vectors_path").agg(*[last(x, "created_at", "model", "dim") for x in ("model", "dim")])
    v = vectors.join(files, "vectors_path").where("size(dense) = dim").groupBy("chunk_id").agg(*[last(x, "vectors_path", F.col("row_no").isNull(), "row_no", x) for x in ("dense", "model")])
    c = chunks.groupBy("id").agg(F.max(F.struct("created_at", "document_id", "page_no", "ordinal", "char_start", "char_end", "text")).alias("c")).select(F.col("id").alias("chunk_id"), "c.*").drop("created_at")
    d = documents.select(F.col("id").alias("document_id"), "filename", "language")
    return v.join(c, "chunk_id").join(d, "document_id", "left").select(
        uuid5(F.col("chunk_id")).alias("point_id"), unsigned_zeros(F.col("dense")).alias("dense"), "chunk_id", "document_id", "filename", "language", "page_no", "ordinal", "char_start", "char_end", "text", "model")


def index_checks(vectors: DataFrame, embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, rows, wrong_width, missing_chunks, example: what keeps a document's vector file from being indexed. Files without a fault are absent."""
    files = embeddings.groupBy("vectors_path").agg(F.max(F.struct("created_at", "document_id", "dim")).alias("f")).select("vectors_path", "f.document_id", "f.dim")
    known = chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("known")).distinct()
    rows = vectors.select("vectors_path", "row_no", "chunk_id", F.size("dense").alias("width")).distinct().join(files, "vectors_path").join(known, "chunk_id", "left")
    out = rows.groupBy("document_id").agg(
        F.count("*").alias("rows"), F.sum((F.col("width") != F.col("dim")).cast("long")).alias("wrong_width"),
        F.sum(F.col("known").isNull().cast("long")).alias("missing_chunks"), F.min(F.when(F.col("known").isNull(), F.col("chunk_id"))).alias("example"))
    return out.where("wrong_width > 0 or missing_chunks > 0")


def model_changes(embeddings: DataFrame, collection_model: str) -> DataFrame:
    """document_id, model: documents whose latest embedding is of another model than the collection; their index stage is stale."""
    last = embeddings.groupBy("document_id").agg(F.max(F.struct("created_at", "model")).alias("e")).select("document_id", "e.model")
    return last.where(~F.col("model").eqNullSafe(F.lit(collection_model)))


# --- search ----------------------------------------------------------------------------------------------


def dense_search(points: DataFrame, query: list[float], k: int = DENSE_K, document_id: str | None = None, id_col: str = "chunk_id", vector: str = "dense") -> DataFrame:
    """The ``k`` points most similar to one query vector, filtered by document before the top-k; equal scores in order of the id."""
    if document_id is not None:
        points = points.where(F.col("document_id") == document_id)
    scored = points.withColumn("score", dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def knn_batch(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str, same: bool = False) -> DataFrame:
    """query_id as q, point_id as p, score: for each query the ``k`` points of the largest inner product, by exact comparison; equal scores by the smaller point id. A point isn't
    its own neighbour unless ``same``.

    The stated query set is written to the shared folder; each task gathers up to POINT_BLOCK of its points and reads the queries past them in blocks of QUERY_BLOCK, one matrix product each,
    keeping the best k of every query. The points are scanned once, nothing goes to the driver, and only queries * k rows a block of points are shuffled. The width is the most frequent one of
    all points (of equally frequent ones the largest); null vectors and those of another width take no part.
    """
    spark = points.sparkSession
    common = points.where(f"size({vector}) > 0").groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = common[0]["width"] if common else 0
    asked = queries.where((F.size(vector) == width) & F.lit(width > 0)).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    path = write_path(asked, "queries")
    qtype, ptype = dict(asked.dtypes)["q"], dict(points.dtypes)[point_id]
    order, upward = ["q", "score", "p"], [True, False, True]

    def best_of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(order, ascending=upward, kind="stable").groupby("q", sort=False).head(k)

    def compare(ids: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        index = {} if same else {p: i for i, p in enumerate(ids)}
        take = min(k, len(ids))
        for batch in read_batches(path, QUERY_BLOCK):
            qs = batch.column("q").to_pylist()
            m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(qs), width)
            score = m @ x
            for i, q in enumerate(qs):
                if q in index:
                    score[i, index[q]] = -np.inf
            kth = -np.partition(-score, take - 1, axis=1)[:, take - 1]
            at = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
            if len(at[0]):
                yield best_of([pd.DataFrame({"q": [qs[i] for i in at[0]], "p": ids[at[1]], "score": score[at]})])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            kept.append(pdf[[v is not None and len(v) == width for v in pdf["v"]]])
            if sum(map(len, kept)) >= POINT_BLOCK:
                block, kept = pd.concat(kept), []
                yield from compare(block["p"].to_numpy(), np.stack(block["v"].to_numpy()).astype("f8").T)
        if sum(map(len, kept)):
            block = pd.concat(kept)
            yield from compare(block["p"].to_numpy(), np.stack(block["v"].to_numpy()).astype("f8").T)

    found = points.select(F.col(point_id).alias("p"), F.col(vector).alias("v")).mapInPandas(run, f"q {qtype}, p {ptype}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def check_collection(collections: DataFrame, name: str, model: str) -> None:
    """Fails when nothing was ever indexed, or by another model."""
    row = collections.where(F.col("name") == name).select("model").limit(1).collect()
    if not row:
        raise LookupError(f"collection {name} was never indexed")
    if row[0]["model"] != model:
        raise RuntimeError(f"collection {name} holds vectors of {row[0]['model']}, the query is of {model}")


def model_guard(hits: DataFrame, model: str) -> DataFrame:
    """Hits without those of another model. Applied after the top-k, so fewer than k may remain."""
    return hits.where(F.col("model").isNull() | (F.col("model") == "") | (F.col("model") == model))


def rerank_all(scored: DataFrame, keys: list[str], k: int = RERANK_K) -> DataFrame:
    """Scored hits of many questions with gate_score (the re-ranker's score, or else the dense one) and place: the best ``k`` of each; ties keep the dense order, then that of the ids."""
    w = Window.partitionBy(*keys).orderBy(F.desc("gate_score"), F.desc("score"), "chunk_id")
    return scored.withColumn("gate_score", F.coalesce("rerank_score", "score")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rerank(hits: DataFrame, question: str, reranker: Reranker, k: int = RERANK_K) -> DataFrame:
    """The best ``k`` hits of one question, best first."""
    scored = reranker.score(hits, question).withColumn("gate_score", F.coalesce("rerank_score", "score"))
    return scored.orderBy(F.desc("gate_score"), F.desc("score"), "chunk_id").limit(k)


def retrieve(points: DataFrame, collections: DataFrame, collection: str, question: str, query: list[float], model: str, reranker: Reranker, dense_k: int = 0, rerank_k: int = 0, document_id: str | None = None) -> DataFrame:
    """Embedded question to candidates: search, model guard, re-rank, truncate. A k of 0 means the default."""
    check_collection(collections, collection, model)
    hits = dense_search(points, query, dense_k or DENSE_K, document_id)
    return rerank(model_guard(hits, model), question, reranker, rerank_k or RERANK_K)


def score_summary(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per question: candidates, best_score (the largest gate score), low and high (four decimals)."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("candidates"), F.max("gate_score").alias("best_score"), F.bround(F.min("gate_score"), 4).alias("low"), F.bround(F.max("gate_score"), 4).alias("high"))


def citations(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.struct("chunk_id", "filename", "page_no", "char_start", "char_end").alias("citation"))
