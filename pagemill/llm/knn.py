"""Problem 6: the most similar vectors of every vector, by a permutation index.

Each vector is represented by the order of its nearest pivots and posted in the inverted files of the first of them. A query opens the files of its own
first pivots, ranks their vectors by the footrule distance of the orders and reranks them by their exact cosine, down the ranking in steps until a
step brings nothing better. Equal vectors are one entry of the index. The pivots grow with the square root of the collection, and as they are drawn from it,
a dense region gets more of them: files grow with the square root too. A file that is longer than a part is compared in parts by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.shared import write_through

#: Pivots a vector is ordered by, files it is posted in, files a query opens, and vectors reranked at a step, for pairs above a high cosine.
ORDER, POSTED, PROBED, STEP = 16, 4, 2, 16
#: The same for the nearest vectors whatever their cosine, which takes more files and longer orders.
WIDE_ORDER, WIDE_POSTED, WIDE_PROBED, WIDE_STEP = 32, 4, 32, 512
#: Pivots of a model: this times the square root of the number of its vectors, at least so many, and at most so many bytes of them (they are broadcast).
PIVOT_FACTOR, PIVOTS_LEAST, PIVOT_BYTES = 2.0, 16, 64 << 20
#: Vectors of a part of a file.
PART = 32_768
#: Neighbours of a vector.
K = 5
#: Of the string ids of chunks, those whose hash is divisible by this are the stated query set of ``nearest``.
QUERY_SHARE = 50


def clean_vectors(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(model, chunk_id, v): one row per vector of a known file, as stored.

    Null, all-zero and wrong-width vectors (another length than the file's dim) and vectors with a null or non-finite element are
    left out, as are vectors of files without a model. A (file, row) delivered twice counts once; of a file delivered with several
    models or a chunk with several vectors the smallest counts.
    """
    known = files.where("model is not null").groupBy("vectors_path").agg(F.min(F.struct("model", "dim")).alias("m")).select("vectors_path", "m.model", "m.dim")
    norm = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    good = (
        rows.select("vectors_path", "chunk_id", "dense")
        .join(known, "vectors_path")
        .where("chunk_id is not null and dense is not null and size(dense) = dim")
        .withColumn("n", norm)
        .where("n > 0 and n < double('infinity') and not isnan(n)")
    )
    return good.groupBy("model", "chunk_id").agg(F.min("dense").alias("v"))


def pivot_count(n: int, width: int) -> int:
    return int(max(1, min(n, max(PIVOTS_LEAST, math.ceil(PIVOT_FACTOR * math.sqrt(n))), PIVOT_BYTES // (4 * max(width, 1)))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    return x / np.sqrt((x * x).sum(1))[:, None]


def choose_pivots(rows: DataFrame) -> dict[str, np.ndarray]:
    """Pivots of each model: of its different vectors (model, id, v) those with the smallest hash of their id. Only rows below the hash that so many are expected
    under go to the driver, at most PIVOT_BYTES of a model."""
    sizes = rows.groupBy("model").agg(F.approx_count_distinct("id", 0.02).alias("n"), F.max(F.size("v")).alias("width")).limit(1_001).collect()
    if len(sizes) > 1_000:
        raise ValueError("more than 1,000 models")
    wanted = {r["model"]: pivot_count(r["n"], r["width"]) for r in sizes}
    scale = 1 << 40
    below = [(r["model"], int(min(1.0, (wanted[r["model"]] + 6 * math.sqrt(wanted[r["model"]]) + 6) / (0.9 * r["n"])) * scale)) for r in sizes]
    if not below:
        return {}
    spark = rows.sparkSession
    limits = F.broadcast(spark.createDataFrame(below, "model string, below long"))  # at most 1,000 rows
    h = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(scale))
    sample = rows.join(limits, "model").withColumn("h", h).where("h < below").groupBy("model", "id", "h").agg(F.first("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for model, most in wanted.items():
        own = sorted(((r["h"], r["id"], r["v"]) for r in sample if r["model"] == model), key=lambda x: x[:2])[:most]
        out[model] = unit(np.array([v for *_, v in own], dtype="f4")).astype("f4")
    return out


def _floats(column, rows: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _order(pivots: dict[str, np.ndarray], length: int):
    """Adds to each entry the numbers of its nearest pivots, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column("model").to_pylist(), dtype=object)
            for model in sorted(set(models)):
                part = batch.filter(pa.array(models == model))
                piv = pivots[model]
                m = min(length, len(piv))
                x = unit(_floats(part.column("v"), part.num_rows)).astype("f4")
                orders = np.empty((len(x), m), "i4")
                for at in range(0, len(x), 2048):
                    sims = x[at : at + 2048] @ piv.T
                    top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    top.sort(axis=1)  # equal similarities in order of the pivots
                    orders[at : at + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * m), pa.array(orders.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("model"), part.column("id"), part.column("asked"), lists, part.column("v")], names=["model", "id", "asked", "files", "v"])

    return run


def build_index(vectors: DataFrame, length: int = ORDER, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, index): entries (model, chunk_id, id, asked) say which vector a chunk has, index (model, id, asked, files, v) has each different vector once with
    the order of its pivots. ``asked`` is a condition on chunk_id: the vectors to be searched for (all by default). ``vectors`` comes from clean_vectors."""
    spark = vectors.sparkSession
    rows = write_through(vectors.withColumn("id", F.xxhash64("model", "v")), "vectors")
    entries = rows.select("model", "chunk_id", "id", (F.lit(True) if asked is None else asked).alias("asked"))
    owners = entries.groupBy("model", "id").agg(F.max("asked").alias("asked"))
    different = rows.groupBy("model", "id").agg(F.first("v").alias("v")).join(owners, ["model", "id"])
    sent = spark.sparkContext.broadcast(choose_pivots(rows))  # PIVOT_BYTES a model at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _order(sent.value, length)(batches)

    index = different.select("model", "id", "asked", "v").mapInArrow(run, "model string, id long, asked boolean, files array<int>, v array<float>")
    return entries, write_through(index, "index")


def shared_weight(orders: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each row of ``orders`` (q x m) and of ``others`` (n x m) the sum over pivots of the lesser weight (m less the rank, 0 if absent).

    The induced footrule distance of two orders is m (m + 1) less twice this sum, so the largest sums are the nearest orders.
    """
    m = orders.shape[1]
    out = np.zeros((len(orders), len(others)), "u2")
    for at in range(0, len(others), 2048):
        block = others[at : at + 2048]
        names, local = np.unique(block, return_inverse=True)
        weights = np.zeros((len(names) + 1, len(block)), "u1" if m < 256 else "u2")  # the last row is for pivots that the block lacks
        weights[local.reshape(block.shape), np.arange(len(block))[:, None]] = m - np.arange(m)
        place = np.minimum(np.searchsorted(names, orders), len(names) - 1)
        place = np.where(names[place] == orders, place, len(names))
        for i in range(m):
            out[:, at : at + 2048] += np.minimum(weights[place[:, i]], weights.dtype.type(m - i))
    return out


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Induced footrule distances of the rows of ``a`` from those of ``b``, scaled to 0 (equal) to 1 (no pivot in common)."""
    m = a.shape[1]
    return 1 - 2 * shared_weight(a, b) / (m * (m + 1))


def nearest_in_file(ids: np.ndarray, orders: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q_orders: np.ndarray, q_x: np.ndarray, k: int, least: float, step: int) -> tuple[list, list, list]:
    """(query id, id, cosine) of the ``k`` most similar vectors with cosine >= ``least`` (more where the k-th cosine is shared) that reranking finds for each query.

    Candidates are taken in order of footrule distance (equal ones by id), ``step`` at a time; a query ends with the first step that adds nothing to its k best.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, orders, x = ids[by_id], orders[by_id], x[by_id]
    n = len(ids)
    single = x.astype("f4")
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q_ids), 256):
        own, qx = q_ids[at : at + 256], q_x[at : at + 256]
        rank = shared_weight(q_orders[at : at + 256], orders).astype("i8") * n + (n - 1 - np.arange(n))
        first = np.argpartition(-rank, step - 1, axis=1)[:, :step] if step < n else np.broadcast_to(np.arange(n), (len(own), n))
        sims = np.einsum("qcw,qw->qc", single[first], qx.astype("f4"))
        sims[ids[first] == own[:, None]] = -2
        for row in range(len(own)):
            hits = first[row][sims[row] >= least - 1e-4]
            if len(hits) and step < n:  # this step brought something: go on down the ranking
                places = np.argsort(-rank[row], kind="stable")
                kept = -np.sort(-(single[hits] @ qx[row].astype("f4")))[:k]
                for lo in range(step, n, step):
                    more = places[lo : lo + step]
                    cos = single[more] @ qx[row].astype("f4")
                    cos[ids[more] == own[row]] = -2
                    better = more[cos >= max(least - 1e-4, kept[-1] if len(kept) >= k else -1.5)]
                    if not len(better):
                        break
                    hits = np.concatenate([hits, better])
                    kept = -np.sort(-(single[hits] @ qx[row].astype("f4")))[:k]
            if not len(hits):
                continue
            exact = np.round((x[hits] * qx[row]).sum(1), 6)
            good = exact >= least
            hits, exact = hits[good], exact[good]
            if len(hits) > k:
                close = exact >= -np.sort(-exact)[k - 1]
                hits, exact = hits[close], exact[close]
            out[0].extend([own[row]] * len(hits))
            out[1].extend(ids[hits])
            out[2].extend(exact)
    return out


def _search(k: int, least: float, step: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        roles = table.column("role").to_numpy()
        member, query = (roles & 1) > 0, (roles & 2) > 0
        if not member.any() or not query.any():
            return schema.empty_table()
        ids, orders = table.column("id").to_numpy(), _floats(table.column("files"), table.num_rows)
        x = unit(_floats(table.column("v"), table.num_rows))
        a, b, cosine = nearest_in_file(ids[member], orders[member], x[member], ids[query], orders[query], x[query], k, least, step)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cosine, pa.float64())], schema=schema)

    return run


def search(index: DataFrame, k: int = K, least: float = -1.0, posted: int = POSTED, probed: int = PROBED, step: int = STEP, part: int = PART) -> DataFrame:
    """(a, b, cosine): for each asked entry ``a`` of ``build_index`` its most similar entries that the index finds, b != a.

    An entry is a member of the files of its first ``posted`` pivots and, if asked, opens those of its first ``probed``. Postings carry the order and the
    vector, so ranking and reranking happen in the file's task and nothing but its best pairs is shuffled on. A file of more than ``part`` vectors is compared part by part
    (each part of its queries with each part of its members), so none is gathered whole; the lengths of such files are broadcast, at most one row a pivot.
    """
    own = F.posexplode(F.slice("files", 1, max(posted, probed))).alias("rank", "file")
    role = F.when(F.col("rank") < posted, 1).otherwise(0) + F.when((F.col("rank") < probed) & F.col("asked"), 2).otherwise(0)
    posts = index.select("model", "id", "asked", "files", "v", own).withColumn("role", role).where("role > 0")
    lengths = index.select("model", F.explode(F.slice("files", 1, posted)).alias("file")).groupBy("model", "file").count()
    long = lengths.where(F.col("count") > part).select("model", "file", F.ceil(F.col("count") / part).cast("int").alias("g"))
    posts = posts.join(F.broadcast(long), ["model", "file"], "left")
    mine = F.pmod(F.xxhash64("id", F.lit(11)), F.col("g")).cast("int")
    every = F.sequence(F.lit(0), F.col("g") - 1)
    cell = lambda i, j, r: F.struct(i.alias("i"), j.alias("j"), r.cast("int").alias("role"))
    none = F.array().cast("array<struct<i:int,j:int,role:int>>")
    spread = F.concat(
        F.when(F.col("role").bitwiseAND(1) > 0, F.transform(every, lambda i: cell(i, mine, F.lit(1)))).otherwise(none),
        F.when(F.col("role").bitwiseAND(2) > 0, F.transform(every, lambda j: cell(mine, j, F.lit(2)))).otherwise(none))
    cells = F.when(F.col("g").isNull(), F.array(cell(F.lit(0), F.lit(0), F.col("role")))).otherwise(spread)
    placed = posts.select("model", "file", "id", "files", "v", F.explode(cells).alias("c")).select("model", "file", "c.i", "c.j", "c.role", "id", "files", "v")
    found = placed.groupBy("model", "file", "i", "j").applyInArrow(_search(k, least, step), "a long, b long, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _heads(entries: DataFrame, k: int) -> DataFrame:
    """(id, chunk_id): of chunks with equal vectors the first k + 1 by id; no other can be among the k nearest of any chunk."""
    by_id = Window.partitionBy("model", "id").orderBy("chunk_id")
    return entries.select("model", "id", "chunk_id").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).select("id", "chunk_id")


def nearest(vectors: DataFrame, k: int = K, share: int = QUERY_SHARE, posted: int = WIDE_POSTED, probed: int = WIDE_PROBED, step: int = WIDE_STEP, length: int = WIDE_ORDER) -> DataFrame:
    """(chunk_id, place, neighbour, cosine): the ``k`` most similar other chunks of the same model, for each chunk whose hashed id is divisible by ``share`` (1: every chunk).

    Equal cosines (to six digits) rank by chunk id, smaller first. ``vectors`` comes from clean_vectors; empty input gives an empty result, a model's only vector has no row.
    """
    asked = F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0
    entries, index = build_index(vectors, length, asked)
    found = search(index, k, -1.0, posted, probed, step)
    heads = _heads(entries, k)
    own = entries.where("asked").select(F.col("id").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("cosine"))
    best = found.withColumn("n", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).where(F.col("n") <= k).drop("n").unionByName(own)
    ask = entries.where("asked").select(F.col("id").alias("a"), F.col("chunk_id").alias("x"))
    pairs = ask.join(best, "a").join(heads.select(F.col("id").alias("b"), F.col("chunk_id").alias("y")), "b").where("x != y")
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("place") <= k)
    return ranked.select(F.col("x").alias("chunk_id"), "place", F.col("y").alias("neighbour"), "cosine")


def mutual_neighbours(vectors: DataFrame, least: float = 0.9, k: int = K) -> DataFrame:
    """(chunk_a, chunk_b, cosine): pairs of chunks of one model with cosine >= ``least``, each among the other's ``k`` most similar.

    Equal cosines (to six digits) rank by chunk id, smaller first. Of chunks with equal vectors the first k + 1 by id are therefore the only ones that can
    be a neighbour of any chunk of the group, which bounds what a group of copies adds: its other members only look up, they are nobody's neighbour, and so are in no mutual pair.
    """
    entries, index = build_index(vectors)
    found = write_through(search(index, k, least), "pairs")
    heads = _heads(entries, k)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).distinct()
    several = entries.groupBy("id").agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).where("lo < hi")
    own = several.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    linked = (
        both.unionByName(own)
        .join(heads.select(F.col("id").alias("a"), F.col("chunk_id").alias("x")), "a")
        .join(heads.select(F.col("id").alias("b"), F.col("chunk_id").alias("y")), "b")
        .where("x != y")
        .select("x", "y", "cosine")
    )
    ranked = linked.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "y"))).where(F.col("n") <= k)
    pair = ranked.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"), "cosine")
    return pair.groupBy("chunk_a", "chunk_b").agg(F.count("*").alias("sides"), F.max("cosine").alias("cosine")).where("sides = 2").select("chunk_a", "chunk_b", "cosine")
