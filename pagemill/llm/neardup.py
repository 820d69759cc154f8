"""Problem 4: records that are edited copies of one another.

Every text gets a 256-bit fingerprint whose Hamming distance estimates the Jaccard similarity of its word shingles (one bit of each
of 256 min-hashes). The outer shards are bands of the min-hashes (shared runs of three), which an unrelated pair rarely has in common. A shard of at most
LEAF texts is a leaf whose pairs are compared. A larger one is partitioned by the Hamming distance from a vantage point: rings that no pair within the radius can
bridge are never brought together, overlapping ones are searched with vantage-point trees, which drop branches by the triangle bound. Pairs within the radius are checked exactly on their
shingles.

A vantage-point partition of the whole collection has nothing to prune at these similarities: two unrelated texts are 128
bits apart give or take 8, partners at similarity 0.4 are 77 apart, so the ball around a query reaches into every ring.

Texts with the same words are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.shared import write_through

#: Min-hashes of a band and bands. A pair of similarity 0.4 shares a band with probability 0.957, of 0.5 with 0.998.
BAND_ROWS, BANDS = 3, 48
#: Bits of a fingerprint and the search radius: similarity 0.4 is 77 bits apart on average, with a deviation of 7.3.
BITS, RADIUS = 256, 104
_HASHES = 256
#: Texts of a leaf; bits of a ring around a shard's vantage point; texts of a cell (a ring, or a part of one) that a task compares with another cell.
LEAF, RING, CELL = 64, 8, 20_000


def word_array(text: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF, as written."""
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def shingle_array(words: Column, size: int) -> Column:
    """Distinct hashes of the runs of ``size`` consecutive words; empty when there are fewer words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_RNG = np.random.RandomState(20240517)
_MUL = _RNG.randint(1, 1 << 31, _HASHES).astype("u4") * np.uint32(2) + np.uint32(1)
_ADD = _RNG.randint(0, 1 << 31, _HASHES).astype("u4")


def signatures(words: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(min-hashes n x 256, fingerprints n x 4) of texts given as arrays of word hashes, each at least ``size`` long."""
    lengths = np.array([len(w) for w in words])
    flat = np.concatenate(words).view("u8")
    h = np.zeros(len(flat) - size + 1, "u8")
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - size + 1 + i]
    h = _mix(h)
    starts = np.concatenate([[0], lengths.cumsum()[:-1]])
    # runs that would cross into the next text get the largest hash
    cross = np.ones(len(h), bool)
    ends = starts + lengths - size
    for back in range(1, size):
        at = ends + back
        cross[at[at < len(h)]] = False
    low = (h & np.uint64(0xFFFFFFFF)).astype("u4")
    mins = np.empty((len(words), _HASHES), "u4")
    high = ~cross
    for j in range(_HASHES):
        x = low * _MUL[j] + _ADD[j]
        x ^= x >> np.uint32(15)
        x[high] = 0xFFFFFFFF
        mins[:, j] = np.minimum.reduceat(x, starts)
    bits = np.packbits(((mins * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(bool), axis=1)
    return mins, np.ascontiguousarray(bits).view("i8")


def band_keys(mins: np.ndarray) -> np.ndarray:
    """Keys (n x BANDS) of the bands."""
    x = mins[:, : BAND_ROWS * BANDS].reshape(len(mins), BANDS, BAND_ROWS).astype("u8")
    key = np.arange(BANDS, dtype="u8")[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for i in range(BAND_ROWS):
        key = _mix(key + x[:, :, i] * np.uint64(0x9E3779B97F4A7C15))
    return key.view("i8")


def _sign(size: int, with_bands: bool):
    """Bands (exploded: one row each) or fingerprints of texts given as id, salt and words (word hashes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for pdf in batches:
            fresh = [i for i in pdf["id"] if i not in seen]
            mask = pdf["id"].isin(set(fresh)) & ~pdf["id"].duplicated()
            pdf = pdf[mask]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(fresh)
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                mins, bits = signatures([np.asarray(w, "i8") for w in part["words"]], size)
                if with_bands:
                    # kinds are never compared, so they share no shard
                    keys = band_keys(mins) ^ part["salt"].to_numpy()[:, None]
                    yield pd.DataFrame({"band": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), BANDS)})
                else:
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "kind": part["kind"].to_numpy(), "f0": bits[:, 0], "f1": bits[:, 1], "f2": bits[:, 2], "f3": bits[:, 3], "words": list(part["words"])})

    return run


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x (n x 4 words of 64 bits) from the row or rows y."""
    return np.bitwise_count(x ^ y).sum(-1, dtype="i4")


def _compare(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(a), 256):
        i, j = np.nonzero(hamming(x[a[at : at + 256], None, :], x[None, b, :]) <= radius)
        yield a[at + i], b[j]


def cross_pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) within the radius. The larger side is split at the median distance from a vantage point of its own; of the other side each half gets
    only those that the triangle bound allows a partner there."""
    if len(a) > len(b):
        yield from ((j, i) for i, j in cross_pairs(x, b, a, radius, leaf))
        return
    if not len(a) or len(b) <= leaf:
        if len(a):
            yield from _compare(x, a, b, radius)
        return
    to_b, to_a = hamming(x[b], x[b[0]]), hamming(x[a], x[b[0]])
    middle = np.median(to_b)
    near = to_b <= middle
    if near.all():
        yield from _compare(x, a, b, radius)
        return
    yield from cross_pairs(x, a[to_a <= middle + radius], b[near], radius, leaf)
    yield from cross_pairs(x, a[to_a > middle - radius], b[~near], radius, leaf)


def tree_pairs(x: np.ndarray, rows: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, each once, by a vantage-point tree: both halves around the median, and what lies within the radius of the boundary on its two sides."""
    if len(rows) <= leaf:
        yield from ((i[i < j], j[i < j]) for i, j in _compare(x, rows, rows, radius))
        return
    d = hamming(x[rows], x[rows[0]])
    middle = np.median(d)
    near = d <= middle
    if near.all():
        yield from ((i[i < j], j[i < j]) for i, j in _compare(x, rows, rows, radius))
        return
    yield from tree_pairs(x, rows[near], radius, leaf)
    yield from tree_pairs(x, rows[~near], radius, leaf)
    yield from cross_pairs(x, rows[near & (d > middle - radius)], rows[~near & (d <= middle + radius)], radius, leaf)


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tree(table: pa.Table) -> pa.Table:
    """Near pairs of two cells, or within one."""
    ids, left = table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
    x = np.stack([table.column(f"f{i}").to_numpy() for i in range(4)], 1).view("u8")
    rows = np.arange(len(ids))
    same = table.num_rows and table.column("c1")[0] == table.column("c2")[0]
    found = list(tree_pairs(x, rows, RADIUS) if same else cross_pairs(x, rows[left], rows[~left], RADIUS))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.array([], "i8") for k in (0, 1))
    return pa.table([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], schema=_NEAR)


def large_shards(members: DataFrame, ring: int = RING, cell: int = CELL) -> DataFrame:
    """(a, b): pairs within RADIUS inside shards too large for a leaf. ``members`` has band, id, f0 to f3.

    Each shard is cut into rings of ``ring`` bits around the fingerprint of its smallest id, rings of more than ``cell`` texts by hash as well; cells whose rings are further apart than
    the radius never meet, and each meeting of two cells is one group of at most about twice ``cell`` texts. Nothing is dropped however large a shard is.
    """
    prints = [f"f{i}" for i in range(4)]
    centre = members.groupBy("band").agg(F.min(F.struct("id", *prints)).alias("v")).select("band", *[F.col(f"v.{p}").alias(p.replace("f", "v")) for p in prints])
    ringed = members.join(centre, "band").withColumn("ring", F.floor(_distance("f", "v") / ring).cast("int")).select("band", "ring", "id", *prints)
    parts = ringed.groupBy("band", "ring").count().select("band", "ring", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    placed = write_through(ringed.join(parts, ["band", "ring"]).withColumn("c", F.col("ring") * (1 << 20) + F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")).select("band", "c", "id", *prints), "cells")
    cells = placed.select("band", "c").distinct()
    apart = (F.shiftright("c2", 20) - F.shiftright("c1", 20)) * ring - (ring - 1)
    meet = cells.withColumnRenamed("c", "c1").join(cells.withColumnRenamed("c", "c2"), "band").where((F.col("c1") <= F.col("c2")) & (apart <= RADIUS))
    first = placed.join(meet.withColumn("c", F.col("c1")), ["band", "c"]).select("band", "c1", "c2", F.lit(True).alias("left"), "id", *prints)
    second = placed.join(meet.where("c1 < c2").withColumn("c", F.col("c2")), ["band", "c"]).select("band", "c1", "c2", F.lit(False).alias("left"), "id", *prints)
    return first.unionByName(second).groupBy("band", "c1", "c2").applyInArrow(_tree, "a long, b long")


def similar_classes(texts: DataFrame, least: float, size: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, kind, key) puts each record in its class of equal word sequences; links (a, b, similarity) are pairs of
    different classes of one kind, a < b, with a Jaccard similarity of at least ``least`` over runs of ``size`` words.

    ``texts`` has kind, key and text, one row per record. Records with fewer than ``least_words`` words (null and empty texts too) have no class.
    Equal texts are signed once a task and meet as one id in the shards; a class is told by a 64-bit hash of its kind and words.

    Of every text only its bands are shuffled (band and id); words and fingerprints move for those texts alone that share a band with another.
    """
    n = max(least_words, size)
    words = texts.select("kind", "key", word_array(F.col("text")).alias("w")).where(F.size("w") >= n)
    classed = words.select("kind", "key", F.xxhash64("kind", "w").alias("id"), F.xxhash64("kind").alias("salt"), F.transform("w", lambda x: F.xxhash64(x)).alias("words"))
    members = classed.select("id", "kind", "key")

    # outer shards: only bands with two different texts go on. A band is one of BANDS that a text has, so even one of a third of all texts is a small part of the rows; the window spills
    shards = classed.select("id", "salt", "words").mapInPandas(_sign(size, True), "band long, id long")
    by_band = Window.partitionBy("band")
    several = shards.withColumns({"lo": F.min("id").over(by_band), "hi": F.max("id").over(by_band)}).where("lo < hi").select("band", "id").distinct()
    shared = write_through(several, "shards")

    touched = shared.select("id").distinct()
    signed = classed.join(touched, "id", "left_semi").select("id", "kind", "salt", "words").mapInPandas(
        _sign(size, False), "id long, kind string, f0 long, f1 long, f2 long, f3 long, words array<long>")
    signed = write_through(signed.dropDuplicates(["id"]), "signatures")
    prints = signed.select("id", "f0", "f1", "f2", "f3")

    counts = shared.groupBy("band").count()
    leaves = shared.join(counts.where(F.col("count") <= LEAF).select("band"), "band", "left_semi")
    leaf_pairs = leaves.withColumnRenamed("id", "a").join(leaves.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()

    def both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """The pairs with the columns of either side, prefixed a and b."""
        left, right = (table.select(F.col("id").alias(x), *[F.col(c).alias(x + c[1:] if c[0] == "f" else x + "_" + c) for c in columns]) for x in "ab")
        return pairs.join(left, "a").join(right, "b")

    leaf_near = both(leaf_pairs, prints, ["f0", "f1", "f2", "f3"]).where(_distance("a", "b") <= RADIUS).select("a", "b")
    large = shared.join(counts.where(F.col("count") > LEAF).select("band"), "band", "left_semi").join(prints, "id")
    near = write_through(leaf_near.unionByName(large_shards(large)).distinct(), "near")

    # the exact check, on the shingles of each text in a near pair
    sets = signed.join(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "kind", shingle_array(F.col("words"), size).alias("s"))
    checked = both(near, sets, ["kind", "s"]).where("a_kind = b_kind").withColumn("common", F.size(F.array_intersect("a_s", "b_s")))
    links = checked.withColumn("similarity", F.col("common") / (F.size("a_s") + F.size("b_s") - F.col("common")))
    return members, links.where(F.col("similarity") >= least).select("a", "b", "similarity")


def records(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, key, text): every page text (key document_id:page_no) and every chunk text (key chunks.id). Equal deliveries are one row."""
    p = pages.where("text is not null").select(F.lit("page").alias("kind"), F.concat_ws(":", "document_id", F.col("page_no").cast("string")).alias("key"), "text")
    c = chunks.where("text is not null").select(F.lit("chunk").alias("kind"), F.col("id").alias("key"), "text")
    return p.unionByName(c)


def edited_copies(texts: DataFrame, least: float = 0.4, size: int = 3, least_words: int = 30) -> DataFrame:
    """(key_a, key_b): pairs of records of one kind, key_a < key_b, whose similarity is at least ``least``; records with the same words count.

    Within a class of equal texts every two members are a pair, and so are the members of two linked classes: the result has as many rows as there are true pairs.
    ``copy_groups`` gives the compact form.
    """
    members, links = similar_classes(texts, least, size, least_words)
    members = write_through(members.distinct(), "members")
    linked = write_through(links.select("a", "b"), "links")
    touched = linked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    of_links = members.join(touched, "id", "left_semi")
    across = linked.join(of_links.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(of_links.select(F.col("id").alias("b"), F.col("key").alias("y")), "b")
    several = members.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("id")
    copies = members.join(several, "id", "left_semi")
    inside = copies.select("id", F.col("key").alias("x")).join(copies.select("id", F.col("key").alias("y")), "id").where("x < y")
    pairs = across.select("x", "y").unionByName(inside.select("x", "y")).where("x != y")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def copy_groups(texts: DataFrame, least: float = 0.8, size: int = 5, least_words: int = 5) -> DataFrame:
    """(kind, key, class_key, links, linked): one row per record with a text, with its class of equal texts (named by its smallest key) and the number of different texts that
    the class is linked to. On the row of the record that names the class, linked has the class keys of those texts; on the others it is empty, so that the result
    stays linear in records and links however large a class is. Records with fewer than ``least_words`` words have no links.
    """
    n = max(least_words, size)
    members, links = similar_classes(texts, least, size, least_words)
    words = texts.where("text is not null").select("kind", "key", word_array(F.col("text")).alias("w"))
    short = words.where(F.size("w") < n).select(F.xxhash64("kind", "w").alias("id"), "kind", "key")
    members = write_through(members.unionByName(short).distinct(), "members")
    names = members.groupBy("id").agg(F.min("key").alias("class_key"))
    either = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.id", "x.other")
    linked = either.join(names.select(F.col("id").alias("other"), "class_key"), "other").groupBy("id").agg(F.count("*").alias("links"), F.array_sort(F.collect_list("class_key")).alias("linked"))
    own = F.when(F.col("key") == F.col("class_key"), F.col("linked"))
    return members.join(names, "id").join(linked, "id", "left").select(
        "kind", "key", "class_key", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(own, F.array().cast("array<string>")).alias("linked"))
