from __future__ import annotations

import random

import numpy as np

from pagemill.llm import neardup


def test_short_records_and_links_between_classes(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = " ".join([f"w{i}" for i in range(59)] + ["z"])
    rows = [("page", "a1", long), ("page", "a2", long), ("page", "b1", near), ("page", "b2", near), ("chunk", "c1", long),
            ("page", "s1", "two words"), ("page", "s2", " two\twords "), ("chunk", "s3", "two words"), ("page", "s4", "words"), ("page", "e", ""), ("page", "null", None)]
    df = spark.createDataFrame(rows + rows[5:6], "kind string, key string, text string")
    got = sorted((r["kind"], r["key"], r["class_key"], r["links"], tuple(r["linked"])) for r in neardup.copy_groups(df).collect())
    assert got == sorted([
        ("page", "a1", "a1", 1, ("b1",)), ("page", "a2", "a1", 1, ()), ("page", "b1", "b1", 1, ("a1",)), ("page", "b2", "b1", 1, ()), ("chunk", "c1", "c1", 0, ()),
        ("page", "s1", "s1", 0, ()), ("page", "s2", "s1", 0, ()), ("chunk", "s3", "s3", 0, ()), ("page", "s4", "s4", 0, ()), ("page", "e", "e", 0, ())])


def clusters(n, seed):
    """Fingerprints (n x 4) in clusters of differing spread."""
    rng = np.random.RandomState(seed)
    centres = rng.randint(0, 2, (8, 256))
    bits = np.array([np.where(rng.rand(256) < rng.choice([0.02, 0.15, 0.35]), 1 - centres[i % 8], centres[i % 8]) for i in range(n)])
    return np.ascontiguousarray(np.packbits(bits.astype(bool), axis=1)).view("u8")


def brute(x):
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if neardup.hamming(x[i], x[j]) <= neardup.RADIUS}


def test_vantage_point_trees_against_brute_force():
    x = clusters(500, 1)
    truth = brute(x)
    rows = np.arange(500)
    got = [(min(a, b), max(a, b)) for i, j in neardup.tree_pairs(x, rows, neardup.RADIUS, 4) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == truth and 0 < len(truth) < 500 * 499 / 2
    got = [(a, b) for i, j in neardup.cross_pairs(x, rows[:200], rows[200:], neardup.RADIUS, 4) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in truth if a < 200 <= b}
    same = np.repeat(x[:1], 30, axis=0)
    assert sum(len(i) for i, _ in neardup.tree_pairs(same, np.arange(30), 10, 4)) == 435


def test_triangle_bound_drops_branches(monkeypatch):
    x = np.vstack([clusters(8, 2)[i : i + 1].repeat(60, 0) for i in range(8)])
    work = []
    plain = neardup._compare
    monkeypatch.setattr(neardup, "_compare", lambda x, a, b, r: work.append(len(a) * len(b)) or plain(x, a, b, r))
    found = sum(len(i) for i, _ in neardup.tree_pairs(x, np.arange(len(x)), 20, 16))
    assert found >= 8 * 60 * 59 / 2 and sum(work) < 0.5 * len(x) ** 2


def test_large_shards_in_cells(spark):
    x = clusters(300, 3)
    rows = [(band, i, *[int(v) for v in x[i].view("i8")]) for band, ids in ((7, range(300)), (9, range(50, 120))) for i in ids]
    df = spark.createDataFrame(rows, "band long, id long, f0 long, f1 long, f2 long, f3 long")
    got = {(r["a"], r["b"]) for r in neardup.large_shards(df, cell=20).collect()}
    assert got == brute(x)
    assert neardup.large_shards(df.limit(0)).count() == 0


def test_shared_boilerplate_against_brute_force(spark):
    """Far more than a leaf of different texts that have half their words in common."""
    rng = random.Random(8)
    usual = [f"u{i}" for i in range(60)]
    texts = {f"k{i:03d}": usual + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 80]))] for i in range(150)}
    runs = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in texts.items()}
    truth = {(a, b) for a in texts for b in texts if a < b and len(runs[a] & runs[b]) >= 0.4 * len(runs[a] | runs[b])}
    df = spark.createDataFrame([("page", k, " ".join(w)) for k, w in texts.items()], "kind string, key string, text string")
    got = {tuple(r) for r in neardup.edited_copies(df).collect()}
    assert got <= truth and 1000 < len(truth) < 150 * 149 / 2 and len(got) >= 0.95 * len(truth)
