from __future__ import annotations

import numpy as np

from pagemill.operators import retrieval


def test_a_long_query_vector_costs_no_other_query_its_neighbours(spark, monkeypatch):
    x = np.random.RandomState(2).randn(60, 8)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, [1.0] * 9), (901, [1.0] * 3), (902, []), (903, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = df.where("id % 10 = 0 or id >= 900")
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got: dict[int, list] = {}
        for r in retrieval.knn_batch(asked, df, 3, "id", "id", "v").collect():
            got.setdefault(r["q"], []).append((-r["score"], r["p"]))
        assert sorted(got) == list(range(0, 60, 10))
        for q in got:
            s = x @ x[q]
            s[q] = -np.inf
            assert [p for _, p in sorted(got[q])] == list(np.argsort(-s, kind="stable")[:3])
    bare = df.where("id >= 902")
    assert retrieval.knn_batch(bare, bare, 3, "id", "id", "v").count() == 0
