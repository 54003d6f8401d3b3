"""Queries far from all clusters get their rows too."""

import numpy as np

from lodestrata.llm import nearest as nn


def test_scattered_queries_get_k_rows(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(80, 32)), 50, axis=0) + rng.normal(scale=0.02, size=(4000, 32))
    far = [1000, 2000]  # too few of 400 queries to move the measured radius
    x[far] = rng.normal(size=(2, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in sorted(nn.nearest(docs, step=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == set(range(0, 4000, 10))
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(np.isclose(s, x[q] @ x[v]) for _, v, s in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
