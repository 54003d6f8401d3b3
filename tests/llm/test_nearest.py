"""Recall against brute force, and what takes part."""

import math

import numpy as np
import pytest

from lodestrata.llm import nearest as nn


def brute(rows, k=20, step=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in sorted(nn.query(spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({x[1] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.93 * sum(map(len, want.values()))
    x = dict(rows)
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        for _, v, s in found:
            assert math.isclose(s, np.dot(np.array(x[q], dtype=float), np.array(x[v], dtype=float)), rel_tol=1e-9, abs_tol=1e-12)


def test_copies_and_bad_rows(spark):
    v, w = [1.0, 0.5, 0.0, 0.25], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, v) for i in range(100)] + [(100 + i, w) for i in range(3)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan")] * 4), (280, [float("inf"), 0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (None, v), (0, v)]
    got = nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by) == {0, 20, 40, 60, 80, 100}
    assert by[0] == list(range(1, 21))
    assert by[40] == list(range(20))[:20]
    assert by[20] == [i for i in range(21) if i != 20]
    assert by[100][:2] == [101, 102]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nn.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nn.nearest(spark.createDataFrame([(3, [1.0])], schema)).count() == 0
    got = nn.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 4.0)]


def retrieved(x, c, q, qc, radius):
    out = []
    for j in range(c.shape[1]):
        i, at, _ = nn.search(x, c, q, qc, j, radius, 10_000)
        out += zip(i.tolist(), at.tolist(), strict=True)
    assert len(out) == len(set(out))  # each by one substring only
    return set(out)


@pytest.mark.parametrize("size", [8, 16, 40])
def test_search_finds_every_code_within_the_radius(size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, size))
    mean, p = nn.learn(x)
    c = nn.encode(x, mean, p)
    for radius in (0, 1, 3, 7, 12, 2 * size):
        want = {(i, j) for i in range(20) for j in range(600) if np.bitwise_count(c[i] ^ c[j]).sum() <= radius}
        assert retrieved(x, c, x[:20], c[:20], radius) == want


def test_extra_columns_and_one_hot_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else rng.normal(size=3).tolist(), "o", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, o string, rank int")
    got = {}
    for r in sorted(nn.nearest(docs).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["score"])
    want = brute([r[:2] for r in rows])
    assert got.keys() == want.keys()
    same = sum(np.isclose(got[q], [s for _, s in want[q]]).all() for q in want)
    assert all(len(v) == 20 for v in got.values()) and same >= 0.9 * len(want)
