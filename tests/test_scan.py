"""Ordered scans against plain loops, with far more stretches than keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import grid, quality, scan


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [("long", i, float(rng.normal())) for i in range(5000)] + [("short", i, 1.0) for i in range(3)] + [(None, i, float(i)) for i in range(40)] + [("one", 7, 2.0)]
    rows = [(k, t, None if rng.random() < 0.1 and k == "long" else x) for k, t, x in rows]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "k string, t int, x double").repartition(7)


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in columns))
    return out


def test_numbers_and_spread(series):
    got = by_key(scan.numbered(series, ["k"], ["t"], tasks=16), "_i")
    assert {k: [x[0] for x in v] for k, v in got.items()} == {k: list(range(n)) for k, n in (("long", 5000), ("short", 3), (None, 40), ("one", 1))}
    parts = scan.stretches(series, ["k"], ["t"], 16).where("k = 'long'").groupBy("_part").count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 1500


def test_halo(series):
    rows = scan.halo(scan.numbered(series, ["k"], ["t"], tasks=16), "_i", 100, 20, 30)
    got = {(r["k"], r["_chunk"]): (r["lo"], r["hi"], r["n"]) for r in rows.groupBy("k", "_chunk").agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"), F.count("*").alias("n")).collect()}
    assert got["long", 0] == (0, 129, 130) and got["long", 20] == (1980, 2129, 150) and got["long", 49] == (4880, 4999, 120)
    assert got["short", 0] == (0, 2, 3)
    assert rows.where("_own").count() == series.count()
    with pytest.raises(ValueError, match="halo"):
        scan.halo(rows, "_i", 10, 11)


def test_recurrences(spark, series):
    steps = {"v": (F.when(F.col("x").isNull(), 1.0).otherwise(0.9), F.coalesce("x", F.lit(0.0))), "n": (F.lit(1.0), F.lit(1.0)), "grow": (F.lit(1.01), F.lit(0.0))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # keys go on over batches
    try:
        made = scan.recurrences(series, ["k"], ["t"], steps, {"v": 3.0, "grow": 1.0}, tasks=16)
        got = by_key(made, "x", "v", "v_before", "n", "n_before", "grow")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for rows in got.values():
        v = 3.0
        for i, (x, after, before, n, was, grow) in enumerate(rows):
            assert abs(before - v) < 1e-9 and (n, was) == (i + 1, i)
            v = v if x is None else 0.9 * v + x
            assert abs(after - v) < 1e-9
            assert abs(grow / 1.01 ** (i + 1) - 1) < 1e-9


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm(series, adjust):
    got = by_key(scan.ewm(series, ["k"], ["t"], "x", 7.0, adjust, least=3), "x", "ewm", "ewm_before")
    for rows in got.values():
        x = pd.Series([np.nan if r[0] is None else r[0] for r in rows])
        want = x.ewm(halflife=7.0, adjust=adjust, ignore_na=True, min_periods=3).mean()
        after, before = (pd.Series([np.nan if r[i] is None else r[i] for r in rows]) for i in (1, 2))
        np.testing.assert_allclose(after, want, rtol=1e-9)
        np.testing.assert_allclose(before, want.shift(1), rtol=1e-9)


@pytest.mark.parametrize(("around", "least"), [(51, 5), (7, 5), (5, 5)])
def test_event_gaps_in_chunks(spark, monkeypatch, around, least):
    """Chunks of 40 rows give what whole keys give."""
    rng = np.random.default_rng(8)
    rows = []
    for k, n in (("a", 700), ("b", 5), ("c", 6), ("d", 2), ("e", 90)):
        t = np.cumsum(np.where(rng.random(n) < 0.05, 90, 10) + rng.integers(0, 3, n))
        rows += [(k, int(x)) for x in t]
    want = []
    for k in "abcde":
        t = [x for key, x in rows if key == k]
        d = [None] + [b - a for a, b in zip(t, t[1:])]
        h = around // 2
        med = []
        for i in range(len(t)):
            f = [x for x in d[max(0, i - h) : i + h + 1] if x is not None]
            med.append(float(np.median(f)) if len(f) >= least else None)
        for i in range(1, len(t)):
            m = next((x for x in med[i:] if x is not None), next((x for x in reversed(med[:i]) if x is not None), None))
            if m and d[i] > 2.5 * m:
                want.append((k, t[i - 1], t[i], int(np.floor(d[i] / m + 0.5)) - 1))
    monkeypatch.setattr(scan, "CHUNK", 40)
    df = spark.createDataFrame(rows + [("a", None)], "asset string, s long").select("asset", F.timestamp_seconds("s").alias("ts"))
    got = quality.event_gaps(df, around=around, least=least, tasks=9)
    got = sorted((r["asset"], int(r["gap_start"].timestamp()), int(r["gap_end"].timestamp()), r["n_missing"]) for r in got.collect())
    assert got == sorted(want) and len(want) > 20


def test_without_keys(series):
    """The whole table as one series."""
    rows = series.where("x is not null").select("t", "x", F.coalesce("k", F.lit("")).alias("k"))
    got = scan.recurrences(scan.numbered(rows, [], ["t", "k"], tasks=8), [], ["_i"], {"s": (F.lit(1.0), F.col("x"))}, tasks=8).orderBy("_i").toPandas()
    want = rows.toPandas().sort_values(["t", "k"])
    assert (got["k"].to_numpy() == want["k"].to_numpy()).all()
    np.testing.assert_allclose(got["s"], want["x"].cumsum(), atol=1e-9)


def test_range_counts_without_the_pairs(spark):
    rng = np.random.default_rng(8)
    at = [None, *[int(x) for x in rng.integers(0, 300, 400)]]
    ranges = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-20, 320, 200), rng.integers(-3, 60, 200), strict=True))]
    ranges += [(1000, None, 5), (1001, 5, None), (1, 0, 300), (1, 0, 300)]
    events = spark.createDataFrame([(x,) for x in at], "s long")
    asked = spark.createDataFrame(ranges, "id int, lo long, hi long")
    want = sorted((i, sum(a <= x < b for x in at[1:]) if a is not None and b is not None else 0) for i, a, b in ranges)
    assert sorted((r["id"], r["n"]) for r in grid.range_counts(events, asked, "s", "lo", "hi").collect()) == want
    joined = grid.range_join(events, asked.where("hi > lo"), "s", "lo", "hi", 25).count()
    assert joined == sum(n for _, n in want)
    assert {r["n"] for r in grid.range_counts(events.limit(0), asked, "s", "lo", "hi").collect()} == {0}
    # 40,000 ranges over 40,000 equal events are 1.6 billion pairs
    many = spark.range(40_000).selectExpr("id", "0 AS lo", "2 AS hi")
    assert grid.range_counts(spark.range(40_000).selectExpr("1 AS s"), many, "s", "lo", "hi").agg(F.sum("n")).first()[0] == 1_600_000_000
