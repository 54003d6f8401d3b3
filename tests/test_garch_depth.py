"""Variance fits against a plain search and known parameters; book snapshots and hours against plain loops."""

import datetime as dt
import json

import numpy as np
import pytest

from lodestrata.operators import depth, garch


def simulated(rng, n, omega, alpha, beta):
    h, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        r = rng.normal() * h**0.5
        out.append(r)
        h = omega + alpha * r * r + beta * h
    return np.array(out) + 0.3


def loss(r, omega, alpha, beta):
    h = garch._path(r, omega, alpha, beta)[:-1]
    x = r - r.mean()
    return (np.log(h) + x * x / h).sum()


def test_fit():
    rng = np.random.default_rng(4)
    true = [(0.1, 0.1, 0.8), (2.0, 0.3, 0.5), (1e-6, 0.05, 0.93)]
    series = [simulated(rng, 2500, *p) for p in true] + [rng.normal(size=60), np.ones(5), np.array([1.0]), np.array([])]
    got = garch.fit(series)
    for p, g, r in zip(true, got, series, strict=False):
        assert abs(g[1] + g[2] - p[1] - p[2]) < 0.08 and abs(g[1] - p[1]) < 0.08
        assert g[3] == pytest.approx(loss(r, *g[:3]), rel=1e-9) and g[3] <= loss(r, *p) + 1e-6
    assert np.isnan(got[4:]).all()
    # no neighbour is better, also where the best is at a bound
    for g, r in zip(got[:4], series, strict=False):
        for i in range(3):
            for f in (0.98, 1.02):
                q = g[:3].copy()
                q[i] *= f
                if q[1] + q[2] < 1 - 1e-6:
                    assert loss(r, *q) > g[3] - 1e-4
    assert np.allclose(garch.fit(series[:1])[0], got[0], rtol=1e-3)  # company doesn't matter


def test_variance_and_forecast(spark):
    rng = np.random.default_rng(6)
    a = simulated(rng, 300, 0.1, 0.1, 0.8)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(i), float(x)) for i, x in enumerate(a)] + [("a", dt.date(2019, 1, 1), None), ("flat", dt.date(2020, 1, 1), 1.0), ("flat", dt.date(2020, 1, 2), 1.0), (None, dt.date(2020, 1, 1), float("nan"))]
    df = spark.createDataFrame(rows, "asset string, date date, ret double").repartition(4)
    fits = {r["asset"]: r for r in garch.garch_fit(df).collect()}
    omega, alpha, beta, _, _ = garch.fit([a])[0]
    assert fits["a"]["n"] == 300 and (fits["a"]["omega"], fits["a"]["alpha"], fits["a"]["beta"]) == pytest.approx((omega, alpha, beta))
    assert fits["flat"]["omega"] is None and fits["flat"]["n"] == 2 and fits[None]["n"] == 0
    path = garch._path(a, omega, alpha, beta)
    v = {(r["asset"], r["date"]): r["variance"] for r in garch.garch_variance(df).collect()}
    assert len(v) == len(rows) and v["a", dt.date(2019, 1, 1)] is None and v["flat", dt.date(2020, 1, 1)] is None
    assert [v["a", dt.date(2020, 1, 1) + dt.timedelta(i)] for i in range(300)] == pytest.approx(list(path[:-1]))
    f = {r["step"]: r["variance"] for r in garch.garch_forecast(garch.garch_fit(df), 3).collect()}
    want = [path[-1]]
    for _ in range(2):
        want.append(omega + (alpha + beta) * want[-1])
    assert [f[i] for i in (1, 2, 3)] == pytest.approx(want)
    assert garch.garch_variance(df.limit(0)).count() == 0


def message(ms, bids, asks, coin="X"):
    levels = [[{"px": str(p), "sz": str(s), "n": 2} for p, s in side] for side in (bids, asks)]
    return json.dumps({"time": "x", "raw": {"channel": "l2Book", "data": {"coin": coin, "time": ms, "levels": levels}}})


def test_snapshots_and_hours(spark):
    start = 1_704_067_200_000  # an hour's start
    lines = [
        message(start + 600_000, [(99.95, 1.0), (99.8, 2.0), (99.0, 4.0)], [(100.05, 3.0), (100.2, 5.0)]),
        message(start + 1_800_000, [(99.9, 1.0)], [(100.1, 1.0), (100.11, 7.0), (101.0, 9.0)]),
        message(start + 3_600_000, [(50.0, 1.0)], [(51.0, 1.0)]),
        message(start + 5, [], [(1.0, 1.0)]),
        message(start + 5, [(1.0, 1.0)], []),
        "",
        "{broken",
        None,
    ]
    s = depth.snapshots(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["bid"]: r for r in s.collect()}
    assert set(got) == {99.95, 99.9, 50.0}
    one = got[99.95]
    assert (one["mid"], one["bid_sz0"], one["n_ask0"]) == (pytest.approx(100.0), 1.0, 2) and one["spread_bps"] == pytest.approx(10.0)
    assert [one[c] for c in ("bid_d10", "bid_d25", "bid_d50", "ask_d10", "ask_d25", "ask_d50")] == [1.0, 3.0, 3.0, 3.0, 8.0, 8.0]
    h = {r["n_snapshots"]: r for r in depth.hours(s).collect()}
    assert set(h) == {1, 2}
    assert (h[2]["open_bid"], h[2]["close_mid"], h[2]["med_spread_bps"]) == (99.95, pytest.approx(100.0), pytest.approx(15.0))
    assert h[2]["held_ask_d25"] == pytest.approx((8.0 * 1200 + 8.0 * 1800) / 3000) and h[2]["held_bid_d25"] == pytest.approx((3.0 * 1200 + 1.0 * 1800) / 3000)
    assert h[1]["held_bid_d10"] == 0.0 and h[1]["open_mid"] == 50.5
