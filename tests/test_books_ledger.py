"""Pair moments, books and the ledger against plain versions and figures worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from lodestrata.operators import books as B
from lodestrata.operators import ledger as L
from lodestrata.operators import moments as M

SCHEMA = "strategy string, date date, asset string, ret double"


def long(x, strategy="s"):
    return [(strategy, dt.date(2024, 1, 1) + dt.timedelta(t), f"a{i}", None if np.isnan(v) else float(v)) for t, r in enumerate(x) for i, v in enumerate(r)]


def matrix(rows, n):
    c = np.full((n, n), np.nan)
    for r in rows:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        c[i, j] = c[j, i] = np.nan if r["cov"] is None else r["cov"]
    return c


def plain(x, method):
    x = x[~np.isnan(x).any(axis=1)]
    t, n = x.shape
    z = x - x.mean(axis=0)
    if method == "sample":
        return np.cov(x.T)
    if method == "ewma":
        k = 0.5 ** (1 / 30)
        return k**t * np.cov(x.T) + sum((1 - k) * k ** (t - 1 - i) * np.outer(r, r) for i, r in enumerate(z))
    s = z.T @ z / t
    target = np.trace(s) / n * np.eye(n)
    apart = ((s - target) ** 2).sum()
    share = min(1.0, sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / t**2 / apart)
    return share * target + (1 - share) * s


@pytest.mark.parametrize("method", ["sample", "lw", "ewma"])
def test_covariances_by_pairs(spark, method):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 6)) + rng.normal(size=(90, 1)), rng.normal(size=(40, 3)) * [1, 5, 9] + 100
    x[7, 2] = x[50, 0] = np.nan
    df = M.covariance(spark.createDataFrame(long(x) + long(y, "u"), SCHEMA), method, "strategy").collect()
    assert len(df) == 21 + 6
    for k, v in (("s", x), ("u", y)):
        assert np.allclose(matrix([r for r in df if r["strategy"] == k], v.shape[1]), plain(v, method), atol=1e-10)


@pytest.mark.parametrize("method", ["sample", "lw", "denoised", "ewma"])
def test_covariance_of_too_few_dates_is_null(spark, method):
    df = spark.createDataFrame(long(np.array([[0.1, 0.2, 0.3]])) + long(np.array([[1.0, np.nan], [np.nan, 2.0], [1.0, np.nan]]), "gaps"), SCHEMA)
    rows = M.covariance(df, method, "strategy").collect()
    assert len(rows) == 9 and all(r["cov"] is None or np.isnan(r["cov"]) for r in rows)
    assert M.covariance(df.limit(0), method, "strategy").count() == 0


def test_denoising():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    x[:, 1] = 0.5
    c = M.without_noise(np.cov(x.T), 50)
    assert np.isfinite(c).all() and not c[1].any()
    x = rng.normal(size=(400, 20)) + 2 * rng.normal(size=(400, 1))
    s = np.cov(x.T)
    c = M.without_noise(s, 400)
    assert np.allclose(np.diag(c), np.diag(s))
    off = ~np.eye(20, dtype=bool)
    sd = np.sqrt(np.diag(s))
    assert (c / np.outer(sd, sd))[off].std() < (s / np.outer(sd, sd))[off].std()
    value = np.linalg.eigvalsh(M.without_noise(np.eye(4) * 9.0, 100))
    assert np.allclose(value, 9)


def test_windows_see_only_the_past(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    x[:40, 2] = np.nan
    rows = M.trailing(spark.createDataFrame(long(x), SCHEMA).drop("strategy"), 10, 30).collect()
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    start = day(dt.date(2024, 1, 1))
    got = {(day(r["cutoff"]), r["asset"], day(r["date"])) for r in rows}
    want = set()
    for end in range(start + 30, start + 120 + 10):
        if end % 10 == 0:
            days = [d for d in range(end - 30, end) if start <= d < start + 120]
            for i in range(3):
                if sum(not np.isnan(x[d - start, i]) for d in days) >= 0.8 * len(days):
                    want |= {(end, f"a{i}", d) for d in days}
    assert got == want and len(rows) == len(got)


def plain_order(d):
    """Repeated search of the nearest pair of clusters."""
    live, number = {i: [i] for i in range(len(d))}, len(d)
    while len(live) > 1:
        _, a, b = min((d[np.ix_(live[a], live[b])].min(), a, b) for a in live for b in live if a < b)
        live[number] = live.pop(a) + live.pop(b)
        number += 1
    return live.popitem()[1]


def test_hierarchical_books():
    for seed in range(50):
        x = np.random.default_rng(seed).normal(size=(60, 8))
        c = np.cov((x + x[:, :1]).T)
        sd = np.sqrt(np.diag(c))
        d = np.sqrt(np.clip((1 - c / np.outer(sd, sd)) / 2, 0, None))
        assert B.leaf_order(d) == plain_order(d)
        w = B.hierarchical(c)
        assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    assert np.allclose(B.hierarchical(np.diag([1.0, 4.0])), [0.8, 0.2])
    assert B.leaf_order(np.zeros((1, 1))) == [0]


def test_books_by_key(spark):
    rng = np.random.default_rng(3)
    panel = spark.createDataFrame(long(rng.normal(size=(60, 5))) + long(rng.normal(size=(60, 5)), "u") + long(np.ones((1, 5)), "short"), SCHEMA)
    alphas = spark.createDataFrame([(k, f"a{i}", float(i - 2)) for k in ("s", "u", "none") for i in range(5)], "strategy string, asset string, alpha double")
    cov = M.covariance(panel, "lw", "strategy")
    for method in ("min_variance", "mean_variance", "hrp"):
        by = {}
        for r in B.books(cov, alphas, method, "strategy").collect():
            by.setdefault(r["strategy"], {})[r["asset"]] = r["weight"]
        assert set(by) == {"s", "u"} and all(len(w) == 5 for w in by.values())
        for w in by.values():
            if method == "min_variance":
                assert abs(sum(w.values()) - 1) < 1e-9
            else:
                assert sum(map(abs, w.values())) <= 1 + 1e-9 and max(map(abs, w.values())) <= 0.25 + 1e-9


def run(prices, weights, rates=None, fills=None, **rules):
    days = pd.date_range("2024-01-01", periods=len(prices))
    px, w = (pd.DataFrame(v, index=days, columns=list("AB")[: len(prices[0])], dtype=float) for v in (prices, weights))
    f = px * 0 if rates is None else pd.DataFrame(rates, index=days, columns=px.columns, dtype=float)
    fill = px if fills is None else pd.DataFrame(fills, index=days, columns=px.columns, dtype=float)
    out = L.run_ledger(px, w, f, fill, L.Rules(**rules))
    return {c: out.pivot(index="date", columns="asset", values=c).to_numpy() for c in out.columns[2:]}


def test_band_edges():
    weight, price = np.array([-0.035413670, -0.069545871, -0.106200685, 0.073186888]), np.array([379.92, 9377.01, 2.826, 70.75])
    r = L.Rules(band=0.1)
    assert np.allclose(L.wanted(np.zeros(4), price, weight, 100_000, r), [0, -0.2084446, -1988.7007988, 32.7729866], atol=1e-3)
    r = L.Rules(band=0.05, relative=True)
    held, price = np.array([100.0]), np.array([10.0])
    assert [L.wanted(held, price, np.array([w]), 10_000, r)[0] for w in (0.104, 0.106, 0.0, np.nan)] == pytest.approx([100, 106, 0, 0])
    assert L.wanted(held, price, np.array([0.3]), 10_000, L.Rules(band=0.1, to_target=True))[0] == pytest.approx(300)


def test_gains_funding_and_sizes():
    a = run([[100.0], [110.0]], [[0.5], [0.5]], [[0.01], [0.002]], cash=1000, margin=0.1)
    assert a["funding"].ravel() == pytest.approx([0, 1.1]) and a["pnl"].ravel() == pytest.approx([0, 51.1])
    assert a["equity"][1, 0] == pytest.approx(1051.1) and a["position"].ravel() == pytest.approx([5, 500 / 110])
    w = [[0.5, 0.0]] * 2
    assert [run([[100, 100], [p, 100]], w, cash=1000, compound=c)["value"][1, 0] for p, c in ((120, False), (120, True), (80, False))] == pytest.approx([500, 550, 450])


def test_margin():
    a = run([[100, 100], [75, 100]], [[5.0, 0]] * 2, cash=1000, margin=0.1)
    assert a["margin_call"][1, 0] and a["position"][1, 0] == 0
    assert not run([[100, 100], [92, 100]], [[2.0, 0]] * 2, cash=1000, margin=0.1)["margin_call"].any()
    a = run([[100, 100], [95, 100]], [[9.0, 0]] * 2, cash=1000, margin=0.1)
    assert a["margin_call"][1, 0] and a["trade"][1, 0] < 0 and a["cash"][1, 0] >= 0
    units = np.array([90.0])
    _, sold, _ = L.call(L.Account(units, np.array([95.0]), 550.0), L.Rules(margin=0.1))
    assert sold[0] == pytest.approx(90 * 1.05 * 305 / 855)
    a = run([[100, 100]] * 2, [[15.0, 0]] * 2, cash=1000, margin=0.1)
    assert a["reduced"][0, 0] and a["value"][0, 0] == pytest.approx(9500)


def test_ends_lots_and_fills():
    a = run([[100, 50], [110, 50], [np.nan, 50], [np.nan, 50]], [[0.5, 0.5]] * 2 + [[0, 0.5]] * 2, cash=1000, margin=0.1)
    assert a["position"][2, 0] == 0 and a["trade"][2, 0] == -a["position"][1, 0] and a["equity"][2, 0] == pytest.approx(a["equity"][1, 0])
    with pytest.raises(ValueError):
        run([[100, 50], [np.nan, 50]], [[0.5, 0.5]] * 2)
    a = run([[100, 100]] * 3, [[0.004, 0.5], [0.004, 0.505], [0, 0]], cash=1000, least=10)
    assert a["position"].tolist() == [[0, 5], [0, 5], [0, 0]]
    assert run([[100, 3.0]] * 2, [[0.333, -0.5]] * 2, cash=1000, lots={"A": 1.0, "B": 10.0})["position"][0] == pytest.approx([3, -160])
    assert L.orderly(np.zeros(2), np.array([0.29, 0.2999]), np.full(2, 1000.0), np.full(2, 0.01), L.Rules(lots={"x": 1})) == pytest.approx([0.29, 0.29])
    a = run([[100.0]] * 2, [[0.5]] * 2, fills=[[101.0]] * 2, cash=1000)
    assert a["position"][0, 0] == pytest.approx(5) and a["equity"][0, 0] == pytest.approx(995)


@pytest.mark.parametrize("size", [1.0, 8.0])
def test_money_is_conserved(spark, size):
    rng = np.random.default_rng(5)
    px = 100 * np.cumprod(1 + rng.normal(0, 0.04, (150, 4)), axis=0)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(t), f"a{i}", float(px[t, i]), float(rng.normal() * size), float(rng.normal() * 1e-4)) for k in ("x", "y") for t in range(150) for i in range(4)]
    df = spark.createDataFrame(rows, "strategy string, date date, asset string, close double, weight double, funding double")
    out = L.backtest(df, "strategy", L.Rules(cash=1000.0, margin=0.1, fee=0.001, band=0.05)).toPandas()
    assert len(out) == 1200
    for _, g in out.groupby("strategy"):
        day = g.groupby("date").agg(pnl=("pnl", "sum"), fee=("commission", "sum"), equity=("equity", "first"), cash=("cash", "first"), margin=("margin", "first"))
        assert np.allclose(1000 + (day["pnl"] - day["fee"]).cumsum(), day["equity"])
        assert np.allclose(day["cash"] + day["margin"], day["equity"])
    assert size < 8 or out["margin_call"].any()
