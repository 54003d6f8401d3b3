"""Forecasts, calibration and attribution of the panel risk model against plain pandas, on made panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import risk_model as R

FACTORS = ("market", "size", "vol")


def made(days, assets, seed):
    """Returns of a market, two styles and noise, with some holes in the universe."""
    rng = np.random.default_rng(seed)
    size, vol = rng.normal(size=assets), rng.normal(size=assets)
    f = rng.normal(size=(days, 3)) * [0.02, 0.015, 0.015]
    zs = np.column_stack([np.ones(assets), (size - size.mean()) / size.std(), (vol - vol.mean()) / vol.std()])
    r = f @ zs.T + rng.normal(size=(days, assets)) * 0.03
    dates = pd.date_range("2021-01-01", periods=days).date
    rows = pd.DataFrame({"date": np.repeat(dates, assets), "asset": np.tile([f"a{i:03d}" for i in range(assets)], days), "ret": r.ravel()})
    rows["close"], rows["vol"], rows["funding"] = 100.0, np.tile(np.exp(0.3 * vol) * 0.04, days), 0.0
    rows["cap"] = np.tile(np.exp(size + 20), days)
    rows["in_universe"] = rng.random(len(rows)) > 0.03
    rows["weight"] = rng.normal(0.5, 1, len(rows)) / assets
    return rows, f


@pytest.fixture(scope="module")
def model(spark):
    rows, f = made(260, 40, 3)
    panel = spark.createDataFrame(rows)
    expo = R.durable(R.build_exposures(panel, momentum=5, funding=5))
    return rows, f, panel, expo, R.fit(panel, expo, FACTORS, most=1e6)


def weights_of(panel):
    w = panel.where("in_universe").select("date", "asset", "weight")
    return w.withColumn("book", F.lit("one")).unionByName(w.where("asset < 'a020'").withColumn("book", F.lit("two")))


def test_exposures(model):
    rows, _, _, expo, _ = model
    got = expo.toPandas()
    assert len(got) == rows["in_universe"].sum() and (got["market"] == 1).all() and (got[["liquidity", "momentum", "funding"]] == 0).all().all()
    rows = rows.assign(size=np.log(rows.groupby("asset")["cap"].shift(1)), v=np.log(rows["vol"]))
    members = rows[rows["in_universe"]]
    for mine, raw in (("size", "size"), ("vol", "v")):
        z = members.groupby("date")[raw].transform(lambda s: ((s - s.mean()) / s.std(ddof=0)).clip(-3, 3)).fillna(0)
        want = members.assign(z=z)[["date", "asset", "z"]]
        both = got.merge(want, on=["date", "asset"])
        np.testing.assert_allclose(both[mine], both["z"], atol=1e-9)


def test_recovers_factor_returns(model):
    _, f, _, _, m = model
    got = R.factor_returns(m).orderBy("date").toPandas()
    for i, name in enumerate(FACTORS):
        assert np.corrcoef(got[f"f_{name}"][5:], f[6 : len(got) + 1, i])[0, 1] > 0.9, name


def test_forecasts_against_plain(model):
    rows, _, panel, expo, m = model
    halflife, idio, least = 20.0, 10.0, 20
    got = R.predicted_vol(m, expo, weights_of(panel), ["book"], halflife, idio, least=least).toPandas().sort_values(["book", "date"])
    fitted = m.toPandas()
    names = R.factors_of(m)
    fr = fitted.groupby("date")[[f"f_{n}" for n in names]].first()
    k, cov, cov_at = 0.5 ** (1 / halflife), None, {}
    for d, x in zip(fr.index, fr.to_numpy(), strict=True):
        cov_at[d] = cov
        cov = np.outer(x, x) if cov is None else k * cov + (1 - k) * np.outer(x, x)
    eps = fitted.pivot(index="date", columns="asset", values="residual").reindex(fr.index) ** 2
    eps = eps.ewm(alpha=1 - 0.5 ** (1 / idio), adjust=False, min_periods=5).mean().shift(1)
    e = expo.toPandas()
    want = []
    for book, w in weights_of(panel).toPandas().groupby("book"):
        x = w.merge(e, on=["date", "asset"])
        x = x[list(names)].mul(x["weight"], axis=0).groupby(x["date"]).sum()
        for i, d in enumerate(x.index):
            if i < least or cov_at.get(d) is None:
                continue
            wd = w[w["date"] == d].set_index("asset")["weight"]
            v = eps.loc[d].reindex(wd.index)
            v = v.fillna(v.median() if v.notna().any() else 0.0)
            fv, iv = x.loc[d] @ cov_at[d] @ x.loc[d], (wd**2 * v).sum()
            want.append((book, d, np.sqrt(365 * (fv + iv)), np.sqrt(365 * fv), np.sqrt(365 * iv), iv / (fv + iv)))
    assert [tuple(r) for r in got[["book", "date"]].to_numpy()] == [w[:2] for w in want]
    np.testing.assert_allclose(got[["total", "factor", "idio", "idio_share"]].to_numpy(float), np.array([w[2:] for w in want], dtype=float), rtol=1e-8)


def test_calibrated_and_adds_up(model):
    rows, _, panel, expo, m = model
    keys = ["book"]
    w = weights_of(panel)
    pred, earned = R.predicted_vol(m, expo, w, keys), R.realised(panel, w, keys)
    bias = R.bias_statistic(R.standardised(pred, earned, keys), keys).toPandas()
    assert bias["bias"].between(0.8, 1.25).all() and bias["exceed_95"].between(0.01, 0.12).all() and bias["ratio"].between(0.7, 1.4).all()
    pnl = R.attribute(m, expo, w, keys)
    both = pnl.join(earned, ["book", "date"]).toPandas()
    np.testing.assert_allclose(both["pnl_total"], both["r"], atol=1e-9)
    summary = R.summarise_attribution(pnl, keys).toPandas()
    assert (abs(summary[summary["source"] != "total"].groupby("book")["share"].sum() - 1) < 1e-9).all()
    assert len(summary) == 2 * 5


def test_no_look_ahead(spark, model):
    """Returns after a date change nothing in its forecast."""
    rows, _, panel, expo, m = model
    cut = sorted(rows["date"].unique())[200]
    later = rows.assign(ret=np.where(rows["date"] > cut, rows["ret"] * 10, rows["ret"]))
    other = R.fit(spark.createDataFrame(later), expo, FACTORS, most=1e6)
    w = weights_of(panel)
    a, b = (R.predicted_vol(x, expo, w, ["book"]).where(F.col("date") <= F.lit(cut)).orderBy("book", "date").toPandas() for x in (m, other))
    np.testing.assert_allclose(a["total"], b["total"], rtol=1e-12)
