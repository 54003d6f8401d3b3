"""Principal components, their probabilistic model and alignment against dense linear algebra."""

import numpy as np
import pandas as pd
import pytest

from lodestrata.operators import components as C


@pytest.fixture(scope="module")
def wide(spark):
    """Four books of three strong factors over forty assets; the second has fewer assets."""
    rng = np.random.default_rng(7)
    b = rng.normal(size=(40, 3)) * [3.0, 2.0, 1.2]
    out, data = [], {}
    for k in range(4):
        r = (rng.normal(size=(90, 3)) @ (b + 0.05 * rng.normal(size=b.shape)).T) * 0.01 + rng.normal(size=(90, 40)) * 0.008
        r = r[:, :30] if k == 1 else r
        data[k] = r
        n = r.shape[1]
        out.append(pd.DataFrame({"book": k, "date": np.repeat(pd.date_range("2024-01-01", periods=90).date, n), "asset": np.tile([f"a{i:02d}" for i in range(n)], 90), "ret": r.ravel()}))
    return data, spark.createDataFrame(pd.concat(out))


@pytest.mark.parametrize("standardize", [False, True])
def test_components(wide, standardize):
    data, panel = wide
    loadings, returns, spectrum = C.principal_components(C.centred(panel, "book", standardize=standardize), "book", 3)
    got, f = loadings.toPandas(), returns.toPandas()
    shares = C.explained(spectrum, "book").toPandas()
    for k, r in data.items():
        x = r - r.mean(axis=0)
        x = x / x.std(axis=0, ddof=1) if standardize else x
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        mine = got[got["book"] == k].sort_values("asset")[["b1", "b2", "b3"]].to_numpy()
        sign = np.sign((mine * vt[:3].T).sum(axis=0))
        np.testing.assert_allclose(mine, vt[:3].T * sign, atol=1e-6)
        assert (mine[np.abs(mine).argmax(axis=0), range(3)] > 0).all()
        np.testing.assert_allclose(f[f["book"] == k].sort_values("date")[["f1", "f2", "f3"]], u[:, :3] * s[:3] * sign, atol=1e-6)
        own = shares[shares["book"] == k].sort_values("factor")
        np.testing.assert_allclose(own["share"], (s**2 / (s**2).sum())[:3], rtol=1e-8)
        np.testing.assert_allclose(own["variance"], s[:3] ** 2 / 89, rtol=1e-8)
        assert standardize or own["share"].sum() > 0.6


def test_probabilistic_model_gives_the_covariance_back(wide):
    data, panel = wide
    loadings, _, spectrum = C.principal_components(C.centred(panel, "book"), "book", 3)
    got, model = loadings.toPandas(), C.probabilistic(spectrum, "book").toPandas().set_index("book")
    for k, r in data.items():
        b = got[got["book"] == k].sort_values("asset")[["b1", "b2", "b3"]].to_numpy()
        c = np.cov(r.T)
        value = np.linalg.eigvalsh(c)[::-1]
        assert np.isclose(model.loc[k, "noise"], value[3:].mean())
        np.testing.assert_allclose(model.loc[k, "factor_variance"], value[:3] - value[3:].mean(), rtol=1e-7)
        assert np.abs(b * model.loc[k, "factor_variance"] @ b.T + model.loc[k, "noise"] * np.eye(len(c)) - c).max() < 5e-4


def test_alignment(spark, wide):
    """Turned copies of one matrix come back to it, whatever the turns; and books are as near as dense algebra has them."""
    rng = np.random.default_rng(2)
    b = rng.normal(size=(20, 3))
    rows = []
    for k in range(5):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0] if k else np.eye(3)
        rows += [(k, f"a{i}", *map(float, v)) for i, v in enumerate(b @ q)]
    got = C.aligned(spark.createDataFrame(rows, "k int, asset string, b1 double, b2 double, b3 double"), "k").toPandas()
    for k in range(5):
        own = got[got["k"] == k].set_index("asset").loc[[f"a{i}" for i in range(20)], ["b1", "b2", "b3"]]
        np.testing.assert_allclose(own, b, atol=1e-8)
    _, panel = wide
    loadings, _, _ = C.principal_components(C.centred(panel, "book"), "book", 3)
    raw, turned = loadings.toPandas(), C.aligned(loadings, "book").toPandas()
    before = None
    for k in range(4):
        own = raw[raw["book"] == k].set_index("asset").sort_index()[["b1", "b2", "b3"]]
        if before is not None:
            common = own.index.intersection(before.index)
            own = own @ C.rotation(before.loc[common].to_numpy().T @ own.loc[common].to_numpy())
            own.columns = ["b1", "b2", "b3"]
        np.testing.assert_allclose(turned[turned["book"] == k].set_index("asset").sort_index()[["b1", "b2", "b3"]], own, atol=1e-8)
        before = own


def test_few_assets_and_none(spark):
    schema = "k int, date date, asset string, ret double"
    rows = [(1, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), a, float((i * 7 + j) % 5)) for i in range(8) for j, a in enumerate("ab")]
    loadings, returns, spectrum = C.principal_components(C.centred(spark.createDataFrame(rows + [(1, rows[0][1], "c", None)], schema), "k"), "k", 3, 2, 2)
    got = loadings.orderBy("asset").toPandas()[["b1", "b2", "b3"]].to_numpy()
    assert np.allclose(got[:, :2].T @ got[:, :2], np.eye(2)) and np.allclose(got[:, 2], 0) and returns.count() == 8
    empty = C.principal_components(C.centred(spark.createDataFrame([], schema), "k"), "k", 2, 1, 1)
    assert all(x.isEmpty() for x in empty)
