"""GARCH(1,1): h = omega + alpha * r_before^2 + beta * h_before, fitted by likelihood for many series at once.

A group is some hundred series side by side; a step of the recursion is one numpy operation over all of them, and all three
parameters move together along the likelihood's scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series of a group, rounds of the fit, and how far alpha + beta stays below 1.
TOGETHER, ROUNDS, BELOW = 128, 100, 1e-6
#: Where the fit begins: (omega, alpha, beta) of returns with unit variance. The better end counts.
STARTS = ((0.05, 0.05, 0.90), (0.50, 0.20, 0.30))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _free(p: tuple[float, float, float], width: int) -> np.ndarray:
    """Free parameters: logarithm of omega, log odds of alpha + beta, and of alpha's share in it."""
    whole = (p[1] + p[2]) / (1 - BELOW)
    share = p[1] / (p[1] + p[2])
    one = np.log([p[0], whole / (1 - whole), share / (1 - share)])
    return np.repeat(one[:, None], width, axis=1)


def _bound(free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha, beta, and their derivatives (3 by 3 by series) by the free parameters."""
    omega, whole, share = np.exp(np.clip(free[0], -30, 30)), (1 - BELOW) * _sigmoid(free[1]), _sigmoid(free[2])
    dw, ds = whole * (1 - _sigmoid(free[1])), share * (1 - share)
    zero = np.zeros_like(omega)
    return omega, whole * share, whole * (1 - share), np.array([[omega, zero, zero], [zero, share * dw, whole * ds], [zero, (1 - share) * dw, -whole * ds]])


def _scored(free: np.ndarray, x2: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of log h + r^2 / h, their gradients and expected curvatures; a row of ``x2`` is a step of all series."""
    omega, alpha, beta, jac = _bound(free)
    h, dh = np.ones(x2.shape[1]), np.zeros((3, x2.shape[1]))
    loss, slope, curve = seen[0] * (np.log(h) + x2[0] / h), np.zeros_like(dh), np.zeros((3, 3, x2.shape[1]))
    one = np.ones_like(h)
    for t in range(1, len(x2)):
        dh = np.stack([one, x2[t - 1], h]) + beta * dh
        h = omega + alpha * x2[t - 1] + beta * h
        u = dh / h
        loss += seen[t] * (np.log(h) + x2[t] / h)
        slope += seen[t] * (1 - x2[t] / h) * u
        curve += seen[t] * u[:, None] * u[None]
    return loss, np.einsum("ijs,is->js", jac, slope), np.einsum("iks,ijs,jls->kls", jac, curve, jac)


def _climbed(free: np.ndarray, x2: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scoring with damping: a step counts only if it betters the series' likelihood. Free parameters and sums at the end.

    A series rests after a step that wins next to nothing, or when no step wins however short; the others go on.
    """
    ends, sums = free.copy(), np.empty(free.shape[1])
    live, damp = np.arange(free.shape[1]), np.full(free.shape[1], 1e-3)
    loss, slope, curve = _scored(free, x2, seen)
    for _ in range(ROUNDS):
        scale = np.maximum(np.einsum("iis->is", curve), 1e-8)
        step = np.linalg.solve(np.moveaxis(curve + damp * np.eye(3)[:, :, None] * scale[:, None], 2, 0), slope.T[:, :, None])[:, :, 0].T
        tried = free - np.clip(step, -3, 3)
        new = _scored(tried, x2, seen)
        better = new[0] < loss
        rest = np.where(better, loss - new[0] < 1e-8 * (1 + np.abs(loss)), damp > 1e6)
        free, loss = np.where(better, tried, free), np.where(better, new[0], loss)
        slope, curve = np.where(better, new[1], slope), np.where(better, new[2], curve)
        damp = np.where(better, np.maximum(damp / 5, 1e-9), damp * 5)
        ends[:, live], sums[live] = free, loss
        if rest.all():
            break
        on = ~rest
        live, free, damp, loss, slope, curve, x2, seen = live[on], free[:, on], damp[on], loss[on], slope[:, on], curve[:, :, on], x2[:, on], seen[:, on]
    return ends, sums


def fit(returns: list[np.ndarray]) -> np.ndarray:
    """``omega, alpha, beta, loss, mean`` a row for each series; NaN without two different values."""
    out = np.full((len(returns), 5), np.nan)
    use = [i for i, r in enumerate(returns) if len(r) > 1 and np.ptp(r) > 0]
    if not use:
        return out
    long = max(len(returns[i]) for i in use)
    x2, seen = np.zeros((long, len(use))), np.zeros((long, len(use)))
    means, variances = np.array([returns[i].mean() for i in use]), np.array([returns[i].var() for i in use])
    for j, i in enumerate(use):
        r = returns[i]
        x2[: len(r), j], seen[: len(r), j] = (r - means[j]) ** 2 / variances[j], 1.0
    ends = [_climbed(_free(s, len(use)), x2, seen) for s in STARTS]
    free = np.where(ends[0][1] <= ends[1][1], ends[0][0], ends[1][0])
    omega, alpha, beta, _ = _bound(free)
    # of the returns themselves: log h grows by the variance's logarithm at each row
    loss = np.minimum(ends[0][1], ends[1][1]) + seen.sum(axis=0) * np.log(variances)
    out[use] = np.stack([omega * variances, alpha, beta, loss, means], axis=1)
    return out


def _path(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """h at each row, and one row on."""
    h = np.full(len(r) + 1, r.var())
    x2 = (r - r.mean()) ** 2
    for t in range(1, len(h)):
        h[t] = omega + alpha * x2[t - 1] + beta * h[t - 1]
    return h


def _grouped(panel: DataFrame, key: str, date: str, value: str, made, schema: str) -> DataFrame:
    """``made(series, fits)`` on groups of TOGETHER series, each sorted by date; a series is whole in its group."""
    rows = panel.select(key, date, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_r"))
    n = rows.select(key).distinct().count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        series = [s for _, s in pdf.sort_values([date], kind="stable").groupby(key, dropna=False, sort=True)]
        fits = fit([s["_r"].dropna().to_numpy(float) for s in series])
        return pd.concat([made(s, f) for s, f in zip(series, fits, strict=True)])

    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // TOGETHER)))).alias("_bucket")
    return rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(run, schema)


def garch_variance(panel: DataFrame, value: str = "ret", key: str = "asset", date: str = "date") -> DataFrame:
    """``date, key, variance``: the fitted variance of each row, null where there is no return or no fit.

    A series is fitted on its own demeaned returns; missing ones are left out, as if the others followed each other.
    """
    kinds = dict(panel.dtypes)

    def made(s: pd.DataFrame, f: np.ndarray) -> pd.DataFrame:
        seen, out = s["_r"].notna().to_numpy(), np.full(len(s), np.nan)
        if not np.isnan(f[0]):
            out[seen] = _path(s["_r"].to_numpy(float)[seen], *f[:3])[:-1]
        return s[[date, key]].assign(variance=out)

    out = _grouped(panel, key, date, value, made, f"`{date}` {kinds[date]}, `{key}` {kinds[key]}, variance double")
    return out.withColumn("variance", F.nanvl("variance", F.lit(None)))


def garch_fit(panel: DataFrame, value: str = "ret", key: str = "asset", date: str = "date") -> DataFrame:
    """``key, n, omega, alpha, beta, loss, next``: a row a series; ``next`` is the variance of the row after the last.

    ``loss`` is the sum of log h + r^2 / h. Nulls where there aren't two different returns.
    """

    def made(s: pd.DataFrame, f: np.ndarray) -> pd.DataFrame:
        r = s["_r"].dropna().to_numpy(float)
        after = np.nan if np.isnan(f[0]) else _path(r, *f[:3])[-1]
        return pd.DataFrame({key: s[key].iloc[:1], "n": len(r), "omega": f[0], "alpha": f[1], "beta": f[2], "loss": f[3], "next": after})

    names = ("omega", "alpha", "beta", "loss", "next")
    out = _grouped(panel, key, date, value, made, f"`{key}` {dict(panel.dtypes)[key]}, n long, " + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in names})


def garch_forecast(fits: DataFrame, horizon: int, key: str = "asset") -> DataFrame:
    """``key, step, variance``: steps 1 to ``horizon`` after the last row, falling back to the variance of the long run."""
    whole = F.col("alpha") + F.col("beta")
    rest = F.col("omega") / (1 - whole)
    steps = fits.where("omega is not null").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(key, "step", (rest + F.pow(whole, F.col("step") - 1) * (F.col("next") - rest)).alias("variance"))
