"""Multiple testing, robust regressions, scenario reweighting and hidden regimes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# --- multiple testing -------------------------------------------------------------------------------------------------
def rademacher(rows: DataFrame, value: str, draws: int = 1000, seed: int = 0, key: str = "asset", date: str = "date") -> DataFrame:
    """``complexity, n, t``: mean over random signs of the best strategy's signed mean; signs are hashes of seed, draw and date.

    A strategy without a value on a date counts as zero there. One row. A task sums its rows for all draws at once, so rows are
    never multiplied by draws; it holds a vector a strategy and a vector a date.
    """
    x = rows.where(F.col(value).isNotNull()).select(key, date, value)
    sizes = x.agg(F.countDistinct(key).alias("n"), F.countDistinct(date).alias("t"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's sums of each strategy, a vector over the draws; signs are made once a date."""
        signs: dict[str, np.ndarray] = {}
        sums: dict = {}
        for pdf in batches:
            for day in set(pdf["_d"]) - set(signs):
                signs[day] = np.array([1.0 if hashlib.md5(f"{seed}:{i}:{day}".encode()).hexdigest()[0] < "8" else -1.0 for i in range(draws)])
            for k, own in pdf.groupby(key, sort=False):
                sums[k] = sums.get(k, 0.0) + own["_v"].to_numpy(float) @ np.array([signs[day] for day in own["_d"]])
            if len(sums) * draws > 4_000_000:
                yield pd.DataFrame({key: list(sums), "_s": list(sums.values())})
                sums = {}
        yield pd.DataFrame({key: list(sums), "_s": list(sums.values())})

    vectors = x.select(key, F.col(date).cast("string").alias("_d"), F.col(value).cast("double").alias("_v")).mapInPandas(summed, f"{key} {dict(rows.dtypes)[key]}, _s array<double>")
    signed = vectors.select(key, F.posexplode("_s").alias("draw", "_x")).groupBy("draw", key).agg(F.sum("_x").alias("s"))
    best = signed.groupBy("draw").agg(F.max("s").alias("s")).agg(F.avg("s").alias("s"))
    return best.crossJoin(sizes).select((F.col("s") / F.col("t")).alias("complexity"), "n", "t")  # one row each


def haircut_sharpe(sharpes: DataFrame, complexity: DataFrame, sr: str = "sr", delta: float = 0.05) -> DataFrame:
    """``haircut``: a lower bound of each strategy's Sharpe that holds for all at once with confidence 1 - delta."""
    c = F.broadcast(complexity.select("complexity", F.col("n").alias("_n"), F.col("t").alias("_t")))  # one row
    low = F.col(sr) - 2 * F.col("complexity") - 3 * F.sqrt(2 * math.log(2 / delta) / F.col("_t")) - F.sqrt(2 * F.ln(2 * F.col("_n") / delta) / F.col("_t"))
    return sharpes.join(c).withColumn("haircut", low).drop("_n", "_t")


# --- regressions over time --------------------------------------------------------------------------------------------
def hac(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares, Bartlett-weighted (Newey-West) errors, R2."""
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ (x.T @ y)
    u = x * (y - x @ b)[:, None]
    s = u.T @ u
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    spread = ((y - y.mean()) ** 2).sum()
    return b, np.sqrt(np.maximum(np.diag(inv @ s @ inv), 0)), 1 - ((y - x @ b) ** 2).sum() / spread if spread > 0 else 0.0


def time_series_attribution(rows: DataFrame, y: str, factors: list[str], key: str, lags: int = 10, date: str = "date") -> DataFrame:
    """``key, term, beta, se, t, pnl, share, r2, n`` of each series regressed on factor returns; shares of the summed y add up to 1.

    Rows with nulls are left out; a series with fewer than factors + 3 rows gives nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        v = pdf[y].to_numpy(float)
        x = np.column_stack([np.ones(len(v)), pdf[factors].to_numpy(float)])
        b, se, r2 = hac(x, v, lags)
        pnl = np.append(b * x.sum(axis=0), (v - x @ b).sum())
        t = np.divide(b, se, out=np.full(len(b), np.nan), where=se > 0)
        total = v.sum() or np.nan
        out = {"term": ["alpha", *factors, "residual"], "beta": [*b, np.nan], "se": [*se, np.nan], "t": [*t, np.nan], "pnl": pnl, "share": pnl / total, "r2": r2, "n": len(v)}
        return pd.DataFrame(out).assign(**{key: pdf[key].iloc[0]})

    use = rows.select(key, date, *dict.fromkeys([y, *factors])).dropna(subset=[y, *factors])
    use = use.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") >= len(factors) + 3)  # by the same key as the groups
    kind = dict(rows.dtypes)[key]
    return use.groupBy(key).applyInPandas(run, f"{key} {kind}, term string, beta double, se double, t double, pnl double, share double, r2 double, n long")


# --- scenarios --------------------------------------------------------------------------------------------------------
def entropy_pool(rows: DataFrame, views: dict[str, float], prior: str | None = None, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """``q``: the scenario probabilities nearest to the prior in relative entropy whose mean of each column is its view.

    Newton on the dual: a step is one aggregate over all scenarios, of size (views + 1)^2, so scenarios stay where they
    are. Columns that hold nulls aren't allowed; views that no scenario mix can meet raise ValueError.
    """
    names = list(views)
    p = F.col(prior) if prior else F.lit(1.0)
    moments = rows.agg(F.sum(p).alias("p"), *[F.stddev_pop(c).alias(c) for c in names]).first()
    if not moments["p"]:
        return rows.withColumn("q", F.lit(None).cast("double"))
    z = [(F.col(c) - views[c]) / (moments[c] or 1.0) for c in names]

    def tilted(at):
        return p / moments["p"] * F.exp(sum((float(a) * c for a, c in zip(at, z, strict=True)), F.lit(0.0)))

    def sums(at):
        w, k = tilted(at), len(z)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = rows.agg(F.sum(w), *[F.sum(w * c) for c in z], *[F.sum(w * z[i] * z[j]) for i, j in pairs]).first()
        total = r[0] or math.nan  # all weights underflow where no mix meets the views
        mean, second = np.array(r[1 : k + 1]) / total, np.zeros((k, k))
        for (i, j), s in zip(pairs, r[k + 1 :], strict=True):
            second[i, j] = second[j, i] = s / total
        return total, mean, second - np.outer(mean, mean)

    at = np.zeros(len(z))
    total, mean, spread = sums(at)
    for _ in range(rounds):
        if np.abs(mean).max(initial=0.0) < tolerance:
            return rows.withColumn("q", tilted(at) / total)
        step = np.clip(np.linalg.pinv(spread) @ mean, -5, 5)
        for _ in range(20):  # halved until the dual falls
            new = sums(at - step)
            if math.isfinite(new[0]) and new[0] < total:
                break
            step = step / 2
        else:
            break
        at, (total, mean, spread) = at - step, new
    if np.abs(mean).max(initial=0.0) < 1e-6:
        return rows.withColumn("q", tilted(at) / total)
    raise ValueError("the views can't be met by these scenarios")


# --- regimes ----------------------------------------------------------------------------------------------------------
def _density(x: np.ndarray, mu: np.ndarray, sd: float) -> np.ndarray:
    return np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / sd + 1e-300


def _filtered(e: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, scale, p = np.empty_like(e), np.empty(len(e)), start
    for i, row in enumerate(e):
        p = (p @ move if i else p) * row
        scale[i] = p.sum()
        out[i] = p = p / scale[i]
    return out, scale


def two_states(x: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Means (low, high), common deviation, transitions and start of a hidden chain of two normal states, by expectation-maximisation."""
    # fixed values: quartiles, half the deviation, 0.95 and 0.05, even start
    mu, sd = np.quantile(x, [0.25, 0.75]), max(float(x.std()) / 2, 1e-6)
    move, start, last = np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5]), -np.inf
    for _ in range(rounds):
        e = _density(x, mu, sd)
        a, scale = _filtered(e, move, start)
        b = np.ones_like(a)
        for i in range(len(x) - 2, -1, -1):
            b[i] = move @ (e[i + 1] * b[i + 1]) / scale[i + 1]
        g = a * b
        g /= g.sum(axis=1, keepdims=True)
        joint = move * (a[:-1].T @ (e[1:] * b[1:] / scale[1:, None]))
        start, move = g[0], joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        mu = (g * x[:, None]).sum(axis=0) / np.maximum(g.sum(axis=0), 1e-300)
        sd = max(math.sqrt((g * (x[:, None] - mu) ** 2).sum() / len(x)), 1e-12)
        seen = float(np.log(scale).sum())
        if abs(seen - last) < tolerance * max(1.0, abs(seen)):
            break
        last = seen
    by = np.argsort(mu)
    return mu[by], sd, move[np.ix_(by, by)], start[by]


def regime_multipliers(rows: DataFrame, value: str, key: str, refit: int = 21, least: int = 250, threshold: float = 0.5, scale: float = 0.5, window: int = 10, ratio: float = 1.5, persistence: float = 0.8, date: str = "date") -> DataFrame:
    """``key, date, p_high, multiplier``: ``scale`` after a row whose filtered chance of the volatile state is above ``threshold``, else 1.

    The state is seen through the log volatility of ``window`` rows; rows without it are passed over. Every ``refit`` rows the
    chain is fitted to strictly earlier ones, ``least`` of them at least, and its chances are filtered by that fit until the
    next; fits whose states are less than ``ratio`` apart, or leave sooner than ``persistence`` allows, decide nothing.
    The defaults are fixed values.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        seen = np.log(pdf[value].rolling(window).std().clip(lower=1e-8)).dropna()
        x, place = seen.to_numpy(float), pdf.index.get_indexer(seen.index)
        high, scaled = np.full(len(pdf), np.nan), np.ones(len(pdf))
        for begin in range(least, len(x), refit):
            mu, sd, move, start = two_states(x[:begin])
            if math.exp(mu[1] - mu[0]) < ratio or move.diagonal().min() < persistence:
                continue
            block = np.arange(begin, min(begin + refit, len(x)))
            chance = _filtered(_density(x[: block[-1] + 1], mu, sd), move, start)[0][:, 1]
            high[place[block]] = chance[block]
            scaled[place[block]] = np.where(chance[block - 1] > threshold, scale, 1.0)  # known a row before, by this fit
        return pdf[[key, date]].assign(p_high=high, multiplier=scaled)

    kinds = dict(rows.dtypes)
    return rows.select(key, date, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {date} {kinds[date]}, p_high double, multiplier double")
