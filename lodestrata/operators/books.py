"""Books of weights from a key's covariances and forecasts: matrices of assets by assets, a key a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .moments import square


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree, built from the shortest edges on.

    Merged clusters are numbered after all earlier ones, and the lower number stands left.
    """
    n = len(distance)
    i, j = np.triu_indices(n, 1)
    leaves, of, number = {k: [k] for k in range(n)}, np.arange(n), n
    for e in np.argsort(distance[i, j], kind="stable"):
        left, right = sorted((int(of[i[e]]), int(of[j[e]])))
        if left != right:
            leaves[number] = leaves.pop(left) + leaves.pop(right)
            of[leaves[number]] = number
            number += 1
    return leaves[number - 1]


def hierarchical(c: np.ndarray) -> np.ndarray:
    """Weights that halve the ordered assets again and again, each half in inverse proportion to its variance."""
    sd = np.sqrt(np.diag(c))
    order = leaf_order(np.sqrt(np.clip((1 - c / np.outer(sd, sd)) / 2, 0, None)))

    def variance(part: list[int]) -> float:
        inverse = 1 / sd[part] ** 2
        return inverse @ c[np.ix_(part, part)] @ inverse / inverse.sum() ** 2

    def split(part: list[int], budget: float) -> list[tuple[int, float]]:
        if len(part) == 1:
            return [(part[0], budget)]
        low, high = part[: len(part) // 2], part[len(part) // 2 :]
        v, u = variance(low), variance(high)
        return split(low, budget * u / (v + u)) + split(high, budget * v / (v + u))

    w = dict(split(order, 1.0))
    return np.array([w[k] for k in range(len(c))])


def limited(w: np.ndarray, cap: float) -> np.ndarray:
    """Weights within ``cap`` either way, and gross one at most."""
    w = np.clip(w, -cap, cap)
    return w / max(1.0, np.abs(w).sum())


def books(cov: DataFrame, alphas: DataFrame, method: str, key: str, cap: float = 0.25) -> DataFrame:
    """``key, asset, weight`` of each key's covariances (``moments.covariance``) and ``alphas`` (key, asset, alpha).

    ``min_variance`` sums to one and knows no cap; ``mean_variance`` (gross one) and ``hrp`` (with the alphas' signs) are
    limited by ``cap``. Assets without alpha have zero there. Keys with null covariances or an asset that never moves have no
    book.
    """

    def run(pdf: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        none = pdf[[key]].assign(asset=pdf["a"], weight=pdf["cov"]).iloc[:0]
        if pdf.empty:
            return none
        names, c = square(pdf)
        if not (np.isfinite(c).all() and (np.diag(c) > 0).all()):
            return none
        a = scores.set_index("asset")["alpha"].reindex(names).fillna(0).to_numpy(float)
        if method == "min_variance":
            w = np.linalg.solve(c, np.ones(len(c)))
            w = w / w.sum()
        elif method == "mean_variance":
            w = np.linalg.solve(c, a)
            w = limited(w / max(np.abs(w).sum(), 1e-300), cap)
        else:
            w = limited(hierarchical(c) * np.where(a == 0, 1, np.sign(a)), cap)
        return pd.DataFrame({key: pdf[key].iloc[0], "asset": names, "weight": w})

    left, right = cov.groupBy(key), alphas.select(key, "asset", "alpha").groupBy(key)
    return left.cogroup(right).applyInPandas(run, f"{key} {dict(cov.dtypes)[key]}, asset string, weight double")
