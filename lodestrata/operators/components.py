"""Principal components of wide panels: a randomised range finder by subspace iteration, aligned from book to book.

The matrix of assets by assets is never formed. A few trial vectors over the assets are multiplied by the data twice, once
summed over a date's assets and once over an asset's dates, which is a product with the covariance; what meets a kernel is
the vectors' Gram matrix, (factors + EXTRA)^2 numbers a key. All keys (dates as of which books are made, or strategies) go
together, so a round is two shuffles whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Trial vectors beyond the factors asked for; more of them, and more rounds, separate close components better.
EXTRA, ROUNDS = 6, 6


def centred(panel: DataFrame, key: str, value: str = "ret", standardize: bool = False) -> DataFrame:
    """``key, date, asset, x``: values less the asset's mean, over its deviation if asked. Missing values are left out.

    Assets that never move have no deviation; they are zero.
    """
    rows = panel.select(key, "date", "asset", F.col(value).cast("double").alias("_v")).where("_v is not null")
    whole = rows.groupBy(key, "asset").agg(F.avg("_v").alias("_m"), F.stddev_samp("_v").alias("_s"))
    x = F.col("_v") - F.col("_m")
    x = F.when(F.col("_s") > 0, x / F.col("_s")).otherwise(0.0) if standardize else x
    return rows.join(whole, [key, "asset"]).select(key, "date", "asset", x.alias("x"))


def _times(rows: DataFrame, vectors: DataFrame, names: list[str], on: list[str], by: list[str]) -> DataFrame:
    """Sums of x times each vector's entry, by ``by``."""
    return rows.join(vectors, on).groupBy(*by).agg(*[F.sum(F.col("x") * F.col(n)).alias(n) for n in names])


def _gram(vectors: DataFrame, names: list[str], key: str) -> DataFrame:
    pairs = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    return vectors.groupBy(key).agg(F.array(*pairs).alias("_g"))


def _mixed(vectors: DataFrame, names: list[str], out: list[str]) -> list[Column]:
    """Columns of the vectors times the matrix in ``_c``, which is stored by rows."""
    size = len(names)
    return [sum((F.col(n) * F.col("_c")[i * size + j] for i, n in enumerate(names)), F.lit(0.0)).alias(o) for j, o in enumerate(out)]


def _kernel(grams: DataFrame, key: str, f, extra: str = "") -> DataFrame:
    """``key, _c`` and more from each key's Gram matrix by ``f``, which returns a dictionary of flat lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [f(np.array(g, dtype=float).reshape(int(len(g) ** 0.5), -1)) for g in pdf["_g"]]
            yield pd.DataFrame([{key: k, **m} for k, m in zip(pdf[key], made, strict=True)], columns=[key, *columns])

    columns = ["_c", *[x.split()[0] for x in extra.split(", ") if x]]
    return grams.mapInPandas(run, f"{key} {dict(grams.dtypes)[key]}, _c array<double>" + (f", {extra}" if extra else ""))


def orthonormal(gram: np.ndarray) -> dict:
    """The matrix that makes vectors with this Gram matrix orthonormal; directions without length become zero."""
    value, vector = np.linalg.eigh(gram)
    root = np.where(value > 1e-12 * max(value[-1], 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
    return {"_c": (vector * root).ravel().tolist()}


def _principal(gram: np.ndarray) -> dict:
    """Largest first: the matrix that turns orthonormal trial vectors into components, and their sums of squares."""
    value, vector = np.linalg.eigh(gram)
    return {"_c": vector[:, ::-1].ravel().tolist(), "_e": np.maximum(value[::-1], 0.0).tolist()}


def principal_components(x: DataFrame, key: str, factors: int, extra: int = EXTRA, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``loadings, factor_returns, spectrum`` of centred values (``centred``), for every key.

    ``loadings``: key, asset, b1, b2, ..., orthonormal, each with its largest entry positive. ``factor_returns``: key, date, f1,
    f2, ... (sums of value times loading). ``spectrum``: key, assets, dates, total and array ``variance``, by n - 1. With as many
    trial vectors as assets, or a gap after them, they are the eigenvectors; keys with fewer assets than factors have zeros.
    """
    x = durable(x)
    size = factors + extra
    names, out, got = [f"_t{i}" for i in range(size)], [f"b{i + 1}" for i in range(factors)], [f"f{i + 1}" for i in range(factors)]
    start = [(F.pmod(F.xxhash64("asset", F.lit(i)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(n) for i, n in enumerate(names)]
    trial = x.select(key, "asset").distinct().select(key, "asset", *start)
    for _ in range(rounds):
        along = _times(x, trial, names, [key, "asset"], [key, "date"])
        new = durable(_times(x, along, names, [key, "date"], [key, "asset"]))
        turn = _kernel(_gram(new, names, key), key, orthonormal)
        trial = durable(new.join(turn, key).select(key, "asset", *_mixed(new, names, names)))
    along = durable(_times(x, trial, names, [key, "asset"], [key, "date"]))
    turn = durable(_kernel(_gram(along, names, key), key, _principal, "_e array<double>"))
    raw = durable(trial.join(turn, key).select(key, "asset", *_mixed(trial, names, out)))
    # the sign of a component is free: its largest entry is positive
    signs = raw.groupBy(key).agg(*[F.when(F.max_by(b, F.struct(F.round(F.abs(b), 9), "asset")) < 0, -1.0).otherwise(1.0).alias(f"_s{b}") for b in out])
    loadings = raw.join(signs, key).select(key, "asset", *[(F.col(b) * F.col(f"_s{b}")).alias(b) for b in out])
    returns = along.join(turn, key).select(key, "date", *_mixed(along, names, got)).join(signs, key)
    returns = returns.select(key, "date", *[(F.col(f) * F.col(f"_s{b}")).alias(f) for f, b in zip(got, out, strict=True)])
    whole = x.groupBy(key).agg(F.count_distinct("date").alias("dates"), F.count_distinct("asset").alias("assets"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    scale = F.col("dates") - 1
    spectrum = whole.join(turn, key).select(key, "assets", "dates", F.try_divide("_q", scale).alias("total"), F.transform(F.slice("_e", 1, factors), lambda v: v / scale).alias("variance"))
    return loadings, returns, spectrum


def explained(spectrum: DataFrame, key: str) -> DataFrame:
    """``key, factor, variance, share``: shares of the total variance; factors from 1."""
    each = spectrum.select(key, "total", F.posexplode("variance").alias("_i", "variance"))
    return each.select(key, (F.col("_i") + 1).alias("factor"), "variance", F.try_divide("variance", "total").alias("share"))


def probabilistic(spectrum: DataFrame, key: str) -> DataFrame:
    """``key, noise, factor_variance``: the likeliest model of factors and one noise for all assets.

    ``noise`` is the mean of the variances that the factors leave, 0 if they leave no asset; factor variances are net of it.
    """
    held = F.aggregate("variance", F.lit(0.0), lambda a, v: a + v)
    left = F.col("assets") - F.size("variance")
    noise = F.when(left > 0, F.greatest(F.col("total") - held, F.lit(0.0)) / left).otherwise(0.0)
    return spectrum.withColumn("noise", noise).select(key, "noise", F.transform("variance", lambda v: F.greatest(v - F.col("noise"), F.lit(0.0))).alias("factor_variance"))


def rotation(old: np.ndarray) -> np.ndarray:
    """The orthogonal X for which new @ X is nearest to old, from old' new."""
    u, _, vt = np.linalg.svd(old)
    return vt.T @ u.T


def aligned(loadings: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """``loadings`` turned, key after key in order, as near as possible to those of the key before, over the assets of both.

    ``group`` names a column of series of keys. Only products of two keys' loadings, factors^2 numbers a key, meet in order.
    """
    b = [c for c in loadings.columns if c not in (key, "asset", group)]
    size, by = len(b), [group] if group else []
    held = durable(loadings)
    keys = held.select(*by, key).distinct()
    if group:
        steps = keys.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("_k"))
    else:
        steps = keys.agg(F.sort_array(F.collect_list(key)).alias("_k"))
    steps = steps.select(*by, F.explode(F.arrays_zip(F.slice("_k", 1, F.size("_k") - 1).alias("old"), F.slice("_k", 2, F.size("_k")).alias("new"))).alias("_s")).select(*by, F.col("_s.old").alias("_old"), F.col("_s.new").alias(key))
    before = held.withColumnsRenamed({key: "_old"} | {c: f"_o{c}" for c in b})
    both = held.join(steps, [*by, key]).join(before, [*by, "_old", "asset"])
    products = both.groupBy(*by, key).agg(F.array(*[F.sum(F.col(f"_o{x}") * F.col(y)) for x in b for y in b]).alias("_g"))
    rows = keys.join(products, [*by, key], "left").withColumn("_all", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, turn, out = pdf.sort_values(key), np.eye(size), []
        for g in pdf["_g"]:
            turn = np.eye(size) if g is None else rotation(turn.T @ np.array(g, dtype=float).reshape(size, size))
            out.append(turn.ravel().tolist())
        return pdf[[*by, key]].assign(_c=out)

    kinds = dict(held.dtypes)
    listed = ", ".join(f"{c} {kinds[c]}" for c in [*by, key])
    turns = rows.groupBy(*(by or ["_all"])).applyInPandas(run, f"{listed}, _c array<double>")
    return held.join(turns, [*by, key]).select(*by, key, "asset", *_mixed(held, b, b))
