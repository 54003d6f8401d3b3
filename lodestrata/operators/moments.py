"""Covariances as sums over pairs of assets: tasks pair up each date's cross-section and only sums of pairs are shuffled.

A key is a strategy or, by ``trailing``, a date as of which a book is made. What meets in one row is a date's cross-section,
and in one task at most the matrix of a key's assets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing(panel: DataFrame, every: int, span: int, value: str = "ret", share: float = 0.8) -> DataFrame:
    """``panel``'s rows under each date ``cutoff`` (a multiple of ``every`` days) that lies 1 to ``span`` days after them.

    Nothing on or after ``cutoff`` is seen. Assets with values on less than ``share`` of a window's rows leave it; other missing
    values are zero. The panel is dense. A row is copied span / every times. The first window is the first full one, the last one
    ends ``every`` days after the panel at most.
    """
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    ends = F.sequence(F.floor(day / every) + 1, F.floor((day + span) / every))
    whole = Window.partitionBy("asset")
    rows = panel.withColumn("_first", F.min("date").over(whole)).withColumn("_last", F.max("date").over(whole)).withColumn("_end", F.explode(F.when(day + span >= (F.floor(day / every) + 1) * every, ends)))
    rows = rows.withColumn("cutoff", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("_end") * every).cast("int")))
    rows = rows.where((F.date_sub("cutoff", span) >= F.col("_first")) & (F.col("cutoff") <= F.date_add("_last", every))).drop("_end", "_first", "_last")
    own = Window.partitionBy("cutoff", "asset")
    rows = rows.withColumn("_share", F.count(value).over(own) / F.count(F.lit(1)).over(own)).where(F.col("_share") >= share).drop("_share")
    return rows.withColumn(value, F.coalesce(value, F.lit(0.0)))


def pair_moments(panel: DataFrame, key: str, value: str = "ret", halflife: float = 30.0) -> DataFrame:
    """``key, a, b, n, s, q, e``, a <= b: dates, and sums of x y, (x y)^2 and decayed x y of values less their means.

    A date counts if all of the key's assets have a value. Decay halves in ``halflife`` dates that count, latest first.
    """
    rows = panel.select(key, "date", "asset", F.col(value).alias("_v"))
    width = rows.groupBy(key).agg(F.count_distinct("asset").alias("_width"))
    full = F.count("_v").over(Window.partitionBy(key, "date")) == F.col("_width")
    rows = rows.join(width, key).withColumn("_v", F.when(full, F.col("_v"))).drop("_width")
    own = Window.partitionBy(key, "asset")
    later = own.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_x", F.col("_v") - F.avg("_v").over(own)).withColumn("_age", F.count("_v").over(later) - 1)
    cuts = rows.groupBy(key, "date").agg(F.sort_array(F.collect_list(F.struct("asset", "_x"))).alias("_s"), F.max("_age").alias("_age"))
    left = cuts.select(key, "_s", "_age", F.posexplode("_s").alias("_i", "_a"))
    pair = left.select(key, "_age", "_a", F.explode(F.slice("_s", F.col("_i") + 1, F.size("_s"))).alias("_b"))
    xy = F.col("_a._x") * F.col("_b._x")
    decay = F.pow(F.lit(0.5), F.col("_age") / F.lit(float(halflife)))
    sums = [F.count(xy).alias("n"), F.sum(xy).alias("s"), F.sum(xy * xy).alias("q"), F.sum(xy * decay).alias("e")]
    return pair.groupBy(key, F.col("_a.asset").alias("a"), F.col("_b.asset").alias("b")).agg(*sums)


def covariance(panel: DataFrame, method: str, key: str, value: str = "ret", halflife: float = 30.0) -> DataFrame:
    """``key, a, b, cov``, a <= b; null with fewer than two dates on which all assets have a value.

    ``sample``; ``ewma``: decayed products on top of the decayed sample matrix; ``lw``: shrunk to a multiple of the identity;
    ``denoised``: without the correlation that random returns would have.
    """
    m = pair_moments(panel, key, value, halflife).withColumn("cov", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)))
    if method == "ewma":
        k = 0.5 ** (1 / halflife)
        m = m.withColumn("cov", F.pow(F.lit(k), "n") * F.col("cov") + (1 - k) * F.col("e"))
    elif method == "lw":
        m = _shrunk(m, key)
    elif method == "denoised":
        return _denoised(m, key)
    return m.select(key, "a", "b", "cov")


def _shrunk(m: DataFrame, key: str) -> DataFrame:
    """Intensity: variance of the entries by their distance from the target, one at most; moments by 1 / n."""
    same, twice = F.col("a") == F.col("b"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    m = m.withColumn("_c", F.when(F.col("n") > 1, F.col("s") / F.col("n")))
    whole = m.groupBy(key).agg(
        F.avg(F.when(same, F.col("_c"))).alias("_mu"),
        F.sum(twice * F.col("_c") * F.col("_c")).alias("_norm"),
        F.sum(twice * F.col("q") / F.col("n")).alias("_fourth"),
        F.count(F.when(same, 1)).alias("_width"),
    )
    m = m.join(whole, key)
    apart = F.col("_norm") - F.col("_width") * F.col("_mu") * F.col("_mu")
    noise = (F.col("_fourth") - F.col("_norm")) / F.col("n")
    share = F.when(apart > 1e-12 * F.col("_norm"), F.least(noise / apart, F.lit(1.0))).otherwise(1.0)
    target = F.when(same, F.col("_mu")).otherwise(0.0)
    return m.withColumn("cov", F.when(F.col("n") > 1, share * target + (1 - share) * F.col("_c")))


def square(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    """Names and full matrix of rows a, b, cov."""
    names = sorted(set(pdf["a"]))
    at = {n: i for i, n in enumerate(names)}
    c, i, j = np.full((len(names), len(names)), np.nan), pdf["a"].map(at), pdf["b"].map(at)
    c[i, j] = c[j, i] = pdf["cov"]
    return names, c


def without_noise(c: np.ndarray, dates: int) -> np.ndarray:
    """The part of the correlations inside the random space, whose eigenvalues are below the edge, becomes its mean there."""
    sd = np.sqrt(np.diag(c))
    scale = np.outer(sd, sd)
    corr = np.divide(c, scale, out=np.zeros_like(c), where=scale > 0)  # a constant has no correlation with anything
    value, vector = np.linalg.eigh(corr)
    basis = vector[:, value < (1 + np.sqrt(len(c) / dates)) ** 2]
    if basis.shape[1]:
        noise = basis @ basis.T
        inside = noise @ corr @ noise
        corr = corr - inside + noise * (np.trace(inside) / basis.shape[1])
    np.fill_diagonal(corr, 1.0)
    return corr * scale


def _denoised(m: DataFrame, key: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = square(pdf)
        if np.isfinite(c).all():
            c = without_noise(c, int(pdf["n"].iloc[0]))
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({key: pdf[key].iloc[0], "a": np.array(names)[i], "b": np.array(names)[j], "cov": c[i, j]})

    return m.groupBy(key).applyInPandas(run, f"{key} {dict(m.dtypes)[key]}, a string, b string, cov double")
