"""Intervals from resampled blocks, the Sharpe ratio expected from a search, and summaries of simulated paths."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf
from . import scan

#: Euler's constant (fixed value).
EULER = 0.5772156649


def sharpe_intervals(rows: DataFrame, r: str, keys: list[str], order: str = "date", block: int = 20, draws: int = 1000, confidence: float = 0.95, periods: float = 365.0, seed: int = 0) -> DataFrame:
    """``keys, n, sharpe, low, high``: percentile interval of the annual Sharpe ratio from a circular block bootstrap.

    A replicate is n // block blocks of ``block`` consecutive rows and one of the n % block left, from starts hashed of (seed,
    replicate, block). Each start's sums are formed once, on chunks of the series with a halo; a replicate adds up the sums
    of its starts, so n / block rows are joined for it and no path is written. Null and NaN returns are left out; rows that
    tie come in an order that is fixed once. Keys with one row, or without dispersion, have no ratio and no interval.
    """
    x = rows.select(*keys, order, F.nanvl(F.col(r).cast("double"), F.lit(None)).alias("_r")).where("_r is not null")
    x = scan.numbered(x, keys, [order])
    whole = x.groupBy(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)]).agg(F.count("*").alias("_n"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_sd"))

    def same(left: str, right: str):
        out = F.lit(True)
        for j in range(len(keys)):
            out &= F.col(f"{left}{j}").eqNullSafe(F.col(f"{right}{j}"))
        return out

    named = x.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_i", "_r")
    x = named.join(whole, same("_k", "_key")).withColumn("_dev", F.col("_r") - F.col("_mean"))
    # the series goes round: a block that starts near its end holds rows of its beginning
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") + block - 2 - F.col("_i")) / F.col("_n")))
    x = x.withColumn("_own_i", F.col("_i")).withColumn("_round", F.explode(rounds)).withColumn("_i", F.col("_i") + F.col("_round") * F.col("_n"))
    x = scan.halo(x, "_i", max(scan.CHUNK, block), 0, block - 1)
    w = Window.partitionBy(*[f"_k{j}" for j in range(len(keys))], "_chunk").orderBy("_i").rowsBetween(0, block - 1)
    x = x.withColumn("_b", F.collect_list("_dev").over(w)).where("_own and _i = _own_i")
    part = F.slice("_b", 1, (F.col("_n") % block).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    sums = x.select(*[f"_k{j}" for j in range(len(keys))], "_i", total("_b").alias("_s"), square("_b").alias("_q"), total(part).alias("_sl"), square(part).alias("_ql"))

    drawn = whole.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / block))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("_j").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = drawn.withColumn("_start", h % F.col("_n"))
    hit = drawn.join(sums, same("_key", "_k") & (F.col("_start") == F.col("_i")))
    last = F.col("_j") == F.floor(F.col("_n") / block)
    key = [F.col(f"_key{j}") for j in range(len(keys))]
    one = hit.groupBy(*key, "draw", "_n", "_mean").agg(F.sum(F.when(last, F.col("_sl")).otherwise(F.col("_s"))).alias("_s"), F.sum(F.when(last, F.col("_ql")).otherwise(F.col("_q"))).alias("_q"))
    # variances that are rounding errors count as none
    spread = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")
    sd = F.when(spread > 1e-12 * F.col("_q"), F.sqrt(F.try_divide(spread, F.col("_n") - 1)))
    one = one.withColumn("_sr", F.try_divide(F.col("_mean") + F.col("_s") / F.col("_n"), sd) * math.sqrt(periods))
    tails = F.percentile("_sr", F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2)))
    ends = one.groupBy(*[c.alias(f"_k{j}") for j, c in enumerate(key)]).agg(tails.alias("_t"))
    out = whole.join(ends, same("_key", "_k"), "left")
    ratio = F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * math.sqrt(periods))
    return out.select(*[c.alias(k) for c, k in zip(key, keys, strict=True)], F.col("_n").alias("n"), ratio.alias("sharpe"), F.col("_t")[0].alias("low"), F.col("_t")[1].alias("high"))


def deflated_sharpe(rows: DataFrame, r: str, keys: list[str], trials: int) -> DataFrame:
    """``keys, n, sr, se, sr0, psr, dsr``: ratios a row, their errors by moments, and chances of a true one above 0 and above ``sr0``.

    ``sr0`` is what the best of ``trials`` searches without merit shows, from the variance of the keys' ratios. With fewer than
    two trials it is 0. Null and NaN returns are left out.
    """
    x = F.nanvl(F.col(r).cast("double"), F.lit(None))
    t = rows.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("sr"), F.skewness(x).alias("_skew"), F.kurtosis(x).alias("_excess")
    )
    sr = F.col("sr")
    var = (1 + sr * sr / 2 - F.col("_skew") * sr + F.col("_excess") / 4 * sr * sr) / F.col("n")
    t = t.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))))
    best = 0.0
    if trials >= 2:
        z = NormalDist().inv_cdf
        best = (1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))
    spread = t.agg((F.coalesce(F.stddev_samp("sr"), F.lit(0.0)) * best).alias("sr0"))  # one row
    t = t.join(F.broadcast(spread))
    above = lambda floor: normal_cdf(F.try_divide(sr - floor, F.col("se")))
    return t.select(*keys, "n", "sr", "se", "sr0", above(F.lit(0.0)).alias("psr"), above(F.col("sr0")).alias("dsr"))


def summarise_paths(statistics: DataFrame, columns: list[str], total: str = "total", quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``statistic, p5 ..., mean, p_loss``: a row for each of ``columns``; the share of paths that lose is on that of ``total``.

    A row a path comes in; quantiles are exact, so the paths are meant to be thousands. Nulls are left out.
    """
    long = statistics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = long.groupBy("statistic").agg(F.percentile("v", F.array(*[F.lit(q) for q in quantiles])).alias("_q"), F.avg("v").alias("mean"), F.avg((F.col("v") < 0).cast("double")).alias("_loss"))
    named = [F.col("_q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)]
    return out.select("statistic", *named, "mean", F.when(F.col("statistic") == total, F.col("_loss")).alias("p_loss"))


def moments(rows: DataFrame, r: str, label: str) -> DataFrame:
    """``sample, n, mean, vol, skew, kurtosis`` of a column: one row, to hold simulated steps beside the history's."""
    return rows.agg(
        F.lit(label).alias("sample"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("vol"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis")
    )
