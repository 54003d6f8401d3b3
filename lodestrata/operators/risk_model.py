"""A style risk model on a dense panel: exposures, daily factor returns, forecasts, calibration and attribution.

Every date's next returns are regressed on what was known at the date. Decayed covariances of factor returns, and decayed
squared residuals, are recurrences over dates (``scan``), of which a forecast takes the value before its row: a date's factor
return is earned after it. Portfolios are long tables (keys, date, asset, weight), any number of them; factor risk is a
product of a date's loadings and covariances, which are joined by date.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..sources.shared import durable
from . import scan
from .kernels import cross_sectional_wls

MARKET = "market"
STYLES = ("size", "vol", "liquidity", "momentum", "funding")


def build_exposures(panel: DataFrame, momentum: int = 30, funding: int = 30, liquidity: int = 30, universe: str | None = "in_universe") -> DataFrame:
    """``date, asset, market`` and the five styles of every member of a date's universe, known at the date.

    ``panel`` is dense with ``close, vol, funding`` and, if it has them, ``cap`` and ``dv`` (dollar volume). ``size``: log cap a
    row before; ``vol``: its log; ``liquidity``: log mean dollar volume of the rows before, half of them at least;
    ``momentum``: log return of ``momentum`` rows; ``funding``: its mean, over half the rows at least. Styles are z-scores over
    the members, cut at 3; what is missing is 0, and so is a whole style without dispersion.
    """
    w = W.series()
    log = lambda x: F.when(x > 0, F.ln(x))
    p = panel if universe else panel.withColumn("_u", F.lit(True))
    dv = F.lag(W.rolling(F.avg, F.col("dv"), liquidity, liquidity // 2)).over(w) if "dv" in panel.columns else F.lit(None).cast("double")
    own = {
        "size": log(F.lag("cap").over(w)) if "cap" in panel.columns else F.lit(None).cast("double"),
        "vol": log(F.col("vol")),
        "liquidity": log(F.col("_dv")),
        "momentum": log(F.col("close")) - F.lag(log(F.col("close")), momentum).over(w),
        "funding": W.rolling(F.avg, F.col("funding"), funding, funding // 2),
    }
    p = p.withColumn("_dv", dv).select("date", "asset", F.coalesce(universe or "_u", F.lit(False)).alias("_u"), *[x.alias(n) for n, x in own.items()])
    p = p.where("_u")
    return p.select("date", "asset", F.lit(1.0).alias(MARKET), *[W.zscore_pop_clipped(F.col(n)).alias(n) for n in STYLES])


def fit(panel: DataFrame, exposures: DataFrame, factors: tuple[str, ...] = (MARKET, *STYLES), value: str = "ret", vol: str = "vol", most: float = 8.0) -> DataFrame:
    """``date, asset, residual, r2, f_<factor>, b_<factor>``: next row's return on the date's exposures, weights 1 / vol^2.

    Returns are cut at ``most`` vols; dates with fewer than factors + 3 rows are left out. Written once.
    """
    p = panel.withColumn("_y", F.lead(value).over(W.series())).where((F.col(vol) > 0) & F.col("_y").isNotNull())
    cut = F.greatest(F.least("_y", most * F.col(vol)), -most * F.col(vol))
    rows = p.select("date", "asset", cut.alias("_y"), (1 / (F.col(vol) * F.col(vol))).alias("_w"))
    known = exposures.select("date", "asset", *factors)
    made = cross_sectional_wls(rows.join(known, ["date", "asset"]), "_y", list(factors), "_w")
    return durable(made.join(known.withColumnsRenamed({f: f"b_{f}" for f in factors}), ["date", "asset"]))


def factors_of(model: DataFrame) -> list[str]:
    return [c[2:] for c in model.columns if c.startswith("f_")]


def factor_returns(model: DataFrame) -> DataFrame:
    """``date, f_<factor>``: a row a date."""
    return model.groupBy("date").agg(*[F.min(f"f_{f}").alias(f"f_{f}") for f in factors_of(model)])


def factor_covariance(model: DataFrame, halflife: float = 60.0) -> DataFrame:
    """``date, a, b, v``, a <= b: decayed covariances (about zero) of factor returns strictly before the date; none on the first."""
    names = factors_of(model)
    pairs = [F.struct(F.lit(min(a, b)).alias("a"), F.lit(max(a, b)).alias("b"), (F.col(f"f_{a}") * F.col(f"f_{b}")).alias("xy")) for i, a in enumerate(names) for b in names[i:]]
    rows = factor_returns(model).select("date", F.inline(F.array(*pairs)))
    return scan.ewm(rows, ["a", "b"], ["date"], "xy", halflife, adjust=False).where("ewm_before is not null").select("date", "a", "b", F.col("ewm_before").alias("v"))


def idiosyncratic_variance(model: DataFrame, wanted: DataFrame, halflife: float = 30.0, least: int = 5) -> DataFrame:
    """``date, asset, v`` of the rows of ``wanted`` (date, asset) on the model's dates: decayed squared residuals before the date.

    Dates of the model without a residual age what was before; null with fewer than ``least`` residuals.
    """
    k = scan.decay(halflife)
    dates = model.select("date").distinct()
    place = dates.withColumn("_d", F.row_number().over(Window.orderBy("date")))  # a row a date
    seen = model.select("date", "asset", (F.col("residual") * F.col("residual")).alias("_x"))
    rows = wanted.select("date", "asset").distinct().withColumn("_w", F.lit(True)).join(seen, ["date", "asset"], "full").join(place, "date")
    last = F.last(F.when(F.col("_x").isNotNull(), F.col("_d")), ignorenulls=True).over(W.series().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_old", F.pow(F.lit(k), F.col("_d") - last))  # what is left of the weight before
    new, whole = F.col("_x").isNotNull(), F.col("_old") + (1 - k)
    step = (
        F.when(~new, 1.0).when(F.col("_old").isNull(), 0.0).otherwise(F.col("_old") / whole),
        F.when(~new, 0.0).when(F.col("_old").isNull(), F.col("_x")).otherwise((1 - k) * F.col("_x") / whole),
    )
    made = scan.recurrences(rows, ["asset"], ["date"], {"_v": step, "_n": (F.lit(1.0), F.when(new, 1.0).otherwise(0.0))})
    return made.where("_w").select("date", "asset", F.when(F.col("_n_before") >= least, F.col("_v_before")).alias("v"))


def loadings(weights: DataFrame, exposures: DataFrame, factors: list[str], keys: list[str]) -> DataFrame:
    """``keys, date, x_<factor>``: a portfolio's sums of weight times exposure."""
    rows = weights.join(exposures.select("date", "asset", *factors), ["date", "asset"])
    return rows.groupBy(*keys, "date").agg(*[F.sum(F.col("weight") * F.col(f)).alias(f"x_{f}") for f in factors])


def predicted_vol(model: DataFrame, exposures: DataFrame, weights: DataFrame, keys: list[str], halflife: float = 60.0, idio_halflife: float = 30.0, periods: float = 365.0, least: int = 20) -> DataFrame:
    """``keys, date, total, factor, idio, idio_share``: annualised forecasts for each date's weights, but a portfolio's first ``least``.

    Assets without a variance of their own get the median of the portfolio's others on the date, or 0.
    """
    names = factors_of(model)
    x = loadings(weights, exposures, names, keys).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    cov = factor_covariance(model, halflife)
    wide = cov.groupBy("date").agg(*[F.max(F.when((F.col("a") == min(a, b)) & (F.col("b") == max(a, b)), F.col("v"))).alias(f"v_{a}_{b}") for i, a in enumerate(names) for b in names[i:]])
    both = [(1 if a == b else 2) * F.col(f"x_{a}") * F.col(f"x_{b}") * F.col(f"v_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    factor = x.where(F.col("_k") > least).join(wide, "date").select(*keys, "date", sum(both, F.lit(0.0)).alias("_f"))
    held = weights.where(F.col("weight").isNotNull())
    own = held.join(idiosyncratic_variance(model, held, idio_halflife), ["date", "asset"], "left")
    middle = F.percentile("v", F.lit(0.5)).over(Window.partitionBy(*keys, "date"))
    own = own.withColumn("_v", F.coalesce("v", middle, F.lit(0.0))).groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col("weight") * F.col("_v")).alias("_i"))
    out = factor.join(own, [*keys, "date"], "left").withColumn("_i", F.coalesce("_i", F.lit(0.0)))
    year = lambda v: F.sqrt(v * periods)
    return out.select(
        *keys, "date", year(F.col("_f") + F.col("_i")).alias("total"), year(F.col("_f")).alias("factor"), year(F.col("_i")).alias("idio"),
        F.try_divide("_i", F.col("_f") + F.col("_i")).alias("idio_share"),
    )


def realised(panel: DataFrame, weights: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """``keys, date, r``: what a date's weights earn by the next row."""
    after = panel.select("date", "asset", F.lead(value).over(W.series()).alias("_y"))
    return weights.join(after, ["date", "asset"]).groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col("_y")).alias("r"))


def standardised(predicted: DataFrame, earned: DataFrame, keys: list[str], window: int = 60, periods: float = 365.0) -> DataFrame:
    """``keys, date, z, ratio``: returns over predicted deviations, and realised by mean predicted vol of ``window`` rows."""
    rows = predicted.select(*keys, "date", "total").join(earned, [*keys, "date"]).where("total is not null and r is not null")
    z = F.try_divide(F.col("r") * math.sqrt(periods), F.col("total"))
    ratio = F.try_divide(W.rolling(F.stddev_samp, F.col("r"), window, keys=keys) * math.sqrt(periods), W.rolling(F.avg, F.col("total"), window, keys=keys))
    return rows.select(*keys, "date", z.alias("z"), ratio.alias("ratio"))


def bias_statistic(z: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bias, n, exceed_95, ratio`` of ``standardised``: about 1, and 5 %, if the forecasts are calibrated."""
    beyond = F.avg((F.abs("z") > 1.96).cast("double"))
    return z.groupBy(*keys).agg(F.stddev_samp("z").alias("bias"), F.count("z").alias("n"), beyond.alias("exceed_95"), F.avg("ratio").alias("ratio"))


def attribute(model: DataFrame, exposures: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, date, pnl_<factor>, pnl_idio, pnl_total`` on the model's dates: loadings times factor returns, weights times residuals."""
    names = factors_of(model)
    x = loadings(weights, exposures, names, keys).join(factor_returns(model), "date")
    own = weights.join(model.select("date", "asset", "residual"), ["date", "asset"]).groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col("residual")).alias("pnl_idio"))
    parts = [(F.col(f"x_{f}") * F.col(f"f_{f}")).alias(f"pnl_{f}") for f in names]
    out = x.select(*keys, "date", *parts).join(own, [*keys, "date"], "left")
    return out.withColumn("pnl_total", sum((F.coalesce(f"pnl_{f}", F.lit(0.0)) for f in [*names, "idio"]), F.lit(0.0)))


def summarise_attribution(pnl: DataFrame, keys: list[str], periods: float = 365.0) -> DataFrame:
    """``keys, source, pnl, share, ann_mean, ann_vol, t_stat, sharpe`` of each column ``pnl_<source>``."""
    sources = [c for c in pnl.columns if c.startswith("pnl_")]
    each = pnl.select(*keys, F.inline(F.array(*[F.struct(F.lit(c[4:]).alias("source"), F.col(c).alias("v")) for c in sources])))
    out = each.groupBy(*keys, "source").agg(F.sum("v").alias("pnl"), F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"), F.count("v").alias("_n"))
    total = F.max(F.when(F.col("source") == "total", F.col("pnl"))).over(Window.partitionBy(*keys))
    score = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s"))
    return out.select(
        *keys, "source", "pnl", F.try_divide(F.col("pnl"), total).alias("share"), (F.col("_m") * periods).alias("ann_mean"), (F.col("_s") * math.sqrt(periods)).alias("ann_vol"),
        (score * F.sqrt("_n")).alias("t_stat"), (score * math.sqrt(periods)).alias("sharpe"),
    )
