"""Sizing, neutralisation and attribution of books, as windows over the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def scale_to_gross(raw: Column, gross: float = 1.0, by: str = "date") -> Column:
    return F.coalesce(gross * F.try_divide(raw, F.sum(F.abs(raw)).over(W.section(by))), F.when(raw.isNotNull(), F.lit(0.0)))


def proportional_size(alpha: Column, gross: float = 1.0) -> Column:
    return scale_to_gross(alpha, gross)


def risk_parity_size(alpha: Column, vol: Column, gross: float = 1.0) -> Column:
    return scale_to_gross(F.try_divide(alpha, vol), gross)


def mean_variance_size(alpha: Column, vol: Column, gross: float = 1.0) -> Column:
    return scale_to_gross(F.try_divide(alpha, vol * vol), gross)


def shrunk_size(alpha: Column, vol: Column, sector_vol: Column, shrink: float, gross: float = 1.0) -> Column:
    return scale_to_gross(F.try_divide(alpha, shrink * vol * vol + (1 - shrink) * sector_vol * sector_vol), gross)


def cap_and_normalise(w: Column, cap: float = 0.25, by: str = "date") -> Column:
    cut = W.clip(w, -cap, cap)
    gross = F.sum(F.abs(cut)).over(W.section(by))
    return F.when(gross > 1, cut / gross).otherwise(cut)


def rolling_betas(panel: DataFrame, window: int = 90, least: int = 45) -> DataFrame:
    """``beta``: rolling covariance with the universe's mean return over that mean's variance, one grid row late.

    The covariance is over rows where both have values, the variance over the basket alone; each has its own guard.
    """
    r = F.col("ret") + F.coalesce("funding", F.lit(0.0))
    p = panel.withColumn("_r", r).withColumn("_b", F.avg(F.when(F.col("in_universe"), r)).over(W.section()))
    both = F.col("_r").isNotNull() & F.col("_b").isNotNull()
    w = W.series().rowsBetween(-(window - 1), 0)
    cov = F.when(F.sum(both.cast("long")).over(w) >= least, F.covar_samp("_r", "_b").over(w))
    var = F.when(F.count("_b").over(w) >= least, F.var_samp("_b").over(w))
    p = p.withColumn("_beta", F.try_divide(cov, var))
    return p.withColumn("beta", F.lag("_beta").over(W.series())).drop("_r", "_b", "_beta")


def neutralise(panel: DataFrame, mode: str, cap: float = 0.25, hedge: str | None = None, rounds: int = 4) -> DataFrame:
    """``neutral``: weights made neutral to the dollar, to beta (column ``beta``), or by a hedge asset; then capped, gross <= 1.

    Rows held (weight neither null nor 0) are settled before anything changes. Hedge mode returns before the caps.
    """
    p = panel.withColumn("_h", F.coalesce(F.col("weight") != 0, F.lit(False))).withColumn("_w", F.col("weight"))
    sec = W.section()
    if mode == "dollar":
        for i in range(rounds):  # each round needs the last one's weights: a window on a window
            mean = F.avg(F.when(F.col("_h"), F.col("_w"))).over(sec)
            p = p.withColumn("_w", W.clip(F.when(F.col("_h"), F.col("_w") - mean).otherwise(F.col("_w")), -cap, cap))
    elif mode == "beta":
        b = F.when(F.col("_h"), F.col("beta"))
        k = F.coalesce(F.try_divide(F.sum(b * F.col("_w")).over(sec), F.sum(b * b).over(sec)), F.lit(0.0))
        p = p.withColumn("_w", F.when(b.isNotNull(), F.col("_w") - k * b).otherwise(F.col("_w")))
    elif mode == "hedge":
        mine = F.max(F.when(F.col("asset") == hedge, F.col("beta"))).over(sec)
        need = F.sum(F.when(F.col("_h"), F.col("beta") * F.col("_w"))).over(sec)
        add = F.when(F.abs(mine) > 0.2, -need / mine).otherwise(0.0)
        out = F.when(F.col("asset") == hedge, F.coalesce("_w", F.lit(0.0)) + F.coalesce(add, F.lit(0.0))).otherwise(F.col("_w"))
        return p.withColumn("neutral", out).drop("_h", "_w")
    else:
        raise ValueError(f"mode {mode!r} is none of dollar, beta, hedge")
    return p.withColumn("_w", W.clip(F.col("_w"), -cap, cap)).withColumn("_g", F.sum(F.abs("_w")).over(sec)).withColumn("neutral", F.when(F.col("_g") > 1, F.col("_w") / F.col("_g")).otherwise(F.col("_w"))).drop("_h", "_w", "_g")


def by_source(panel: DataFrame) -> DataFrame:
    """Daily result of lagged weights by source: price, funding, long, short, gross, net."""
    w = F.coalesce(F.lag("weight").over(W.series()), F.lit(0.0))
    p = panel.withColumn("_w", w)
    price, fund = F.coalesce("ret", F.lit(0.0)), F.coalesce("funding", F.lit(0.0))
    pnl = F.col("_w") * (price + fund)
    return p.groupBy("date").agg(
        F.sum(pnl).alias("total"),
        F.sum(F.col("_w") * price).alias("price"),
        F.sum(F.col("_w") * fund).alias("funding"),
        F.sum(F.when(F.col("_w") > 0, pnl).otherwise(0.0)).alias("long"),
        F.sum(F.when(F.col("_w") < 0, pnl).otherwise(0.0)).alias("short"),
        F.sum(F.abs("_w")).alias("gross"),
        F.sum("_w").alias("net"),
    )


def by_asset(panel: DataFrame) -> DataFrame:
    w = F.coalesce(F.lag("weight").over(W.series()), F.lit(0.0))
    return panel.withColumn("_w", w).groupBy("asset").agg(F.sum(F.col("_w") * F.coalesce("ret", F.lit(0.0))).alias("price"), F.sum(F.col("_w") * F.coalesce("funding", F.lit(0.0))).alias("funding"))


def factor_portfolio_returns(panel: DataFrame, factor: str) -> DataFrame:
    """Return of yesterday's factor values as weights, and of yesterday's universe equally weighted."""
    f, u = F.lag(factor).over(W.series()), F.lag("in_universe").over(W.series())
    p = panel.withColumn("_f", f).withColumn("_u", F.coalesce(u, F.lit(False)))
    return p.groupBy("date").agg(F.coalesce(F.sum(F.col("_f") * F.col("ret")), F.lit(0.0)).alias("factor"), F.avg(F.when(F.col("_u"), F.col("ret"))).alias("market"))


def selection_sizing_timing(panel: DataFrame) -> DataFrame:
    """Daily result of the book, of the book with equal sizes within each date, and with equal gross over time too."""
    w = F.coalesce(F.lag("weight").over(W.series()), F.lit(0.0))
    p = panel.withColumn("_w", w).withColumn("_r", F.coalesce("ret", F.lit(0.0)))
    active = F.sum((F.col("_w") != 0).cast("long")).over(W.section())
    gross = F.sum(F.abs("_w")).over(W.section())
    p = p.withColumn("_n", active).withColumn("_g", gross)
    d = p.groupBy("date").agg(
        F.sum(F.col("_w") * F.col("_r")).alias("pnl"),
        F.sum(F.coalesce(F.signum("_w") * F.try_divide("_g", "_n") * F.col("_r"), F.lit(0.0))).alias("equal_size"),
        F.sum(F.coalesce(F.try_divide(F.signum("_w") * F.col("_r"), F.col("_n")), F.lit(0.0))).alias("unit"),
        F.max("_g").alias("gross"),
    )
    whole = Window.partitionBy()  # one row a date
    d = d.withColumn("equal_gross", F.col("unit") * F.avg(F.when(F.col("gross") > 0, F.col("gross"))).over(whole))
    return d.select("date", "pnl", (F.col("pnl") - F.col("equal_size")).alias("sizing"), (F.col("equal_size") - F.col("equal_gross")).alias("timing"), F.col("equal_gross").alias("selection"))


def effective_breadth(w: Column) -> Column:
    """(sum |w|)^2 / sum w^2, an aggregate."""
    return F.try_divide(F.sum(F.abs(w)) ** 2, F.sum(w * w))
