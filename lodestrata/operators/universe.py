"""Point-in-time universes by liquidity and by capitalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W


def dollar_volume(bars: DataFrame) -> DataFrame:
    """``date, asset, dv``: null before an asset's first positive value."""
    dv = bars.groupBy("date", "asset").agg(F.sum(F.col("volume") * F.col("close")).alias("dv"))
    started = F.max(F.col("dv") > 0).over(W.series().rowsBetween(Window.unboundedPreceding, 0))
    return dv.withColumn("dv", F.when(started, F.col("dv")))


def liquidity_universe(dv: DataFrame, n: int = 10, lookback: int = 30, min_age: int = 60, least_dates: int | None = None, step: str = "interval 1 month") -> DataFrame:
    """``date, asset, member``: the ``n`` assets with the largest median of the last ``lookback`` days, from rebalance to rebalance.

    Rebalances are the month starts after the first date and not after the last. The window is [R - lookback days, R); a
    rebalance is left out if it holds fewer than ``least_dates`` dates; an asset needs half of them and ``min_age`` days
    since its first value. A member also needs a value that day.
    """
    need = least_dates if least_dates is not None else max(5, lookback // 2)
    half = max(1, (least_dates if least_dates is not None else lookback) // 2)
    first = dv.where("dv is not null").groupBy("asset").agg(F.min("date").alias("born"))
    ends = dv.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = ends.select("lo", "hi", F.explode(F.expr(f"sequence(trunc(lo, 'month'), hi, {step})")).alias("r")).where("r > lo")
    # each date serves the rebalances of the next lookback days: an equi-join on the month, not a loop over dates
    months = F.sequence(F.trunc("date", "month"), F.trunc(F.date_add("date", lookback), "month"), F.expr("interval 1 month"))
    near = dv.withColumn("r", F.explode(months)).where((F.col("date") < F.col("r")) & (F.col("date") >= F.date_sub("r", lookback)))
    near = near.join(F.broadcast(cal.select("r")), "r")  # a row a month
    enough = near.groupBy("r").agg(F.countDistinct("date").alias("k")).where(F.col("k") >= need).select("r")
    score = near.groupBy("r", "asset").agg(F.percentile("dv", F.lit(0.5)).alias("score"), F.count("dv").alias("k"))
    score = score.join(enough, "r").join(first, "asset").where((F.col("k") >= half) & (F.datediff("r", "born") >= min_age))
    top = score.withColumn("rank", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "asset"))).where(F.col("rank") <= n)
    # rebalance that a date belongs to: the last valid one at or before it
    valid = enough.withColumn("next", F.lead("r").over(Window.orderBy("r")))
    span = valid.select("r", F.explode(F.expr("sequence(r, coalesce(date_sub(next, 1), add_months(r, 1200)), interval 1 month)")).alias("m")).select("r", F.trunc("m", "month").alias("m")).distinct()
    dated = dv.withColumn("m", F.trunc("date", "month")).join(F.broadcast(span), "m", "left")
    out = dated.join(top.select("r", "asset", F.lit(True).alias("in_top")), ["r", "asset"], "left")
    return out.select("date", "asset", (F.coalesce("in_top", F.lit(False)) & F.col("dv").isNotNull()).alias("member"))


def membership_summary(universe: DataFrame) -> DataFrame:
    return universe.where("member").groupBy("asset").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days")).orderBy(F.desc("days"), "asset")


def normalise_ticker(t: Column, known: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Aliases, then the numeric suffix goes when the base is known and the ticker isn't."""
    out = t
    for a, b in (aliases or {}).items():
        out = F.when(t == a, F.lit(b)).otherwise(out)
    base = F.regexp_replace(out, "[0-9]+$", "")
    return out if known is None else F.when(~out.isin(known) & base.isin(known), base).otherwise(out)


def cap_series(caps: DataFrame, smooth: int = 7, min_history: int = 30, fill: int = 3, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``date, ticker, cap``: filled over ``fill`` grid rows, rolling median, null until ``min_history`` rows are known.

    ``caps`` is a dense grid (``densify``) of ``date, ticker, cap``; duplicates are reduced to their maximum before.
    """
    keys = ("ticker",)
    kept = caps.where(~F.col("ticker").isin(*exclude) & ~F.regexp_replace("ticker", "[0-9]+$", "").isin(*exclude)) if exclude else caps
    f = kept.withColumn("filled", W.ffill(F.col("cap"), fill, keys))
    known = F.count("filled").over(W.series(*keys).rowsBetween(Window.unboundedPreceding, 0))
    med = W.rolling_median(F.col("filled"), smooth, max(1, smooth // 2), keys)
    return f.select("date", "ticker", F.when(known >= min_history, med).alias("cap"))


def cap_universe(series: DataFrame, n: int = 10) -> DataFrame:
    """``date, ticker, member``: among the ``n`` largest on the grid row before; the first date has none."""
    rank = F.when(F.col("cap").isNotNull(), F.row_number().over(Window.partitionBy("date").orderBy(F.col("cap").desc_nulls_last(), "ticker")))
    r = series.withColumn("rank", rank)
    return r.select("date", "ticker", F.coalesce(F.lag("rank").over(W.series("ticker")) <= n, F.lit(False)).alias("member"))
