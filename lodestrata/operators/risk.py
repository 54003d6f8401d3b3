"""Risk in long tables: loadings (asset, factor, b), factor covariance (f1, f2, v), idiosyncratic variance (asset, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..sources.shared import durable
from . import scan


def realised_variance(rows: DataFrame, keys: list[str], r: str = "r", ts: str = "ts") -> DataFrame:
    """Sum of squared returns and its root by key and day."""
    v = F.sum(F.col(r) * F.col(r))
    return rows.groupBy(*keys, F.to_date(ts).alias("date")).agg(v.alias("variance"), F.sqrt(v).alias("volatility"))


def roll_spread(rows: DataFrame, key: str, px: str, order: list[str]) -> DataFrame:
    """Effective spread from the negative covariance of successive price changes; 0 if it isn't negative."""
    w = Window.partitionBy(key).orderBy(*order)
    d = rows.withColumn("_d", F.col(px) - F.lag(px).over(w)).withColumn("_l", F.lag("_d").over(w))
    c = F.covar_samp("_d", "_l")
    return d.groupBy(key).agg(F.when(c < 0, 2 * F.sqrt(-c)).otherwise(0.0).alias("spread"))


def sample_covariance(rows: DataFrame, value: str = "ret", key: str = "asset", date: str = "date") -> DataFrame:
    """``a, b, cov, corr, n`` of all pairs of assets with a <= b, over dates on which both have a value."""
    x = rows.where(F.col(value).isNotNull()).select(date, F.struct(F.col(key).alias("k"), F.col(value).alias("x")).alias("s"))
    # a date's cross-section pairs up inside a task, so only sums of pairs are shuffled
    cuts = x.groupBy(date).agg(F.sort_array(F.collect_list("s")).alias("_s")).select("_s", F.posexplode("_s").alias("_i", "_a"))
    pair = cuts.select("_a", F.explode(F.slice("_s", F.col("_i") + 1, F.size("_s"))).alias("_b"))
    x, y = F.col("_a.x"), F.col("_b.x")
    return pair.groupBy(F.col("_a.k").alias("a"), F.col("_b.k").alias("b")).agg(F.covar_samp(x, y).alias("cov"), F.corr(x, y).alias("corr"), F.count("*").alias("n"))


def winsorize_returns(rows: DataFrame, most: float = 8.0, value: str = "ret", key: str = "asset") -> DataFrame:
    """Log returns cut at ``most`` times the asset's median absolute one; ``clipped`` says where."""
    lr = F.log1p(value)
    limit = most * F.percentile(F.abs(lr), F.lit(0.5)).over(Window.partitionBy(key))
    out = rows.withColumn("_l", lr).withColumn("_m", limit)
    cut = F.when(F.col("_l").isNotNull(), F.greatest(F.least("_l", "_m"), -F.col("_m")))
    return out.withColumn("winsorized", F.expm1(cut)).withColumn("clipped", F.coalesce(F.abs("_l") > F.col("_m"), F.lit(False))).drop("_l", "_m")


def exposures(weights: DataFrame, loadings: DataFrame, keys: list[str]) -> DataFrame:
    """B'w: ``keys, factor, x``."""
    on = ["asset", *[k for k in keys if k in loadings.columns]]
    return weights.join(loadings, on).groupBy(*keys, "factor").agg(F.sum(F.col("b") * F.col("weight")).alias("x"))


def portfolio_variance(x: DataFrame, fcov: DataFrame, weights: DataFrame, idio: DataFrame, keys: list[str]) -> DataFrame:
    """``factor_variance, idio_variance, variance, pct_idio`` by key."""
    left = x.select(*keys, F.col("factor").alias("f1"), F.col("x").alias("x1"))
    right = x.select(*keys, F.col("factor").alias("f2"), F.col("x").alias("x2"))
    pair = left.join(fcov, "f1").join(right, [*keys, "f2"])
    fv = pair.groupBy(*keys).agg(F.sum(F.col("x1") * F.col("v") * F.col("x2")).alias("factor_variance"))
    iv = weights.join(idio, "asset").groupBy(*keys).agg(F.sum(F.col("v") * F.col("weight") ** 2).alias("idio_variance"))
    out = fv.join(iv, keys).withColumn("variance", F.col("factor_variance") + F.col("idio_variance"))
    return out.withColumn("pct_idio", F.coalesce(F.try_divide("idio_variance", "variance"), F.lit(0.0)))


def marginal_contributions(x: DataFrame, fcov: DataFrame, keys: list[str]) -> DataFrame:
    """F x / sqrt(x'Fx) by factor, and each factor's share of the factor variance."""
    right = x.select(*keys, F.col("factor").alias("f2"), F.col("x").alias("x2"))
    fx = fcov.join(right, "f2").groupBy(*keys, F.col("f1").alias("factor")).agg(F.sum(F.col("v") * F.col("x2")).alias("fx"))
    out = x.join(fx, [*keys, "factor"]).withColumn("part", F.col("x") * F.col("fx"))
    total = F.sum("part").over(Window.partitionBy(*keys))
    return out.withColumn("mcfr", F.when(total > 0, F.col("fx") / F.sqrt(total)).otherwise(0.0)).withColumn("share", F.coalesce(F.try_divide(F.col("part"), total), F.lit(0.0))).drop("part", "fx")


def hedge_ratio(rows: DataFrame, core: str, hedge: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(-F.covar_samp(core, hedge), F.var_samp(hedge)).alias("hedge_ratio"), F.corr(core, hedge).alias("corr"))


def drawdowns(rows: DataFrame, equity: str, keys: list[str], order: str = "date") -> DataFrame:
    """High-water mark, drawdown >= 0 (risk's sign) and <= 0 (the performance tables' sign)."""
    top = F.max(equity).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("high_watermark", top)
    return out.withColumn("drawdown", 1 - F.col(equity) / F.col("high_watermark")).withColumn("underwater", F.col(equity) / F.col("high_watermark") - 1)


def equity_curve(r: Column, keys=("asset",)) -> Column:
    """Compounded returns; a missing return leaves it as it is."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(W.series(*keys).rowsBetween(Window.unboundedPreceding, 0))


# --- tail -------------------------------------------------------------------------------------------------------------
def _tail(scen: DataFrame, alpha: float, keys: list[str], pnl: str, sid: str, p: str | None) -> DataFrame:
    """Loss, probability and weight in the tail of each scenario: the boundary one is split.

    The boundary is row k = min(#{cumulative p <= 1 - alpha}, n - 1) of the losses in falling order.
    """
    if not keys:
        return _tail_of_one(scen, alpha, pnl, sid, p)
    part = Window.partitionBy(*keys)
    prob = F.col(p) / F.sum(p).over(part) if p else F.lit(1.0) / F.count("*").over(part)
    order = part.orderBy(F.desc("loss"), sid)
    t = scen.withColumn("loss", -F.col(pnl)).withColumn("p", prob)
    t = t.withColumn("i", F.row_number().over(order) - 1).withColumn("cum", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.col("cum") <= 1 - alpha + 1e-12
    t = t.withColumn("k", F.least(F.sum(full.cast("long")).over(part), F.count("*").over(part) - 1))
    inside = F.col("i") < F.col("k")
    before = F.coalesce(F.sum(F.when(inside, F.col("p"))).over(part), F.lit(0.0))
    return t.withColumn("w", F.when(inside, F.col("p")).when(F.col("i") == F.col("k"), 1 - alpha - before).otherwise(0.0))


def _tail_of_one(scen: DataFrame, alpha: float, pnl: str, sid: str, p: str | None) -> DataFrame:
    """``_tail`` of all scenarios together: ranks and running probabilities by an ordered scan, totals as one row."""
    one = scen.agg((F.sum(p) if p else F.count("*").cast("double")).alias("_sum"), F.count("*").alias("_all"))
    t = scen.withColumn("loss", -F.col(pnl)).join(F.broadcast(one)).withColumn("p", (F.col(p) if p else F.lit(1.0)) / F.col("_sum"))
    t = t.withColumn("_late", F.col("loss").isNull()).withColumn("_order", -F.col("loss"))
    t = durable(scan.recurrences(t, [], ["_late", "_order", sid], {"cum": (F.lit(1.0), F.col("p")), "_c": (F.lit(1.0), F.lit(1.0))}))
    full = F.col("cum") <= 1 - alpha + 1e-12
    k = t.agg(F.least(F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.max("_all") - 1).alias("k"))
    t = t.withColumn("i", F.col("_c_before").cast("long")).join(F.broadcast(k))
    before = t.agg(F.coalesce(F.sum(F.when(F.col("i") < F.col("k"), F.col("p"))), F.lit(0.0)).alias("_before"))
    t = t.join(F.broadcast(before))
    w = F.when(F.col("i") < F.col("k"), F.col("p")).when(F.col("i") == F.col("k"), 1 - alpha - F.col("_before")).otherwise(0.0)
    return t.withColumn("w", w).drop("_sum", "_all", "_late", "_order", "_c", "_c_before", "cum_before", "_before")


def var_cvar(scen: DataFrame, alpha: float = 0.95, keys: tuple[str, ...] = (), pnl: str = "pnl", sid: str = "date", p: str | None = None) -> DataFrame:
    t = _tail(scen, alpha, list(keys), pnl, sid, p)
    return t.groupBy(*keys).agg((F.sum(F.col("w") * F.col("loss")) / (1 - alpha)).alias("cvar"), F.max(F.when(F.col("i") == F.col("k"), F.col("loss"))).alias("var"))


def euler_contributions(components: DataFrame, alpha: float = 0.95, sid: str = "date", pnl: str = "pnl", component: str = "component") -> DataFrame:
    """Share of each component in the CVaR of their sum; they add up to it."""
    total = components.groupBy(sid).agg(F.sum(pnl).alias("_total"))
    tail = _tail(total, alpha, [], "_total", sid, None).where("w != 0").select(sid, "w")
    return components.join(tail, sid).groupBy(component).agg((-F.sum(F.col("w") * F.col(pnl)) / (1 - alpha)).alias("contribution"))


def tail_summary(scen: DataFrame, keys: tuple[str, ...] = (), pnl: str = "pnl", sid: str = "date", periods: int = 365) -> DataFrame:
    out = scen.groupBy(*keys).agg(F.avg(pnl).alias("mean"), F.stddev_pop(pnl).alias("sd"), F.max(-F.col(pnl)).alias("worst"))
    out = out.withColumn("sharpe", F.try_divide("mean", "sd") * F.sqrt(F.lit(float(periods))))
    for alpha in (0.95, 0.99):
        v = var_cvar(scen, alpha, keys, pnl, sid).withColumnRenamed("cvar", f"cvar{round(100 * alpha)}").drop("var")
        out = out.join(v, list(keys)) if keys else out.withColumn("_", F.lit(1)).join(v.withColumn("_", F.lit(1)), "_").drop("_")
    return out


def effective_scenarios(rows: DataFrame, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    q = rows.withColumn("_p", F.col(p) / F.sum(p).over(Window.partitionBy(*keys)))
    return q.groupBy(*keys).agg(F.exp(-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")))).alias("effective"))
