"""Performance, forecasts and validation splits."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, quantile
from . import scan


def performance(rows: DataFrame, r: str, keys: list[str], periods: float = 52.0) -> DataFrame:
    """Sharpe with its errors, t, hit rate, moments and the probability of a positive true Sharpe, by key."""
    x = F.col(r)
    out = rows.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3).alias("kurt"),
    )
    sr = F.try_divide("mean", "sd")
    out = out.withColumn("sr", sr).withColumn("sharpe", sr * F.sqrt(F.lit(periods))).withColumn("t", sr * F.sqrt("n"))
    out = out.withColumn("se", F.sqrt((1 + F.col("sr") ** 2 / 2) / F.col("n")))
    moment = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2
    out = out.withColumn("se_moments", F.sqrt(F.try_divide(moment, F.col("n") - 1)))
    return out.withColumn("psr", normal_cdf(F.try_divide("sr", "se_moments")))


def sharpe_band(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    z = quantile(0.5 + confidence / 2)
    return rows.withColumn("low", F.col("sr") - z * F.col("se")).withColumn("high", F.col("sr") + z * F.col("se"))


def forecast_scores(rows: DataFrame, prob: str = "prob", outcome: str = "outcome", eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col(prob), F.lit(1 - eps)), F.lit(eps))
    y = F.col(outcome)
    return rows.agg(F.avg((F.col(prob) - y) ** 2).alias("brier"), (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.count("*").alias("n"))


def calibration_curve(rows: DataFrame, bins: int = 10, prob: str = "prob", outcome: str = "outcome") -> DataFrame:
    """Equal-width bins, the last one closed; bins without rows are left out."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_prob"), F.avg(outcome).alias("frequency"), F.count("*").alias("n"))


def variance_scores(rows: DataFrame, realised: Column, forecast: Column, keys: list[str]) -> DataFrame:
    q = F.try_divide(realised, forecast)
    return rows.groupBy(*keys).agg(F.avg(q - F.ln(q) - 1).alias("qlike"), F.avg((realised - forecast) ** 2).alias("mse"))


# --- splits -----------------------------------------------------------------------------------------------------------
def numbered(dates: DataFrame) -> DataFrame:
    """``date, i``: distinct dates from 0. One row a date, so one task counts them."""
    d = dates.select("date").distinct()
    return d.withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def walk_forward(dates: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """``fold, role, date``: ``train`` rows, then ``test`` rows, moved on by ``step`` (test)."""
    step = step or test
    d = numbered(dates)
    n = F.count("*").over(Window.partitionBy())
    d = d.withColumn("_n", n)
    # folds that hold row i: those whose start is in (i - train - test, i]
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - train - test + 1) / step))
    hi = F.least(F.floor(F.col("i") / step), F.floor((F.col("_n") - train - test) / step))
    e = d.where(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    at = F.col("i") - F.col("fold") * step
    return e.select("fold", F.when(at < train, "train").otherwise("test").alias("role"), "date")


def groups(dates: DataFrame, k: int) -> DataFrame:
    """``date, i, grp``: k contiguous groups, the first n % k one longer."""
    return numbered(dates).withColumn("grp", (F.ntile(k).over(Window.orderBy("i")) - 1).cast("long"))


def combinations(dates: DataFrame, n_groups: int = 6, n_test: int = 2, purge: int = 0, embargo: int = 0) -> DataFrame:
    """``fold, role, date``: every choice of ``n_test`` of the groups as test; training rows near a test group are purged.

    A training row is dropped if it lies in [first - purge, last + embargo] of any test group. With ``n_test`` 1 this is
    the purged k-fold.
    """
    g = groups(dates, n_groups)
    chosen = list(itertools.combinations(range(n_groups), n_test))
    spec = F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), F.array(*[F.lit(x).cast("long") for x in c]).alias("test")) for f, c in enumerate(chosen)])
    ends = g.groupBy("grp").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    spans = ends.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("lo", "hi")))).alias("span"))  # n_groups entries
    rows = g.withColumn("_", F.lit(1)).join(F.broadcast(spans.withColumn("_", F.lit(1))), "_").withColumn("s", F.explode(spec))
    test = F.array_contains("s.test", F.col("grp"))
    near = F.exists("s.test", lambda x: (F.col("i") >= F.col("span")[x]["lo"] - purge) & (F.col("i") <= F.col("span")[x]["hi"] + embargo))
    out = rows.select(F.col("s.fold").alias("fold"), "date", F.when(test, "test").when(~near, "train").alias("role"))
    return out.where("role is not null").select("fold", "role", "date")


def paths(spark: SparkSession, n_groups: int = 6, n_test: int = 2) -> DataFrame:
    """``path, grp, fold``: the folds of ``combinations`` stitched to paths, each of which has every group once.

    The earliest fold that tests a group is on the first path, the next one on the second, and so on; every test group of
    every fold is on one path.
    """
    tested = [(f, g) for f, c in enumerate(itertools.combinations(range(n_groups), n_test)) for g in c]
    rows = spark.createDataFrame(tested, "fold long, grp long")  # as many as the folds have test groups
    return rows.select((F.row_number().over(Window.partitionBy("grp").orderBy("fold")) - 1).cast("long").alias("path"), "grp", "fold")


def path_returns(rows: DataFrame, r: str, n_groups: int = 6, n_test: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, path, date`` and ``r`` of the paths: each date's return comes from the fold that tests it there.

    ``rows``: keys, fold, date and the return out of sample; what isn't a test row of its fold isn't used. Groups are those of
    all dates in ``rows``.
    """
    g = groups(rows, n_groups).select("date", "grp")
    stitched = rows.join(g, "date").join(F.broadcast(paths(rows.sparkSession, n_groups, n_test)), ["fold", "grp"])
    return stitched.select(*keys, "path", "date", r)


def compare_variants(rows: DataFrame, r: str, variant: str, k: int = 6, periods: float = 52.0) -> DataFrame:
    """``variant, sharpe, groups_min, groups_mean, groups_positive, n``: the whole and the contiguous groups of all dates.

    ``groups_positive`` is a share of the groups in which the variant has a Sharpe ratio.
    """
    x = F.col(r)
    score = F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(periods))
    seen = rows.where(x.isNotNull())
    each = seen.join(groups(rows, k).select("date", "grp"), "date").groupBy(variant, "grp").agg(score.alias("_s")).groupBy(variant)
    parts = each.agg(F.min("_s").alias("groups_min"), F.avg("_s").alias("groups_mean"), F.avg((F.col("_s") > 0).cast("double")).alias("groups_positive"))
    return seen.groupBy(variant).agg(score.alias("sharpe"), F.count("*").alias("n")).join(parts, variant).select(variant, "sharpe", "groups_min", "groups_mean", "groups_positive", "n")


def group_sharpes(rows: DataFrame, r: str, k: int = 6, periods: float = 52.0) -> DataFrame:
    j = rows.join(groups(rows, k), "date")
    return j.groupBy("grp").agg(F.min("date").alias("first"), F.max("date").alias("last"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(periods))).alias("sharpe"))


def regime_table(rows: DataFrame, r: str, benchmark: str, window: int = 90, periods: float = 52.0) -> DataFrame:
    """Performance in bull and bear regimes: the sign of the trailing compounded benchmark, a row late."""
    w = Window.orderBy("date")
    full = F.when(F.count(benchmark).over(w.rowsBetween(-(window - 1), 0)) == window, F.product(1 + F.col(benchmark)).over(w.rowsBetween(-(window - 1), 0)) - 1)
    s = rows.withColumn("_t", full).withColumn("_s", F.lag("_t").over(w)).where("_s is not null")
    out = s.groupBy(F.when(F.col("_s") >= 0, "bull").otherwise("bear").alias("regime"))
    return out.agg(F.count("*").alias("n"), (F.avg(r) * periods).alias("mean"), (F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(periods))).alias("sharpe"))


# --- simulation -------------------------------------------------------------------------------------------------------
def block_paths(history: DataFrame, starts: DataFrame, block: int, horizon: int) -> DataFrame:
    """``path, step, pnl``: circular blocks of history rows. ``starts``: path, b (block's number), start (row it begins at)."""
    n = history.count()
    steps = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    steps = steps.select("path", (F.col("b") * block + F.col("o")).alias("step"), F.pmod(F.col("start") + F.col("o"), F.lit(n)).alias("i")).where(F.col("step") < horizon)
    return steps.join(history, "i").select("path", "step", "pnl")


def hashed_starts(spark, n_paths: int, n_blocks: int, n: int, seed: int = 0) -> DataFrame:
    """Block starts from a hash of (seed, path, block): the same in every run and on every cluster."""
    p = spark.range(n_paths).withColumnRenamed("id", "path").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("path").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("long")
    return p.withColumn("start", F.pmod(h, F.lit(n)))


def path_statistics(paths: DataFrame, periods: int = 52) -> DataFrame:
    """Per path: sum, volatility, Sharpe, drawdown of the running sum (not compounded), worst step."""
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = paths.withColumn("cum", F.sum("pnl").over(w)).withColumn("dd", F.col("cum") - F.max("cum").over(w))
    return c.groupBy("path").agg(
        F.sum("pnl").alias("total"),
        (F.stddev_samp("pnl") * F.sqrt(F.lit(float(periods)))).alias("vol"),
        (F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.min("dd").alias("max_drawdown"),
        F.min("pnl").alias("worst"),
    )


def state_probabilities(rows: DataFrame, state: str, target: float, order: str = "date", half_life: int | None = None) -> DataFrame:
    """``p``: Gaussian weight of a row's state around ``target`` (bandwidth: half the deviation), decayed by age."""
    one = rows.agg((F.stddev_pop(state) / 2).alias("_bw"), F.count("*").alias("_n"))  # one row
    s = scan.numbered(rows, [], [order]) if half_life else rows.withColumn("_i", F.lit(0))
    s = s.join(F.broadcast(one))
    k = F.coalesce(F.exp(-0.5 * F.try_divide(F.col(state) - target, F.col("_bw")) ** 2), F.lit(0.0))
    if half_life:
        k = k * F.pow(F.lit(0.5), (F.col("_n") - 1 - F.col("_i")) / half_life)
    s = s.withColumn("_k", k)
    return s.join(F.broadcast(s.agg(F.sum("_k").alias("_total")))).withColumn("p", F.col("_k") / F.col("_total")).select(*rows.columns, "p")
