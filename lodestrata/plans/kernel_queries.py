"""Queries of grouped kernels and pair moments. Where SQL can't express them, tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import books as B
from ..operators import components as C
from ..operators import decisions as D
from ..operators import futures as U
from ..operators import garch as G
from ..operators import inference as I
from ..operators import kernels as K
from ..operators import ledger as L
from ..operators import moments as M
from ..operators import risk_model as R
from ..sources.shared import durable
from . import views as V

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _panel(spark, d):
    p = V.panel(spark, d).withColumn("strategy", F.lit("momentum")).withColumn("alpha", F.col("mom"))
    return p.withColumn("vol", W.rolling(F.stddev_samp, F.col("ret"), 26, 13)).withColumn("market", F.lit(1.0))


#: Days from book to book, days that a book looks back, and the share of them that an asset needs.
EVERY, SPAN, SHARE = 28, 364, 0.4

WINDOWS = f"""days AS (
  SELECT unnest(generate_series((SELECT min(date) FROM panel), (SELECT max(date) FROM panel) + INTERVAL {EVERY} DAY, INTERVAL 1 DAY))::DATE AS cutoff
), ends AS (
  SELECT cutoff FROM days WHERE date_diff('day', DATE '1970-01-01', cutoff) % {EVERY} = 0 AND cutoff - {SPAN} >= (SELECT min(date) FROM panel)
), w AS (
  SELECT cutoff, date, asset, coalesce(ret, 0) AS ret FROM ends JOIN panel ON date < cutoff AND date >= cutoff - {SPAN}
  QUALIFY count(ret) OVER (PARTITION BY cutoff, asset) >= {SHARE} * count(*) OVER (PARTITION BY cutoff, asset)
), x AS (
  SELECT cutoff, date, asset, ret - avg(ret) OVER (PARTITION BY cutoff, asset) AS x, row_number() OVER (PARTITION BY cutoff, asset ORDER BY date DESC) - 1 AS age FROM w
), pairs AS (
  SELECT a.cutoff AS cutoff, a.asset AS a, b.asset AS b, count(*) AS n, sum(a.x * b.x) AS s, sum((a.x * b.x) ** 2) AS q,
    sum(a.x * b.x * 0.5::DOUBLE ** (a.age / 30.0::DOUBLE)) AS e
  FROM x a JOIN x b ON a.cutoff = b.cutoff AND a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2, 3)"""

SHRUNK = """whole AS (
  SELECT cutoff, avg(s / n) FILTER (a = b) AS mu, count(*) FILTER (a = b) AS width, sum(CASE WHEN a = b THEN 1 ELSE 2 END * (s / n) ** 2) AS norm,
    sum(CASE WHEN a = b THEN 1 ELSE 2 END * q / n) AS fourth
  FROM pairs GROUP BY 1
), share AS (
  SELECT cutoff, mu, CASE WHEN norm - width * mu * mu > 1e-12::DOUBLE * norm THEN least((fourth - norm) / (norm - width * mu * mu) / n, 1) ELSE 1 END AS d
  FROM whole JOIN (SELECT cutoff, min(n) AS n FROM pairs GROUP BY 1) USING (cutoff)
)"""


def _windows(spark, d):
    return M.trailing(V.panel(spark, d).select("date", "asset", "ret"), EVERY, SPAN, share=SHARE)


def _cov(spark, d, method):
    return M.covariance(_windows(spark, d), method, "cutoff").withColumn("cov", F.round("cov", 7))


@query
def cov_sample(spark, d):
    return _cov(spark, d, "sample")


@query
def cov_ledoit_wolf(spark, d):
    return _cov(spark, d, "lw")


@query
def cov_denoised(spark, d):
    return _cov(spark, d, "denoised")


@query
def cov_ewma(spark, d):
    return _cov(spark, d, "ewma")


ORACLES |= {
    "cov_sample": f"WITH {V.PANEL}, {WINDOWS} SELECT cutoff, a, b, round(s / (n - 1), 7) AS cov FROM pairs",
    "cov_ledoit_wolf": f"WITH {V.PANEL}, {WINDOWS}, {SHRUNK} SELECT cutoff, a, b, round(d * CASE WHEN a = b THEN mu ELSE 0 END + (1 - d) * s / n, 7) AS cov FROM pairs JOIN share USING (cutoff)",
    "cov_ewma": f"WITH {V.PANEL}, {WINDOWS} SELECT cutoff, a, b, round(0.5::DOUBLE ** (n / 30.0::DOUBLE) * s / (n - 1) + (1 - 0.5::DOUBLE ** (1 / 30.0::DOUBLE)) * e, 7) AS cov FROM pairs",
}


def _books(spark, d, method):
    """Each book's alphas are the last momentum before it."""
    alphas = M.trailing(V.panel(spark, d).select("date", "asset", "mom"), EVERY, SPAN, "mom", 0.0)
    alphas = alphas.groupBy("cutoff", "asset").agg(F.max_by("mom", "date").alias("alpha"))
    return B.books(M.covariance(_windows(spark, d), "lw", "cutoff"), alphas, method, "cutoff")


@query
def book_min_variance(spark, d):
    return _books(spark, d, "min_variance")


@query
def book_mean_variance(spark, d):
    return _books(spark, d, "mean_variance")


@query
def book_hierarchical(spark, d):
    return _books(spark, d, "hrp")


@query
def vol_ewma(spark, d):
    return K.ewma_variance(_panel(spark, d), 10).withColumn("variance", F.round("variance", 9))


# weights are put as powers that fall from the first row on, so that a running sum serves
ORACLES["vol_ewma"] = f"""WITH {V.PANEL}, seen AS (
  SELECT date, asset, ret, count(ret) OVER w AS n, var_pop(ret) OVER (PARTITION BY asset) AS v FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)
)
SELECT date, asset, round(0.5::DOUBLE ** (n / 10.0::DOUBLE) * (v + (1 - 0.5::DOUBLE ** 0.1::DOUBLE) * coalesce(sum(ret * ret * 2.0::DOUBLE ** (n / 10.0::DOUBLE)) OVER (PARTITION BY asset ORDER BY date), 0)), 9) AS variance FROM seen"""


@query
def vol_garch(spark, d):
    return G.garch_variance(_panel(spark, d))


@query
def vol_garch_forecast(spark, d):
    """Variances of the twelve weeks after each asset's last one."""
    return _rounded(G.garch_forecast(G.garch_fit(_panel(spark, d)), 12), "variance", digits=5)


@query
def filter_local_level(spark, d):
    return K.local_level(_panel(spark, d), 1.0, 4.0)


@query
def risk_model_fit(spark, d):
    p = _panel(spark, d).withColumn("momentum", W.zscore_pop_clipped(F.col("mom"))).withColumn("carry", W.zscore_pop_clipped(F.col("funding")))
    return K.panel_risk_model(p.where("in_universe"), ["market", "momentum", "carry"])


@query
def backtest_daily(spark, d):
    """A sweep of 32 strategies: the panel's weights up to eight rows late, at four sizes."""
    p = V.panel(spark, d).select("date", "asset", "close", "weight", "funding")
    late = [F.struct(F.lit(n).alias("late"), F.lag("weight", n).over(W.series()).alias("w")) for n in range(1, 9)]
    p = p.withColumn("_v", F.array(*late)).withColumn("_v", F.explode("_v")).withColumn("_size", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0)))))
    p = p.withColumn("strategy", F.format_string("late%d size%.1f", "_v.late", "_size"))
    p = p.withColumn("weight", F.when(F.col("close").isNotNull(), F.col("_v.w") * F.col("_size")))
    return L.backtest(p, "strategy", L.Rules(cash=100_000.0, margin=0.1, fee=0.0005, band=0.02, least=10.0))


def futures_bars(spark, d):
    """Return flags as roots; an item's contract ends in the month of its shipping, or up to six months later."""
    items = V.read(spark, d, "lineitem").withColumn("root", F.col("l_returnflag"))
    expiry = U.third_last_business_day(F.add_months(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int") - 1))
    rows = items.withColumn("date", F.col("l_shipdate").cast("date")).withColumn("expiry", expiry).withColumn("contract", F.date_format("expiry", "yyyy-MM"))
    return rows.groupBy("root", "contract", "expiry", "date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


@query
def futures_front_second(spark, d):
    return U.front_second(U.daily_panel(futures_bars(spark, d)))


@query
def futures_curve(spark, d):
    p = U.daily_panel(futures_bars(spark, d))
    return U.curve(p, U.front_second(p))


@query
def attr_time_series(spark, d):
    p = V.panel(spark, d)
    f = p.groupBy("date").agg(F.avg("ret").alias("market"), F.avg(F.col("ret") * F.signum("mom")).alias("momentum"))
    return I.time_series_attribution(p.select("date", "asset", "ret").join(f, "date"), "ret", ["market", "momentum"], "asset")


@query
def tail_entropy_pool(spark, d):
    s = V.scenarios(spark, d).groupBy("date").agg(F.sum("pnl").alias("pnl"))
    m = s.agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s")).first()
    return I.entropy_pool(s, {"pnl": (m["m"] or 0.0) - 0.25 * (m["s"] or 0.0)})


@query
def book_regime_multipliers(spark, d):
    """Regimes of every asset's own returns."""
    return I.regime_multipliers(V.panel(spark, d), "ret", "asset", refit=42, least=150)


# --- the style risk model ---------------------------------------------------------------------------------------------
STYLE = ("market", "momentum")
HALF, IDIO, LEAST, WEEKS = 26.0, 13.0, 20, 52.0
#: Share of the rows before a date on which an asset needs a return; few have more on the smallest tables.
PRESENT = 0.2


def _style(spark, d):
    """The panel, exposures, the fitted model, and the panel's weights one, two and four rows late as strategies."""
    p = durable(V.panel(spark, d).withColumn("vol", W.rolling(F.stddev_samp, F.col("ret"), 26, 5)))
    expo = durable(R.build_exposures(p, momentum=13, funding=8, liquidity=8))
    late = [F.struct(F.lit(f"late{n}").alias("strategy"), F.lag("weight", n).over(W.series()).alias("weight")) for n in (1, 2, 4)]
    held = p.select("date", "asset", F.array(*late).alias("_v")).select("date", "asset", F.inline("_v")).where("weight is not null")
    return p, expo, R.fit(p, expo, STYLE), held


STYLES_SQL = f"""rp AS (
  SELECT date, asset, in_universe, ret, lead(ret) OVER w AS y, CASE WHEN count(ret) OVER r >= 5 THEN stddev_samp(ret) OVER r END AS vol, ln(close) - ln(lag(close, 13) OVER w) AS m,
    lag(weight, 1) OVER w AS w1, lag(weight, 2) OVER w AS w2, lag(weight, 4) OVER w AS w4
  FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date), r AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)
), ex AS (
  SELECT date, asset, CASE WHEN m IS NOT NULL AND stddev_pop(m) OVER s > 0 THEN greatest(least((m - avg(m) OVER s) / stddev_pop(m) OVER s, 3), -3) ELSE 0 END AS b FROM rp WHERE in_universe WINDOW s AS (PARTITION BY date)
), rr AS (
  SELECT date, asset, b, greatest(least(y, 8 * vol), -8 * vol) AS y, 1 / (vol * vol) AS w FROM rp JOIN ex USING (date, asset) WHERE vol > 0 AND y IS NOT NULL
), ss AS (
  SELECT date, sum(w) AS s0, sum(w * b) AS s1, sum(w * b * b) AS s2, sum(w * y) AS t0, sum(w * b * y) AS t1 FROM rr GROUP BY 1 HAVING count(*) >= 5
), fr AS (
  SELECT date, row_number() OVER (ORDER BY date) AS i, CASE WHEN s0 * s2 - s1 * s1 > 1e-9::DOUBLE * s0 * s2 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS f0,
    CASE WHEN s0 * s2 - s1 * s1 > 1e-9::DOUBLE * s0 * s2 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) ELSE 0 END AS f1
  FROM ss
), wt AS (
  SELECT unnest(['late1', 'late2', 'late4']) AS strategy, date, asset, unnest([w1, w2, w4]) AS weight FROM rp
), held AS (
  SELECT * FROM wt WHERE weight IS NOT NULL
), eps AS (
  SELECT date, i, asset, y - f0 - f1 * b AS e FROM rr JOIN fr USING (date)
), ld AS (
  SELECT strategy, date, sum(weight) AS x0, sum(weight * b) AS x1 FROM held JOIN ex USING (date, asset) GROUP BY 1, 2
)"""

FORECAST_SQL = f"""cv AS (
  SELECT date, i, k ** (i - 1) * sum(c * f0 * f0 / k ** i) OVER p AS v00, k ** (i - 1) * sum(c * f0 * f1 / k ** i) OVER p AS v01, k ** (i - 1) * sum(c * f1 * f1 / k ** i) OVER p AS v11
  FROM (SELECT *, CASE WHEN i = 1 THEN 1 ELSE 1 - k END AS c FROM (SELECT *, 0.5::DOUBLE ** (1 / {HALF}::DOUBLE) AS k FROM fr)) WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ob AS (
  SELECT asset, i, e * e AS x, row_number() OVER (PARTITION BY asset ORDER BY i) AS n, 0.5::DOUBLE ** ((i - lag(i) OVER (PARTITION BY asset ORDER BY i)) / {IDIO}::DOUBLE) AS old FROM eps
), iv AS (
  SELECT asset, i, n, x AS v FROM ob WHERE n = 1
  UNION ALL
  SELECT ob.asset, ob.i, ob.n, (old * v + (1 - k) * x) / (old + 1 - k) FROM iv JOIN ob ON ob.asset = iv.asset AND ob.n = iv.n + 1, (SELECT 0.5::DOUBLE ** (1 / {IDIO}::DOUBLE) AS k)
), hi AS (
  SELECT strategy, asset, date, fr.i AS i, weight FROM held JOIN fr USING (date)
), hv AS (
  SELECT hi.*, CASE WHEN iv.n >= 5 THEN iv.v END AS v FROM hi ASOF LEFT JOIN iv ON hi.asset = iv.asset AND hi.i > iv.i
), own AS (
  SELECT strategy, date, sum(weight * weight * coalesce(v, m, 0)) AS v FROM (SELECT *, median(v) OVER (PARTITION BY strategy, date) AS m FROM hv) GROUP BY 1, 2
), fc AS (
  SELECT strategy, date, x0 * x0 * v00 + 2 * x0 * x1 * v01 + x1 * x1 * v11 AS fv, coalesce(own.v, 0) AS iv
  FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) AS k FROM ld) JOIN cv USING (date) LEFT JOIN own USING (strategy, date) WHERE k > {LEAST} AND v00 IS NOT NULL
), pv AS (
  SELECT strategy, date, sqrt((fv + iv) * {WEEKS}::DOUBLE) AS total, sqrt(fv * {WEEKS}::DOUBLE) AS factor, sqrt(iv * {WEEKS}::DOUBLE) AS idio, iv / nullif(fv + iv, 0) AS idio_share FROM fc
)"""

ZS_SQL = f"""ea AS (
  SELECT strategy, held.date, sum(weight * y) AS r FROM held JOIN rp USING (date, asset) GROUP BY 1, 2
), zs AS (
  SELECT strategy, date, r * sqrt({WEEKS}::DOUBLE) / nullif(total, 0) AS z, CASE WHEN count(r) OVER w >= 26 THEN stddev_samp(r) OVER w * sqrt({WEEKS}::DOUBLE) / nullif(avg(total) OVER w, 0) END AS ratio
  FROM pv JOIN ea USING (strategy, date) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)
)"""

PNL_SQL = """pnl AS (
  SELECT strategy, date, x0 * f0 AS pnl_market, x1 * f1 AS pnl_momentum, e AS pnl_idio, coalesce(x0 * f0, 0) + coalesce(x1 * f1, 0) + coalesce(e, 0) AS pnl_total
  FROM ld JOIN fr USING (date) LEFT JOIN (SELECT strategy, date, sum(weight * e) AS e FROM held JOIN eps USING (date, asset) GROUP BY 1, 2) USING (strategy, date)
)"""


def _rounded(df, *but, digits=8):
    """Doubles rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double" and c not in but})


def _columns(names, digits=8):
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names.split())


def _forecast(spark, d):
    p, expo, model, held = _style(spark, d)
    return p, held, R.predicted_vol(model, expo, held, ["strategy"], HALF, IDIO, WEEKS, LEAST)


@query
def risk_forecast(spark, d):
    return _rounded(_forecast(spark, d)[2])


@query
def risk_bias(spark, d):
    p, held, predicted = _forecast(spark, d)
    z = R.standardised(predicted, R.realised(p, held, ["strategy"]), ["strategy"], 26, WEEKS)
    return _rounded(R.bias_statistic(z, ["strategy"]), digits=6)


@query
def risk_attribution(spark, d):
    _, expo, model, held = _style(spark, d)
    return _rounded(R.attribute(model, expo, held, ["strategy"]))


@query
def risk_attribution_summary(spark, d):
    _, expo, model, held = _style(spark, d)
    return _rounded(R.summarise_attribution(R.attribute(model, expo, held, ["strategy"]), ["strategy"], WEEKS), digits=6)


_STYLE_SQL = f"WITH RECURSIVE {V.PANEL}, {STYLES_SQL}"
ORACLES |= {
    "risk_forecast": f"{_STYLE_SQL}, {FORECAST_SQL} SELECT strategy, date, {_columns('total factor idio idio_share')} FROM pv",
    "risk_bias": f"{_STYLE_SQL}, {FORECAST_SQL}, {ZS_SQL} SELECT strategy, round(stddev_samp(z), 6) AS bias, count(z) AS n, round(avg((abs(z) > 1.96)::INT), 6) AS exceed_95, round(avg(ratio), 6) AS ratio FROM zs GROUP BY 1",
    "risk_attribution": f"{_STYLE_SQL}, {PNL_SQL} SELECT strategy, date, {_columns('pnl_market pnl_momentum pnl_idio pnl_total')} FROM pnl",
    "risk_attribution_summary": f"""{_STYLE_SQL}, {PNL_SQL}, ea AS (
  SELECT strategy, unnest(['market', 'momentum', 'idio', 'total']) AS source, unnest([pnl_market, pnl_momentum, pnl_idio, pnl_total]) AS v FROM pnl
), su AS (
  SELECT strategy, source, sum(v) AS pnl, avg(v) AS m, nullif(stddev_samp(v), 0) AS s, count(v) AS n FROM ea GROUP BY 1, 2
)
SELECT strategy, source, round(pnl, 6) AS pnl, round(pnl / nullif(max(CASE WHEN source = 'total' THEN pnl END) OVER (PARTITION BY strategy), 0), 6) AS share, round(m * {WEEKS}::DOUBLE, 6) AS ann_mean,
  round(s * sqrt({WEEKS}::DOUBLE), 6) AS ann_vol, round(m / s * sqrt(n), 6) AS t_stat, round(m / s * sqrt({WEEKS}::DOUBLE), 6) AS sharpe FROM su""",
}


# --- books at every date ----------------------------------------------------------------------------------------------
def _strategies(spark, d):
    """The dense panel under three strategies, whose weights are one, two and four rows late."""
    p = durable(V.panel(spark, d).select("date", "asset", "ret", "weight", "in_universe"))
    late = [F.struct(F.lit(f"late{n}").alias("strategy"), F.lag("weight", n).over(W.series()).alias("weight")) for n in (1, 2, 4)]
    return p, p.withColumn("_v", F.array(*late)).select("date", "asset", "ret", "in_universe", F.inline("_v"))


def _markets(p):
    """Five markets of assets, by the brand's number."""
    return p.withColumn("market", F.concat(F.lit("m"), F.regexp_extract("asset", "[0-9]+", 0).cast("int") % 5))


@query
def decision_vol_target(spark, d):
    """Risk shares below 30 %, target 10 % a year, half of it while the market is volatile."""
    p, s = _strategies(spark, d)
    m = D.regime_scale(p.withColumn("market", F.lit("all")), "market", 13, 104, 0.8, 0.5, WEEKS).drop("market")
    return _rounded(D.decision_books(s, "vol_target", "strategy", 52, "ewma", 0.1, 1.5, share=0.3, multipliers=m, periods=WEEKS, halflife=13.0, present=PRESENT), digits=7)


@query
def decision_mean_variance(spark, d):
    return _rounded(D.decision_books(_strategies(spark, d)[1], "mv", "strategy", 52, "lw", periods=WEEKS, present=PRESENT), digits=6)


@query
def decision_hierarchical(spark, d):
    return _rounded(D.decision_books(_strategies(spark, d)[1], "hrp", "strategy", 52, "mp", periods=WEEKS, present=PRESENT), digits=6)


@query
def market_vol_state(spark, d):
    return _rounded(D.market_vol_state(_markets(V.panel(spark, d)), "market", 13, 104, 0.8, WEEKS), digits=7)


@query
def neutral_styles(spark, d):
    _, expo, _, held = _style(spark, d)
    return _rounded(D.project_out(held, expo, ["momentum", "liquidity"], ["strategy"]), "weight")


ORACLES |= {
    "market_vol_state": f"""WITH {V.PANEL}, mk AS (
  SELECT 'm' || (regexp_extract(asset, '[0-9]+')::INT % 5) AS market, date, avg(ret) AS r FROM panel GROUP BY 1, 2
), nn AS (
  SELECT *, count(r) OVER (PARTITION BY market ORDER BY date) AS n FROM mk
), kk AS (
  SELECT *, CASE WHEN r IS NOT NULL THEN 2.0::DOUBLE ** (n / 13.0::DOUBLE) END AS u FROM nn
), sm AS (
  SELECT market, date, count(r) OVER b AS n, sum(u) OVER b AS w, sum(u * u) OVER b AS ww, sum(u * r) OVER b AS x, sum(u * r * r) OVER b AS xx FROM kk
  WINDOW b AS (PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), st AS (
  SELECT market, date, CASE WHEN n >= 13 THEN sqrt(greatest((xx / w - (x / w) ** 2) * w * w / (w * w - ww), 0) * {WEEKS}::DOUBLE) END AS state FROM sm
)
SELECT market, date, round(state, 7) AS state, round(CASE WHEN count(state) OVER b >= 52 THEN quantile_cont(state, 0.8) OVER b END, 7) AS threshold FROM st
WINDOW b AS (PARTITION BY market ORDER BY date ROWS BETWEEN 104 PRECEDING AND 1 PRECEDING)""",
}


# --- principal components ---------------------------------------------------------------------------------------------
def _components(spark, d):
    return C.principal_components(C.centred(_windows(spark, d), "cutoff"), "cutoff", 3)


@query
def pca_loadings(spark, d):
    """Loadings of each book's returns, turned to those of the book before."""
    return _rounded(C.aligned(_components(spark, d)[0], "cutoff"), digits=6)


@query
def pca_explained(spark, d):
    return _rounded(C.explained(_components(spark, d)[2], "cutoff"), digits=7)


@query
def pca_probabilistic(spark, d):
    spectrum = _components(spark, d)[2]
    return C.probabilistic(spectrum, "cutoff").select("cutoff", F.round("noise", 9).alias("noise"), F.transform("factor_variance", lambda v: F.round(v, 8)).alias("factor_variance"))
