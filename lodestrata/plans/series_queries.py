"""Queries of state-space filters, resampled intervals, contract identity and inventories, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import depth as D
from ..operators import evaluation as E
from ..operators import state_space as S
from ..sources import contracts as C
from ..sources import inventory as N
from . import views as V
from .catalogue import rnd

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- state space ------------------------------------------------------------------------------------------------------
#: Variances of level, slope and close of a local linear trend of the logarithm of closes, and of its prior.
LEVEL, SLOPE, NOISE, WIDE = 1e-4, 1e-6, 4e-3, 100.0

TREND = f"""WITH RECURSIVE {V.PANEL}, y AS (
  SELECT asset, date, ln(close) AS y, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM panel
), p AS (
  SELECT asset, 0::BIGINT AS i, 0::DOUBLE AS a1, 0::DOUBLE AS a2, {WIDE}::DOUBLE AS p11, 0::DOUBLE AS p12, {WIDE}::DOUBLE AS p22, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS u11, 0::DOUBLE AS u22 FROM y WHERE i = 1
  UNION ALL
  SELECT asset, i, x1 + x2, x2, u11 + 2 * u12 + u22 + {LEVEL}::DOUBLE, u12 + u22, u22 + {SLOPE}::DOUBLE, x1, x2, u11, u22 FROM (
    SELECT asset, i, a1 + k1 * v AS x1, a2 + k2 * v AS x2, (1 - k1) * p11 AS u11, (1 - k1) * p12 AS u12, p22 - k2 * p12 AS u22 FROM (
      SELECT y.asset, y.i, a1, a2, p11, p12, p22, coalesce(y - a1, 0) AS v, CASE WHEN y IS NULL THEN 0 ELSE p11 / (p11 + {NOISE}::DOUBLE) END AS k1, CASE WHEN y IS NULL THEN 0 ELSE p12 / (p11 + {NOISE}::DOUBLE) END AS k2
      FROM p JOIN y ON y.asset = p.asset AND y.i = p.i + 1)))
SELECT y.asset, date, round(x1, 6) AS level, round(x2, 6) AS slope, round(u11, 6) AS level_var, round(u22, 7) AS slope_var FROM p JOIN y USING (asset, i)"""


def _closes(spark, d):
    return V.panel(spark, d).select("asset", "date", F.ln("close").alias("y"), F.ln("open").alias("y_open"))


@query(TREND)
def kalman_trend(spark, d):
    """Level and slope of each asset's closes; weeks without a bar widen both."""
    m = S.Model([[1, 1], [0, 1]], [[1, 0]], [[LEVEL, 0], [0, SLOPE]], [[NOISE]], [0, 0], [[WIDE, 0], [0, WIDE]])
    s = S.kalman_filter(_closes(spark, d), ["asset"], ["date"], ["y"], m)
    at = lambda c, i, n: F.round(F.col(c)[i], n)
    return s.select("asset", "date", at("state", 0, 6).alias("level"), at("state", 1, 6).alias("slope"), at("state_cov", 0, 6).alias("level_var"), at("state_cov", 3, 7).alias("slope_var"))


# --- resampling -------------------------------------------------------------------------------------------------------
BLOCK, DRAWS, TRIALS = 13, 200, 40


@query(f"""WITH {V.PANEL}, x AS (
  SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, ret, count(*) OVER (PARTITION BY asset) AS n FROM panel WHERE ret IS NOT NULL
), s AS (
  SELECT asset, n, draw, j, ('0x' || substr(md5('0:' || draw || ':' || j), 1, 12))::BIGINT % n AS start
  FROM (SELECT DISTINCT asset, n, unnest(range(n // {BLOCK} + 1)) AS j FROM x) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)
), e AS (
  SELECT s.asset, draw, avg(ret) / stddev_samp(ret) * sqrt(52) AS sr FROM (SELECT *, unnest(range({BLOCK})) AS o FROM s) s JOIN x ON x.asset = s.asset AND x.i = (start + o) % s.n
  WHERE j * {BLOCK} + o < s.n GROUP BY 1, 2
), t AS (
  SELECT asset, quantile_cont(sr, [0.05, 0.95]) AS q FROM e GROUP BY 1
)
SELECT asset, count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(52), 6) AS sharpe, round(any_value(q[1]), 6) AS low, round(any_value(q[2]), 6) AS high FROM x JOIN t USING (asset) GROUP BY 1""")
def bt_bootstrap(spark, d):
    """90 % intervals of assets' Sharpe ratios from blocks of a quarter."""
    return rnd(B.sharpe_intervals(V.panel(spark, d), "ret", ["asset"], block=BLOCK, draws=DRAWS, confidence=0.9, periods=52.0), "sharpe", "low", "high")


@query(f"""WITH {V.PANEL}, c AS (
  SELECT asset, ret, avg(ret) OVER (PARTITION BY asset) AS m FROM panel WHERE ret IS NOT NULL
), t AS (
  SELECT asset, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg((ret - m) ** 3) / avg((ret - m) ** 2) ** 1.5 AS skew, avg((ret - m) ** 4) / avg((ret - m) ** 2) ** 2 - 3 AS excess FROM c GROUP BY 1
)
SELECT asset, n, round(sr, 6) AS sr, round(sqrt(greatest((1 + sr * sr / 2 - skew * sr + excess / 4 * sr * sr) / n, 0)), 6) AS se,
  round(stddev_samp(sr) OVER () * {(1 - B.EULER) * B.NormalDist().inv_cdf(1 - 1 / TRIALS) + B.EULER * B.NormalDist().inv_cdf(1 - 1 / (TRIALS * math.e))!r}::DOUBLE, 6) AS sr0 FROM t""")
def bt_deflated(spark, d):
    return rnd(B.deflated_sharpe(V.panel(spark, d), "ret", ["asset"], TRIALS).drop("psr", "dsr"), "sr", "se", "sr0")


PATHS = V.SCENARIOS + """, h AS (SELECT pnl, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM scenarios WHERE component = 1),
st AS (SELECT p, b, ('0x' || substr(md5('0:' || p || ':' || b), 1, 8))::BIGINT % (SELECT max(n) FROM h) AS start FROM range(0, 200) a(p), range(0, 4) c(b)),
pt AS (SELECT p AS path, b * 13 + o AS step, pnl FROM (SELECT *, unnest(range(13)) AS o FROM st) s JOIN h ON h.i = (start + o) % h.n)"""


def _paths(spark, d):
    h = V.scenarios(spark, d).where("component = 1").select("pnl", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))  # a row a week
    n = h.count()
    return h, E.block_paths(h, E.hashed_starts(spark, 200, 4, n), 13, 52)


@query("WITH " + PATHS + """, x AS (SELECT path, step, pnl, sum(pnl) OVER (PARTITION BY path ORDER BY step) AS cum FROM pt), y AS (SELECT *, cum - max(cum) OVER (PARTITION BY path ORDER BY step) AS dd FROM x),
z AS (SELECT path, sum(pnl) AS total, min(dd) AS max_drawdown, min(pnl) AS worst FROM y GROUP BY 1), l AS (UNPIVOT z ON total, max_drawdown, worst INTO NAME statistic VALUE v)
SELECT statistic, round(quantile_cont(v, 0.05), 2) AS p5, round(quantile_cont(v, 0.25), 2) AS p25, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.75), 2) AS p75, round(quantile_cont(v, 0.95), 2) AS p95, round(avg(v), 2) AS mean,
  CASE WHEN statistic = 'total' THEN round(avg(CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) END AS p_loss FROM l GROUP BY 1""")
def sim_summary(spark, d):
    out = B.summarise_paths(E.path_statistics(_paths(spark, d)[1]), ["total", "max_drawdown", "worst"])
    return rnd(rnd(out, "p5", "p25", "p50", "p75", "p95", "mean", digits=2), "p_loss")


def _moments(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS sample, count(*) AS n, round(avg(pnl), 3) AS mean, round(stddev_samp(pnl), 3) AS vol, round(avg((pnl - m) ** 3) / avg((pnl - m) ** 2) ** 1.5, 6) AS skew, round(avg((pnl - m) ** 4) / avg((pnl - m) ** 2) ** 2, 6) AS kurtosis
FROM (SELECT pnl, avg(pnl) OVER () AS m FROM {table})"""


@query("WITH " + PATHS + "\n" + _moments("history", "h") + "\nUNION ALL\n" + _moments("simulated", "pt"))
def sim_moments(spark, d):
    h, p = _paths(spark, d)
    return rnd(rnd(B.moments(h, "pnl", "history").unionByName(B.moments(p, "pnl", "simulated")), "mean", "vol", digits=3), "skew", "kurtosis")


# --- contracts --------------------------------------------------------------------------------------------------------
BARS = """b AS (
  SELECT o_orderdate AS ts, o_totalprice AS close, o_orderkey AS k, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 60 END AS instrument_id,
    CASE o_custkey % 60 % 3 WHEN 0 THEN 'HG' WHEN 1 THEN 'GC' ELSE 'SI' END || substr('FGHJKMNQUVXZ', (o_custkey % 12 + 1)::INT, 1) || o_custkey % 10 || CASE WHEN o_custkey % 15 = 4 THEN '-HGZ' || o_custkey % 10 ELSE '' END || CASE WHEN o_custkey % 60 = 59 THEN ' C45' ELSE '' END AS symbol
  FROM orders WHERE o_custkey % 2 = 1 OR o_orderdate < DATE '1996-03-01' OR o_orderdate >= DATE '2000-01-01'
), g AS (
  SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 1095 DAY, false) AS new FROM b WHERE NOT regexp_matches(symbol, '[: ]') WINDOW w AS (PARTITION BY symbol, instrument_id ORDER BY ts, k)
), i AS (
  SELECT *, coalesce(sum(new::BIGINT) OVER (PARTITION BY symbol, instrument_id ORDER BY ts, k), 0)::BIGINT AS life FROM g
), v AS (
  SELECT symbol, instrument_id, life, min(ts) AS first, max(ts) AS last, count(*) AS n_bars FROM i GROUP BY 1, 2, 3
), legs AS (
  SELECT *, unnest(string_split(symbol, '-')) AS leg, generate_subscripts(string_split(symbol, '-'), 1) AS place FROM v
), years AS (
  SELECT *, list_filter([c - 10, c, c + 10], lambda y: make_date(y, month, 1) >= first::DATE - 31)[1] AS year FROM (
    SELECT *, year(first) - year(first) % 10 + leg[4:4]::BIGINT AS c, strpos('FGHJKMNQUVXZ', leg[3:3]) AS month FROM legs)
), named AS (
  SELECT symbol, instrument_id, life, first, last, n_bars, string_agg(leg[1:3] || year, '-' ORDER BY place) AS asset FROM years GROUP BY ALL
)"""


def _contracts(spark, d):
    """Orders as bars of contracts with one-digit symbols; half of them are silent for years, some have no instrument id."""
    o, k = V.read(spark, d, "orders"), F.col("o_custkey")
    symbol = F.concat(
        F.when(k % 60 % 3 == 0, "HG").when(k % 60 % 3 == 1, "GC").otherwise("SI"), F.substring(F.lit(C.MONTHS), (k % 12 + 1).cast("int"), F.lit(1)), (k % 10).cast("string"),
        F.when(k % 15 == 4, F.concat(F.lit("-HGZ"), (k % 10).cast("string"))).otherwise(""), F.when(k % 60 == 59, " C45").otherwise(""),
    )
    o = o.where((k % 2 == 1) | (F.col("o_orderdate") < "1996-03-01") | (F.col("o_orderdate") >= "2000-01-01"))
    return o.select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("k"), F.when(k % 9 != 0, k % 60).alias("instrument_id"), symbol.alias("symbol"))


@query(f"WITH {BARS} SELECT symbol, instrument_id, life, first::TIMESTAMP AS first, last::TIMESTAMP AS last, asset, n_bars FROM named")
def contract_lives(spark, d):
    out = C.lives(_contracts(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query(f"WITH {BARS} SELECT asset, year(ts) AS year, count(*) AS n, round(sum(close), 2) AS close FROM i JOIN named n ON i.symbol = n.symbol AND i.instrument_id IS NOT DISTINCT FROM n.instrument_id AND i.life = n.life GROUP BY 1, 2")
def contract_bars(spark, d):
    b = _contracts(spark, d)
    return rnd(C.identified(b, C.lives(b)).groupBy("asset", F.year("ts").alias("year")).agg(F.count("*").alias("n"), F.sum("close").alias("close")), "close", digits=2)


DEFINED = """f AS (
  SELECT instrument_id, ts - INTERVAL 5 DAY AS ts_event, max((k % 100) / 100.0::DOUBLE) AS min_price_increment FROM b WHERE k % 13 = 0 AND instrument_id IS NOT NULL GROUP BY 1, 2
)"""


@query(f"""WITH {BARS}, {DEFINED}
SELECT k, CASE WHEN n.ts - f.ts_event <= INTERVAL 1095 DAY THEN min_price_increment END AS min_price_increment FROM (SELECT * FROM b WHERE instrument_id IS NOT NULL) n ASOF LEFT JOIN f ON n.instrument_id = f.instrument_id AND n.ts >= f.ts_event
UNION ALL SELECT k, NULL FROM b WHERE instrument_id IS NULL""")
def contract_definitions(spark, d):
    b = _contracts(spark, d)
    f = b.where("k % 13 = 0").select("instrument_id", F.expr("ts - interval 5 days").alias("ts_event"), ((F.col("k") % 100) / 100.0).alias("min_price_increment"))
    return C.defined(b, f, ["min_price_increment"]).select("k", "min_price_increment")


@query(f"""WITH r AS (
  SELECT 'S' || l_suppkey % 7 AS symbol, l_suppkey % 7 AS instrument_id, l_linenumber::BIGINT + 2 * (l_partkey % 4) AS stat_type, l_extendedprice AS price, l_quantity AS quantity, l_shipdate + to_hours((l_orderkey % 20)::INT) AS ts_event,
    CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate END AS ts_ref FROM lineitem
)
SELECT coalesce(ts_ref, ts_event)::DATE AS ts, symbol, instrument_id, {", ".join(f"arg_max({'quantity' if n in C.QUANTITIES else 'price'}, (ts_event, {'quantity' if n in C.QUANTITIES else 'price'})) FILTER (stat_type = {c}) AS {n}" for c, n in C.STATISTICS.items())}
FROM r WHERE stat_type IN ({", ".join(map(str, C.STATISTICS))}) GROUP BY 1, 2, 3""")
def contract_statistics(spark, d):
    x = V.read(spark, d, "lineitem")
    r = x.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("symbol"), (F.col("l_suppkey") % 7).alias("instrument_id"), (F.col("l_linenumber") + 2 * (F.col("l_partkey") % 4)).alias("stat_type"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 20 as int))").alias("ts_event"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_shipdate")).alias("ts_ref"),
    )
    return C.daily_statistics(r)


# --- inventories ------------------------------------------------------------------------------------------------------
FILES = """k AS (
  SELECT doc_id AS i, CASE WHEN doc_id % 4 = 0 THEN 'external/' ELSE 'raw/' END || coalesce(source, 'none') || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.csv' ELSE '.parquet' END AS key, sha256(coalesce(text, '')) AS h, length(coalesce(text, '')) AS size FROM documents
), a AS (
  SELECT i, key, size, h AS sha256 FROM k WHERE i % 13 <> 0
), l AS (
  SELECT i, key, size + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS size, i % 17 AS modified, CASE WHEN i % 5 = 0 THEN md5(h) ELSE h END AS sha256 FROM k WHERE i % 6 <> 0
), r AS (
  SELECT i, key, size + CASE WHEN i % 10 = 0 THEN 1 ELSE 0 END AS size, i % 19 AS modified, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN md5(h || 'r') WHEN i % 10 = 0 THEN md5(h) ELSE h END AS sha256 FROM k WHERE i % 8 <> 0
)"""


def _inventories(spark, d):
    """Documents as files of two sides and of what they had in common."""
    doc, i = V.read(spark, d, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    layer, end = F.when(i % 4 == 0, "external/").otherwise("raw/"), F.when(i % 3 == 0, ".csv").otherwise(".parquet")
    k = doc.select(i.alias("i"), F.concat(layer, F.coalesce("source", F.lit("none")), F.lit("/"), i.cast("string"), end).alias("key"), F.sha2(text, 256).alias("h"), F.length(text).cast("long").alias("size"))
    i, size, h = F.col("i"), F.col("size"), F.col("h")
    plus = lambda c: size + F.when(c, 1).otherwise(0)
    agreed = k.where("i % 13 <> 0").select("key", "size", F.lit(0).cast("long").alias("modified"), h.alias("sha256"))
    local = k.where("i % 6 <> 0").select("key", plus(i % 5 == 0).alias("size"), (i % 17).alias("modified"), F.when(i % 5 == 0, F.md5("h")).otherwise(h).alias("sha256"))
    there = F.when(i % 11 == 0, None).when(i % 7 == 0, F.md5(F.concat("h", F.lit("r")))).when(i % 10 == 0, F.md5("h")).otherwise(h)
    return local, k.where("i % 8 <> 0").select("key", plus(i % 10 == 0).alias("size"), (i % 19).alias("modified"), there.alias("sha256")), agreed


@query(f"""WITH {FILES} SELECT * FROM (SELECT key, l.size, CASE WHEN r.key IS NULL THEN 'missing' WHEN l.size <> r.size THEN 'size' WHEN r.sha256 IS NULL OR l.sha256 <> r.sha256 THEN 'content' END AS reason FROM l LEFT JOIN r USING (key)) WHERE reason IS NOT NULL""")
def inventory_push(spark, d):
    local, remote, _ = _inventories(spark, d)
    return N.push_plan(local, remote)


@query(f"""WITH {FILES} SELECT * FROM (SELECT key, r.size, CASE WHEN l.key IS NULL THEN 'download' WHEN l.size = r.size AND (r.sha256 IS NULL OR l.sha256 = r.sha256) THEN NULL WHEN l.modified <= r.modified THEN 'download'
  WHEN key LIKE 'raw/%.parquet' THEN 'merge' ELSE 'keep' END AS action FROM r LEFT JOIN l USING (key)) WHERE action IS NOT NULL""")
def inventory_pull(spark, d):
    local, remote, _ = _inventories(spark, d)
    return N.pull_plan(local, remote, merge=True)


@query(f"""WITH {FILES}, j AS (
  SELECT key, l.key AS lk, r.key AS rk, a.key AS ak, l.size AS ls, r.size AS rs, a.size AS z, l.sha256 AS lh, r.sha256 AS rh, a.sha256 AS ah FROM (SELECT key FROM k) LEFT JOIN l USING (key) LEFT JOIN r USING (key) LEFT JOIN a USING (key)
), c AS (
  SELECT *, CASE WHEN lk IS NULL OR ak IS NULL THEN (lk IS NULL) <> (ak IS NULL) ELSE coalesce(lh <> ah, ls <> z) END AS mine, CASE WHEN rk IS NULL OR ak IS NULL THEN (rk IS NULL) <> (ak IS NULL) ELSE coalesce(rh <> ah, rs <> z) END AS theirs,
    CASE WHEN lk IS NULL OR rk IS NULL THEN (lk IS NULL) <> (rk IS NULL) ELSE coalesce(lh <> rh, ls <> rs) END AS apart FROM j
), o AS (
  SELECT key, CASE WHEN NOT mine AND NOT theirs THEN NULL WHEN lk IS NULL AND rk IS NULL THEN 'forget' WHEN mine AND NOT theirs AND lk IS NULL THEN 'delete_remote' WHEN mine AND NOT theirs THEN 'push'
    WHEN NOT mine AND rk IS NULL THEN 'delete_local' WHEN NOT mine THEN 'pull' WHEN NOT apart THEN 'agree' WHEN lk IS NOT NULL AND rk IS NOT NULL AND key LIKE 'raw/%.parquet' THEN 'merge' ELSE 'conflict' END AS action FROM c
)
SELECT * FROM o WHERE action IS NOT NULL""")
def inventory_sync(spark, d):
    return N.sync_plan(*_inventories(spark, d))


# --- order books ------------------------------------------------------------------------------------------------------
def _hours() -> str:
    deep = [f"{s}_d{d}" for d in D.BANDS for s in ("bid", "ask")]
    near = ", ".join(f"list_sum([0.0::DOUBLE] || [x.sz for x in {s}s if {'mid - x.px' if s == 'bid' else 'x.px - mid'} <= mid * ({d} * 1e-4::DOUBLE)]) AS {s}_d{d}" for d in D.BANDS for s in ("bid", "ask"))
    values = ("mid", "bid", "ask", "spread_bps", *deep)
    row = "(" + ", ".join(("ts", *values)) + ")"
    first = ", ".join(f"round(arg_min({c}, {row}), 9) AS open_{c}" for c in values)
    median = ", ".join(f"round(quantile_cont({c}, 0.5), 9) AS med_{c}" for c in ("spread_bps", *deep))
    held = ", ".join(f"round(sum({c} * stood) / nullif(sum(stood), 0), 9) AS held_{c}" for c in ("spread_bps", *deep))
    return f"""WITH e AS (
  SELECT event_type AS symbol, date_trunc('millisecond', ts) AS ts, 100.0::DOUBLE + value AS m, user_id % 7 + 1 AS w, event_id % 5 + 1 AS z FROM events
), l AS (
  SELECT symbol, ts, [{{'px': m * (1 - k * w * 2e-4::DOUBLE), 'sz': k * z + 0.5::DOUBLE}} for k in range(1, 6)] AS bids, [{{'px': m * (1 + k * w * 3e-4::DOUBLE), 'sz': k * z + 0.25::DOUBLE}} for k in range(1, 6)] AS asks FROM e
), s AS (SELECT *, 0.5::DOUBLE * (bids[1].px + asks[1].px) AS mid, bids[1].px AS bid, asks[1].px AS ask, 1e4::DOUBLE * (asks[1].px - bids[1].px) / (0.5::DOUBLE * (bids[1].px + asks[1].px)) AS spread_bps FROM l
), t AS (SELECT symbol, ts, mid, bid, ask, spread_bps, date_trunc('hour', ts) AS hour, {near} FROM s
), u AS (SELECT *, epoch_us(coalesce(lead(ts) OVER (PARTITION BY symbol, hour ORDER BY ts, {", ".join(values)}), hour + INTERVAL 1 HOUR)) - epoch_us(ts) AS stood FROM t)
SELECT hour::TIMESTAMP AS ts, symbol, count(*) AS n_snapshots, min(ts)::TIMESTAMP AS first_ts, {first}, round(arg_max(mid, {row}), 9) AS close_mid, {median}, round(avg(spread_bps), 9) AS mean_spread_bps, {held} FROM u GROUP BY 1, 2"""


@query(_hours())
def book_hours(spark, d):
    """Events as messages of a book, through their JSON, and the hours of each symbol."""
    e = V.ticks(spark, d)
    m, w, z = F.lit(100.0) + F.col("value"), F.col("user_id") % 7 + 1, F.col("event_id") % 5 + 1
    ks = F.sequence(F.lit(1), F.lit(5))
    level = lambda px, sz: F.struct(px.cast("string").alias("px"), sz.cast("string").alias("sz"), F.lit(1).alias("n"))
    bids = F.transform(ks, lambda k: level(m * (1 - k * w * 2e-4), k * z + 0.5))
    asks = F.transform(ks, lambda k: level(m * (1 + k * w * 3e-4), k * z + 0.25))
    data = F.struct(F.col("event_type").alias("coin"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.array(bids, asks).alias("levels"))
    h = D.hours(D.snapshots(e.select(F.to_json(F.struct(F.struct(data.alias("data")).alias("raw"))).alias("value"))))
    h = h.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "first_ts")})
    return rnd(h, *[c for c in h.columns if c not in ("ts", "first_ts", "symbol", "n_snapshots")], digits=9)
