"""The input tables as panels, ticks, registries and scenarios, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators.grid import densify

#: Grid rows of the panel's parameters: momentum, liquidity window and least, members.
MOM, LIQ, LIQ_LEAST, MEMBERS = 13, 8, 4, 15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars of part brands: open is the median unit price, close the volume-weighted one."""
    items = read(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    u = F.col("l_extendedprice") / F.col("l_quantity")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("date", F.date_trunc("week", "l_shipdate").cast("date")).withColumn("u", u)
    return rows.groupBy("date", "asset").agg(
        F.percentile("u", F.lit(0.5)).alias("open"),
        F.max("u").alias("high"),
        F.min("u").alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.avg((F.col("l_discount") - 0.05) * 0.01).alias("funding"),
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Dense weekly panel with returns, a momentum weight, and a lagged liquidity universe."""
    g = densify(bars(spark, d))
    g = g.withColumn("ret", W.pct_change(F.col("close"))).withColumn("mom", W.momentum(F.col("close"), MOM)).withColumn("dv", F.col("volume") * F.col("close"))
    g = g.withColumn("mdv", W.rolling_median(F.col("dv"), LIQ, LIQ_LEAST)).withColumn("weight", W.clip(W.zscore_sample(F.col("mom")), -3.0, 3.0) * 0.05)
    g = g.withColumn("rk", F.row_number().over(Window.partitionBy("date").orderBy(F.col("mdv").desc_nulls_last(), "asset")))
    s = W.series()
    member = (F.lag("rk").over(s) <= MEMBERS) & F.lag("mdv").over(s).isNotNull()
    return g.select("date", "asset", "open", "high", "low", "close", "volume", "dv", "ret", "funding", "mom", "weight", F.coalesce(member, F.lit(False)).alias("in_universe"))


def caps(spark: SparkSession, d: str) -> DataFrame:
    """Weekly value of orders by nation: a capitalisation per ticker."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("n_name").alias("ticker")).agg(F.sum("o_totalprice").alias("cap"), F.avg("o_totalprice").alias("price"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


def scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Weekly profit of regions: (scenario date, component, pnl) as differences of order value."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    w = o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("n_regionkey").cast("long").alias("component")).agg(F.sum("o_totalprice").alias("v"))
    step = F.col("v") - F.lag("v").over(Window.partitionBy("component").orderBy("date"))
    return w.withColumn("pnl", step).where("pnl is not null").select("date", "component", "pnl")


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """A probability (length of the document on 0..1) and an outcome (toxic)."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").where("toxic is not null")
    return j.select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 3000.0)).alias("prob"), F.col("toxic").cast("double").alias("outcome"))


BARS = """bars AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS date, p_brand AS asset, quantile_cont(u, 0.5) AS open, max(u) AS high, min(u) AS low,
    sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, avg((l_discount - 0.05::DOUBLE) * 0.01::DOUBLE) AS funding
  FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

PANEL = (
    BARS
    + f""", dates AS (
  SELECT unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars), INTERVAL 7 DAY))::DATE AS date
), g AS (
  SELECT d.date, a.asset, open, high, low, close, volume, funding FROM dates d CROSS JOIN (SELECT DISTINCT asset FROM bars) a
  LEFT JOIN bars b ON b.date = d.date AND b.asset = a.asset
), m AS (
  SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(close) OVER w / nullif(lag(close, {MOM}) OVER w, 0) - 1 AS mom, volume * close AS dv
  FROM g WINDOW w AS (PARTITION BY asset ORDER BY date)
), z AS (
  SELECT *, CASE WHEN stddev_samp(mom) OVER s > 0 THEN (mom - avg(mom) OVER s) / stddev_samp(mom) OVER s WHEN mom IS NOT NULL THEN 0 END AS zm,
    CASE WHEN count(dv) OVER r >= {LIQ_LEAST} THEN quantile_cont(dv, 0.5) OVER r END AS mdv
  FROM m WINDOW s AS (PARTITION BY date), r AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {LIQ - 1} PRECEDING AND CURRENT ROW)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY mdv DESC NULLS LAST, asset) AS rk FROM z
), panel AS (
  SELECT date, asset, open, high, low, close, volume, dv, ret, funding, mom,
    CASE WHEN zm IS NOT NULL THEN greatest(least(zm, 3.0), -3.0) * 0.05::DOUBLE END AS weight,
    coalesce(lag(rk) OVER w <= {MEMBERS} AND lag(mdv) OVER w IS NOT NULL, false) AS in_universe
  FROM k WINDOW w AS (PARTITION BY asset ORDER BY date))"""
)

CAPS = """caps AS (
  SELECT date_trunc('week', o_orderdate)::DATE AS date, n_name AS ticker, sum(o_totalprice) AS cap, avg(o_totalprice) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""

SCENARIOS = """scenarios AS (
  SELECT * FROM (
    SELECT date, component, v - lag(v) OVER (PARTITION BY component ORDER BY date) AS pnl FROM (
      SELECT date_trunc('week', o_orderdate)::DATE AS date, n_regionkey::BIGINT AS component, sum(o_totalprice) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2))
  WHERE pnl IS NOT NULL)"""

FORECASTS = """forecasts AS (
  SELECT doc_id, n_chars / (n_chars + 3000.0::DOUBLE) AS prob, toxic::DOUBLE AS outcome FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)"""
