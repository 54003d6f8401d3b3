"""Registries and capitalisation snapshots: dedup, changes, splices, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_canonicals(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of a canonical id keeps it; the others become ``<id>-<symbol>``."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", k).withColumn("canonical_id", F.when(F.col("_k") == 1, F.col("canonical_id")).otherwise(F.concat_ws("-", "canonical_id", "symbol"))).drop("_k")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change``: listed (only in the new), delisted (only in the old)."""
    return new.join(old, key, "left_anti").select(key, F.lit("listed").alias("change")).unionByName(old.join(new, key, "left_anti").select(key, F.lit("delisted").alias("change")))


def splice(snapshot: DataFrame, extension: DataFrame, date: str) -> DataFrame:
    """The snapshot through its last date, then the extension strictly after it; ``src`` says which."""
    last = snapshot.agg(F.max(date)).first()[0]
    later = extension.where(F.col(date) > F.lit(last)) if last is not None else extension
    return snapshot.withColumn("src", F.lit("snapshot")).unionByName(later.withColumn("src", F.lit("extension")), allowMissingColumns=True)


def overlap_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two sources overlap: rows, median ratio and interquartile range of the log ratio, by ticker."""
    j = a.join(b.withColumnRenamed("cap", "_other"), ["ticker", "date"]).withColumn("lr", F.ln(F.try_divide("cap", "_other")))
    q = F.percentile("lr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return j.groupBy("ticker").agg(F.count("*").alias("n"), q.alias("q")).select("ticker", "n", F.exp(F.col("q")[1]).alias("ratio"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def pegged(prices: DataFrame, band: float = 0.03, share: float = 0.9) -> DataFrame:
    """Tickers whose price is within ``band`` of 1 on ``share`` of their rows or more; a missing price isn't."""
    near = F.coalesce(F.abs(F.col("price") - 1) <= band, F.lit(False)).cast("double")
    return prices.groupBy("ticker").agg(F.avg(near).alias("near")).where(F.col("near") >= share).select("ticker")


def largest_id(rows: DataFrame) -> DataFrame:
    """Of the ids that share a ticker the one with the largest cap; ``by_rule`` where there was a choice."""
    w = Window.partitionBy("ticker")
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(F.desc("cap"), "id"))).withColumn("by_rule", F.count("*").over(w) > 1)
    return r.where("_k = 1").select("ticker", "id", "by_rule")


def canonical(symbol, style: str):
    """(canonical id, multiplier) of a venue's symbol, as Columns."""
    if style == "quote_suffix":  # 1000XXXUSDT, 1MXXXUSDT, XXXUSDT
        base = F.regexp_replace(symbol, "USDT$", "")
        mult = F.when(base.startswith("1000000"), 1000000).when(base.startswith("1M"), 1000000).when(base.startswith("1000"), 1000).otherwise(1)
        return F.regexp_replace(base, "^(1000000|1M|1000)", ""), mult
    kilo = symbol.rlike("^k[A-Z0-9]*[A-Z][A-Z0-9]*$")  # kXXX
    return F.when(kilo, F.substring(symbol, 2, 100)).otherwise(F.upper(symbol)), F.when(kilo, 1000).otherwise(1)
