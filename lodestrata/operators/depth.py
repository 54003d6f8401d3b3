"""Order-book snapshots: depth near the middle from nested levels, and summaries of hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The feed's message: a coin, milliseconds, and levels of bids and asks, best first; numbers are strings.
MESSAGE = "raw struct<data: struct<coin: string, time: bigint, levels: array<array<struct<px: string, sz: string, n: int>>>>>"
#: Distances from the middle, in hundredths of a percent.
BANDS = (10, 25, 50)


def _within(levels: Column, off) -> Column:
    """Sum of the sizes of levels whose price ``off`` accepts."""
    return F.aggregate(F.filter(levels, lambda x: off(x["px"].cast("double"))), F.lit(0.0), lambda s, x: s + x["sz"].cast("double"))


def snapshots(lines: DataFrame, bands: tuple[int, ...] = BANDS, line: str = "value") -> DataFrame:
    """A row for each JSON message: ts, symbol, best prices and sizes, orders there, spread and depth within ``bands``.

    Empty and broken lines, and snapshots that lack a side, a time or a best price, are left out. Levels stay nested arrays,
    so a message is one row throughout.
    """
    m = lines.select(F.from_json(line, MESSAGE).alias("m")).select("m.raw.data.*")
    b, a = F.get("levels", F.lit(0)), F.get("levels", F.lit(1))
    m = m.where((F.size(b) > 0) & (F.size(a) > 0)).select(F.timestamp_millis("time").alias("ts"), F.col("coin").alias("symbol"), b.alias("_b"), a.alias("_a"))
    bid, ask = F.col("_b")[0], F.col("_a")[0]
    m = m.withColumn("bid", bid["px"].cast("double")).withColumn("ask", ask["px"].cast("double")).withColumn("mid", 0.5 * (F.col("bid") + F.col("ask")))
    mid = F.col("mid")
    depth = {}
    for d in bands:
        depth[f"bid_d{d}"] = _within(F.col("_b"), lambda px, d=d: mid - px <= mid * (d * 1e-4))
        depth[f"ask_d{d}"] = _within(F.col("_a"), lambda px, d=d: px - mid <= mid * (d * 1e-4))
    return m.where("ts is not null and mid is not null").select(
        "ts", "symbol", "bid", "ask", "mid", (1e4 * (F.col("ask") - F.col("bid")) / mid).alias("spread_bps"),
        bid["sz"].cast("double").alias("bid_sz0"), ask["sz"].cast("double").alias("ask_sz0"), bid["n"].alias("n_bid0"), ask["n"].alias("n_ask0"), *[c.alias(n) for n, c in depth.items()],
    )


def hours(snaps: DataFrame, bands: tuple[int, ...] = BANDS, hour: str | None = None) -> DataFrame:
    """A row for each symbol and hour: counts, opening and closing values, medians, means, and depth by the time it stood.

    ``hour`` names a column with the hour that a snapshot is filed under (its time may be a little earlier); without it, it is
    the hour of its time. A snapshot stands until the next one of its symbol and hour, the last one until the hour's end;
    ``held_`` columns are means by that time, null if no snapshot stood. Of snapshots of one time the smallest in its values
    opens, the largest closes and stands. A symbol's hour is one group: thousands of snapshots.
    """
    s = snaps.withColumn("_hour", F.date_trunc("hour", hour or "ts"))
    deep = [f"{side}_d{d}" for d in bands for side in ("bid", "ask")]
    row = F.struct("ts", "mid", "bid", "ask", "spread_bps", *deep)
    w = Window.partitionBy("symbol", "_hour").orderBy("ts", "mid", "bid", "ask", "spread_bps", *deep)
    until = F.coalesce(F.lead("ts").over(w), F.col("_hour") + F.expr("interval 1 hour"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    s = s.withColumn("_row", row).withColumn("_stood", F.greatest(micros(until) - micros(F.col("ts")), F.lit(0).cast("long")))
    held = lambda c: F.try_divide(F.sum(F.col(c) * F.col("_stood")), F.sum("_stood")).alias(f"held_{c}")
    median = lambda c: F.percentile(c, F.lit(0.5)).alias(f"med_{c}")
    out = s.groupBy("symbol", F.col("_hour").alias("ts")).agg(
        F.count("*").alias("n_snapshots"), F.min("_row").alias("_open"), F.max("_row").alias("_close"), median("spread_bps"), F.avg("spread_bps").alias("mean_spread_bps"), held("spread_bps"),
        *[median(c) for c in deep], *[held(c) for c in deep],
    )
    first = [F.col("_open")[c].alias(f"open_{c}") for c in ("mid", "bid", "ask", "spread_bps", *deep)]
    rest = [c for c in out.columns if c.startswith(("med_", "mean_", "held_"))]
    return out.select("ts", "symbol", "n_snapshots", F.col("_open")["ts"].alias("first_ts"), *first, F.col("_close")["mid"].alias("close_mid"), *rest)
