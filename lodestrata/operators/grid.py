"""Grids, as-of joins, range joins and islands: the relational helpers that panels need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .scan import stretches


def densify(panel: DataFrame, step: str = "interval 7 days", key: str = "asset", date: str = "date") -> DataFrame:
    """Every key on every date from the first to the last of the table; missing rows are null.

    The calendar's ends come from one row a key; each key then makes its own dates, so nothing is multiplied but the grid.
    """
    ends = panel.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    whole = Window.partitionBy()
    ends = ends.select(key, F.min("_lo").over(whole).alias("_lo"), F.max("_hi").over(whole).alias("_hi"))
    grid = ends.select(key, F.explode(F.expr(f"sequence(_lo, _hi, {step})")).alias(date))
    return grid.join(panel, [key, date], "left")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], within: Column | None = None) -> DataFrame:
    """Each left row with the last right row at or before it, by key: union, then the last value seen.

    ``within`` is a condition on ``_at`` (the right row's time) that the match must meet.
    """
    rows = left.select(*by, on, F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("struct<_at:timestamp>").alias("_x"))
    hit = F.struct(F.col(on).alias("_at"), *[F.col(v) for v in values])
    seen = right.select(*by, on, F.lit(0).alias("_left"), hit.alias("_m"))
    both = rows.drop("_x").withColumn("_m", F.lit(None).cast(seen.schema["_m"].dataType)).unionByName(seen.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    w = Window.partitionBy(*by).orderBy(on, "_left").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_left = 1")
    out = out.select("_row.*", *[F.col("_m")[v].alias(v) for v in values], F.col("_m")["_at"].alias("_at"))
    if within is not None:
        out = out.select(*left.columns, *[F.when(within, F.col(v)).alias(v) for v in values], F.when(within, F.col("_at")).alias("_at"))
    return out


def range_join(events: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Events inside [lo, hi) of numeric ranges: an equi-join on buckets of ``width``, then the condition."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return events.withColumn("_b", F.floor(F.col(at) / width)).join(spread, "_b").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


def range_counts(events: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """``ranges`` with ``n``, the number of events in [lo, hi), as ``range_join`` finds them, without a row for each of them.

    Events before a bound are counted once a bound by prefix sums over sorted stretches; a range's count is the difference
    of two, so the work grows with events plus ranges however many events a range holds. 0 for null bounds and lo >= hi.
    """
    points = events.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("_x")).agg(F.count("*").alias("_n"))
    ends = ranges.select(F.explode(F.array(lo, hi)).alias("_x")).where("_x is not null").distinct()
    both = points.withColumn("_event", F.lit(1)).unionByName(ends.select("_x", F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_event")))
    rows = stretches(both, [], ["_x", "_event"])  # a bound comes before the events at it
    held = rows.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for a stretch
    held = held.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_c", F.sum("_n").over(within)).where("_event = 0").join(F.broadcast(held), "_part").select("_x", (F.col("_c") + F.col("_base")).alias("_c"))
    seen = durable(seen)
    low, high = (seen.select(F.col("_x").alias(f"_{e}"), F.col("_c").alias(f"_c{e}")) for e in ("lo", "hi"))
    out = ranges.join(low, F.col(lo) == F.col("_lo"), "left").join(high, F.col(hi) == F.col("_hi"), "left")
    n = F.greatest(F.coalesce(F.col("_chi") - F.col("_clo"), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*ranges.columns, n.alias("n"))


def islands(rows: DataFrame, new: Column, keys: list[str], order: str) -> DataFrame:
    """``island``: number of starts (``new`` true) so far, within the keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(new.cast("long")).over(w))
