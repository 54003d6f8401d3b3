"""Gaps, sanity of bars, health, and comparison of venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def find_gaps(rows: DataFrame, step: str, key: str = "asset", ts: str = "ts") -> DataFrame:
    """``key, gap_start, gap_end, n_missing``: runs of grid slots between a key's first and last row that hold none."""
    seen = rows.select(key, ts).distinct()
    ends = seen.groupBy(key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    slots = ends.select(key, F.posexplode(F.expr(f"sequence(lo, hi, {step})")).alias("i", ts))
    missing = slots.join(seen, [key, ts], "left_anti")
    run = F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return missing.withColumn("run", run).groupBy(key, "run").agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count("*").alias("n_missing")).drop("run")


def event_gaps(rows: DataFrame, key: str = "asset", ts: str = "ts", around: int = 51, least: int = 5, factor: float = 2.5, tasks: int | None = None) -> DataFrame:
    """Gaps of data without a grid: spacings above ``factor`` times the median spacing around them.

    The median is over ``around`` rows, centred; where it has fewer than ``least`` it is the next one that has enough,
    or the last. A key of any size is spread over tasks; rows of equal time keep one order, rows without time are left out.
    """
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = scan.numbered(rows.where(F.col(ts).isNotNull()).withColumn("_s", s), [key], [ts], "_i", tasks)
    # chunks of a key's rows, each with the rows that the frames of its first and last row reach
    half = around // 2
    rows = scan.halo(rows, "_i", max(scan.CHUNK, half + 1), half + 1, half)
    w = Window.partitionBy(key, "_chunk").orderBy("_i")
    d = rows.withColumn("prev", F.lag(ts).over(w)).withColumn("d", F.col("_s") - F.lag("_s").over(w))
    near = w.rowsBetween(-half, half)
    # the frame's spacings, ``around`` at most, sorted: far cheaper than an exact percentile built anew for each row
    d = d.withColumn("_f", F.array_sort(F.collect_list("d").over(near))).withColumn("_n", F.size("_f"))
    middle = lambda i: F.get("_f", i.cast("int"))
    med = (middle(F.floor((F.col("_n") - 1) / 2)) + middle(F.floor(F.col("_n") / 2))) / 2
    d = d.withColumn("med", F.when(F.col("_n") >= least, med)).where("_own").drop("_f", "_n")
    if least > half:  # else the rows at a key's ends have enough, too, or none of its rows has
        # frames grow towards the middle, so rows without enough are before the first one that has, or after the last
        known = d.where("med is not null").groupBy(F.col(key).alias("_k"))
        ends = known.agg(F.min("_i").alias("_lo"), F.min_by("med", "_i").alias("_head"), F.max_by("med", "_i").alias("_tail"))
        d = d.join(ends, F.col(key).eqNullSafe(F.col("_k")), "left")
        d = d.withColumn("med", F.coalesce("med", F.when(F.col("_i") < F.col("_lo"), F.col("_head")).otherwise(F.col("_tail"))))
    hit = d.where((F.col("med") > 0) & (F.col("d") > factor * F.col("med")))
    return hit.select(key, F.col("prev").alias("gap_start"), F.col(ts).alias("gap_end"), (F.round(F.col("d") / F.col("med")) - 1).cast("long").alias("n_missing"))


def check_bars(bars: DataFrame, key: str = "asset", ts: str = "date") -> DataFrame:
    """Counts of what is wrong with a key's bars, in one pass."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    hurt = o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    return bars.groupBy(key).agg(
        F.count("*").alias("n_bars"),
        (F.count("*") - F.countDistinct(ts)).alias("n_duplicate"),
        F.count_if(hurt).alias("n_null"),
        F.count_if((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0)).alias("n_not_positive"),
        F.count_if(h < lo).alias("n_high_below_low"),
        F.count_if((o > h) | (o < lo)).alias("n_open_outside"),
        F.count_if((c > h) | (c < lo)).alias("n_close_outside"),
        F.count_if(v < 0).alias("n_negative_volume"),
        F.count_if(v <= 0).alias("n_synthetic"),
    )


def health(bars: DataFrame, step: str, now, key: str = "asset", ts: str = "date") -> DataFrame:
    """A row a key: sanity counts, missing slots, last row and its age in days at ``now`` (a literal or Column)."""
    gaps = find_gaps(bars, step, key, ts).groupBy(key).agg(F.sum("n_missing").alias("n_missing"), F.count("*").alias("n_gaps"))
    last = bars.groupBy(key).agg(F.max(ts).alias("last"))
    out = check_bars(bars, key, ts).join(gaps, key, "left").join(last, key)
    return out.withColumn("age_days", F.datediff(now, "last").cast("long")).na.fill(0, ["n_missing", "n_gaps"])


def flag(report: DataFrame, most_missing: int, most_age: int) -> DataFrame:
    """Rows of a health report that need a look."""
    wrong = sum((F.col(c) for c in report.columns if c.startswith("n_") and c not in ("n_bars", "n_synthetic", "n_gaps", "n_missing")), F.lit(0))
    return report.where((wrong > 0) | (F.col("n_missing") > most_missing) | (F.col("age_days") > most_age))


def cross_venue(a: DataFrame, b: DataFrame, tolerance: float = 0.05, most_off: float = 0.02, key: str = "asset", ts: str = "date") -> DataFrame:
    """Two venues' closes: days and share of days whose log ratio exceeds the tolerance, and its median."""
    j = a.select(key, ts, F.col("close").alias("x")).join(b.select(key, ts, F.col("close").alias("y")), [key, ts]).where("x > 0 and y > 0")
    j = j.withColumn("lr", F.ln(F.col("x") / F.col("y")))
    out = j.groupBy(key).agg(
        F.count("*").alias("days"),
        F.count_if(F.abs("lr") > tolerance).alias("off_days"),
        F.round(F.percentile("lr", F.lit(0.5)), 5).alias("median"),
    )
    out = out.withColumn("off_share", F.round(F.col("off_days") / F.col("days"), 4))
    return out.withColumn("flagged", (F.col("off_share") > most_off) | (F.abs("median") > tolerance)).orderBy(F.desc("off_share"), key)
