"""Column functions on panels: guarded rolling frames, cross-sections, ranks. All native expressions.

A panel is a long table with ``date`` and ``asset``. Rows are grid rows after ``operators.grid.densify``, so "30 rows" is 30
dates. A missing value is null; ``clean`` turns NaN into null, as NaN would win every maximum and spoil every mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None))


def series(*keys: str, order: str = "date"):
    """Window over one series: all rows up to the frame that the caller sets."""
    return Window.partitionBy(*(keys or ("asset",))).orderBy(order)


def section(by: str = "date"):
    """Window over one cross-section, without order."""
    return Window.partitionBy(by)


def rolling(agg, x: Column, n: int, least: int | None = None, keys=("asset",), order: str = "date") -> Column:
    """``agg`` of the last ``n`` rows, null unless ``least`` of them (all, if not given) hold a value."""
    w = series(*keys, order=order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def rolling_median(x: Column, n: int, least: int | None = None, keys=("asset",), order: str = "date") -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(0.5)), x, n, least, keys, order)


def ffill(x: Column, limit: int | None = None, keys=("asset",), order: str = "date") -> Column:
    """Last value seen, over at most ``limit`` missing rows."""
    lo = Window.unboundedPreceding if limit is None else -limit
    return F.last(x, ignorenulls=True).over(series(*keys, order=order).rowsBetween(lo, 0))


def zscore_sample(x: Column, by: str = "date") -> Column:
    """(x - mean) / sample deviation of the cross-section; 0 where there is no dispersion."""
    w = section(by)
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd).when(x.isNotNull(), F.lit(0.0))


def zscore_pop_clipped(x: Column, by: str = "date", clip: float = 3.0) -> Column:
    """Population z-score cut to +-clip; missing values and sections without dispersion give 0."""
    w = section(by)
    sd = F.stddev_pop(x).over(w)
    z = F.when(sd > 0, (x - F.avg(x).over(w)) / sd)
    return F.coalesce(F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))), F.lit(0.0))


def winsorize(x: Column, limit: float = 3.0, by: str = "date") -> Column:
    z = zscore_sample(x, by)
    return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)))


def rank_transform(x: Column, tie: str = "asset", by: str = "date") -> Column:
    """Ordinal rank on [-1, 1]; ties in the order of ``tie``."""
    n = F.count(F.lit(1)).over(section(by))
    r = F.row_number().over(Window.partitionBy(by).orderBy(x.asc_nulls_last(), tie))
    return F.when(n > 1, 2.0 * (r - 1) / (n - 1) - 1).otherwise(0.0)


def rank_normalize(x: Column, by: str = "date") -> Column:
    """Average rank over rows + 1, where the rows include missing values."""
    w = section(by)
    least = F.rank().over(Window.partitionBy(by).orderBy(x.asc_nulls_last()))
    name = F.count(x).over(Window.partitionBy(by, x))
    return F.when(x.isNotNull(), (least + (name - 1) / 2.0) / (F.count(F.lit(1)).over(w) + 1))


def clip(x: Column, lo: float, hi: float) -> Column:
    """``least`` and ``greatest`` skip nulls; this keeps them."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def log_transform(x: Column, offset: float = 0.0) -> Column:
    return F.signum(x + offset) * F.log1p(F.abs(x + offset)) if offset else F.signum(x) * F.log1p(F.abs(x))


def arctan_transform(x: Column, scale: float = 1.0) -> Column:
    return F.lit(2 / math.pi) * F.atan(x / scale)


def term_structure(x: Column, short: int, long: int, keys=("asset",)) -> Column:
    return rolling(F.avg, x, short, keys=keys) - rolling(F.avg, x, long, keys=keys)


def change_vs_average(x: Column, n: int, keys=("asset",)) -> Column:
    return x - rolling(F.avg, x, n, keys=keys)


def normalize_by(x: Column, scale: Column, n: int | None = None, keys=("asset",)) -> Column:
    return F.try_divide(x, scale if n is None else rolling(F.avg, scale, n, keys=keys))


def pct_change(x: Column, keys=("asset",), order: str = "date") -> Column:
    return F.try_divide(x, F.lag(x).over(series(*keys, order=order))) - 1


def momentum(px: Column, lookback: int, skip: int = 1, keys=("asset",)) -> Column:
    w = series(*keys)
    return F.try_divide(F.lag(px, skip).over(w), F.lag(px, lookback).over(w)) - 1


def reversal(px: Column, lookback: int = 1, keys=("asset",)) -> Column:
    return -(F.try_divide(px, F.lag(px, lookback).over(series(*keys))) - 1)


def funding_zscore(x: Column, n: int, keys=("asset",)) -> Column:
    return F.try_divide(x - rolling(F.avg, x, n, keys=keys), rolling(F.stddev_samp, x, n, keys=keys))


def annualize_funding(rate: Column, hours: float) -> Column:
    return rate * (8760.0 / hours)
