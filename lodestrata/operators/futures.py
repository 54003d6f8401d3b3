"""Futures curves: contracts, their panel, the front that rolls, returns of what was held."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month codes of contracts, January first.
MONTHS = "FGHJKMNQUVXZ"


def expiry_month(symbol: Column, first: Column) -> Column:
    """First day of the month that a symbol's last letter and year digits name; one digit is the first such year from ``first`` on."""
    code = F.regexp_extract(symbol, f"([{MONTHS}])([0-9]{{1,2}})$", 1)
    year = F.regexp_extract(symbol, f"[{MONTHS}]([0-9]{{1,2}})$", 1)
    span = F.when(F.length(year) == 1, 10).otherwise(100)
    month = F.instr(F.lit(MONTHS), code)
    # months before the first bar belong to the next cycle
    at = F.year(first) + F.pmod(year.try_cast("int") - F.year(first), span)
    at = at + F.when((at == F.year(first)) & (month < F.month(first)), span).otherwise(0)
    return F.when(code != "", F.make_date(at, month, F.lit(1)))


def third_last_business_day(month: Column) -> Column:
    """Third-last weekday of the month of a date."""
    last = F.last_day(month)
    days = F.filter(F.sequence(F.date_sub(last, 6), last), lambda d: F.weekday(d) < 5)
    return F.element_at(days, -3)


def contract_table(bars: DataFrame) -> DataFrame:
    """``root, contract, expiry, first, last, n, volume`` of bars ``root, contract, expiry, date, close, volume``."""
    return bars.groupBy("root", "contract", "expiry").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.sum("volume").alias("volume"))


def daily_panel(bars: DataFrame) -> DataFrame:
    """``root, contract, expiry, date, close, volume, v5``: each contract on every weekday its root traded in its life.

    Closes are carried forward, missing volumes are zero. ``v5`` is the mean volume of the root's last five dates, of
    fewer where the root has no more; dates before the contract's life count as zero.
    """
    b = bars.where(F.weekday("date") < 5)
    dates = b.select("root", "date").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("date")))
    life = b.where("close is not null").groupBy("root", "contract", "expiry").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    grid = life.join(dates, "root").where("date between _lo and _hi").drop("_lo", "_hi")
    p = grid.join(b.select("root", "contract", "date", "close", "volume"), ["root", "contract", "date"], "left")
    w = Window.partitionBy("root", "contract").orderBy("date")
    p = p.withColumn("close", F.last("close", ignorenulls=True).over(w)).withColumn("volume", F.coalesce("volume", F.lit(0)).cast("double"))
    return p.select("root", "contract", "expiry", "date", "close", "volume", (F.sum("volume").over(w.rowsBetween(-4, 0)) / F.least(F.lit(5), "_k")).alias("v5"))


def front_second(panel: DataFrame, guard: int = 3, look: int = 4, share: float = 0.05) -> DataFrame:
    """``root, date, front, second``: the loudest live contract, which never moves to an earlier one while it lives.

    A contract lives until ``guard`` business days before its expiry. The second is the first of the next ``look`` traded
    contracts with ``share`` of the front's volume, else the loudest of them. The state goes from date to date, so a
    root's contracts, some dozens a date, are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "expiry", "contract"])
        ends = np.busday_offset(pdf["expiry"].to_numpy().astype("datetime64[D]"), -guard, roll="forward")
        pdf = pdf.assign(_live=pdf["date"].to_numpy().astype("datetime64[D]") < ends)
        held, out = None, []
        for date, day in pdf.groupby("date", sort=False):
            day = day[day["_live"]]
            key = list(zip(day["expiry"], day["contract"], strict=True))
            v5, volume = day["v5"].to_numpy(float), day["volume"].to_numpy(float)
            if not key:
                held, second = None, None
            else:
                best = key[int(np.argmax(v5))]
                if held not in key or best > held:
                    held = best
                at = key.index(held)
                later = [i for i in range(at + 1, len(key)) if volume[i] > 0][:look]
                enough = [i for i in later if v5[i] >= share * v5[at]]
                pick = enough[0] if enough else max(later, key=lambda i: v5[i], default=None)
                second = None if pick is None else key[pick][1]
            out.append((pdf["root"].iloc[0], date, held and held[1], second))
        return pd.DataFrame(out, columns=["root", "date", "front", "second"])

    kinds = dict(panel.dtypes)
    return panel.select("root", "contract", "expiry", "date", "volume", "v5").groupBy("root").applyInPandas(run, f"root {kinds['root']}, date date, front {kinds['contract']}, second {kinds['contract']}")


def curve(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """Front and second prices and volumes, returns of the contracts held the date before, spread, carry a year, rolls."""
    w = Window.partitionBy("root").orderBy("date")
    c = chosen.withColumns({"was_front": F.lag("front").over(w), "was_second": F.lag("second").over(w), "_before": F.lag("date").over(w)})
    day = panel.select("root", "date", "contract", "expiry", "close", "volume")

    def price(name: str, at: str, out: str, *more: str) -> DataFrame:
        cols = [F.col("root").alias("_r"), F.col("date").alias("_d"), F.col("contract").alias("_c"), F.col("close").alias(out), *[F.col(m).alias(f"{out}_{m}") for m in more]]
        return c.join(day.select(*cols), (F.col("root") == F.col("_r")) & (F.col(at) == F.col("_d")) & (F.col(name) == F.col("_c")), "left").drop("_r", "_d", "_c")

    for name, at, out, more in (
        ("front", "date", "front_px", ("volume", "expiry")),
        ("second", "date", "second_px", ("volume", "expiry")),
        ("was_front", "date", "_f1", ()),
        ("was_front", "_before", "_f0", ()),
        ("was_second", "date", "_s1", ()),
        ("was_second", "_before", "_s0", ()),
    ):
        c = price(name, at, out, *more)
    r1, r2 = F.try_divide("_f1", "_f0") - 1, F.try_divide("_s1", "_s0") - 1
    apart = F.datediff("second_px_expiry", "front_px_expiry")
    return c.select(
        "root", "date", "front", "second", "front_px", "second_px",
        F.col("front_px_volume").alias("front_volume"), F.col("second_px_volume").alias("second_volume"),
        r1.alias("ret_front"), r2.alias("ret_second"), (r1 - r2).alias("ret_spread"),
        F.datediff("second_px_expiry", "date").alias("days_to_second"),
        F.try_divide(F.ln(F.try_divide("front_px", "second_px")) * 365, apart).alias("carry_ann"),
        (F.col("was_front").isNotNull() & ~F.col("front").eqNullSafe(F.col("was_front"))).alias("roll"),
    )
