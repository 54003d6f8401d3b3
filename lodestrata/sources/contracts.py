"""Identity of futures contracts whose symbols and instrument ids are used again, their definitions and daily statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grid import asof_join

#: Letters of the delivery months, days of silence after which an id is another contract's, days by which a
#: contract may outlive its month's first day, and the statistics by their code (those of QUANTITIES are counts).
MONTHS = "FGHJKMNQUVXZ"
SILENCE = 3 * 365
SLACK = 31
STATISTICS = {1: "open", 3: "settlement", 4: "session_low", 5: "session_high", 6: "cleared_volume", 9: "open_interest", 10: "fixing", 11: "close"}
QUANTITIES = ("cleared_volume", "open_interest")

_LEG = f"^([A-Z0-9]+?)([{MONTHS}])([0-9]|[0-9]{{2}}|[0-9]{{4}})$"


def delivery_year(month: Column, digits: Column, first: Column) -> Column:
    """Year of a month's letter and one, two or four digits.

    Two digits are 1970 to 2069. One digit is used again every ten years: the earliest such year, of the decade before the
    ``first`` bar's or later, whose delivery month begins no more than SLACK days before that bar.
    """
    d, m = digits.cast("int"), F.instr(F.lit(MONTHS), month)
    near = F.year(first) - F.year(first) % 10 + d
    fits = lambda y: F.make_date(y, m, F.lit(1)) >= F.date_sub(first.cast("date"), SLACK)
    one = F.when(fits(near - 10), near - 10).when(fits(near), near).otherwise(near + 10)
    return F.when(F.length(digits) == 4, d).when(F.length(digits) == 2, d + F.when(d < 70, 2000).otherwise(1900)).otherwise(one)


def contract_id(symbol: Column, first: Column) -> Column:
    """Symbol with full delivery years, leg by leg (legs are joined by "-"); one that isn't a contract stays as it is."""

    def named(leg: Column) -> Column:
        root, month, digits = (F.regexp_extract(leg, _LEG, i) for i in (1, 2, 3))
        return F.concat(root, month, delivery_year(month, digits, first).cast("string"))

    legs = F.split(symbol, "-", -1)
    return F.when(F.forall(legs, lambda x: x.rlike(_LEG)), F.array_join(F.transform(legs, named), "-")).otherwise(symbol)


def root_of(symbol: Column) -> Column:
    """Product of a contract or of a spread's first leg; null for what isn't one."""
    leg = F.split(symbol, "-", -1)[0]
    return F.when(leg.rlike(_LEG), F.regexp_extract(leg, _LEG, 1))


def expiry_code(symbol: Column) -> Column:
    """Month and year of an outright, as written; null for spreads and what isn't a contract."""
    return F.when(symbol.rlike(_LEG), F.concat(F.regexp_extract(symbol, _LEG, 2), F.regexp_extract(symbol, _LEG, 3)))


def lives(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """``symbol, instrument_id, life, first, last, asset, n_bars``: the time from first to last bar of each contract.

    Rows of one symbol and id (null is an id) that are more than SILENCE days apart belong to different contracts. Symbols
    with colons or spaces are no contracts and are left out, as are null symbols and times. Bars are counted by day before
    they are put in order, so a contract's rows in one task are days, however fine its bars.
    """
    days = bars.where(~F.col("symbol").rlike("[: ]") & F.col(ts).isNotNull()).groupBy("symbol", "instrument_id", F.to_date(ts).alias("_day"))
    days = days.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count("*").alias("_n"))
    w = Window.partitionBy("symbol", "instrument_id").orderBy("_day")
    silent = F.col("_lo") > F.lag("_hi").over(w) + F.expr(f"interval {SILENCE} days")
    days = days.withColumn("_new", F.coalesce(silent, F.lit(False)).cast("long"))
    days = days.withColumn("life", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = days.groupBy("symbol", "instrument_id", "life").agg(F.min("_lo").alias("first"), F.max("_hi").alias("last"), F.sum("_n").alias("n_bars"))
    return out.select("symbol", "instrument_id", "life", "first", "last", contract_id(F.col("symbol"), F.col("first")).alias("asset"), "n_bars")


def identified(bars: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """``bars`` with ``life`` and ``asset``: those of the interval (``lives``) that holds the bar's time; others are left out.

    A column of ``bars`` of one of these names is replaced. The interval table has a row a contract; of one symbol and id no
    two intervals overlap, so no bar is multiplied.
    """
    held = intervals.select(F.col("symbol").alias("_s"), F.col("instrument_id").alias("_id"), F.col("first").alias("_first"), F.col("last").alias("_last"), "life", "asset")
    b = bars.drop("life", "asset")
    same = (b["symbol"] == held["_s"]) & b["instrument_id"].eqNullSafe(held["_id"]) & (b[ts] >= held["_first"]) & (b[ts] <= held["_last"])
    return b.join(held, same).drop("_s", "_id", "_first", "_last")


def defined(bars: DataFrame, definitions: DataFrame, values: list[str], ts: str = "ts", at: str = "ts_event") -> DataFrame:
    """``bars`` with the definition that its instrument id had by then, unless it is older than SILENCE days: a former life's.

    Definitions of one id and time: the one with the largest values counts. Values are null where there is none, and for null ids.
    """
    one = definitions.where(F.col("instrument_id").isNotNull() & F.col(at).isNotNull()).groupBy("instrument_id", F.col(at).alias(ts)).agg(F.max(F.struct(*values)).alias("_d"))
    right = one.select("instrument_id", ts, *[F.col("_d")[v].alias(v) for v in values])
    left = bars.drop(*values)
    named = left.where("instrument_id is not null")
    got = asof_join(named, right, ts, ["instrument_id"], values, F.expr(f"{ts} - _at <= interval {SILENCE} days")).drop("_at")
    return got.unionByName(left.where("instrument_id is null"), allowMissingColumns=True)


def daily_statistics(records: DataFrame) -> DataFrame:
    """``ts, symbol, instrument_id`` and a column a statistic: the last update of each for a contract and reference day.

    The day is that of ``ts_ref``, or of ``ts_event`` where it is missing or of 1970 or before. Updates of one time: the larger
    value counts. One combining aggregate; other kinds of records are left out.
    """
    kept = records.where(F.col("stat_type").isin(*STATISTICS))
    day = F.to_date(F.when(F.year("ts_ref") > 1970, F.col("ts_ref")).otherwise(F.col("ts_event")))

    def last(code: int, name: str) -> Column:
        value = F.col("quantity" if name in QUANTITIES else "price").cast("double")
        return F.max(F.when(F.col("stat_type") == code, F.struct("ts_event", value.alias("v")))).getField("v").alias(name)

    return kept.groupBy(day.alias("ts"), "symbol", "instrument_id").agg(*[last(c, n) for c, n in STATISTICS.items()])
