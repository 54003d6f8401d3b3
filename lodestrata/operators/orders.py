"""Orders, fills and targets of trading books as relational queries: positions, reconciliation, rounding.

Fills are tables of ``fill_id, side, size, price, fee`` and keys; deliveries may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Significant figures of a price, and its decimals plus those of a size.
FIGURES, DECIMALS = 5, 6


def _price_decimals(px: Column, decimals: Column) -> Column:
    return F.greatest(F.least(DECIMALS - decimals, FIGURES - 1 - F.floor(F.log10(px)).cast("int")), F.lit(0))


def tick(px: Column, decimals: Column) -> Column:
    """The price step at a level; 0 for prices that aren't positive."""
    return F.when(px > 0, 1 / F.pow(F.lit(10.0), _price_decimals(px, decimals))).otherwise(0.0)


def round_price(px: Column, decimals: Column, up: Column) -> Column:
    """A price below 10^10 cut to the figures and decimals allowed, up or down, by its decimal digits; 0 if it isn't positive."""
    scale = F.pow(F.lit(10.0), _price_decimals(px, decimals))
    units = px.cast("string").cast("decimal(30,20)") * scale.cast("decimal(7,0)")
    return F.when(px > 0, F.when(up, F.ceil(units)).otherwise(F.floor(units)).cast("double") / scale).otherwise(0.0)


def quoted_price(px: Column, decimals: Column, side: Column, passive: bool = True) -> Column:
    """Passive buys round down and sells up, aggressive ones the other way."""
    return round_price(px, decimals, (side == "buy") != F.lit(passive))


def round_size(size: Column, decimals: Column) -> Column:
    """A size's absolute value in whole lots, rounded down, binary noise aside."""
    scale = F.pow(F.lit(10.0), decimals)
    return F.floor(F.round(F.abs(size) * scale, 8)) / scale


def distinct_fills(fills: DataFrame) -> DataFrame:
    """Each ``fill_id`` once; deliveries of one fill are equal, else the least row counts. Rows without id are left out."""
    rest = [c for c in fills.columns if c != "fill_id"]
    one = fills.where("fill_id is not null").groupBy("fill_id").agg(F.min(F.struct(*rest)).alias("_r"))
    return one.select("fill_id", "_r.*")


def totals(fills: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, position, notional, fees, n_fills``: signed sizes and values of distinct fills."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    sums = [F.sum(sign * F.col("size")).alias("position"), F.sum(sign * F.col("size") * F.col("price")).alias("notional"), F.sum("fee").alias("fees"), F.count("*").alias("n_fills")]
    return distinct_fills(fills).groupBy(*keys).agg(*sums)


def positions(start: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, position``: the start of a session (``keys, position``) plus what was filled since."""
    both = start.select(*keys, "position").unionByName(filled.select(*keys, "position"))
    return both.groupBy(*keys).agg(F.sum("position").alias("position"))


def targets(weights: DataFrame, held: DataFrame, quotes: DataFrame, book: str, coin: str, buffer: float = 0.0) -> DataFrame:
    """``book, coin, target, trade, value``: sizes that weights ask for at the quotes, in whole lots.

    ``weights``: book, coin, weight, capital; ``held``: book, coin, position; ``quotes``: coin, mid, decimals. Coins that are
    held without a weight go to zero, coins without a quote are left out. A target within ``buffer`` of itself from what is held
    is what is held.
    """
    rows = weights.join(held.where("position != 0").select(book, coin, "position"), [book, coin], "full")
    rows = rows.join(quotes.select(coin, "mid", "decimals"), coin).withColumn("_p", F.coalesce("position", F.lit(0.0)))
    raw = F.coalesce(F.col("weight") * F.col("capital") / F.col("mid"), F.lit(0.0))
    size = round_size(raw, F.col("decimals")) * F.when(raw >= 0, 1).otherwise(-1)
    near = (F.lit(buffer) > 0) & (F.abs(size - F.col("_p")) <= buffer * F.abs(size))
    rows = rows.withColumn("target", F.when(near, F.col("_p")).otherwise(size))
    trade = F.col("target") - F.col("_p")
    return rows.select(book, coin, "target", trade.alias("trade"), (trade * F.col("mid")).alias("value"))


def reconcile_positions(ledger: DataFrame, venue: DataFrame, decimals: DataFrame, keys: list[str], coin: str) -> DataFrame:
    """``keys, ledger, venue, mismatch``: both sides' positions, 0 where one has none, and whether they differ by over 1.5 lots."""
    a, b = ledger.select(*keys, F.col("position").alias("ledger")), venue.select(*keys, F.col("position").alias("venue"))
    rows = a.join(b, keys, "full").join(decimals.select(coin, "decimals"), coin, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ledger", "venue")})
    lots = 1.5 * F.pow(F.lit(10.0), -F.coalesce("decimals", F.lit(0)))
    return rows.select(*keys, "ledger", "venue", (F.abs(F.col("ledger") - F.col("venue")) > lots).alias("mismatch"))


def reconcile_orders(orders: DataFrame, resting: DataFrame) -> DataFrame:
    """``orders`` (cloid, size, filled, status) with the status that the venue's resting orders (cloid) leave.

    Open ones that don't rest are canceled unless filled; those that rest are partial or open. ``unknown`` rows rest without
    being known.
    """
    venue = resting.select("cloid").distinct().withColumn("_rests", F.lit(True))
    rows = orders.withColumn("_known", F.lit(True)).join(venue, "cloid", "full")
    live = ~F.coalesce(F.col("status").isin("filled", "canceled", "rejected"), F.lit(False))
    filled = F.coalesce("filled", F.lit(0.0))
    rest = F.when(filled > 0, "partial").otherwise("open")
    gone = F.when(F.col("size") - filled > 1e-12, "canceled").otherwise("filled")
    status = F.when(F.col("_known").isNull(), "unknown").when(live & F.col("_rests").isNotNull(), rest).when(live, gone).otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_known", "_rests")
