"""Event streams: dedup, windows, sessions, and the state of orders, on streaming or batch frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("filled", "canceled", "rejected")


def replay(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A directory of parquet files as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each id once; ids are forgotten when the watermark has passed them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], late: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


ORDER = "cloid string, status string, filled double, notional double, fees double"


def order_states(events: DataFrame) -> DataFrame:
    """Order states from events ``cloid, kind, fill_id, status, size, price, fee, filled``.

    Fills count once by id; a terminal status stays whatever comes after it but another terminal one; a venue's total
    that exceeds the fills seen wins. Duplicates and disorder among events don't change the outcome of fills.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, filled, notional, fees, seen = state.get if state.exists else ("new", 0.0, 0.0, 0.0, "")
        known = set(seen.split("\x1f")) if seen else set()
        for pdf in frames:
            for e in pdf.itertuples():
                if e.kind == "fill":
                    if e.fill_id in known:
                        continue
                    known.add(e.fill_id)
                    filled, notional, fees = filled + e.size, notional + e.size * e.price, fees + e.fee
                    if status not in TERMINAL:
                        status = "partial"
                else:
                    if status not in TERMINAL or e.status in TERMINAL:
                        status = e.status
                    if e.filled == e.filled and e.filled is not None:
                        filled = max(filled, e.filled)
        state.update((status, filled, notional, fees, "\x1f".join(sorted(known))))
        yield pd.DataFrame({"cloid": [key[0]], "status": [status], "filled": [filled], "notional": [notional], "fees": [fees]})

    return events.groupBy("cloid").applyInPandasWithState(step, ORDER, "status string, filled double, notional double, fees double, seen string", "update", GroupStateTimeout.NoTimeout)


def alerts_once_a_day(rows: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first alert of a key and day, no more."""
    return once(rows.withColumn("_day", F.to_date(ts)), [*keys, "_day"], ts, late)
