"""Partitioned datasets: scans with predicates that reach the files, upserts, coverage; and parsers of feed formats."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import clean
from . import versioned
from .versioned import merge_latest as merge_latest

PARTITIONS = ("exchange", "asset", "year")


def scan(spark: SparkSession, path: str, assets: list[str] | None = None, exchange: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a dataset by venue, asset and time; NaN becomes null.

    A bare end date holds through its day, an end with a time is exclusive. Venue, assets, and the years that follow from
    the times, prune partitions. The dataset is a versioned one, of which the latest version is read, or plain folders.
    """
    parts = F.lit(True)
    if exchange:
        parts &= F.col("exchange") == exchange
    if assets:
        parts &= F.col("asset").isin(assets)
    if start:
        parts &= F.col("year") >= int(start[:4])
    if end:
        parts &= F.col("year") <= int(end[:4])
    df = versioned.read(spark, path, parts) if versioned.versions(spark, path) else spark.read.option("mergeSchema", "true").parquet(path).where(parts)
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        stop = F.lit(end).cast("timestamp")
        df = df.where(F.col("ts") < (stop + F.expr("interval 1 day") if re.fullmatch(r"\d{4}-\d\d-\d\d", end) else stop))
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def upsert(spark: SparkSession, path: str, new: DataFrame, key: tuple[str, ...] = ("ts",)) -> int:
    """Merge rows into the partitions they touch, as a new version of the dataset; its number is returned.

    New rows win over old ones of the same key. Writers may run at the same time, see ``versioned``.
    """
    return versioned.upsert(spark, path, new.withColumn("year", F.year("ts")), PARTITIONS, key)


def coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("exchange", "asset").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def epoch(x: Column) -> Column:
    """Milliseconds or microseconds since 1970, told apart row by row by their size."""
    n = x.cast("long")
    return F.when(n > 10**14, F.timestamp_micros(n)).otherwise(F.timestamp_millis(n))


def parse_klines(lines: DataFrame, symbol: str) -> DataFrame:
    """Bars from CSV lines (column ``value``) of twelve columns; a header line is passed over."""
    c = F.split("value", ",")
    names = ["open", "high", "low", "close", "volume"]
    rows = lines.where(F.col("value").rlike("^[0-9]"))
    return rows.select(
        epoch(c[0]).alias("ts"),
        *[c[i + 1].cast("double").alias(n) for i, n in enumerate(names)],
        c[7].cast("double").alias("quote_volume"),
        c[8].cast("long").alias("trades"),
        c[9].cast("double").alias("taker_buy_volume"),
        c[10].cast("double").alias("taker_buy_quote_volume"),
        F.lit(symbol).alias("symbol"),
    )


def parse_funding(lines: DataFrame, symbol: str) -> DataFrame:
    """Funding rates: time rounded to the minute, one row a time."""
    c = F.split("value", ",")
    t = F.timestamp_seconds(F.round(c[0].cast("long") / 60000.0) * 60)
    rows = lines.where(F.col("value").rlike("^[0-9]")).select(t.alias("ts"), c[2].cast("double").alias("rate"), c[1].cast("long").alias("interval_hours"), F.lit(symbol).alias("symbol"))
    return rows.dropDuplicates(["ts"])


_BOOK = "struct<raw:struct<data:struct<time:bigint,levels:array<array<struct<px:string,sz:string,n:int>>>>>>"


def parse_books(lines: DataFrame, bands=(10, 25, 50)) -> DataFrame:
    """Best prices, spread and depth within bands of basis points, from one JSON snapshot a line (column ``value``)."""
    d = lines.select(F.from_json("value", _BOOK)["raw"]["data"].alias("d")).where("size(d.levels) = 2 and size(d.levels[0]) > 0 and size(d.levels[1]) > 0")
    d = d.select(F.timestamp_millis("d.time").alias("ts"), *[F.transform(F.col("d.levels")[i], lambda x: F.struct(x["px"].cast("double").alias("px"), x["sz"].cast("double").alias("sz"))).alias(n) for i, n in enumerate(("bids", "asks"))])
    d = d.withColumn("bid", F.col("bids")[0]["px"]).withColumn("ask", F.col("asks")[0]["px"]).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    out = [F.col(x) for x in ("ts", "bid", "ask", "mid")] + [((F.col("ask") - F.col("bid")) / F.col("mid") * 1e4).alias("spread_bps")]
    for b in bands:
        lo, hi = F.col("mid") * (1 - b / 1e4), F.col("mid") * (1 + b / 1e4)
        out += [F.aggregate("bids", F.lit(0.0), _within(lo, True)).alias(f"bid_d{b}"), F.aggregate("asks", F.lit(0.0), _within(hi, False)).alias(f"ask_d{b}")]
    return d.select(*out)


def _within(limit: Column, above: bool):
    return lambda a, x: a + F.when((x["px"] >= limit) if above else (x["px"] <= limit), x["sz"]).otherwise(0.0)


def parse_chart(docs: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Daily bars of each symbol from chart JSON (column ``value``) with parallel arrays; the date is the exchange's; empty closes go."""
    quote = "struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>"
    r = docs.select(F.explode(F.from_json("value", f"struct<chart:struct<result:array<{quote}>>>")["chart"]["result"]).alias("r"))
    q = F.col("r.indicators.quote")[0]
    rows = r.select(F.col("r.meta.symbol").alias("symbol"), F.inline(F.arrays_zip(F.col("r.timestamp").alias("t"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])))
    rows = rows.select("symbol", F.to_date(F.from_utc_timestamp(F.timestamp_seconds(rows[1]), zone)).alias("ts"), *rows.columns[2:])
    last = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc_nulls_last("close")))
    return rows.where("close is not null").withColumn("_k", last).where("_k = 1").drop("_k")


def parse_positions(rows: DataFrame, text_columns: list[str]) -> DataFrame:
    """Positioning report: codes padded to six, thousands separators out of the numbers, one row a code and day."""
    out = rows.withColumn("code", F.lpad(F.trim("code"), 6, "0")).withColumns({c: F.expr(f"try_cast(replace(trim({c}), ',', '') as double)") for c in text_columns})
    return out.dropDuplicates(["code", "ts"])


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = ""

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(self.cell.strip())
            self.cell = None


def html_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, row, cells``: the cells of all table rows of pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                t = _Table()
                t.feed(text or "")
                out += [(k, i, cells) for i, cells in enumerate(r for r in t.rows if r)]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(read, f"{key} {kind}, row long, cells array<string>")


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(api_?key|token|secret)=[^&\s]+", "$1=***")
