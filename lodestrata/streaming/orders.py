"""The state of orders as a stream: fills that arrive repeatedly, late or not at all, with expiry and restart.

An order's fills are a list state. A micro-batch reads it once for each order that it has something of and appends the new
fills at once, so calls to the state store are a few for an order, not for a delivery. What an order is follows from the set of its fills and from its latest terminal and other reports by their own times, not from the order of
arrival. A timer of event time ends an order that nothing was heard of for ``keep``; its state goes, and as that is longer
than the watermark's delay, no delivery of it can come again. The state is in RocksDB and in the checkpoint: a stream that is
started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import durable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("filled", "canceled", "rejected")
OUT = "cloid string, status string, filled double, notional double, fees double, n_fills long, ended boolean"
_STATE = Row(*[c.split()[0] for c in OUT.split(", ")])
#: Latest reports: (time, status) of terminal and of other ones, the venue's total, and the order's size.
_HEAD = "done_at double, done string, open_at double, open string, total double, size double, last double"


def outcome(fills: list[tuple], head: tuple) -> tuple[str, float, float, float]:
    """``status, filled, notional, fees`` from fills (size, price, fee) and the latest reports.

    Filled is what the fills say, the order's size at most, or the venue's total if that is more. A terminal report stays,
    but an order that is filled is filled.
    """
    done, opened, total, size = head[1], head[3], head[4], head[5]
    filled = sum(f[0] for f in fills)
    if size is not None:
        filled = min(filled, size)
    filled = max(filled, total or 0.0)
    if size is not None and filled >= size - 1e-12:
        status = "filled"
    elif done:
        status = done
    else:
        status = "partial" if filled > 0 else opened or "new"
    return status, filled, sum(f[0] * f[1] for f in fills), sum(f[2] for f in fills)


class _Orders(StatefulProcessor):
    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fills = handle.getListState("fills", "id string, size double, price double, fee double")
        self.head = handle.getValueState("head", _HEAD)

    def _due(self, last: float) -> int:
        return int((last + self.keep) * 1000)

    def _row(self, key, fills: list[tuple], head: tuple, ended: bool) -> Row:
        fills = sorted(f[1:] for f in fills)  # one sum whatever the order of arrival
        status, filled, notional, fees = outcome(fills, head)
        if ended and status not in TERMINAL:
            status = "expired"
        return _STATE(key[0], status, filled, notional, fees, len(fills), ended)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.head.get()
        done_at, done, open_at, opened, total, size, last = known or (None,) * 7
        fills = [tuple(f) for f in self.fills.get()] if known else []
        seen, new = {f[0] for f in fills}, []
        none = lambda v: None if v is None or v != v else v
        number = lambda v: float("nan") if v is None else v
        for _, kind, fill_id, status, amount, price, fee, filled, order_size, at, _ in rows:
            last = at if last is None else max(last, at)
            size = none(order_size) if size is None else size
            if kind == "fill":
                if fill_id is not None and fill_id not in seen:
                    seen.add(fill_id)
                    new.append((fill_id, number(amount), number(price), none(fee) or 0.0))
                continue
            if none(filled) is not None:
                total = max(total or 0.0, filled)
            # of reports of one time the larger name counts, so that arrival doesn't
            if status in TERMINAL and (done_at is None or (at, status) >= (done_at, done)):
                done_at, done = at, status
            elif status is not None and status not in TERMINAL and (open_at is None or (at, status) >= (open_at, opened)):
                open_at, opened = at, status
        if new:
            self.fills.appendList(new)
        head = (done_at, done, open_at, opened, total, size, last)
        if head != known:
            self.head.update(head)
        if not known:  # the one timer of an order; when it fires too early, it is set anew
            self.handle.registerTimer(self._due(last))
        yield self._row(key, fills + new, head, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        head = tuple(self.head.get())
        due = self._due(head[6])
        if due > expiredTimerInfo.getExpiryTimeInMs() and due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        yield self._row(key, [tuple(f) for f in self.fills.get()], head, True)
        self.fills.clear()
        self.head.clear()


def order_states(events: DataFrame, late: str = "1 hour", keep: float = 86_400.0) -> DataFrame:
    """``OUT`` rows of a stream of ``cloid, kind, fill_id, status, size, price, fee, filled, order_size, ts``.

    ``kind`` is ``fill`` or ``update``; ``order_size`` may be null. An order gives a row after every micro-batch that has
    something of it, and a last one (``ended``) when ``keep`` seconds passed without any, ``expired`` if it was still open.
    ``keep`` must be longer than ``late``, after which events are dropped. Needs the state store PROVIDER.
    """
    rows = events.withWatermark("ts", late).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = rows.select("cloid", "kind", "fill_id", "status", "size", "price", "fee", "filled", "order_size", "at", "ts")
    return rows.groupBy("cloid").transformWithState(_Orders(keep), OUT, "append", "eventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, its rows appended to files; and those files as a table."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(path)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each order: ended ones are last, and a state never has fewer fills than an earlier one."""
    rest = [c for c in states.columns if c != "cloid"]
    later = F.struct(F.col("ended"), "n_fills", "filled", F.col("status").isin(*TERMINAL), "status")
    return states.groupBy("cloid").agg(F.max_by(F.struct(*rest), later).alias("_r")).select("cloid", "_r.*")


def replayed(spark: SparkSession, events: DataFrame, folder: str, files: int) -> DataFrame:
    """A table as a stream: written as so many slices in the order of ``ts``, one after another, and read so, a file a micro-batch."""
    sliced = durable(events.repartitionByRange(files, "ts").withColumn("_slice", F.spark_partition_id()))
    for i in range(files):  # files are read in the order in which they were written
        sliced.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
