"""Order states against plain versions, through duplicates, disorder, losses, expiry and restarts; rounding by decimals."""

import datetime as dt
import random
from decimal import ROUND_DOWN, ROUND_UP, Decimal

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import orders as O
from lodestrata.streaming import orders as S

EVENT = "cloid string, kind string, fill_id string, status string, size double, price double, fee double, filled double, order_size double, ts timestamp"
T = dt.datetime(2024, 5, 1)


def events(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(12):
        n = rng.randrange(1, 6)
        size = float(n) if k % 3 else None
        at = T + dt.timedelta(seconds=rng.randrange(600))
        own = [(f"c{k}", "fill", f"{k}-{i}", None, 1.0, 10.0 + i, 0.25, None, size, at + dt.timedelta(seconds=i)) for i in range(n)]
        if k % 4 == 1:
            own.pop()  # lost, but the venue's total has it
            own.append((f"c{k}", "update", None, "open", None, None, None, float(n), size, at))
        if k % 4 == 2:
            own.append((f"c{k}", "update", None, "canceled", None, None, None, None, size, at + dt.timedelta(seconds=60)))
            own.append((f"c{k}", "update", None, "open", None, None, None, None, size, at + dt.timedelta(seconds=1)))
        rows += own
    rows += [rows[i] for i in [rng.randrange(len(rows)) for _ in range(25)]]
    rng.shuffle(rows)
    return rows


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == c}, key=lambda r: r[9])
        fills = {r[2]: r for r in own if r[1] == "fill"}
        size = own[0][8]
        filled = sum(r[4] for r in fills.values())
        filled = min(filled, size) if size else filled
        filled = max([filled, *[r[7] for r in own if r[7] is not None]])
        done = [r[3] for r in own if r[3] in S.TERMINAL]
        status = "filled" if size and filled >= size else done[-1] if done else "partial" if filled else "open"
        out[c] = (status, filled, sum(r[4] * r[5] for r in fills.values()), 0.25 * len(fills), len(fills))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def got(states):
    return {r["cloid"]: (r["status"], r["filled"], r["notional"], r["fees"], r["n_fills"]) for r in S.latest(states).collect()}


def test_restart_gives_the_same_states(spark, tmp_path):
    rows = events(3)
    want = plain(rows)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    stream = lambda: S.order_states(spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1).parquet(source))
    write(spark, rows[:30], source)
    S.run_to_table(stream(), out, checkpoint)
    for part in (rows[30:50], rows[50:]):  # the stream is started anew each time
        write(spark, part, source)
        states = S.run_to_table(stream(), out, checkpoint)
    assert got(states) == want
    # nothing is heard of them for long: a last row each, after which they are forgotten
    later = T + dt.timedelta(days=3)
    for i in range(2):
        write(spark, [("z", "update", None, "open", None, None, None, None, None, later + dt.timedelta(hours=2 * i))], source)
        states = S.run_to_table(stream(), out, checkpoint)
    ended = {r["cloid"]: r["status"] for r in states.where("ended").collect()}
    assert ended == {c: s if s in S.TERMINAL else "expired" for c, (s, *_) in want.items()}


def test_arrival_does_not_matter(spark, tmp_path):
    rows, seen = events(5), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        source = str(tmp_path / f"in{seed}")
        write(spark, rows[:25], source)
        write(spark, rows[25:], source)
        stream = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1).parquet(source)
        seen.append(got(S.run_to_table(S.order_states(stream), str(tmp_path / f"out{seed}"), str(tmp_path / f"check{seed}"))))
    assert seen[0] == seen[1] == plain(rows)


def test_rounding(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.29, 1.1, 0.05 - 0.06, 12345.678, 99999.5, 0.000123456, 7.0, 1e-7, 100000.0, 0.0, 5.015]) * rng.choice([1, 3, 7]), rng.randrange(5), rng.choice(["buy", "sell"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, d int, side string")
    made = df.select("x", "d", "side", O.round_size(F.col("x"), F.col("d")).alias("size"), O.quoted_price(F.col("x"), F.col("d"), F.col("side")).alias("px"), O.quoted_price(F.col("x"), F.col("d"), F.col("side"), False).alias("cross"), O.tick(F.col("x"), F.col("d")).alias("tick"))
    for r in made.collect():
        clean = Decimal(repr(round(abs(r["x"]), r["d"] + 8)))
        assert r["size"] == pytest.approx(float(clean.quantize(Decimal(1).scaleb(-r["d"]), rounding=ROUND_DOWN)), rel=1e-12)
        if r["x"] <= 0:
            assert r["px"] == r["cross"] == r["tick"] == 0
            continue
        x = Decimal(repr(r["x"]))
        places = max(min(6 - r["d"], 4 - x.adjusted()), 0)
        step = Decimal(1).scaleb(-places)
        down, up = (float(x.quantize(step, rounding=m)) for m in (ROUND_DOWN, ROUND_UP))
        assert (r["px"], r["cross"]) == pytest.approx((down, up) if r["side"] == "buy" else (up, down), rel=1e-12)
        assert r["tick"] == pytest.approx(float(step))


def test_books(spark):
    fills = spark.createDataFrame([("a", "b1", "X", "buy", 2.0, 10.0, 0.1), ("a", "b1", "X", "buy", 2.0, 10.0, 0.1), ("b", "b1", "X", "sell", 0.5, 12.0, 0.1), ("c", "b1", "Y", "sell", 1.0, 5.0, 0.2), (None, "b1", "Y", "buy", 9.0, 5.0, 0.2)], "fill_id string, book string, coin string, side string, size double, price double, fee double")
    filled = O.totals(fills, ["book", "coin"])
    assert {(r["coin"], r["position"], r["notional"], r["n_fills"]) for r in filled.collect()} == {("X", 1.5, 14.0, 2), ("Y", -1.0, -5.0, 1)}
    start = spark.createDataFrame([("b1", "X", 1.0), ("b1", "Z", 4.0)], "book string, coin string, position double")
    held = O.positions(start, filled, ["book", "coin"])
    assert {(r["coin"], r["position"]) for r in held.collect()} == {("X", 2.5), ("Y", -1.0), ("Z", 4.0)}
    quotes = spark.createDataFrame([("X", 10.0, 1), ("Y", 3.0, 0), ("Z", 2.0, 0)], "coin string, mid double, decimals int")
    weights = spark.createDataFrame([("b1", "X", 0.26, 100.0), ("b1", "Y", -0.1, 100.0), ("b1", "Q", 0.5, 100.0)], "book string, coin string, weight double, capital double")
    got = {r["coin"]: (r["target"], r["trade"]) for r in O.targets(weights, held, quotes, "book", "coin", 0.05).collect()}
    assert got == {"X": (2.5, 0.0), "Y": (-3.0, -2.0), "Z": (0.0, -4.0)}
    venue = spark.createDataFrame([("b1", "X", 2.6), ("b1", "Y", -4.0), ("b1", "W", 2.0)], "book string, coin string, position double")
    seen = {r["coin"]: r["mismatch"] for r in O.reconcile_positions(held, venue, quotes, ["book", "coin"], "coin").collect()}
    assert seen == {"X": False, "Y": True, "Z": True, "W": True}
    orders = spark.createDataFrame([("1", 2.0, 0.0, "open"), ("2", 2.0, 1.0, "open"), ("3", 2.0, 2.0, "partial"), ("4", 2.0, 1.0, "canceled"), ("5", 2.0, 1.0, "new")], "cloid string, size double, filled double, status string")
    resting = spark.createDataFrame([("1",), ("5",), ("9",), ("9",)], "cloid string")
    assert {r["cloid"]: r["status"] for r in O.reconcile_orders(orders, resting).collect()} == {"1": "open", "2": "canceled", "3": "filled", "4": "canceled", "5": "partial", "9": "unknown"}


class Store:
    """A state store of one order that counts the calls made to it."""

    def __init__(self):
        self.calls, self.items, self.value, self.timers = 0, [], None, []

    def getListState(self, name, schema):  # noqa: N802
        return self

    getValueState = lambda self, name, schema: Head(self)  # noqa: E731, N815

    def appendList(self, new):  # noqa: N802
        self.calls += 1
        self.items += new

    def get(self):
        self.calls += 1
        return iter(self.items)

    def clear(self):
        self.items = []

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class Head:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value

    def clear(self):
        self.store.value = None


class Clock:
    def __init__(self, now):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: now


def test_calls_to_the_store_do_not_grow_with_fills():
    store = Store()
    orders = S._Orders(10.0)
    orders.init(store)
    for batch in range(3):
        fills = [("c", "fill", str(i), None, 1.0, 2.0, 0.0, None, None, float(batch), None) for i in range(1000 * (batch + 1))]
        before = store.calls
        (row,) = orders.handleInputRows(("c",), iter(fills * 2), None)
        assert store.calls - before <= 5
        assert (row.filled, row.notional, row.n_fills, row.ended) == (1000.0 * (batch + 1), 2000.0 * (batch + 1), 1000 * (batch + 1), False)
    assert store.timers == [10_000]
    assert list(orders.handleExpiredTimer(("c",), Clock(10_000), Clock(10_000))) == [] and store.timers == [10_000, 12_000]
    (row,) = orders.handleExpiredTimer(("c",), Clock(12_000), Clock(12_000))
    assert (row.status, row.ended, store.items, store.value) == ("expired", True, [], None)
