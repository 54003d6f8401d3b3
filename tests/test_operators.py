"""Kernels by identities, sources by round trips, streams by their batch results."""

import datetime as dt
import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import garch as G
from lodestrata.operators import kernels as K
from lodestrata.sources import datasets as D
from lodestrata.streaming import events as E


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    base = dt.date(2024, 1, 1)
    rows, px = [], np.full(5, 100.0)
    for t in range(120):
        r = rng.normal(0, 0.02, 5) + rng.normal(0, 0.01)
        px = px * (1 + r)
        rows += [("s", base + dt.timedelta(t), f"a{i}", float(px[i]), float(r[i]), float(r[i] + i), 0.1 * (i - 2), 0.0001, 1.0) for i in range(5)]
    return spark.createDataFrame(rows, "strategy string, date date, asset string, close double, ret double, alpha double, weight double, funding double, one double").cache()


def test_regression_residuals_are_orthogonal(panel):
    rows = K.cross_sectional_wls(panel.withColumn("y", F.col("ret") * 3 + F.col("alpha")), "y", ["one", "ret"], "one").collect()
    by = {}
    for r in rows:
        by.setdefault(r["date"], []).append(r["residual"])
    assert len(by) == 120 and all(abs(sum(v)) < 1e-9 for v in by.values())


def test_recursions(panel):
    v = {(r["asset"], r["date"]): r["variance"] for r in K.ewma_variance(panel, 10).collect()}
    assert len(v) == 600 and min(v.values()) > 0
    k = 0.5**0.1
    days = sorted(d for a, d in v if a == "a0")
    r = {x["date"]: x["ret"] for x in panel.where("asset = 'a0'").collect()}
    assert all(math.isclose(v["a0", b], (1 - k) * r[b] ** 2 + k * v["a0", a]) for a, b in zip(days, days[1:], strict=False))
    assert G.garch_variance(panel).where("variance <= 0").count() == 0
    assert K.local_level(panel, 1.0, 4.0).where("level is null").count() == 0


def test_scalars(spark):
    z = [-9.0, -3.0, -0.5, 0.0, 1.0, 2.5, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert all(math.isclose(a, NormalDist().cdf(b), rel_tol=1e-6, abs_tol=1e-14) for a, b in zip(got, z, strict=True))
    assert math.isclose(S.kelly_binary(0.6, 1, 1), 0.2) and S.leverage_ceiling(0.1, 10, 0.2, 10.0) == math.inf
    assert 0 < S.muth_gain(0.1) < S.muth_gain(3.0) < 1
    assert math.isclose(S.decay_to_halflife(S.halflife_to_decay(7)), 7)


def test_upsert_and_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    t0 = dt.datetime(2023, 12, 31, 23)
    bars = lambda n, close, shift=0: spark.createDataFrame([(t0 + dt.timedelta(minutes=15 * (i + shift)), close, "v", "A") for i in range(n)], "ts timestamp, close double, exchange string, asset string")
    D.upsert(spark, path, bars(8, 100.0))
    D.upsert(spark, path, bars(8, 200.0, 4))
    out = D.scan(spark, path, ["A"], "v")
    assert out.count() == 12 and out.where("close = 200").count() == 8
    assert D.scan(spark, path, end="2023-12-31").count() == 4 and D.scan(spark, path, start="2024-01-01").count() == 8
    assert D.coverage(out).first()["n"] == 12


def test_parsers(spark):
    lines = spark.createDataFrame([("open_time,o",), ("1704067200000,1,2,0.5,1.5,10,0,15,7,4,6,0",), ("1704067200000000,1,2,0.5,1.5,10,0,15,7,4,6,0",)], "value string")
    got = D.parse_klines(lines, "X").collect()
    assert [r["ts"] for r in got] == [dt.datetime(2024, 1, 1)] * 2 and got[0]["trades"] == 7
    fund = spark.createDataFrame([("calc_time,x,y",), ("1704067200007,8,0.0001",), ("1704067200001,8,0.0001",)], "value string")
    assert D.parse_funding(fund, "X").count() == 1
    book = {"raw": {"data": {"time": 1704067200000, "levels": [[{"px": "99.95", "sz": "2", "n": 1}, {"px": "99.0", "sz": "5", "n": 1}], [{"px": "100.05", "sz": "3", "n": 1}]]}}}
    r = D.parse_books(spark.createDataFrame([(json.dumps(book),), ("broken",)], "value string")).collect()
    assert len(r) == 1 and r[0]["bid_d10"] == 2 and r[0]["ask_d10"] == 3 and math.isclose(r[0]["spread_bps"], 10, rel_tol=1e-9)
    q = {"open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0], "close": [1.0, None], "volume": [1.0, 2.0]}
    chart = {"chart": {"result": [{"timestamp": [1704205800, 1704292200], "indicators": {"quote": [q]}}]}}
    assert [x["ts"] for x in D.parse_chart(spark.createDataFrame([(json.dumps(chart),)], "value string")).collect()] == [dt.date(2024, 1, 2)]
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th></tr><tr><td>1 </td><td>x</td></tr></table>"), (2, None)], "id long, html string")
    assert [x["cells"] for x in D.html_rows(pages, "id").orderBy("row").collect()] == [["a"], ["1", "x"]]
    assert spark.range(1).select(D.redact(F.lit("u?api_key=abc&x=1"))).first()[0] == "u?api_key=***&x=1"


EVENT = "cloid string, kind string, fill_id string, status string, size double, price double, fee double, filled double, ts timestamp, value double"


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = dt.datetime(2024, 1, 1)
    rows = [(f"c{i % 4}", "fill", f"f{i}", None, 1.0, 10.0, 0.1, None, t + dt.timedelta(minutes=i), 1.0) for i in range(40)]
    rows += [("c0", "update", None, "canceled", None, None, None, None, t, 0.0), ("c0", "update", None, "open", None, None, None, None, t, 0.0)]
    rows += [rows[i] for i in rng.integers(0, 40, 30)]
    tail = rows[40:42]
    rest = rows[:40] + rows[42:]
    rng.shuffle(rest)
    for k in range(2):
        part = (rest[::2] + tail if k == 0 else rest[1::2])
        spark.createDataFrame([tuple(r) for r in part], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema

    def run(df, mode):
        name = f"q{abs(hash(str(df.schema) + mode)) % 10**8}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = E.replay(spark, str(tmp_path / "in"), schema)
    last = {}
    for r in run(E.order_states(stream), "update"):
        last[r["cloid"]] = r if r["cloid"] not in last or r["filled"] >= last[r["cloid"]]["filled"] else last[r["cloid"]]
    assert {k: v["filled"] for k, v in last.items()} == dict.fromkeys(["c0", "c1", "c2", "c3"], 10.0)
    assert all(math.isclose(v["notional"], 100.0) for v in last.values()) and last["c0"]["status"] == "canceled"
    once = run(E.once(stream.where("kind = 'fill'"), ["fill_id"], "ts", "1 day"), "append")
    assert len(once) == 40
    n = run(E.tumbling(stream.where("kind = 'fill'"), "ts", "10 minutes", ["cloid"], "1 day"), "complete")
    assert sum(r["n"] for r in n) == 70
