"""Regressions, reweighted scenarios, regimes, rolls and weight checks, against identities and small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import futures as U
from lodestrata.operators import inference as I
from lodestrata.operators import weights as T


def test_hac_without_lags_is_the_sandwich_and_shares_add_up(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 0.1 + x @ [1.5, -0.5] + rng.normal(size=300)
    b, se, r2 = I.hac(np.column_stack([np.ones(300), x]), y, 0)
    assert np.allclose(b, [0.1, 1.5, -0.5], atol=0.2) and 0.6 < r2 < 0.9
    assert np.allclose(se, 1 / np.sqrt(300), rtol=0.35)
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v), float(p), float(q)) for i, (v, (p, q)) in enumerate(zip(y, x))]
    out = I.time_series_attribution(spark.createDataFrame([*rows, ("short", dt.date(2020, 1, 1), 1.0, 1.0, 1.0)], "key string, date date, y double, a double, b double"), "y", ["a", "b"], "key").collect()
    assert {r["key"] for r in out} == {"s"} and abs(sum(r["share"] for r in out) - 1) < 1e-9


def test_entropy_pool_meets_its_views(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))], "i long, a double, b double")
    q = I.entropy_pool(df, {"a": 0.3, "b": -0.2})
    r = q.agg(F.sum("q"), F.sum(F.col("q") * F.col("a")), F.sum(F.col("q") * F.col("b")), F.min("q")).first()
    assert np.allclose(list(r)[:3], [1, 0.3, -0.2], atol=1e-7) and r[3] > 0
    same = I.entropy_pool(df, {}).agg(F.min("q"), F.max("q")).first()
    assert np.allclose(list(same), 1 / 500)
    with pytest.raises(ValueError):
        I.entropy_pool(df, {"a": 99.0})
    assert I.entropy_pool(df.where("i < 0"), {"a": 0.0}).count() == 0


def test_two_states_are_found_and_multipliers_use_the_past_only(spark):
    rng = np.random.default_rng(3)
    state = (np.arange(600) // 100) % 2
    mu, sd, move, _ = I.two_states(np.where(state, 2.0, 0.0) + 0.3 * rng.normal(size=600))
    assert np.allclose(mu, [0, 2], atol=0.1) and abs(sd - 0.3) < 0.05 and move.diagonal().min() > 0.95
    r = rng.normal(size=600) * np.where(state, 0.05, 0.01)
    rows = [("m", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "s string, date date, ret double")
    run = lambda d: [x["multiplier"] for x in I.regime_multipliers(d, "ret", "s").orderBy("date").collect()]
    m = run(df)
    assert m[:250] == [1.0] * 250 and np.mean(np.array(m)[530:] == 0.5) > 0.9 and np.mean(np.array(m)[430:500] == 1.0) > 0.9
    assert run(df.where("date < '2021-02-01'")) == m[:397]


def test_front_never_rolls_back_and_returns_are_of_what_was_held(spark):
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)) if d.weekday() < 5]
    ends = {"a": dt.date(2024, 2, 27), "b": dt.date(2024, 3, 27), "c": dt.date(2024, 4, 26)}
    loud = {"a": lambda i: 100 if i < 15 or i > 22 else 10, "b": lambda i: 50, "c": lambda i: 1}
    rows = [("r", c, ends[c], d, 10.0 + k + i, float(loud[c](i))) for k, c in enumerate(ends) for i, d in enumerate(days) if d <= ends[c]]
    df = spark.createDataFrame(rows, "root string, contract string, expiry date, date date, close double, volume double")
    p = U.daily_panel(df)
    out = U.curve(p, U.front_second(p)).orderBy("date").collect()
    fronts = [r["front"] for r in out]
    assert fronts == sorted(fronts) and set(fronts) == {"a", "b"} and sum(r["roll"] for r in out) == 1
    at = next(i for i, r in enumerate(out) if r["roll"])
    assert abs(out[at]["ret_front"] - ((10.0 + at) / (9.0 + at) - 1)) < 1e-12 and out[at]["front_px"] == 11.0 + at
    assert out[0]["second"] == "b" and out[-1]["second"] == "c"


def test_expiries(spark):
    df = spark.createDataFrame([("HGH4", dt.date(2023, 5, 1)), ("HGZ25", dt.date(2024, 1, 5)), ("HGF3", dt.date(2023, 2, 1)), ("x", dt.date(2023, 1, 1))], "s string, f date")
    got = [r[0] for r in df.select(U.expiry_month(F.col("s"), F.col("f"))).collect()]
    assert got == [dt.date(2024, 3, 1), dt.date(2025, 12, 1), dt.date(2033, 1, 1), None]
    assert df.select(U.third_last_business_day(F.lit("2024-03-05").cast("date"))).first()[0] == dt.date(2024, 3, 27)


def test_weight_checks(spark):
    kind = "book string, asset string, weight double, in_universe boolean, listed boolean"
    w = spark.createDataFrame([("ok", "x", 0.2, True, True), ("bad", "x", 0.9, True, False), ("bad", "y", float("nan"), None, True)], kind)
    old = spark.createDataFrame([("bad", "z", 0.4), ("bad", "x", 0.9), ("gone", "x", 0.1)], "book string, asset string, weight double")
    got = {r["book"]: r for r in T.validate_weights(w, old, "book").collect()}
    assert set(got) == {"ok", "bad"} and got["ok"]["violations"] == "" and got["ok"]["change"] is None
    assert got["bad"]["violations"] == "finite,cap,universe,listed,net" and abs(got["bad"]["change"] - 0.4) < 1e-12
    h = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2023-12-31 23:50:00"), (2, None, None, None)], "schema int, a string, b string, c string")
    h = h.select("schema", F.col("a").cast("timestamp").alias("valid_from"), F.col("b").cast("timestamp").alias("valid_to"), F.col("c").cast("timestamp").alias("produced_at"))
    assert [r["violations"] for r in T.validate_headers(h, F.lit("2024-01-01 00:05:00").cast("timestamp")).orderBy("schema").collect()] == ["", "schema,window,stale"]
