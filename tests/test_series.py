"""Filters, resampled intervals, contract identity and inventories against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import bootstrap, scan, state_space
from lodestrata.operators.evaluation import hashed_starts
from lodestrata.sources import contracts, inventory


def day(s, hour=0):
    return dt.datetime.fromisoformat(s) + dt.timedelta(hours=hour)


# --- filters ----------------------------------------------------------------------------------------------------------
MODEL = state_space.Model([[1, 1, 0], [0, 0.9, 0], [0, 0, 0.5]], [[1, 0, 1], [0, 1, 0.3]], np.diag([0.1, 0.02, 0.3]), [[0.5, 0.1], [0.1, 0.4]], [1.0, 0.0, -1.0], np.diag([2.0, 1.0, 3.0]))


def plain_filter(m, ys):
    mean, cov, out = m.initial_state, m.initial_cov, []
    for t, y in enumerate(ys):
        if t:
            mean, cov = m.transition @ mean, m.transition @ cov @ m.transition.T + m.state_cov
        at = [i for i, v in enumerate(y) if v is not None and not math.isnan(v)]
        if at:
            h, r = m.observation[at], m.obs_cov[np.ix_(at, at)]
            gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + r)
            mean = mean + gain @ (np.array([y[i] for i in at]) - h @ mean)
            cov = cov - gain @ h @ cov
        out.append((mean, cov))
    return out


@pytest.mark.parametrize("batch", ["57", "10000"])
def test_filter(spark, batch):
    rng = np.random.default_rng(3)
    series = {"long": 3000, "b": 40, "one": 1, None: 25, "blind": 6}
    series |= {f"s{i:03}": 3 for i in range(100)}
    hide = lambda k, x: None if k == "blind" or rng.random() < 0.2 else math.nan if rng.random() < 0.05 else float(x)
    rows = [(k, t, hide(k, a), hide(k, b), -1.0) for k, n in series.items() for t, (a, b) in enumerate(rng.normal(size=(n, 2)).cumsum(0))]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k string, t int, a double, b double, state double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = state_space.kalman_filter(df, ["k"], ["t"], ["a", "b"], MODEL, tasks=12).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    made = {(r["k"], r["t"]): r for r in got}
    for k in series:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for (_, t, a, b, _), (mean, cov) in zip(mine, plain_filter(MODEL, [r[2:4] for r in mine]), strict=True):
            assert np.allclose(made[k, t]["state"], mean, rtol=0, atol=1e-9)
            assert np.allclose(made[k, t]["state_cov"], cov.reshape(-1), rtol=0, atol=1e-9)
    parts = scan.stretches(df, ["k"], ["t"], 12).where("k = 'long'").select("_part").distinct().count()
    assert parts > 8  # the long series was many tasks' work


def test_filter_edges(spark):
    none = spark.createDataFrame([], "k string, t int, a double, b double")
    assert state_space.kalman_filter(none, ["k"], ["t"], ["a", "b"], MODEL).collect() == []
    with pytest.raises(ValueError, match="observations"):
        state_space.kalman_filter(none, ["k"], ["t"], ["a"], MODEL)
    with pytest.raises(ValueError, match="obs_cov"):
        state_space.Model([[1.0]], [[1.0]], [[1.0]], np.eye(2), [0.0], [[1.0]])


def test_steady_gain(spark):
    local = state_space.Model(1.0, 1.0, 0.7, 2.0, 0.0, 5.0)
    p = (0.7 + math.sqrt(0.7**2 + 4 * 0.7 * 2.0)) / 2  # p = p - p^2 / (p + r) + q
    assert state_space.steady_gain(local)[0, 0] == pytest.approx(p / (p + 2.0), abs=1e-10)
    mean, cov = plain_filter(MODEL, [(0.0, 0.0)] * 500)[-1]
    before = MODEL.transition @ cov @ MODEL.transition.T + MODEL.state_cov
    h = MODEL.observation
    assert np.allclose(state_space.steady_gain(MODEL), before @ h.T @ np.linalg.inv(h @ before @ h.T + MODEL.obs_cov), atol=1e-9)


# --- resampling -------------------------------------------------------------------------------------------------------
def plain_interval(spark, x, block, draws, confidence, periods):
    import hashlib

    n, out = len(x), []
    for b in range(draws):
        at = []
        for j in range(n // block + 1):
            s = int(hashlib.md5(f"0:{b}:{j}".encode()).hexdigest()[:12], 16) % n
            at += [(s + o) % n for o in range(block)]
        y = x[at[:n]]
        if y.std(ddof=1) > 1e-12:
            out.append(y.mean() / y.std(ddof=1) * math.sqrt(periods))
    return np.percentile(out, [50 * (1 - confidence), 50 * (1 + confidence)])


def test_intervals(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(0.001, 0.01, 401), "even": rng.normal(0, 1, 200), "short": rng.normal(0.5, 1, 7), None: rng.normal(0.1, 1, 60)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 9999, None), ("a", -5, math.nan), ("flat", 1, 0.5), ("flat", 2, 0.5), ("flat", 3, 0.5), ("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, r double").repartition(5)
    got = {r["k"]: r for r in bootstrap.sharpe_intervals(df, "r", ["k"], "t", 20, 80, 0.9).collect()}
    assert set(got) == {*series, "flat", "one"}
    for k, x in series.items():
        low, high = plain_interval(spark, x, 20, 80, 0.9, 365.0)
        assert got[k]["n"] == len(x) and got[k]["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(365), rel=1e-9)
        assert (got[k]["low"], got[k]["high"]) == (pytest.approx(low, rel=1e-8), pytest.approx(high, rel=1e-8))
    for k in ("flat", "one"):
        assert got[k]["sharpe"] is None and got[k]["low"] is None


def test_interval_covers(spark):
    """Of 60 made strategies nearly all have their true ratio inside the 95 % interval."""
    rng = np.random.default_rng(8)
    rows = [(k, i, float(v)) for k in range(60) for i, v in enumerate(rng.normal(0.1, 1.0, 500))]
    got = bootstrap.sharpe_intervals(spark.createDataFrame(rows, "k int, t int, r double"), "r", ["k"], "t", 20, 300, periods=1.0).collect()
    assert 0.85 <= sum(r["low"] < 0.1 < r["high"] for r in got) / 60 <= 1.0


def test_deflated(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k in range(30) for v in rng.normal(0.002 * k / 30, 0.01, 500)]
    df = spark.createDataFrame(rows, "k int, r double")
    got = bootstrap.deflated_sharpe(df, "r", ["k"], 30).collect()
    assert all(r["sr0"] > 0 and r["dsr"] < r["psr"] for r in got)
    for r in bootstrap.deflated_sharpe(df, "r", ["k"], 1).collect():
        assert r["sr0"] == 0 and r["dsr"] == r["psr"]
        assert r["se"] == pytest.approx(math.sqrt((1 + r["sr"] ** 2 / 2) / r["n"]), rel=0.1)  # near normal


# --- contracts --------------------------------------------------------------------------------------------------------
def bars(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, instrument_id long, close double")


def names(spark, pairs):
    df = spark.createDataFrame([(s, dt.date.fromisoformat(d)) for s, d in pairs], "s string, d date")
    return [r[0] for r in df.select(contracts.contract_id(F.col("s"), F.col("d"))).collect()]


def test_ids(spark):
    cases = {
        ("ESM0", "2010-06-06"): "ESM2010", ("ESF0", "2018-06-29"): "ESF2020", ("HGZ5", "2011-01-31"): "HGZ2015", ("HGZ5", "2023-12-22"): "HGZ2025", ("CLK1", "2021-06-01"): "CLK2021",
        ("CLK1", "2021-06-02"): "CLK2031", ("HGZ26", "2024-01-01"): "HGZ2026", ("HGZ71", "1970-01-01"): "HGZ1971", ("HGZ2026", "2024-01-01"): "HGZ2026", ("HGZ6-HGH7", "2024-05-01"): "HGZ2026-HGH2027",
        ("HG.FUT", "2024-05-01"): "HG.FUT", ("HGZ6-X", "2024-05-01"): "HGZ6-X", ("HGZ123", "2024-05-01"): "HGZ123", ("", "2024-05-01"): "",
    }
    assert names(spark, list(cases)) == list(cases.values())
    df = spark.createDataFrame([("HGZ6",), ("HGZ2026-HGH2027",), ("HG.FUT",), (None,)], "s string")
    got = [tuple(r) for r in df.select(contracts.root_of(F.col("s")), contracts.expiry_code(F.col("s"))).collect()]
    assert got == [("HG", "Z6"), ("HG", None), (None, None), (None, None)]


def test_lives(spark):
    rows = [(day("2015-06-01"), "HGZ5", 1, 1.0), (day("2015-06-02", 5), "HGZ5", 1, 2.0), (day("2025-06-01"), "HGZ5", 2, 3.0)]
    rows += [(day("2010-06-07"), "GCM1", 77, 4.0), (day("2010-06-07", 3), "GCM1", 77, 4.0), (day("2021-03-01"), "GCM1", 77, 5.0)]  # one id, two lives
    rows += [(day("2012-01-01"), "SIZ3", None, 6.0), (day("2014-12-31"), "SIZ3", None, 6.0), (day("2017-12-30"), "SIZ3", None, 6.0)]  # 1095 days aren't too long
    rows += [(day("2024-07-17"), "ZW:CF Z4", 78, 7.0), (day("2024-07-17"), None, 79, 8.0), (None, "HGZ5", 1, 9.0)]
    b = bars(spark, rows)
    got = contracts.lives(b)
    assert {(r["asset"], r["instrument_id"], r["life"], r["n_bars"]) for r in got.collect()} == {("HGZ2015", 1, 0, 2), ("HGZ2025", 2, 0, 1), ("GCM2011", 77, 0, 2), ("GCM2021", 77, 1, 1), ("SIZ2013", None, 0, 3)}
    made = contracts.identified(b.withColumn("asset", F.lit("old")), got)
    assert sorted((r["close"], r["asset"]) for r in made.collect()) == [
        (1.0, "HGZ2015"), (2.0, "HGZ2015"), (3.0, "HGZ2025"), (4.0, "GCM2011"), (4.0, "GCM2011"), (5.0, "GCM2021"), (6.0, "SIZ2013"), (6.0, "SIZ2013"), (6.0, "SIZ2013")
    ]
    assert contracts.lives(b.limit(0)).count() == 0


def test_definitions(spark):
    b = bars(spark, [(day("2010-06-07"), "GCM1", 77, 1.0), (day("2021-03-01"), "GCM1", 77, 2.0), (day("2021-03-09"), "GCM1", 77, 3.0), (day("2021-03-09"), "X", None, 4.0)])
    f = spark.createDataFrame([(day("2010-06-01"), 77, "old"), (day("2021-03-05"), 77, "new"), (day("2021-03-05"), 77, "mew"), (None, 77, "never")], "ts_event timestamp_ntz, instrument_id long, currency string")
    assert {r["close"]: r["currency"] for r in contracts.defined(b, f, ["currency"]).collect()} == {1.0: "old", 2.0: None, 3.0: "new", 4.0: None}


def test_statistics(spark):
    day1, day2 = day("2024-01-02"), day("2024-01-03")
    rows = [(3, 10.0, None, day1, day2), (3, 11.0, None, day("2024-01-02", 9), day2), (9, 1.0, 500, day1, day2), (11, 7.0, None, day1, None), (11, 7.5, None, day1, day("1970-01-01")), (99, 1.0, 1, day1, day2)]
    df = spark.createDataFrame([("A", 1, *r) for r in rows], "symbol string, instrument_id long, stat_type int, price double, quantity long, ts_event timestamp_ntz, ts_ref timestamp_ntz")
    got = {str(r["ts"]): r for r in contracts.daily_statistics(df).collect()}
    assert set(got) == {"2024-01-02", "2024-01-03"}
    assert (got["2024-01-03"]["settlement"], got["2024-01-03"]["open_interest"], got["2024-01-03"]["close"], got["2024-01-02"]["close"]) == (11.0, 500.0, None, 7.5)


# --- inventories ------------------------------------------------------------------------------------------------------
KIND = "key string, size long, modified long, sha256 string"


def test_pull_and_push(spark):
    local = spark.createDataFrame([("raw/same.parquet", 1, 5, "x"), ("raw/newer.parquet", 1, 5, "x"), ("raw/newer.csv", 1, 5, "x"), ("raw/older.parquet", 1, 1, "x"), ("raw/legacy", 1, 5, "x"), ("raw/mine", 1, 5, "x")], KIND)
    remote = spark.createDataFrame([("raw/same.parquet", 1, 2, "x"), ("raw/newer.parquet", 1, 2, "y"), ("raw/newer.csv", 2, 2, None), ("raw/older.parquet", 1, 1, "y"), ("raw/legacy", 1, 2, None), ("raw/theirs", 1, 2, "x")], KIND)
    plan = lambda **o: {r["key"][4:]: r["action"] for r in inventory.pull_plan(local, remote, **o).collect()}
    assert plan() == {"newer.parquet": "keep", "newer.csv": "keep", "older.parquet": "download", "theirs": "download"}
    assert plan(merge=True) == plan() | {"newer.parquet": "merge"}
    assert plan(force=True, merge=True) == dict.fromkeys(plan(), "download")
    push = lambda **o: {r["key"][4:]: r["reason"] for r in inventory.push_plan(local, remote, **o).collect()}
    assert push() == {"newer.parquet": "content", "newer.csv": "size", "older.parquet": "content", "legacy": "content", "mine": "missing"}
    assert push(force=True) == push() | {"same.parquet": "forced"}


def test_sync_has_every_cell(spark):
    """Each side against what was agreed: gone, the same, changed, changed to the same, never there."""
    other = {"-": None, "0": "base", "1": "one", "2": "two"}
    want = {  # agreed, local, remote
        "000": None, "001": "pull", "00-": "delete_local", "010": "push", "011": "agree", "012": "merge", "01-": "conflict", "0-0": "delete_remote", "0-1": "conflict", "0--": "forget",
        "-0-": "push", "--0": "pull", "-11": "agree", "-12": "merge",
    }
    sides = [spark.createDataFrame([(f"raw/{c}.parquet", 1, 0, other[c[i]]) for c in want if c[i] != "-"], KIND) for i in range(3)]
    got = {r["key"][4:7]: r["action"] for r in inventory.sync_plan(sides[1], sides[2], sides[0]).collect()}
    assert got == {k: v for k, v in want.items() if v}
    csv = [s.withColumn("key", F.replace("key", F.lit(".parquet"), F.lit(".csv"))) for s in sides]
    assert {r["action"] for r in inventory.sync_plan(csv[1], csv[2], csv[0]).where("key like '%12.csv'").collect()} == {"conflict"}
    sizes = [spark.createDataFrame([("k", n, 0, None)], KIND) for n in (1, 2, 1)]
    assert [r["action"] for r in inventory.sync_plan(sizes[1], sizes[2], sizes[0]).collect()] == ["push"]


def test_listing(spark, tmp_path):
    import hashlib

    for name in ("raw/a/x.parquet", "raw/a/y.parquet.tmp", "raw/b/.hidden", "raw/b/z.csv", "external/e.bin", "state/s.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = inventory.listing(spark, str(tmp_path))
    got = {r["key"]: (r["size"], r["sha256"]) for r in inventory.hashed(spark, str(tmp_path), files).collect()}
    assert got == {k: (len(k), hashlib.sha256(k.encode()).hexdigest()) for k in ("raw/a/x.parquet", "raw/b/z.csv", "external/e.bin")}
    assert [r["key"] for r in inventory.listing(spark, str(tmp_path), dataset="b").collect()] == ["raw/b/z.csv"]
    assert [r["key"] for r in inventory.listing(spark, str(tmp_path), dataset="external").collect()] == ["external/e.bin"]


def test_merged(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.5)], "ts int, v double")
    b = spark.createDataFrame([(2, 9.0, "x"), (3, 3.0, "y")], "ts int, v double, note string")
    assert sorted(tuple(r) for r in inventory.merged(a, b, ["ts"]).collect()) == [(1, 1.0, None), (2, 2.5, None), (3, 3.0, "y")]
