"""Versioned tables: concurrent writers, a writer that dies, versions, schemas and odd partition values."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import datasets, versioned

SCHEMA = "ts timestamp, close double, exchange string, asset string"


def bars(spark, first, n, asset="X", close=1.0):
    rows = spark.range(first, first + n).select(F.timestamp_seconds(F.col("id") * 900 + 1_704_067_200).alias("ts"), F.lit(close).alias("close"))
    return rows.withColumn("exchange", F.lit("venue")).withColumn("asset", F.lit(asset))


def test_concurrent_writers_lose_no_rows(spark, tmp_path):
    path = str(tmp_path / "bars")

    def writer(k):
        return [datasets.upsert(spark, path, bars(spark, 100 * k + 10 * i, 10, asset="same" if i % 2 else f"own{k}")) for i in range(4)]

    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(writer, range(3)))
    assert sorted(v for m in made for v in m) == list(range(1, 13)) == versioned.versions(spark, path)
    counts = {r["asset"]: r["count"] for r in datasets.scan(spark, path).groupBy("asset").count().collect()}
    assert counts == {"same": 60, "own0": 20, "own1": 20, "own2": 20}
    assert [r["rows"] for r in versioned.history(spark, path).orderBy("version").collect()] == [10 * k for k in range(1, 13)]


def test_rivals_on_one_base(spark, tmp_path):
    """Both merged on version 1: the second one of a partition must merge again, that of another partition need not."""
    path, by, key = str(tmp_path / "t"), ["asset"], ["ts"]
    versioned.upsert(spark, path, bars(spark, 0, 5, "a"), by, key)
    staged = [versioned.stage(spark, path, bars(spark, 0, 9, x).drop("exchange"), by) for x in "aab"]
    schema = versioned.read(spark, path).drop("exchange").schema
    done = [versioned.commit_staged(spark, path, c, made, by, schema, 1) for c, made in staged]
    assert done == [2, None, 3]
    assert versioned.read(spark, path).count() == 18


def test_killed_between_stage_and_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    datasets.upsert(spark, path, bars(spark, 0, 5))
    versioned.stage(spark, path, bars(spark, 0, 50).withColumn("year", F.lit(2024)), datasets.PARTITIONS)  # and nothing more
    assert versioned.versions(spark, path) == [1] and datasets.scan(spark, path).count() == 5
    assert datasets.upsert(spark, path, bars(spark, 3, 5, close=2.0)) == 2
    got = [r["close"] for r in datasets.scan(spark, path).orderBy("ts").collect()]
    assert got == [1.0] * 3 + [2.0] * 5
    held = versioned.read(spark, path, version=1)
    assert held.count() == 5
    assert versioned.expire(spark, path, keep=1, hours=1.0) == 0
    assert versioned.expire(spark, path, keep=1, hours=-1.0) == 2  # the dead writer's and the first version's
    assert datasets.scan(spark, path).count() == 8


def test_many_versions_keep_untouched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(versioned.CHECKPOINT + 2):
        versioned.upsert(spark, path, bars(spark, i, 1, f"a{i % 4}"), ["asset"], ["ts"])
    live = {r["asset"]: r["n"] for r in versioned.partitions(spark, path).collect()}
    assert live == {f"a{k}": 3 for k in range(4)}
    assert versioned.partitions(spark, path, 2).count() == 2
    assert "a1" in str(versioned.read(spark, path, F.col("asset") == "a1").inputFiles()) and len(versioned.read(spark, path, F.col("asset") == "a1").inputFiles()) == 1


def test_odd_values_and_new_columns(spark, tmp_path):
    path, by = str(tmp_path / "t"), ["asset"]
    odd = ["a b", "50%", "x#y", "p+q", "s/t", "007", "1e5", "k=v", "[z]*", "ü", None]
    rows = spark.createDataFrame([(i, float(i), a) for i, a in enumerate(odd)], "id long, v double, asset string")
    assert versioned.upsert(spark, path, rows.limit(0), by, ["id"]) == 0
    assert versioned.upsert(spark, path, rows, by, ["id"]) == 1
    assert versioned.upsert(spark, path, rows.limit(0), by, ["id"]) == 1
    more = spark.createDataFrame([(1, "new", "50%", 1), (1, "newer", "50%", 2), (99, "null", None, 1)], "id long, note string, asset string, o int")
    assert versioned.upsert(spark, path, more, by, ["id"], ["o"]) == 2
    got = {(r["asset"], r["id"]): (r["v"], r["note"]) for r in versioned.read(spark, path).collect()}
    want = {(a, i): (float(i), None) for i, a in enumerate(odd)} | {("50%", 1): (None, "newer"), (None, 99): (None, "null")}
    assert got == want
    assert versioned.read(spark, path).columns[-1] == "asset"
    with pytest.raises(ValueError, match="no version"):
        versioned.read(spark, path, version=7)
