"""Helpers shared by the corpus operators: durable tables, hot-key joins, word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it holds more than this share of the rows; so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 2000


#: Rows that go to a Python worker at a time. Rows are whole texts here, and Spark's 10,000 of them fill its memory.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and batches small, if the session hasn't set them itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lodestrata-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestrata-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(left: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left-join per-key ``groups`` (one row a key, its row count in ``count``) to ``left`` without skew.

    Keys that hold more than HOT_SHARE of ``total`` rows are at most 1 / HOT_SHARE many, so they are broadcast; their
    rows then get keys of their own and spread evenly over the shuffle that serves all other keys.
    """
    payload = [c for c in groups.columns if c != key]
    least = max(1.0, total * HOT_SHARE)
    hot = groups.where(F.col(count) > least).select(F.col(key).alias("_hk"), F.struct(*payload).alias("_hot"))
    cold = groups.where(F.col(count) <= least).select(F.col(key).alias("_ck"), F.struct(*payload).alias("_cold"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    spread = F.when(F.col("_hk").isNull(), F.col(key))
    salt = F.when(F.col("_hk").isNotNull(), F.xxhash64(*[F.col(c) for c in left.columns if c != key])).otherwise(F.lit(0))
    out = out.withColumn("_jk", spread).withColumn("_js", salt)
    out = out.join(
        # always 0, but not to the optimizer, which would drop a literal from the keys and send all hot rows to one task
        cold.withColumn("_cs", F.pmod(F.xxhash64("_ck"), F.lit(1)).cast("long")),
        (F.col("_jk") == F.col("_ck")) & (F.col("_js") == F.col("_cs")),
        "left",
    )
    got = F.coalesce("_hot", "_cold")
    return out.select(*left.columns, *[got[c].alias(c) for c in payload])


def join_repeated(left: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of per-key ``groups`` (as for ``join_counted``) to ``left``, which is read twice, without skew.

    Each row meets one group at most. Rows of hot keys meet theirs where they are and don't enter the shuffle of the others.
    """
    payload = [c for c in groups.columns if c != key]
    least = max(1.0, total * HOT_SHARE)
    hot, cold = groups.where(F.col(count) > least), groups.where(F.col(count) <= least)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    met = [rows.join(found, key).select(*left.columns, *payload) for rows, found in ((left, F.broadcast(hot)), (rest, cold))]
    return met[0].unionByName(met[1])


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
