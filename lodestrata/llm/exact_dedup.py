"""Operator 6, exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Native: DataFrame functions only. Texts travel once, in a grouping by (hash, text) that combines copies before the
shuffle; that grouping is the byte comparison. Everything after it moves hashes and ids only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, join_counted, table

NAME = "op6_exact_dedup"

ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def content_hash(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: str = "max",
    hasher: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts are byte-equal; a null text counts as empty. ``keep`` is ``max`` or ``min``: which id of a group stays.
    Null ids never win over others; a group that has only null ids has a null keep_id and keeps no row. Rows that
    repeat the winning id are all marked kept, as they can't be told apart. Other columns of the input are ignored, and
    an empty table gives an empty result. Texts whose hashes collide stay in groups of their own.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.withColumn("_h", hasher(F.col("_t")))
    classes = durable(
        base.groupBy("_h", "_t")
        .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_h", F.unhex(F.sha2("_t", 256)).alias("_sha"), "keep_id", "group_size")
    )
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    collided = classes.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    ids = base.select("doc_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_sha"))
    if collided.isEmpty():
        single = join_counted(ids, classes.drop("_sha"), "_h", "group_size", total)
        return _finish(single)
    # Some hashes stand for several texts: their documents are grouped by the text itself, everything else as above.
    alone = classes.join(collided, "_h", "left_anti").drop("_sha")
    single = join_counted(ids.join(collided, "_h", "left_anti"), alone, "_h", "group_size", total)
    mixed = base.join(collided, "_h", "left_semi")
    by_text = mixed.groupBy("_t").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    double = join_counted(mixed, by_text, "_t", "group_size", total)
    double = double.select("doc_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_sha"), "keep_id", "group_size")
    return _finish(single.unionByName(double))


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))
