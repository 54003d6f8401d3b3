"""Mirrors of a folder of files: inventories by content, what to copy, and partitions that both sides have changed.

An inventory is a table ``key, size, modified, sha256``. Plans are joins of inventories, so they can be read, tested and
counted before anything is copied; hashes are null where they aren't known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Layers that are mirrored, and endings of files that never are.
LAYERS = ("raw", "external")
PASSING = (".tmp", ".lock")


def listing(spark: SparkSession, root: str, layers: tuple[str, ...] = LAYERS, dataset: str | None = None) -> DataFrame:
    """``key, size, modified, path`` of the files below ``root`` in the layers, or in one dataset (a layer's name means it all).

    Only names and sizes are read. Hidden and passing files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    base = F.lit("/" + root.split("://")[-1].strip("/") + "/")
    key = F.expr("substring(path, instr(path, _base) + length(_base))")
    files = files.withColumn("_base", base).withColumn("key", key).drop("_base")
    scopes = [f"{x}/" for x in layers] if dataset is None else [f"{dataset}/" if dataset in layers else f"raw/{dataset}/"]
    inside = F.lit(False)
    for s in scopes:
        inside |= F.col("key").startswith(s)
    passing = F.lit(False)
    for s in PASSING:
        passing |= F.col("key").endswith(s)
    return files.where(inside & ~passing & ~F.col("key").rlike(r"(^|/)\.[^/]*$")).select("key", "size", "modified", "path")


def hashed(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``files`` (of ``listing``) with ``sha256``: their contents are read, each by one task; Spark takes files up to 2 GB."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_path"), F.sha2("content", 256).alias("sha256"))
    return files.join(content, files["path"] == content["_path"], "left").drop("_path")


def _beside(left: DataFrame, right: DataFrame, names: tuple[str, str], how: str = "full") -> DataFrame:
    """Both sides by key, as structs named ``names``, null where a side lacks the file."""
    a, b = (x.select("key", F.struct("size", "modified", "sha256").alias(n)) for x, n in zip((left, right), names, strict=True))
    return a.join(b, "key", how)


def push_plan(local: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """``key, size, reason`` of local files to copy: missing there, another size, another hash, or ``forced``.

    A remote file whose hash isn't known counts as another one.
    """
    j, lo, re = _beside(local, remote, ("l", "r"), "left"), F.col("l"), F.col("r")
    reason = F.when(re.isNull(), "missing").when(lo["size"] != re["size"], "size").when(~lo["sha256"].eqNullSafe(re["sha256"]) | re["sha256"].isNull(), "content")
    if force:
        reason = F.coalesce(reason, F.lit("forced"))
    return j.select("key", lo["size"].alias("size"), reason.alias("reason")).where("reason is not null")


def pull_plan(local: DataFrame, remote: DataFrame, force: bool = False, merge: bool = False) -> DataFrame:
    """``key, size, action`` of remote files that the local side lacks or has otherwise: download, merge or keep.

    Of one size and without a known remote hash they count as equal. A local file that differs and is newer is kept, or, with
    ``merge``, merged where it is a Parquet file of the raw layer; with ``force`` it is overwritten.
    """
    j, lo, re = _beside(remote, local, ("r", "l"), "left"), F.col("l"), F.col("r")
    equal = (lo["size"] == re["size"]) & (re["sha256"].isNull() | lo["sha256"].eqNullSafe(re["sha256"]))
    newer = (lo["modified"] > re["modified"]) & F.lit(not force)
    mergeable = F.lit(merge) & F.col("key").startswith("raw/") & F.col("key").endswith(".parquet")
    action = F.when(lo.isNull(), "download").when(equal, None).when(newer & mergeable, "merge").when(newer, "keep").otherwise("download")
    return j.select("key", re["size"].alias("size"), action.alias("action")).where("action is not null")


def _changed(now: Column, then: Column) -> Column:
    """Whether a side differs from what was agreed; hashes count where both are known, else sizes."""
    known = now["sha256"].isNotNull() & then["sha256"].isNotNull()
    other = F.when(known, now["sha256"] != then["sha256"]).otherwise(now["size"] != then["size"])
    return F.when(now.isNull() | then.isNull(), now.isNull() != then.isNull()).otherwise(other)


def sync_plan(local: DataFrame, remote: DataFrame, agreed: DataFrame) -> DataFrame:
    """``key, action``: what makes both sides equal again, given the inventory that they last had in common.

    A side that changed alone is copied (push, pull), or its deletion is (delete_remote, delete_local). Both changed to the
    same, or both gone: forget or agree, nothing is copied. Both changed otherwise: merge for Parquet files of the raw layer
    that both still have, else conflict. Files that no side changed have no row.
    """
    base = agreed.select("key", F.struct("size", "modified", "sha256").alias("b"))
    j = _beside(local, remote, ("l", "r")).join(base, "key", "full")
    lo, re, ba = F.col("l"), F.col("r"), F.col("b")
    mine, theirs, apart = _changed(lo, ba), _changed(re, ba), _changed(lo, re)
    partition = F.col("key").startswith("raw/") & F.col("key").endswith(".parquet") & lo.isNotNull() & re.isNotNull()
    action = (
        F.when(~mine & ~theirs, None)
        .when(lo.isNull() & re.isNull(), "forget")
        .when(mine & ~theirs, F.when(lo.isNull(), "delete_remote").otherwise("push"))
        .when(~mine & theirs, F.when(re.isNull(), "delete_local").otherwise("pull"))
        .when(~apart, "agree")
        .when(partition, "merge")
        .otherwise("conflict")
    )
    return j.select("key", action.alias("action")).where("action is not null")


def merged(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two copies of a partition; of rows with one key the local one counts, of one side's the one with the largest values.

    Columns are matched by name, missing ones are null.
    """
    both = local.withColumn("_side", F.lit(0)).unionByName(remote.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in both.columns if c not in (*keys, "_side")]
    w = Window.partitionBy(*keys).orderBy("_side", *rest)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_side")
