"""Versioned tables: partitions that are replaced as a whole, and a version for every commit.

    table/data/commit=<id>/<partition columns>/...   rows, written before the commit that shows them
    table/manifests/<id>/...                         partitions of that commit: their columns, ``dir`` and ``n`` rows
    table/versions/<number>.json                     one small file a version; making it is the commit

A writer merges its rows into the partitions that they touch, writes those under an id of its own, and then makes the next
version's file, which only one writer can. The other one looks at what was committed meanwhile: if that touched none of its
partitions, it takes the number after, else it merges again on top. Readers see whole versions only, a writer that dies
before the commit leaves nothing but files that no version names, and earlier versions stay readable.

What is alive at a version is an aggregate over manifests, the latest commit of each partition; every CHECKPOINT versions a
manifest lists all of them, so that few are read. Only directory names of partitions that are asked for reach the driver,
which lists them for the scan anyway.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Every so many versions a manifest lists all partitions.
CHECKPOINT = 10


def merge_latest(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union in which, for each key, new rows win over old ones, and later (by ``order``) over earlier.

    Nulls in a key are equal to each other; of rows that tie one stays.
    """
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_s")]
    best = F.max_by(F.struct(F.lit(1).alias("_one"), *rest), F.struct("_s", *order)).alias("_r")
    return both.groupBy(*key).agg(best).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, target: str, text: str) -> bool:
    """Make a whole file under a name that nobody has; False if somebody has it.

    On local folders by a link, elsewhere by a rename that doesn't overwrite; both are atomic.
    """
    jvm = spark._jvm
    to, fs = _fs(spark, target)
    draft = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(to), local(draft))
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, to, kinds)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, in order; none if there is no table."""
    p, fs = _fs(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _info(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version:020d}.json", wholetext=True).first()[0])


def partitions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Live partitions of a version, the latest if not given: partition columns, ``dir``, ``n``, ``version``."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version if known else ''} of {path}")
    version = known[-1] if version is None else version
    parts, read = [], []
    for v in reversed([v for v in known if v <= version]):
        info = _info(spark, path, v)
        parts = parts or info["partitions"]
        schema = StructType.fromJson(info["manifest"])
        read.append(spark.read.schema(schema).parquet(f"{path}/manifests/{info['commit']}").withColumn("version", F.lit(v)))
        if info["full"]:
            break
    rows = reduce(DataFrame.unionByName, read)
    last = F.max_by(F.struct("dir", "n", "version"), "version").alias("_r")
    return rows.groupBy(*parts).agg(last).select(*parts, "_r.*")


def _rows(spark: SparkSession, path: str, dirs: list[str], schema: StructType) -> DataFrame:
    if not dirs:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*[f"{path}/data/{d}" for d in dirs]).select(*schema.names)


def read(spark: SparkSession, path: str, where: Column | None = None, version: int | None = None) -> DataFrame:
    """Rows of a version, the latest if not given. ``where`` is about partition columns and is put to the manifest.

    Files of other partitions aren't even listed. A plan that is held keeps its version, whatever is committed later.
    """
    live = partitions(spark, path, version)
    info = _info(spark, path, versions(spark, path)[-1] if version is None else version)
    live = live if where is None else live.where(where)
    return _rows(spark, path, [r["dir"] for r in live.select("dir").collect()], StructType.fromJson(info["schema"]))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def stage(spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str]) -> tuple[str, DataFrame]:
    """Write rows under a new id; the id, and the partitions that they make (``by``, ``dir``, ``n``).

    Rows are dealt by partition first; Spark cuts large ones over several tasks and files.
    """
    commit = uuid.uuid4().hex
    rows.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{path}/data/commit={commit}")
    made = spark.read.schema(rows.schema).parquet(f"{path}/data/commit={commit}")
    # names in file_path are escaped once more than on disk
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.regexp_extract(whole, f"(commit={commit}/.*)/[^/]*$", 1)
    return commit, made.groupBy(*by, inside.alias("dir")).agg(F.count("*").alias("n"))


def commit_staged(spark: SparkSession, path: str, commit: str, made: DataFrame, by: Sequence[str], schema: StructType, base: int) -> int | None:
    """The version under which a staged commit shows; None if one after ``base`` touched its partitions."""
    made = made.select(*by, "dir", "n")
    made.write.parquet(f"{path}/manifests/{commit}")
    own = spark.read.schema(made.schema).parquet(f"{path}/manifests/{commit}")
    while True:
        number, name = base + 1, commit
        full = base == 0 or number % CHECKPOINT == 0
        if base and full:  # list all partitions as they will be
            others = partitions(spark, path, base).drop("version")
            name = uuid.uuid4().hex
            others.join(own, _same(others, own, list(by)), "left_anti").unionByName(own).write.parquet(f"{path}/manifests/{name}")
        if base:
            schema = _wider(StructType.fromJson(_info(spark, path, base)["schema"]), schema, by)
        info = {"version": number, "commit": name, "staged": commit, "partitions": list(by), "schema": schema.jsonValue(), "manifest": made.schema.jsonValue(), "full": full, "time": time.time()}
        if _publish(spark, f"{path}/versions/{number:020d}.json", json.dumps(info)):
            return number
        while base < versions(spark, path)[-1]:  # somebody was faster
            base += 1
            info = _info(spark, path, base)
            theirs = spark.read.schema(StructType.fromJson(info["manifest"])).parquet(f"{path}/manifests/{info['commit']}")
            theirs = theirs.where(F.col("dir").startswith(f"commit={info['staged']}/"))  # a full manifest lists others, too
            if not theirs.join(own, _same(theirs, own, list(by)), "left_semi").isEmpty():
                return None


def _wider(old: StructType, new: StructType, by: Sequence[str]) -> StructType:
    """Columns of both; partition columns last."""
    fields = {f.name: f for f in [*new.fields, *old.fields]}
    return StructType([f for n, f in fields.items() if n not in by] + [fields[n] for n in by])


def upsert(spark: SparkSession, path: str, new: DataFrame, by: Sequence[str], key: Sequence[str], order: Sequence[str] = (), attempts: int = 50) -> int:
    """Merge rows into the table and return the version that shows them.

    Of rows with one key (``key`` within the partition columns ``by``) the new one wins, and among new ones the last by
    ``order``. New columns are added, missing ones are null. No rows make no version: 0 if there is none yet. Writers may run
    at the same time; one that meets a rival in a partition merges again.
    """
    touched = new.select(*by).distinct()
    for _ in range(attempts):
        known = versions(spark, path)
        base = known[-1] if known else 0
        if base:
            live = partitions(spark, path, base)
            dirs = [r["dir"] for r in live.join(touched, _same(live, touched, list(by)), "left_semi").select("dir").collect()]
            old = _rows(spark, path, dirs, StructType.fromJson(_info(spark, path, base)["schema"]))
        else:
            old = new.limit(0)
        merged = merge_latest(old, new, [*by, *key], order)
        commit, made = stage(spark, path, merged.select(*[c for c in merged.columns if c not in by], *by), by)
        if made.isEmpty():
            return base
        schema = StructType([*[f for f in merged.schema.fields if f.name not in by], *[merged.schema[c] for c in by]])
        number = commit_staged(spark, path, commit, made, by, schema, base)
        if number:
            return number
    raise RuntimeError(f"{attempts} attempts met rivals in {path}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """``version, time, partitions, rows``: what each version holds alive."""
    made = None
    for v in versions(spark, path):
        row = partitions(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        row = row.withColumn("time", F.lit(_info(spark, path, v)["time"]).cast("timestamp"))
        made = row if made is None else made.unionByName(row)
    return made.select("version", "time", "partitions", "rows")


def expire(spark: SparkSession, path: str, keep: int = 1, hours: float = 24.0) -> int:
    """Remove data that none of the last ``keep`` versions shows and that is older than ``hours``; how many commits went.

    Versions before those can't be read afterwards; writers that stage for longer than ``hours`` would lose their files.
    """
    known = versions(spark, path)
    p, fs = _fs(spark, f"{path}/data")
    if not known or not fs.exists(p):
        return 0
    shown: set[str] = set()
    for v in known[-keep:]:
        names = partitions(spark, path, v).select(F.substring_index("dir", "/", 1).alias("c")).distinct()
        shown |= {r["c"] for r in names.collect()}  # a name a commit
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in shown and f.getModificationTime() / 1000 < time.time() - 3600 * hours]
    for x in gone:
        fs.delete(x, True)
    return len(gone)
