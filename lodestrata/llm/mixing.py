"""Operator 5, mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training progress 0..1. The schedule's integral says how many words of the
source training has asked for by then; a document copy that fills words [c, c + size) of its source's stream is trained
at the moment when that demand reaches the middle of its words. Positions come from inverting the integral; a copy whose
middle the demand of the whole training never reaches has no position and isn't taken. The mixture is the copies that have
one, sorted by position.

Prefix sums over a source are taken in two steps, over hash buckets and inside each bucket, so that a source with a
third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, word_count

NAME = "op5_mixing"

#: Weights of the sources in code point order, repeating; share of all words to take; most repeats of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Relative slope of the schedules: a source's weight runs linearly from 1 + slope to 1 - slope times its mean.
SLOPES = (0.5, -0.5, 0.0)
#: Hex digits of the order hash that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3

ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, sum(source_size) OVER () AS total FROM s
), f AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS level,
    coalesce(sum(2 * source_size) OVER o, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight::DOUBLE, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max(CASE WHEN (1.5 * total::DOUBLE - full_before) / open_weight <= level THEN (1.5 * total::DOUBLE - full_before) / open_weight END) AS lam FROM f
), t AS (
  SELECT f.source, f.source_size, f.r, CASE WHEN level <= lam THEN 2.0 * source_size ELSE lam * weight END::DOUBLE AS target FROM f, l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE r % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0.0 END::DOUBLE AS slope,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, md5(coalesce(d.text, ''))
      ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * ((before + size / 2.0 < target)::INT + (source_size + before + size / 2.0 < target)::INT))::BIGINT AS taken,
  CASE WHEN size > 0 AND before + size / 2.0 < target THEN 2 * ((before + size / 2.0) / target)
    / (1 + slope + sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * ((before + size / 2.0) / target), 0.0::DOUBLE))) END AS position_1,
  CASE WHEN size > 0 AND source_size + before + size / 2.0 < target THEN 2 * ((source_size + before + size / 2.0) / target)
    / (1 + slope + sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * ((source_size + before + size / 2.0) / target), 0.0::DOUBLE))) END AS position_2
FROM c
"""


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of the sources: ``share`` of all words by weight, none above ``most`` times its size.

    ``sources`` has one row a source: ``source, source_size``. Capping a source and resharing its excess until none is
    above ends where every target is min(cap, level * weight); sorted by cap / weight, the level is found with one
    running sum. The table has one row a source, so one task handles it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("r") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("r", rank).withColumn("weight", weight)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", "r").rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(Window.partitionBy()) - used
    lam = (F.lit(share) * F.col("total").cast("double") - full) / open_weight
    rows = rows.withColumn("lam", lam)
    rows = rows.withColumn("lam", F.max(F.when(F.col("lam") <= F.col("level"), F.col("lam"))).over(Window.partitionBy()))
    capped = F.col("lam").isNull() | (F.col("level") <= F.col("lam"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("lam") * F.col("weight"))
    return rows.select("source", "source_size", "r", target.alias("target"))


def position(share_done: Column, slope: Column) -> Column:
    """Moment in 0..1 at which the integral of 1 + slope * (1 - 2t) reaches ``share_done`` of its whole.

    The integral is (1 + slope) * t - slope * t**2; its inverse in the form that also holds for slope 0.
    """
    b = 1 + slope
    return 2 * share_done / (b + F.sqrt(F.greatest(b * b - 4 * slope * share_done, F.lit(0.0))))


def _placed(docs: DataFrame, weights, share, most, digits, carry: bool = False) -> DataFrame:
    base = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_o"),
        F.md5(F.coalesce("text", F.lit(""))).alias("_c"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if carry else []),
    )
    # the source as a key without nulls
    base = base.withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # null ids share a hash; they are spread by their texts', between the ids whose hashes are smaller and the others
    within = F.when(F.col("doc_id").isNull(), F.substring("_c", 1, digits)).when(F.col("_o") < F.md5(F.lit("")), "").otherwise("g")
    base = base.withColumn("_b", F.concat(F.substring("_o", 1, digits), F.lit("/"), within))
    cells = base.groupBy("_k", "source", "_b").agg(F.sum("size").alias("_n"))
    run = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    sources = cells.groupBy("_k", "source").agg(F.sum("_n").alias("source_size"))
    targets = water_fill(sources.drop("_k"), weights, share, most)
    targets = targets.withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    offsets = cells.select("_k", "_b", "_before").join(targets, "_k")
    rows = base.join(offsets, ["_k", "_b"])
    inside = Window.partitionBy("_k", "_b").orderBy("_o", "doc_id", "_c").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("before", F.col("_before") + F.sum("size").over(inside) - F.col("size"))


def _positioned(docs: DataFrame, weights, slopes, share, most, digits, carry: bool = False) -> DataFrame:
    """Rows with ``positions``: array of struct<copy, position> of the copies that the source's demand reaches."""
    rows = _placed(docs, weights, share, most, digits, carry)
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("r") % len(slopes) + 1).cast("int"))

    def trained(p: int) -> Column:
        middle = p * F.col("source_size") + F.col("before") + F.col("size") / 2.0
        at = F.when((F.col("size") > 0) & (middle < F.col("target")), position(middle / F.col("target"), slope))
        return F.struct(F.lit(p).alias("copy"), at.alias("position"))

    copies = F.array(*[trained(p) for p in range(most)])
    return rows.withColumn("positions", F.filter(copies, lambda c: c["position"].isNotNull()))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: int = MOST, digits: int = BUCKET_DIGITS, partitions=None) -> DataFrame:
    """One row per document, in the order of training: ``doc_id, size, source_size, target, taken, position_1, ...``.

    A source's stream is its documents in the order of a hash of their ids, again and again up to ``most`` times. The
    copies that are taken are those with a position in the curriculum, ``position_1`` to ``position_<most>``, null for
    copies that aren't taken. The schedule's whole demand is the source's target, so what is taken differs from it by half
    a document at most. Rows are sorted by range of the first position; those not taken come last. Null sources are one
    source, ordered last; a null text has size 0 and is never taken; a null id hashes as an empty one; rows that repeat an
    id are ordered by their text. Extra columns are ignored, an empty table gives an empty result.
    """
    rows = _positioned(docs, weights, slopes, share, most, digits)
    taken = F.col("size") * F.size("positions")
    out = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *[F.get("positions", F.lit(p))["position"].alias(f"position_{p + 1}") for p in range(most)])
    return _ranged(out, [F.col("position_1").asc_nulls_last(), F.col("doc_id").asc()], partitions)


def _ranged(rows: DataFrame, order: list, partitions) -> DataFrame:
    """Rows sorted by range. They are written first, so that finding the ranges doesn't compute them a second time."""
    return _sorted(durable(rows), order, partitions)


def _sorted(rows: DataFrame, order: list, partitions) -> DataFrame:
    return (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)


def curriculum(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share=SHARE, most=MOST, digits=BUCKET_DIGITS, partitions=None) -> DataFrame:
    """The mixture itself: the input's columns, ``copy`` (0, 1, ...) and ``position`` in 0..1, sorted by position.

    One row for every copy that ``mix`` takes; an input that has columns ``copy`` or ``position`` loses them. The result
    is sorted by range, so that file k holds the k-th stretch of training. Edge cases are those of ``mix``.

    Whole rows are shuffled twice, to their buckets and to their places, and not written in between: finding the ranges
    reads the buckets' shuffle a second time.
    """
    rows = _positioned(docs, weights, slopes, share, most, digits, carry=True).withColumn("_p", F.explode("positions"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("copy", "position")]
    return _sorted(rows.select(*kept, "_p.copy", "_p.position"), ["position", "copy", "doc_id"], partitions)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 3, 1, 2 repeating, 150 % of all words, no source above twice its size.

    The first source's share falls over training, the second's rises, the third's stays, repeating.
    """
    return mix(table(spark, sf_dir, "documents"))
