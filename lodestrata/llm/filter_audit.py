"""Operator 12, filter interaction audit: direct relational replay of filters in every order.

A document becomes five flags (which filters it fails) in one pass over the texts. Documents' flags are crossed with the
broadcast orders of the filters, of which there are 120 whatever the input, the first failing step of each order is found,
the steps are exploded, and one grouping by part, order and step counts everything. That grouping combines inside the tasks
first, so a task sends 600 rows for each part that it holds, and a part with a third of all documents is no skew.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, join_counted, table

NAME = "op12_filter_audit"

#: Letters of the filters, in the order of their flags.
FILTERS = "ABCDE"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s
), o AS (
  SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.s NOT IN (b.s, c.s, d.s, e.s) AND b.s NOT IN (c.s, d.s, e.s) AND c.s NOT IN (d.s, e.s) AND d.s <> e.s
), p AS (
  SELECT part, filter_order, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(list_filter(fails, lambda y: y)) AS n_fails,
         list_transform([1, 2, 3, 4, 5], lambda i: fails[ascii(filter_order[i]) - 64]) AS f,
  FROM f LEFT JOIN l USING (doc_id), o
), r AS (
  SELECT *, coalesce(list_position(f, true), 6) AS first FROM p
), g AS (
  SELECT part, filter_order, step, filter_order[step] AS letter,
         count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (f[step] AND first < step) AS redundant,
         count(*) FILTER (f[step] AND n_fails = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r) GROUP BY 1, 2, 3
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on a text that isn't null, by letter; repeated texts (E) need the table and aren't here."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, fails (array<boolean>, by FILTERS), good, toxic`` of every document.

    Texts are compared by their SHA-256. A null source is the part '', a null text an empty text. A null id is no smaller
    and no larger than any other, so its row doesn't fail E; rows that share the smallest id of a text all pass. A document
    is good or toxic if any of its labels says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    own = conditions(F.col("_t"))
    read = durable(base.select("doc_id", "part", F.array(*[own[x] for x in FILTERS[:-1]]).alias("_own"), F.unhex(F.sha2("_t", 256)).alias("_h")))
    first = read.groupBy("_h").agg(F.min("doc_id").alias("_min"), F.count("*").alias("_n")).where("_n > 1")
    known = join_counted(read, first, "_h", "_n", read.count())
    repeats = F.coalesce(F.col("doc_id") > F.col("_min"), F.lit(False))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = known.join(said, F.col("doc_id") == F.col("_id"), "left")
    return joined.select(
        "doc_id", "part", F.concat("_own", F.array(repeats)).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def orders(spark: SparkSession) -> DataFrame:
    """``filter_order, places``: all orders of FILTERS, and where in ``fails`` each step looks."""
    rows = [("".join(FILTERS[i] for i in p), [i + 1 for i in p]) for p in permutations(range(len(FILTERS)))]
    return spark.createDataFrame(rows, "filter_order string, places array<int>").coalesce(1)


def replay(flagged: DataFrame) -> DataFrame:
    """One row per part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``, counts of documents.

    ``flagged`` is a table of ``part, fails, good, toxic``; other columns are ignored. Every part gives all its rows, zeros
    included; an empty table gives none.
    """
    spark = flagged.sparkSession
    size = len(FILTERS)
    crossed = flagged.select("part", "fails", "good", "toxic", F.size(F.filter("fails", lambda x: x)).alias("n_fails")).join(F.broadcast(orders(spark)))
    at = F.transform("places", lambda i: F.element_at("fails", i))
    crossed = crossed.select("part", "filter_order", "good", "toxic", "n_fails", at.alias("at"))
    first = F.array_position("at", True)  # 0: no filter fails
    crossed = crossed.withColumn("first", F.when(first == 0, size + 1).otherwise(first).cast("int"))
    steps = crossed.select("part", "filter_order", "good", "toxic", "n_fails", "first", F.posexplode("at").alias("before", "fails"))
    steps = steps.withColumn("step", F.col("before") + 1)
    here = F.col("first") == F.col("step")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counted = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count(F.col("fails") & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("fails") & (F.col("n_fails") == 1)).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Replay of the five filters in all 120 orders, see ``flags`` and ``replay``.

    Repeated rows are documents of their own, labels of unknown documents and extra columns are ignored, whole texts are
    read, and an empty table gives an empty result.
    """
    return replay(flags(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
