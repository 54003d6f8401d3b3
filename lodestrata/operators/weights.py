"""Checks of target weights before they are used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(rules: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def validate_headers(headers: DataFrame, now: Column, schema: int = 1, book: str | None = None, late: str = "interval 30 minutes", early: str = "interval 5 minutes") -> DataFrame:
    """``violations`` of files' headers: schema, book, ``valid_from, valid_to`` (half an hour early is fine), ``produced_at``."""
    rules = {
        "schema": ~F.col("schema").eqNullSafe(F.lit(schema)),
        **({"book": ~F.col("book").eqNullSafe(F.lit(book))} if book else {}),
        "window": F.coalesce((now < F.col("valid_from") - F.expr(late)) | (now > F.col("valid_to")), F.lit(True)),
        "stale": F.coalesce(now - F.expr(late) > F.col("produced_at"), F.lit(True)),
        "future": F.coalesce(F.col("produced_at") > now + F.expr(early), F.lit(False)),
    }
    return headers.withColumn("violations", _named(rules))


def validate_weights(weights: DataFrame, previous: DataFrame, key: str, cap: float = 0.25, gross: float = 1.5, net: float = 0.5, names: int = 100, change: float = 0.5) -> DataFrame:
    """``key, n, gross, net, change, violations`` of every file of weights, violations comma-joined in a fixed order.

    ``weights``: key, asset, weight, in_universe, listed; ``previous``: key (of the later file), asset, weight. Names of
    either file count for the change, absent ones as zero; without a previous file there is none. A file that only the
    previous one knows isn't judged. Null weights and NaN aren't finite.
    """
    old = previous.select(F.col(key).alias("_k"), F.col("asset").alias("_a"), F.col("weight").alias("_old"))
    new = weights.select(key, "asset", "weight", "in_universe", "listed").withColumn("_new", F.lit(True))
    both = new.join(old, (F.col(key) == F.col("_k")) & (F.col("asset") == F.col("_a")), "full").withColumn(key, F.coalesce(key, "_k"))
    w, is_new = F.col("weight"), F.coalesce("_new", F.lit(False))
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) < math.inf)
    used = F.when(finite, w).otherwise(0.0)
    out = both.groupBy(key).agg(
        F.count_if(is_new).alias("n"),
        F.count_if(is_new & ~finite).alias("_bad"),
        F.max(F.abs(used)).alias("_most"),
        F.count_if(is_new & ~F.coalesce("in_universe", F.lit(False))).alias("_out"),
        F.count_if(is_new & ~F.coalesce("listed", F.lit(False))).alias("_unlisted"),
        F.sum(F.abs(used)).alias("gross"),
        F.sum(used).alias("net"),
        F.count("_k").alias("_olds"),
        F.sum(F.abs(used - F.coalesce("_old", F.lit(0.0)))).alias("_change"),
    )
    out = out.where("n > 0").withColumn("change", F.when(F.col("_olds") > 0, F.col("_change")))
    rules = {
        "finite": F.col("_bad") > 0,
        "cap": F.col("_most") > cap,
        "universe": F.col("_out") > 0,
        "listed": F.col("_unlisted") > 0,
        "gross": F.col("gross") > gross,
        "net": F.abs("net") > net,
        "names": F.col("n") > names,
        "change": F.coalesce(F.col("change") > change, F.lit(False)),
    }
    return out.select(key, "n", "gross", "net", "change", _named(rules).alias("violations"))
