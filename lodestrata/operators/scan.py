"""Ordered scans over long keys: many tasks a key, joined by small summaries.

``numbered`` sorts rows by range, so a key's rows lie in stretches, one a task; positions inside stretches and the sizes of
the stretches before give row numbers. ``halo`` cuts numbered rows into chunks of equal size and copies the rows at their
sides, so frames of rows are computed chunk by chunk. ``recurrences`` runs v = a * v_before + b: a stretch's rows compose to
one map v -> a * v + b, maps of a key's stretches compose to what enters each, and the stretches are run once more from there.
No key is ever whole in one task, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Rows of a chunk.
CHUNK = 4096


def stretches(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    """``df`` with ``_part`` and ``_at``: stretches in the order of (keys, order), and places within; written once.

    Rows with equal keys and order are in one stretch, in any order, which stays as it is from here on.
    """
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()  # the task in the upper bits, the row's place in it in the lower 33
    return durable(rows.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33).cast("int")))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "_i", tasks: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number within its key, from 0, in order. Null keys are one key."""
    rows = stretches(df, keys, order, tasks)
    held = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for a stretch
    held = held.select(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{j}"))
    return rows.join(held, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def halo(rows: DataFrame, number: str = "_i", size: int = CHUNK, before: int = 0, after: int = 0) -> DataFrame:
    """Numbered rows with ``_chunk`` and ``_own``: chunks of ``size``, each with copies of the rows beside it (``_own`` false).

    The ``before`` rows in front of a chunk and the ``after`` rows behind it are in it, as far as the key has them.
    """
    if max(before, after) > size:
        raise ValueError("a halo can't be wider than a chunk")
    own = F.floor(F.col(number) / size)
    place = F.col(number) - own * size
    copies = F.array(
        F.struct(own.alias("c"), F.lit(True).alias("own")),
        F.when(place >= size - before, F.struct((own + 1).alias("c"), F.lit(False).alias("own"))),
        F.when((place < after) & (own > 0), F.struct((own - 1).alias("c"), F.lit(False).alias("own"))),
    )
    out = rows.withColumn("_x", F.explode(F.array_compact(copies)))
    return out.withColumn("_chunk", F.col("_x.c")).withColumn("_own", F.col("_x.own")).drop("_x")


# --- linear recurrences -----------------------------------------------------------------------------------------------
def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the maps v -> a * v + b, composed in order; by doubling, so errors don't grow with powers of a."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        if not a[step:].any():  # all older values are forgotten
            break
        step *= 2
    return a, b


def _same_as_above(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys are those of the row before, for all rows but the first."""
    same = np.ones(max(0, batch.num_rows - 1), dtype=bool)
    for k in keys:
        code = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same &= code[1:] == code[:-1]
    return same


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple]:
    """``batch, first, maps``: for each batch, whether rows begin a segment (new ``keys``), and composed maps since its start.

    Rows come in order. A batch that goes on with the last one's segment goes on with its maps.
    """
    last, carry = None, {n: (1.0, 0.0) for n in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        head = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        first = np.concatenate([[head != last], ~_same_as_above(batch, keys)])
        maps = {}
        for n in names:
            a, b = (batch.column(batch.schema.get_field_index(f"_{x}_{n}")).to_numpy(zero_copy_only=False).astype(float) for x in "ab")
            a, b = a.copy(), b.copy()
            if not first[0]:
                a[0], b[0] = a[0] * carry[n][0], a[0] * carry[n][1] + b[0]
            maps[n] = _by_segment(a, b, first)
            carry[n] = (maps[n][0][-1], maps[n][1][-1])
        last = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
        yield batch, first, maps


def _by_segment(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``compose`` that starts anew where ``first``; a row is composed with those of its own segment only."""
    n = len(a)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    reach = np.arange(n) - start  # rows before this one in its segment
    a, b, step = a.copy(), b.copy(), 1
    while step < n and (go := np.flatnonzero(reach >= step)).size:
        b[go] += a[go] * b[go - step]
        a[go] = a[go] * a[go - step]
        if not a[go].any():
            break
        step *= 2
    return a, b


def recurrences(
    df: DataFrame, keys: list[str], order: list[str], steps: dict[str, tuple[Column, Column]], start: dict[str, float | str] | None = None, tasks: int | None = None
) -> DataFrame:
    """``df`` with, for each name of ``steps``, the value v = a * v_before + b after its row, and ``<name>_before``.

    ``steps`` has the columns a and b, neither null. A key begins with ``start``: a number, or the name of a column that is
    constant within a key (its nulls and those of other rows too, 0 if a name isn't in ``start``). ``order`` should be total
    within a key; rows that tie come in an order that is fixed once. Keys of any size, null keys included, are one series each.
    """
    names, start = list(steps), start or {}
    columns = {f"_{x}_{n}": c.cast("double") for n, pair in steps.items() for x, c in zip("ab", pair, strict=True)}
    columns |= {f"_s_{n}": (F.col(s) if isinstance(s := start.get(n, 0.0), str) else F.lit(s)).cast("double") for n in names}
    rows = stretches(df.withColumns(columns), keys, order, tasks)
    kinds, kept = dict(rows.dtypes), df.columns
    listed = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    maps = ", ".join(f"_a_{n} double, _b_{n} double, _s_{n} double" for n in names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key of a stretch: its map, from all its rows."""
        held: pa.RecordBatch | None = None
        for batch, first, got in _segments(batches, [*keys, "_part"], names):
            ends = np.flatnonzero(np.append(first[1:], True))
            out = [batch.column(batch.schema.get_field_index(k)).take(pa.array(ends)) for k in [*keys, "_part"]]
            for n in names:
                s = batch.column(batch.schema.get_field_index(f"_s_{n}")).take(pa.array(ends))
                out += [pa.array(got[n][0][ends]), pa.array(got[n][1][ends]), s]
            made = pa.RecordBatch.from_arrays(out, names=[*keys, "_part", *[f"_{x}_{n}" for n in names for x in "abs"]])
            if held is not None:
                yield held.slice(0, held.num_rows - (not first[0]))  # its last key goes on here
            held = made
        if held is not None:
            yield held

    def entering(pdf: pd.DataFrame) -> pd.DataFrame:
        """What enters each stretch of one key; a row for a stretch."""
        pdf = pdf.sort_values("_part")
        out = pdf[[*keys, "_part"]].copy()
        for n in names:
            a, b = compose(pdf[f"_a_{n}"].to_numpy(float), pdf[f"_b_{n}"].to_numpy(float))
            s = pdf[f"_s_{n}"].to_numpy(float)[0]
            out[f"_v_{n}"] = np.concatenate([[s], a[:-1] * s + b[:-1]])
        return out

    read = rows.select(*keys, "_part", *columns, "_at")
    # files of a stretch are read in any number of tasks: sorted anew, each is in one task and in order
    by_part = lambda x: x.repartition("_part").sortWithinPartitions("_part", "_at")
    held = by_part(read).mapInArrow(summed, f"{listed}_part int, {maps}")
    enters = held.groupBy(*keys).applyInPandas(entering, f"{listed}_part int, " + ", ".join(f"_v_{n} double" for n in names))
    other = enters.withColumnsRenamed({k: f"_key{j}" for j, k in enumerate(keys)} | {"_part": "_p"})
    same = F.col("_part") == F.col("_p")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{j}"))
    ready = rows.join(other, same).drop("_p", *[f"_key{j}" for j in range(len(keys))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch, first, got in _segments(batches, [*keys, "_part"], names):
            out = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            for n in names:
                enter = batch.column(batch.schema.get_field_index(f"_v_{n}")).to_numpy(zero_copy_only=False)
                value = got[n][0] * enter + got[n][1]
                before = np.concatenate([[last.get(n, np.nan)], value[:-1]])
                before = np.where(first, enter, before)
                last[n] = value[-1]
                out += [pa.array(value), pa.array(before)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *[x for n in names for x in (n, f"{n}_before")]])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", " + ", ".join(f"{n} double, {n}_before double" for n in names)
    return by_part(ready).mapInArrow(run, schema)


def decay(halflife: float) -> float:
    """The factor by which weights fall in a row."""
    return 0.5 ** (1 / halflife)


def ewm(df: DataFrame, keys: list[str], order: list[str], value: str, halflife: float, adjust: bool = True, least: int = 0, out: str = "ewm") -> DataFrame:
    """``df`` with ``out`` and ``<out>_before``: the exponentially weighted mean up to and with a row, and before it.

    Null values leave it as it is and don't age it; null unless ``least`` values (one at least) were seen. With ``adjust`` it
    is a ratio of decayed sums, without it starts at the first value.
    """
    k, seen, x = decay(halflife), F.col(value).isNotNull(), F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    stay = F.when(seen, F.lit(k)).otherwise(1.0)
    one = F.when(seen, 1.0).otherwise(0.0)
    gain = one if adjust else one * (1 - k)
    steps = {"_sum": (stay, gain * x), "_seen": (F.lit(1.0), one)}
    if adjust:
        steps["_weight"] = (stay, one)
        made = recurrences(df, keys, order, steps)
        ratio = lambda s: F.col(f"_sum{s}") / F.col(f"_weight{s}")
    else:
        # a series that begins with its first value has that value after its first row, too
        first = df.groupBy(*keys).agg(F.min(F.when(seen, F.struct(*order, F.col(value).alias("_v")))).alias("_f"))
        first = first.select(*[F.col(c).alias(f"_key{j}") for j, c in enumerate(keys)], F.col("_f._v").cast("double").alias("_first"))
        same = F.lit(True)
        for j, c in enumerate(keys):
            same &= F.col(c).eqNullSafe(F.col(f"_key{j}"))
        joined = df.join(first, same, "left").drop(*[f"_key{j}" for j in range(len(keys))])
        made = recurrences(joined, keys, order, steps, {"_sum": "_first"})
        ratio = lambda s: F.col(f"_sum{s}")
    enough = max(1, least)
    return made.withColumns({f"{out}{s}": F.when(F.col(f"_seen{s}") >= enough, ratio(s)) for s in ("", "_before")}).select(*df.columns, out, f"{out}_before")
