"""Operator 13, SimHash near-dedup: pigeonhole blocks, joined, then verified by Hamming distance.

A fingerprint's 64 bits are cut into twice as many parts as bits may differ. Fingerprints within that distance agree on half
of the parts at least, so every choice of half of them is a key (20 keys of some 32 bits for three differing bits), under
which close pairs meet. The join runs over distinct fingerprints only, in blocks of keys; distances are counted inside a
block, and a block returns for each key a forest of its links, never more rows than it has, as only components are asked for.

A key that very many fingerprints share is cut again: of the bits that it leaves open, cut into one part more than bits may
differ, one part agrees. That is repeated until a key leaves 14 bits open or few fingerprints share it, so no key holds more
than 2^14 fingerprints whatever the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, join_counted, table
from .jaccard_join import components
from .words import canonical

NAME = "op13_simhash"

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Keys with more fingerprints are cut again, while they leave more than OPEN bits.
MANY, OPEN = 2048, 14
#: Rows of a block of keys, about.
PER_BLOCK = 200_000
#: Bytes of whole texts, and shingles, that are taken at a time.
_CHUNK, _SHINGLES = 1 << 21, 255 << 8


def _majority(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, summed in bytes first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(texts: list[bytes], k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each whole text over its shingles of ``k`` words, repeats included, A-Z lower-cased; 0 without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    data, starts, ends, n = canonical([t.lower() for t in texts])  # of bytes, lower() changes A-Z only
    blob, hashed, at = data.tobytes(), xxhash.xxh64_intdigest, 0
    for i, words in enumerate(n.tolist()):
        if words:
            size = min(k, words)
            ones, m = np.zeros(BITS, dtype=np.int64), words - size + 1
            for lo in range(at, at + m, _SHINGLES):
                hi = min(lo + _SHINGLES, at + m)
                spans = zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist(), strict=True)
                ones += _majority(np.array([hashed(blob[s:e], seed) for s, e in spans], dtype=np.uint64))
            out[i] = np.packbits(2 * ones > m, bitorder="little").view("<u8")[0]
        at += words
    return out


def read(docs: DataFrame, k: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every document; fingerprints as signed 64-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            sizes = np.cumsum([0, *(len(t) for t in texts.to_pylist())])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + _CHUNK, side="right")) - 1)
                fp = fingerprints(texts.slice(lo, hi - lo).to_pylist(), k, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
                lo = hi

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _parts(mask: int, parts: int) -> list[int]:
    """The set bits of a mask, cut into parts of nearly equal size."""
    places = [i for i in range(BITS) if mask >> i & 1]
    return [sum(1 << int(i) for i in x) for x in np.array_split(places, parts)]


def first_masks(distance: int) -> list[int]:
    """Masks of which any two numbers that differ in ``distance`` bits or fewer agree on one at least."""
    parts = _parts((1 << BITS) - 1, 2 * distance)
    return [sum(x) for x in combinations(parts, distance)]


def next_masks(masks: list[int], distance: int) -> list[tuple[int, int]]:
    """``mask, finer mask``: numbers that agree on the mask and differ in ``distance`` bits or fewer agree on a finer one."""
    return [(m, m | p) for m in masks if BITS - m.bit_count() > OPEN for p in _parts(~m & (1 << BITS) - 1, distance + 1)]


def keyed(prints: DataFrame, distance: int = DISTANCE, many: int = MANY) -> DataFrame:
    """``fp, m, v``: fingerprints under their keys (a mask and the bits under it), with at most ``many`` or 2^OPEN each."""
    spark = prints.sparkSession
    masks = first_masks(distance)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m"))
    out = None
    while True:
        rows = rows.withColumn("v", F.col("fp").bitwiseAND(F.col("m")))
        finer = next_masks(masks, distance)
        if not finer:
            return rows if out is None else out.union(rows)
        steps = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in finer], "m long, finer long")  # fixed, below 2,000 rows
        shared = rows.groupBy("m", "v").agg(F.count("*").alias("n")).where(F.col("n") > many)
        hot = durable(shared.join(F.broadcast(steps), "m", "left_semi").select("m", "v"))  # masks that leave few bits aren't cut
        if hot.isEmpty():
            return rows if out is None else out.union(rows)
        few = rows.join(hot, ["m", "v"], "left_anti").select("fp", "m", "v")
        out = few if out is None else out.union(few)
        rows = durable(rows.join(hot, ["m", "v"], "left_semi").join(F.broadcast(steps), "m").select("fp", F.col("finer").alias("m")))
        masks = [b for _, b in finer]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _close(f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one key's fingerprints within the distance, a stretch of rows at a time."""
    first, second = [], []
    step = max(1, (1 << 20) // len(f))
    for lo in range(0, len(f), step):
        i, j = np.nonzero(np.bitwise_count(f[lo : lo + step, None] ^ f[None, lo:]) <= distance)
        ok = i < j
        first.append(lo + i[ok])
        second.append(lo + j[ok])
    return np.concatenate(first), np.concatenate(second)


def links(rows: DataFrame, blocks: int, distance: int = DISTANCE) -> DataFrame:
    """``x, y``: for each key a forest of the links between its fingerprints."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, v, f = (pdf[c].to_numpy().view(np.uint64) for c in ("m", "v", "fp"))  # bits of signed numbers aren't counted
        order = np.lexsort((f, v, m))
        m, v, f = m[order], v[order], f[order]
        head = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (v[1:] != v[:-1])]))
        size = np.diff(np.append(head, len(f)))
        two = head[size == 2]
        ok = np.bitwise_count(f[two] ^ f[two + 1]) <= distance
        xs, ys = [f[two][ok]], [f[two + 1][ok]]
        for lo, s in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = f[lo : lo + s]
            i, j = _close(own, distance)
            if len(i):
                low = _forest(s, i, j)
                moved = low != np.arange(s)
                xs.append(own[low[moved]])
                ys.append(own[moved])
        return pd.DataFrame({"x": np.concatenate(xs).view(np.int64), "y": np.concatenate(ys).view(np.int64)}).drop_duplicates()

    block = F.pmod(F.xxhash64("m", "v"), F.lit(blocks))
    return rows.withColumn("block", block).groupBy("block").applyInPandas(run, "x long, y long")


def near_components(docs: DataFrame, k: int = WORDS, distance: int = DISTANCE, many: int = MANY, blocks: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Fingerprints link when ``distance`` bits or fewer differ; ``component_id`` is the smallest id reachable by links, the
    document's own included. Null and empty texts and texts without words have fingerprint 0 and link like any other. Null
    ids are never the smallest, and a component of null ids only has a null component_id. Repeated rows and ids are rows of
    their own; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = durable(read(docs, k))
    classes = durable(rows.groupBy("fp").agg(F.count("*").alias("_count"), F.min("doc_id").alias("_min")))
    n = classes.count()
    if distance and n > 1:
        keys = keyed(classes.select("fp"), distance, many)
        blocks = blocks or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), len(first_masks(distance)) * n // PER_BLOCK)
        labels = components(durable(links(keys, blocks, distance).distinct()))
        classes = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
    else:
        classes = classes.withColumn("label", F.lit(None).cast("long"))
    classes = durable(classes.withColumn("label", F.coalesce("label", "fp")))
    lowest = classes.groupBy("label").agg(F.min("_min").alias("component_id"), F.count("*").alias("_size"))
    groups = join_counted(classes, lowest, "label", "_size", n).select("fp", "component_id", "_count")
    return join_counted(rows, groups, "fp", "_count", rows.count()).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three words, three bits."""
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
