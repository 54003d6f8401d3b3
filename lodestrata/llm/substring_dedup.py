"""Operator 2, substring dedup: repeated windows of words, found by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among its runs of MINIMISER words; consecutive
windows with the same minimiser travel together, as one string, to the bucket that the minimiser names, so equal windows
always meet. Inside a bucket windows are sorted by a hash of their words, and windows of equal hash are compared byte by
byte: the counts are exact.

Runs that are very common in the whole input, by counters over all documents, are minimisers only of windows that have no
other run; those windows travel alone, by a hash of the whole window. So a phrase that a third of all documents hold, each
in other surroundings, doesn't name a bucket. Strings that a task has twice are repeated for certain: their places are
settled there, and the bucket gets the string alone. The strings of a task that go to the same bucket are one compressed blob.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counters, words
from .common import durable, table

NAME = "op2_substring_dedup"

WINDOW = 35
MINIMISER = 6
#: Buckets for every input partition, and bytes of text that a task packs at a time.
BUCKETS_PER_PARTITION = 8
BATCH_BYTES = 12 << 20
#: A run is common when it occurs more often, and COMMON_RATIO times as often as the mean counter says.
COMMON = 20_000
COMMON_RATIO = 4
_U = np.uint64
_TOP = _U(1 << 63)


def runs_hash(v: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values: a polynomial in an odd multiplier, put together by doubling."""
    base, out, done, power = _U(0x9E3779B97F4A7C15), None, 0, _U(1)
    block, size, step = v, 1, _U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out, done, power = block, size, step
                else:
                    n = len(v) - done - size + 1
                    if n <= 0:
                        return np.zeros(0, dtype=np.uint64)
                    out = out[:n] * step + block[done : done + n]
                    done += size
                    power = power * step
            if done == k:
                break
            n = len(block) - size
            if n <= 0:
                return np.zeros(0, dtype=np.uint64)
            block = block[:n] * step + block[size : size + n]
            step, size = step * step, size * 2
        x = out * base
        return (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def row_key() -> Column:
    """16 bytes for a row, from its id and text: rows that repeat both share it, and are treated alike."""
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.length(text).cast("string"), text, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[bytes]]]:
    """Whole texts of a column, about BATCH_BYTES at a time, and the rows' keys, if the column isn't the first."""
    keys, texts, size = [], [], 0
    for batch in batches:
        of = batch.column(0).to_pylist() if column else [None] * batch.num_rows
        for key, text in zip(of, batch.column(column).to_pylist(), strict=True):
            if text:
                keys.append(key)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def common_runs(docs: DataFrame, m: int, common: int, ratio: float) -> np.ndarray:
    """Which counters are common, over the runs of ``m`` words of all documents: COUNTERS booleans."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters.COUNTERS, dtype=np.uint32)
        for _, texts in _pieces(batches, 0):
            data, starts, ends, _ = words.canonical(texts)
            r = runs_hash(words.hashes(data, starts, ends), m)
            np.add(total, np.bincount(counters.cells(r), minlength=counters.COUNTERS), out=total, casting="unsafe")
        if total.any():
            yield pa.RecordBatch.from_arrays([*counters.packed(total)], names=["part", "counts"])

    tasks = docs.rdd.getNumPartitions()
    seen = counters.counted(counters.scale(docs.select("text").mapInArrow(count, "part int, counts binary"), tasks))
    return seen > max(common, ratio * seen.mean())


def _super_kmers(data, starts, ends, n, window: int, m: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, first window, first byte, last byte) of the super-k-mers of ``words.canonical`` texts, as arrays."""
    none = np.zeros(0, dtype=np.int64)
    if len(starts) < window:
        return none.astype(np.uint64), none, none, none, none
    v = words.hashes(data, starts, ends)
    runs = runs_hash(v, m)
    key = (runs >> _U(1)) | np.where(common[counters.cells(runs)], _TOP, _U(0))
    least = sliding_min(key, window - m + 1)  # one entry a window
    alone = least >= _TOP  # windows of common runs only, by themselves
    if alone.any():
        least[alone] = runs_hash(v, window)[alone] | _TOP
    start = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= start[owner + 1])
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    change = np.ones(len(at), dtype=bool)
    change[1:] = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = at[change]
    last = np.append(at[np.flatnonzero(change)[1:] - 1], at[-1])
    return least[first], owner[first], first - start[owner[first]], starts[first], ends[last + window - 1]


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [first, last) of documents, those that touch or overlap joined."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    wide = int(last.max()) + 2
    reach = np.maximum.accumulate(doc * wide + last)  # documents in order, so the maximum is the document's own
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] * wide + first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], first[at], reach[np.append(at[1:], len(doc)) - 1] - doc[at] * wide


def packed(docs: DataFrame, buckets: int, window: int, m: int, common) -> DataFrame:
    """``bucket, texts, spots``: compressed super-k-mers, and where those that a piece has once occur.

    A row with null ``texts`` holds ranges that are repeated for certain.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = common.value
        for keys, texts in _pieces(batches, 1):
            data, starts, ends, n = words.canonical(texts)
            key, doc, first, lo, hi = _super_kmers(data, starts, ends, n, window, m, rare)
            size = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)  # words
            raw = data.tobytes()
            by: dict = defaultdict(dict)
            for i, (b, x, y) in enumerate(zip((words.mix(key) % _U(buckets)).astype(np.int64).tolist(), lo.tolist(), hi.tolist(), strict=True)):
                by[b].setdefault(raw[x:y], []).append(i)
            out: list[list] = [[], [], []]
            again: list[int] = []
            for b, found in by.items():
                once = np.array([s[0] for s in found.values() if len(s) == 1], dtype=np.int64)
                single = np.array([len(s) == 1 for s in found.values()], dtype=np.uint8)
                again += [i for s in found.values() if len(s) > 1 for i in s]
                used, number = np.unique(doc[once], return_inverse=True)
                out[0].append(b)
                out[1].append(zlib.compress(b"\n".join(found), 2))
                places = zlib.compress(single.tobytes() + np.stack([number, first[once]]).astype("<i4").tobytes(), 1)
                out[2].append(np.array([len(used), len(single)], dtype="<i4").tobytes() + b"".join(keys[d] for d in used) + places)
                if len(out[0]) == 64:
                    yield _batch(out)
                    out = [[], [], []]
            if again:
                i = np.array(again)
                d, a, z = _merged(doc[i], first[i], first[i] + size[i])
                rows = np.empty(len(d), dtype=_RANGE)
                rows["key"], rows["first"], rows["last"] = [keys[x] for x in d], a, z
                out[0].append(int(lo[0] + len(raw)) % buckets)
                out[1].append(None)
                out[2].append(zlib.compress(rows.tobytes(), 1))
            if out[0]:
                yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "texts", "spots"])

    return docs.select(row_key().alias("_key"), "text").mapInArrow(pack, "bucket int, texts binary, spots binary")


_RANGE = np.dtype([("key", "V16"), ("first", "<i4"), ("last", "<i4")])


def repeated_windows(texts: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """Of all windows of the texts, in order, which occur twice or more; a text counts as often as ``counts`` says."""
    data, starts, ends, lengths = words.canonical(texts)
    n = lengths - window + 1
    owner = np.repeat(np.arange(len(lengths)), n)
    at = (np.cumsum(lengths) - lengths)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    h = runs_hash(words.hashes(data, starts, ends), window)[at]
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    flag = counts[owner] > 1
    if equal.any():
        # windows whose hash is another's too: compared byte by byte with the first of that hash, then among themselves
        raw = data.tobytes()
        member = np.zeros(len(h), dtype=bool)
        member[:-1] |= equal
        member[1:] |= equal
        runs = order[member]
        lo, hi, hash_ = starts[at[runs]].tolist(), ends[at[runs] + window - 1].tolist(), h[runs].tolist()
        seen: dict[bytes, int] = {}
        hit, last = [], None
        for i, (x, y, z) in enumerate(zip(lo, hi, hash_, strict=True)):
            if z != last:
                seen, last = {}, z
            j = seen.setdefault(raw[x:y], i)
            if j != i:
                hit += (i, j)
        flag[runs[hit]] = True
    return flag


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    n_keys, n_texts = np.frombuffer(blob[:8], dtype="<i4")
    keys = [blob[8 + 16 * i : 24 + 16 * i] for i in range(n_keys)]
    rest = zlib.decompress(blob[8 + 16 * n_keys :])
    flat = np.frombuffer(rest[n_texts:], dtype="<i4").reshape(2, -1)
    return keys, np.frombuffer(rest[:n_texts], dtype=np.uint8) > 0, flat[0], flat[1]


def covered(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, buckets: int | None = None, common: int = COMMON) -> DataFrame:
    """``_key, ranges``: word ranges [first, last) that repeated windows cover, of the rows that have any."""
    buckets = buckets or max(8, docs.rdd.getNumPartitions() * BUCKETS_PER_PARTITION)
    rare = docs.sparkSession.sparkContext.broadcast(common_runs(docs, m, common, COMMON_RATIO))  # COUNTERS booleans

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        texts: list[bytes] = []
        number: dict[bytes, int] = {}
        blobs, counts = [], []
        out_key, out_lo, out_hi = [], [], []
        for t, s in zip(pdf["texts"], pdf["spots"], strict=True):
            if t is None:
                known = np.frombuffer(zlib.decompress(s), dtype=_RANGE)
                out_key += known["key"].tolist()
                out_lo.append(known["first"])
                out_hi.append(known["last"])
                continue
            keys, single, doc, first = _unpack(s)
            mine = []
            for x, one in zip(zlib.decompress(t).split(b"\n"), single.tolist(), strict=True):
                j = number.setdefault(x, len(texts))
                if j == len(texts):
                    texts.append(x)
                    counts.append(0)
                counts[j] += 1 if one else 2
                if one:
                    mine.append(j)
            blobs.append((keys, np.array(mine, dtype=np.int64), doc, first))
        del number
        if texts:
            flag = repeated_windows(texts, np.array(counts), window)
            n = np.array([t.count(b" ") + 2 - window for t in texts])
            begin = np.cumsum(n) - n
            # runs of flagged windows inside each text
            edge = np.zeros(len(flag) + 1, dtype=bool)
            edge[begin] = True
            up = flag & (edge[:-1] | ~np.concatenate([[False], flag[:-1]]))
            down = flag & (edge[1:] | ~np.concatenate([flag[1:], [False]]))
            lo, hi = np.flatnonzero(up), np.flatnonzero(down)
            owner = np.searchsorted(begin, lo, side="right") - 1
            lo, hi = lo - begin[owner], hi - begin[owner] + window
            per = np.bincount(owner, minlength=len(texts))
            offset = np.cumsum(per) - per
            for keys, text, doc, first in blobs:
                reps = per[text]
                if not reps.sum():
                    continue
                src = np.repeat(np.arange(len(text)), reps)
                k = np.arange(len(src)) - np.repeat(np.cumsum(reps) - reps, reps) + offset[text[src]]
                d, x, y = _merged(doc[src].astype(np.int64), first[src] + lo[k], first[src] + hi[k])
                out_key += [keys[i] for i in d]
                out_lo.append(x)
                out_hi.append(y)
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"_key": out_key, "first": whole(out_lo), "last": whole(out_hi)})

    sent = packed(docs, buckets, window, m, rare).repartition(buckets, "bucket")
    found = sent.groupBy("bucket").applyInPandas(judge, "_key binary, first int, last int")
    # one row of packed ranges for each row of the input
    return found.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, buckets: int | None = None, common: int = COMMON) -> DataFrame:
    """The input's columns, with ``kept`` (its words that stay, joined by one space), ``n_words`` and ``n_removed``.

    A word is removed if any window over it occurs twice or more in the input, the same document included. A null text
    has no words; texts shorter than a window lose nothing; null and repeated ids are rows of their own, and rows that
    repeat id and text count as often as they occur. Input columns named as the added ones are replaced. An empty table
    gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    ranges = durable(covered(docs, window, m, buckets, common))
    joined = docs.select(*keep, row_key().alias("_key")).join(ranges, "_key", "left").select(*keep, "ranges")
    schema = docs.select(*keep).schema.add("kept", "string").add("n_words", "long").add("n_removed", "long")
    at = keep.index("text")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                kept, reached = [], 0
                for s in spans or ():
                    if s["first"] > reached:
                        kept += own[reached : s["first"]]
                    reached = max(reached, s["last"])
                kept += own[reached:]
                out[0].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                out[1].append(len(own))
                out[2].append(len(own) - len(kept))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(remove, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents, windows of 35 words."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
