"""Operator 10, language ID: nearest of several TF-IDF centroids per language, by cosine, with distance-based rejection.

Features are byte trigrams of the lower-cased text, hashed to DIMENSIONS bins. Document frequencies come from all training
rows; the centroids are fitted by spherical k-means on at most SAMPLE training rows a language, those with the smallest
hashes of their ids. What reaches every task is DIMENSIONS weights and CENTROIDS vectors a language.

A document is rejected when its best cosine lies too far below those of the training rows of that language and about that
length: cosines of all training rows are counted by language, length and value, and the cut is SLACK times the QUANTILE of
the lengths around the document's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

NAME = "op10_language_id"

DIMENSIONS = 4096
CENTROIDS = 3
#: Training rows a language that the centroids are fitted on, at most.
SAMPLE = 400
#: Lengths (their numbers of binary digits) are pooled until they have ENOUGH rows.
SLACK = 0.8
QUANTILE = 0.001
ENOUGH = 100
LENGTHS = 32
BINS = 1000
_BYTES = 1 << 20


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of consecutive texts: counts[i, d] is how often text i has a trigram of bin d. Whole texts."""
    data = [b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    lo = 0
    while lo < len(data):
        hi, size = lo, 0
        while hi < len(data) and hi - lo < 128 and (hi == lo or size + len(data[hi]) <= _BYTES):
            size += len(data[hi])
            hi += 1
        b = np.frombuffer(b"".join(data[lo:hi]), dtype=np.uint8).astype(np.uint32)
        codes = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761) >> np.uint32(20)
        size = np.array([len(x) for x in data[lo:hi]])
        owner = np.repeat(np.arange(hi - lo, dtype=np.int64) * DIMENSIONS, size)
        own = np.ones(len(b), dtype=bool)  # the last two places of a text begin no trigram of it
        own[np.cumsum(size) - 1] = own[np.cumsum(size) - 2] = False
        cells = np.bincount(owner[own] + codes[own[:-2]], minlength=(hi - lo) * DIMENSIONS)
        yield lo, cells.reshape(hi - lo, DIMENSIONS)
        lo = hi


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bin occurs, over all rows; and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, c in _blocks(batch.column(0).to_pylist()):
                total += (c > 0).sum(axis=0)
        d = np.append(np.arange(DIMENSIONS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(np.append(total, rows), pa.int64())], names=["d", "n"])

    rows = texts.mapInArrow(count, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    got = {r["d"]: r["n"] for r in rows}
    return np.array([got.get(d, 0) for d in range(DIMENSIONS)], dtype=np.float64), got.get(-1, 0)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, so the result depends on the rows only."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].sum(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return c


def fit(training: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """Model from rows ``doc_id, text, lang``: rows with a null text or lang, or without letters, are left out."""
    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    by = Window.partitionBy("lang").orderBy("_o", "doc_id")
    chosen = rows.select("lang", "text", "doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)).alias("_o"))
    # the smallest hashes of a language lie below a few times its share; so little more than the sample is sorted
    share = F.lit(1.0)
    for r in rows.groupBy("lang").count().collect():  # a row a language
        share = F.when(F.col("lang") == r["lang"], min(1.0, (3 * sample + 50) / r["count"])).otherwise(share)
    chosen = chosen.where(F.col("_o") <= share)
    chosen = chosen.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= sample).select("lang", "text")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([_vectors(c, idf) for _, c in _blocks(list(pdf["text"]))])
        c = _cluster(x, centroids)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(c.astype(np.float32))})

    found = chosen.groupBy("lang").applyInPandas(train, "lang string, centroid array<float>").collect()
    found = sorted(found, key=lambda r: r["lang"])
    model = {
        "idf": idf,
        "langs": [r["lang"] for r in found],
        "centroids": np.array([r["centroid"] for r in found], dtype=np.float32).reshape(len(found), DIMENSIONS),
    }
    return model | {"low": cuts(rows, model)}


def cuts(rows: DataFrame, model: dict) -> np.ndarray:
    """For each centroid and length, the QUANTILE of the best cosines of all rows that are nearest to their own language.

    Rows of all centroids of a language count together, and of shorter texts as well, until they are ENOUGH; of longer ones
    only where there are none as short. Shorter texts have lower cosines, so this errs on the side of keeping; so does half
    the value where there aren't ENOUGH at all.
    """
    langs, c = model["langs"], model["centroids"]
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs], dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), LENGTHS, BINS + 1), dtype=np.int64)
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), np.array([names.index(x) for x in batch.column(1).to_pylist()])
            for lo, counts in _blocks(texts):
                near = _vectors(counts, model["idf"]) @ c.T
                best, cosine, length = of[near.argmax(axis=1)], np.clip(near.max(axis=1), 0, 1), _lengths(texts[lo : lo + len(near)])
                ok = best == own[lo : lo + len(near)]
                np.add.at(total, (best[ok], length[ok], (cosine[ok] * BINS).astype(int)), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in at), pa.array(total[at])], names=["lang", "length", "bin", "n"])

    seen = np.zeros((len(names), LENGTHS, BINS + 1), dtype=np.int64)
    if names:
        counted = rows.select("text", "lang").mapInArrow(count, "lang long, length long, bin long, n long")
        for r in counted.groupBy("lang", "length", "bin").agg(F.sum("n").alias("n")).collect():  # a row a cell, at most
            seen[r["lang"], r["length"], r["bin"]] = r["n"]
    low = np.zeros((len(names), LENGTHS))
    for i in range(len(names)):
        for k in range(LENGTHS):
            lo, hi = k, k + 1
            while lo and seen[i, lo:hi].sum() < ENOUGH:
                lo -= 1
            while hi < LENGTHS and not seen[i, lo:hi].any():
                hi += 1
            run = np.cumsum(seen[i, lo:hi].sum(axis=0))
            value = np.searchsorted(run, QUANTILE * run[-1], side="right") / BINS if run[-1] else 0.0
            low[i, k] = value if run[-1] >= ENOUGH else value / 2
    return low[of] if len(of) else low


def _lengths(texts: list[str]) -> np.ndarray:
    return np.array([min(len(t).bit_length(), LENGTHS - 1) for t in texts], dtype=np.int64)


def predict(docs: DataFrame, model: dict, slack: float = SLACK) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to the input, of which columns so named are replaced.

    ``score`` is the cosine of the nearest centroid, cut to 0..1; ties go to the language first by name. A null text, one
    without letters, or any text when nothing was learned is ``und`` with score 0 and rejected. Whole texts count.
    """
    langs, c, low = model["langs"], model["centroids"], model["low"] * slack
    keep = [x for x in docs.columns if x not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    text_at, letters = keep.index("text"), len(keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            has = np.array(batch.column(letters).to_pylist(), dtype=bool)
            pred, score, out = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            at = np.flatnonzero(has) if langs else np.zeros(0, dtype=int)
            for lo, counts in _blocks([texts[i] for i in at]):
                near = _vectors(counts, model["idf"]) @ c.T
                best, rows = near.argmax(axis=1), at[lo : lo + len(near)]
                pred[rows] = best
                score[rows] = np.clip(near[np.arange(len(near)), best], 0, 1)
                out[rows] = score[rows] < low[best, _lengths([texts[i] for i in rows])]
            columns = [batch.column(i) for i in range(letters)]
            columns += [pa.array([langs[p] if p >= 0 else "und" for p in pred], pa.string()), pa.array(score), pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    return docs.select(*keep, has).mapInArrow(label, schema)


def held_out() -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with predictions of a model that has learned from all its rows that aren't held out."""
    return predict(docs, fit(docs.where(~held_out()).select("doc_id", "text", "lang")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
