"""Repeated windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import substring_dedup as sd


def brute(texts, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(texts, brute(texts.values(), 35), strict=True))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize(("k", "m", "common"), [(5, 2, 20_000), (8, 3, 3), (7, 7, 0), (6, 2, 0)])
def test_small_alphabet(spark, k, m, common):
    rng = random.Random(k)
    texts = [None, "", "   ", "a"] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [texts[7]] * 3 + ["x\ty\nz " * 30, "é ü " * 20]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = sd.substring_dedup(docs, k, m, buckets=5, common=common).collect()
    want = brute(texts, k)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got} == dict(enumerate(want))


def test_rows_that_repeat(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + " z"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in sd.substring_dedup(docs).collect()) == [0, 40, 40, 40]
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd, "runs_hash", lambda v, k: np.zeros(max(0, len(v) - k + 1), dtype=np.uint64))
    texts = [b"a b c", b"b c d", b"a b e"]
    flag = sd.repeated_windows(texts, np.ones(3, dtype=int), 2)
    assert flag.tolist() == [True, True, True, False, True, False]


def test_runs_hash():
    v = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 6, 8, 29, 35):
        h = sd.runs_hash(v, k)
        by = {}
        for i in range(len(v) - k + 1):
            assert by.setdefault(tuple(v[i : i + k]), h[i]) == h[i]
        assert len(set(by.values())) == len(by) and len(h) == len(v) - k + 1
        assert (sd.sliding_min(v, k) == [v[i : i + k].min() for i in range(len(v) - k + 1)]).all()


def test_a_common_phrase_in_different_surroundings(spark):
    """One run of six words in very many documents: exact, and no bucket is much larger than the others."""
    phrase = "all rights reserved by the authors"
    rng = random.Random(4)
    texts = [" ".join([*(str(rng.randrange(10**6)) for _ in range(40)), phrase, *(str(rng.randrange(10**6)) for _ in range(40))]) for _ in range(3000)]
    texts += [texts[5], "x " + texts[9][:400]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in sd.substring_dedup(docs, common=100).collect()}
    assert got == dict(enumerate(brute(texts, 35)))
    rare = spark.sparkContext.broadcast(sd.common_runs(docs, 6, 100, 4))
    load = [r["n"] for r in sd.packed(docs, 64, 35, 6, rare).selectExpr("bucket", "length(texts) as n").groupBy("bucket").sum("n").toDF("bucket", "n").collect()]
    assert max(load) < 2 * sorted(load)[len(load) // 2]


def test_merged():
    doc, first, last = sd._merged(np.array([2, 0, 0, 2, 0]), np.array([5, 3, 0, 1, 9]), np.array([9, 6, 4, 5, 10]))
    assert list(zip(doc.tolist(), first.tolist(), last.tolist(), strict=True)) == [(0, 0, 6), (0, 9, 10), (2, 1, 9)]
