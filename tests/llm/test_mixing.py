"""Targets by plain resharing, and what the mixture takes."""

import hashlib
import itertools
import os
import random
import re
from collections import defaultdict

import pytest

from lodestrata.llm import common, mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight; cap; reshare the excess among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def corpus(seed):
    rng = random.Random(seed)
    sources = [None, "b", "a", "ä", "z", "", "one"][: 2 + seed]
    return [(i, None if i % 17 == 0 else "w " * rng.randrange(0, 40), sources[min(len(sources) - 1, int(rng.expovariate(1)))]) for i in range(600)]


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_mix(spark, seed):
    rows = corpus(seed)
    size = {d: len(re.findall(r"\S+", t or "")) for d, t, _ in rows}
    by = defaultdict(int)
    for d, _, s in rows:
        by[s] += size[d]
    want = targets(by)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 20
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())


def test_curriculum(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, position string")
    mixed = mixing.mix(docs, partitions=3).collect()
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixed}
    out = mixing.curriculum(docs, partitions=4).collect()
    times = defaultdict(int)
    for r in out:
        times[r["doc_id"]] += 1
    assert {d: (s * times[d]) for d, (s, t) in taken.items()} == {d: t for d, (s, t) in taken.items()}
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    assert all(0 <= r["position"] <= 1 for r in out)
    # a document's positions are those of its copies, and the documents come in the order of the first
    at = defaultdict(list)
    for r in out:
        at[r["doc_id"]].append(r["position"])
    assert all([r["position_1"], r["position_2"]] == (at[r["doc_id"]] + [None, None])[:2] for r in mixed)
    first = [2.0 if r["position_1"] is None else r["position_1"] for r in mixed]
    assert first == sorted(first)
    # by position t a source has taken what the integral of its weights asks for, but for parts of documents
    slopes = dict(zip(sorted({r["source"] for r in out if r["source"] is not None}, key=str.encode), itertools.cycle(mixing.SLOPES)))
    source = {r[0]: r[2] for r in rows}
    for s, slope in slopes.items():
        target = next(r["target"] for r in mixed if source[r["doc_id"]] == s)
        for t in (0.1, 0.3, 0.7, 0.95):
            words = sum(taken[r["doc_id"]][0] for r in out if r["source"] == s and r["position"] < t)
            assert abs(words - target * ((1 + slope) * t - slope * t * t)) <= 20
    # the second source's schedule rises, so its first half holds less than half of its copies
    second = [r["position"] for r in out if r["source"] == "a"]
    assert sum(p < 0.5 for p in second) < len(second) / 2


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.curriculum(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None), (1, "", "a"), (1, "", "a")]
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame(rows, schema)).collect()] == [0, 0, 0]


def test_null_ids_are_placed_as_one_hash(spark):
    rng = random.Random(3)
    rows = [(None if i % 2 else str(i), "w " * rng.randrange(1, 30), "a") for i in range(500)] + [("", "x y", "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    before, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (md5(r[0] or ""), r[0] is not None, r[0] or "", md5(r[1]))):
        n = len(t.split())
        want.append((d or "-", n, before))
        before += n
    target = got[0]["target"]
    assert sorted((r["doc_id"] or "-", r["size"], r["taken"]) for r in got) == sorted((d, n, n * sum(b + n / 2 + p * before < target for p in (0, 1))) for d, n, b in want)


def test_curriculum_writes_no_texts_on_its_way(spark):
    rows = [(*r, "x") for r in corpus(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    folder = common.shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = mixing.curriculum(docs, partitions=4)
    got = out.collect()
    assert set(os.listdir(folder) if os.path.isdir(folder) else ()) == before
    assert sorted(r["position"] for r in got) == [r["position"] for r in got]
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert all(mixed[r["doc_id"]][f"position_{r['copy'] + 1}"] == r["position"] for r in got)
    assert len(got) == sum((r["position_1"] is not None) + (r["position_2"] is not None) for r in mixed.values())
