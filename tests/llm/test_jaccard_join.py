"""Near-duplicate components against brute force."""

import random
import re

import pytest

from lodestrata.llm import jaccard_join as jj


def brute(rows, k=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: (len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def corpus(seed, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "Ünder one two three four five"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))] for _ in range(6)]
    for base in bases:
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w if rng.random() < 0.7 else w + line))
        texts += [" ".join(base)] * 3
    texts += [" ".join(line + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))]) for _ in range(30)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "edits", "few", "together", "tile"), [(1, 3, 2, 10, 3), (2, 5, 6, 50_000, 512), (3, 2, 3, 2, 8), (4, 12, 2, 20, 5)])
def test_planted(spark, seed, edits, few, together, tile):
    rows = corpus(seed, edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(docs, few=few, blocks=7, together=together, tile=tile).collect()}
    assert got == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, h string, cls string"
    assert jj.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", "", ""), (None, "a b c", "", ""), (4, "a b c", "", ""), (4, "a b c", "", ""), (5, None, "", "")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jj.jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 4), (0, 4), (4, 4), (4, 4), (5, 5)]
    assert jj.near_dedup(spark.createDataFrame(rows, schema)).count() == 2


def test_template_family_below_the_threshold(spark):
    """Pages of one template that aren't near duplicates share long columns; a few true pairs hide among them."""
    rng = random.Random(9)
    frame = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join([*frame, *(str(rng.randrange(10**6)) for _ in range(30))])) for i in range(400)]
    rows += [(1000 + i, t + " end") for i, t in rows[::40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(docs, together=100, tile=32).collect()}
    assert got == brute(rows)
    assert sum(c != d for d, (_, c) in got.items()) == 10


def test_hub(spark):
    """One class with thousands of neighbours that aren't linked otherwise, and labels that meet on one component."""
    edges = spark.range(20_000).selectExpr("cast('h' as binary) as x", "cast(concat('z', id) as binary) as y")
    got = jj.components(edges)
    assert got.count() == 20_001 and got.where("label != cast('h' as binary)").isEmpty()
