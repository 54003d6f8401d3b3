"""SimHash components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from lodestrata.llm import simhash as sh


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute(ids, prints, distance=3):
    """Smallest reachable ids."""
    label = np.array(ids, dtype=float)
    f = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            return label.astype(int).tolist()
        label = new


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "Été x y z", "a\x1cb c d e", "x " * 100_000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 400))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in sh.near_components(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    assert got == dict(enumerate(zip(prints, brute(range(len(texts)), prints), strict=True)))
    assert 10 < len({c for _, c in got.values()}) < len(texts)


@pytest.mark.parametrize(("many", "distance"), [(2048, 3), (8, 3), (1, 3), (4, 2), (4, 1)])
def test_links(spark, many, distance):
    """Planted neighbours, a chain, and a family that shares most of its bits, so that keys are cut again."""
    rng = random.Random(many)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [flip(p, n) for p in prints for n in (1, 2, 3, 4)]
    chain = [rng.getrandbits(64)]
    for _ in range(25):
        chain.append(flip(chain[-1], distance))
    family = [(0xABCDEF << 40) | rng.getrandbits(16) for _ in range(300)]
    family += [(0x123456 << 40) | sum(1 << 3 * b for b in range(13) if rng.random() < 0.5) for _ in range(300)]
    prints = sorted({*prints, *chain, *family, 0, 2**64 - 1})
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    keys = sh.keyed(df, distance, many)
    most = keys.groupBy("m", "v").count().agg({"count": "max"}).first()[0]
    assert most <= max(many, 1 << sh.OPEN)
    found = sh.links(keys, 5, distance).collect()
    assert len(found) <= keys.count()
    label = {p: p for p in prints}
    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for r in found:
        a, b = top(r["x"] % 2**64), top(r["y"] % 2**64)
        label[max(a, b)] = min(a, b)
    want = brute(range(len(prints)), prints, distance)
    assert [prints.index(top(p)) for p in prints] == want


def test_masks_meet():
    rng = random.Random(3)
    first = sh.first_masks(3)
    assert len(first) == 20
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        masks = [m for m in first if not x & m]
        assert masks
        while fine := sh.next_masks(masks, 3):
            deeper = [b for _, b in fine if not x & b]
            assert {a for a, b in fine if not x & b} == {a for a, _ in fine}
            masks = deeper[:3]
    deepest = first
    while fine := sh.next_masks(deepest, 3):
        deepest = [b for _, b in fine]
    assert all(64 - m.bit_count() <= sh.OPEN for m in deepest) and len(deepest) <= 1280


def test_edges(spark):
    schema = "doc_id long, text string, fp string, label string"
    assert sh.near_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", "", ""), (None, "q r s t", "", ""), (4, "a b c", "", ""), (4, "a b c", "", ""), (5, None, "", ""), (3, "  ", "", "")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in sh.near_components(docs).collect())
    assert got == [(0, 0), (0, 4), (3, 3), (4, 4), (4, 4), (5, 3)]
