"""Exact dedup with forced hash collisions; line chunks against brute force; packing round trip."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import exact_dedup, line_dedup, packing


def test_exact_collisions(spark):
    texts = [None, "", "a", "b", "a", "c", "a", "bb", "bb", "é"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, keep_id string")
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t or ""].append(i)
    for hasher in (exact_dedup.content_hash, lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 32, "0")), lambda t: F.unhex(F.lit("00" * 16))):
        got = exact_dedup.exact_dedup(docs, hasher=hasher).collect()
        assert len(got) == len(texts)
        for r in got:
            group = want[texts[r["doc_id"]] or ""]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
            assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "q"), (None, "q")], "doc_id long, text string")
    assert [r["kept"] for r in exact_dedup.exact_dedup(null).collect()] == [False, False]


def test_lines(spark):
    block = "\n".join(f"line {i} of the shared block" for i in range(40))
    texts = {1: f"alpha\n{block}\nomega", 2: f"beta\nbeta2\n{block}\nend", 3: None, 4: "", 5: "one line", 6: "x\ny\nz", 7: "\n\n\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1]["text"] == texts[1] and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] >= 20 and got[2]["text"].startswith("beta\n") and got[2]["text"].endswith("end")
    assert all(got[i]["text"] == texts[i] for i in (3, 4, 5, 6, 7))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    # a document that is put together again from chunks is the document
    lines = texts[2].split("\n")
    at = line_dedup.boundaries(lines)
    assert "\n".join("\n".join(lines[a:b]) for a, b in zip(at, at[1:], strict=False)) == texts[2]
    assert all(b - a >= 2 for a, b in zip(at, at[1:], strict=False))


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000, None), (None, "İstanbul ΑΣ don't 12,5 x<|endoftext|>y"), (10_002, "")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    assert by.keys() == texts.keys()
    for d, pieces in by.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 2048))
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert len(part) == p["length"] == min(2048, len(ids) - p["start"]) and zlib.crc32(part.tobytes()) == p["ids_crc32"]
    total = 0
    for s in seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s])[:-1])
        assert sum(r["length"] for r in s) <= 2048
        total += sum(r["length"] for r in s)
    assert len(seq) <= 1.02 * -(-total // 2048) + 1


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(1)
    for most, n in ((8, 50), (64, 5000), (256, 40_000), (2, 10), (1, 3)):
        counts = np.bincount(rng.integers(1, most + 1, n), minlength=most + 1)
        held = np.zeros(most + 1, dtype=int)
        for lengths, repeats in packing.plan(counts, most, 4):
            assert sum(lengths) <= most and repeats > 0
            for x in lengths:
                held[x] += repeats
        assert (held == counts).all()
