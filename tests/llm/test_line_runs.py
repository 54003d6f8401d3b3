"""Repeated runs of lines against brute force over all pairs of neighbouring lines."""

import random

import corpus_pipeline
from lodestrata.llm import line_dedup


def brute(texts):
    """Kept text of each id: pairs that a smaller id has, or the text itself before, lose both their lines."""
    split = {d: (t or "").split("\n") for d, t in texts.items()}
    where = {}
    for d, lines in split.items():
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(pair):
                where.setdefault(pair, []).append((d, i))
    out = {}
    for d, lines in split.items():
        dead = set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(e < d or (e == d and j + 2 <= i) for e, j in where.get(pair, ())):
                dead |= {i, i + 1}
        out[d] = texts[d] if not dead else "\n".join(x for i, x in enumerate(lines) if i not in dead)
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    shared = [[f"shared {p} line {i}" for i in range(2 + p % 6)] for p in range(20)]
    texts = {1: None, 2: "", 3: "\n\n\n", 4: "a\na", 5: "a\na\na\nb", 6: "z\nz\nz\nz\nz"}
    for d in range(10, 150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines += [rng.choice(["", "common", f"own {d} {rng.random()}"]) for _ in range(rng.randrange(3))]
            lines += rng.choice(shared)
        texts[d] = "\n".join(lines)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_dedup.run_dedup(docs).collect()}
    want = brute(texts)
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_lines"] == len((texts[d] or "").split("\n")) for d, r in got.items())
    assert got[6]["n_removed"] == 3
    for line in {x for t in texts.values() for x in (t or "").split("\n") if x}:  # a line's first place stays
        first = min(d for d, t in texts.items() if line in (t or "").split("\n"))
        assert line in want[first].split("\n")
    assert line_dedup.run_dedup(docs.limit(0)).count() == 0


def test_chunks_are_the_anchors_of_runs(spark, monkeypatch):
    passage = [f"shared line {i}" for i in range(30)]
    spaced = ["begin", "", "", "", "", "end"] * 4
    texts = {d: "\n".join([f"{d} one", *passage[d % 3 :], f"{d} two", *spaced, f"{d} three"]) for d in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    anchors = line_dedup.removed(docs)
    inside = {(bytes(r["_key"]), i) for r in anchors.collect() for g in r["gone"] for i in range(g["first"], g["last"] - 1)}
    every = {(bytes(r["_key"]), r["first"]) for r in line_dedup.pairs(docs).collect()}
    left = {(bytes(r["_key"]), r["first"]) for r in line_dedup.uncovered(docs, anchors).collect()}
    assert len(inside) > 100 and left == every - inside
    cut, chunks = [], line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda docs, every=line_dedup.EVERY: cut.append(every) or chunks(docs, every))
    got = {r["doc_id"]: r["text"] for r in line_dedup.run_dedup(docs).collect()}
    assert cut == [line_dedup.EVERY]
    assert got == brute(texts)


def test_pipeline_drops_short_passages(spark):
    passage = [f"licence line {i}" for i in range(3)]
    rows = [(d, "\n".join([f"{d} one", f"{d} two", *passage, f"{d} three"]), "en", "web", 60) for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got[0]["text"] == rows[0][1]
    for d in range(1, 30):
        assert got[d]["text"] == f"{d} one\n{d} two\n{d} three" and got[d]["n_chars"] == len(got[d]["text"])


def test_unrepeated_pairs_leave_at_the_join(spark, monkeypatch):
    passage = ["licence", "no warranty", "all rights"]
    texts = {d: "\n".join([*(f"{d} own {i}" for i in range(40)), *passage, f"{d} end", *([f"rare {d % 100}", "twin"] if d < 200 else [])]) for d in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    met, join = [], line_dedup.join_repeated
    monkeypatch.setattr(line_dedup, "join_repeated", lambda *given: met.append((given, join(*given))) or met[-1][1])
    got = {r["doc_id"]: r["text"] for r in line_dedup.run_dedup(docs).collect()}
    assert got == brute(texts)
    (left, classes, _, _, total), rows = met[0]
    shared = {r["hash"]: r["n"] for r in classes.collect()}
    assert max(shared.values()) > total / 2000 >= min(shared.values())  # both ways are taken
    want = sorted((r["_key"], r["first"]) for r in left.collect() if r["hash"] in shared)
    assert sorted((r["_key"], r["first"]) for r in rows.collect()) == want
    assert len(want) == sum(shared.values()) < left.count() / 10
