"""Alignment of two tokenizations against byte offsets of fresh tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestrata.llm import token_alignment as ta

FIRST, SECOND = ta.tokenizer_path("byte_bpe_50k.json"), ta.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=SECOND)


def spelled(plain, text):
    """Ids and bytes of the tokens of both sides, by whole text; None where they spell something else."""
    a, b = plain
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    whole = (" " + text).encode()
    return (ia, ba, ib, bb) if text and b"".join(ba) == whole == b"".join(bb) else None


def brute(plain, texts):
    """Result rows, by offsets of bytes."""
    made = []
    for t in texts:
        got = spelled(plain, t) if t else None
        if not got:
            made.append(None)
            continue
        ia, ba, ib, bb = got
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links, i, j = [], 0, 0
        while i < len(ia) and j < len(ib):
            links.append((ia[i], ib[j]))
            end = min(ea[i], eb[j])
            i, j = i + (ea[i] == end), j + (eb[j] == end)
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, ia[i:p])) + "|" + ",".join(map(str, ib[j:q])))
            i, j = p, q
        made.append((len(ia), len(ib), groups, links))
    counts = Counter(x for m in made if m for x in set(m[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = m
        best = sum(counts[x] == top[x[0]] for x in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def rows_of(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


AWKWARD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "<|endoftext|>", "<s> </s> <unk>", "x <0x41> y", "▁", "a▁b", "a\x00b", "\x1c a \x1f b", "a᠎ b",
    "café café", "ﬁne Å", "你好 世界", "\U0001f600 \U0001f469‍\U0001f4bb", "  x y", "　", "don't I'LL", "a" * 3000, "1234567890 3.14", "﻿x", "x�y", "́ ́",
]


def test_against_offsets(spark, plain):
    rng = random.Random(4)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    letters = [" ", " ", " ", "\n", "a", "b", "the", "ing", "'s", "é", "9", "!", "你", "\t", "\U0001f600", "<s>", "́", "zx", "#"]
    texts = AWKWARD + real + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows_of(ta.token_alignment(docs, hot=50))
    assert got == dict(enumerate(brute(plain, texts)))
    assert sum(g[0] > 0 for g in got.values()) > 800


def test_words_stand_alone(plain):
    """What is remembered for words is what the tokenizers give for whole texts."""
    own = ta.Tokenizers(FIRST, SECOND)
    assert own.apart
    rng = random.Random(11)
    points = [*range(32, 127), *range(160, 0x250), *range(0x300, 0x310), *range(0x2000, 0x2030), 0x180E, 9, 10, 28, 31, 0x85, 0x3000, 0x4E00, 0x1F600]
    texts = ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice(" aeiou") for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    for lo in range(0, len(texts), 50):
        some = texts[lo : lo + 50]
        for text, got, want in zip(some, own.texts(some), own.parts([" " + t for t in some]), strict=True):
            assert got == want, repr(text)


def test_transducer():
    t = ta.Transducer(([b"ab", b"c", b"abc", b"d"], [b"a", b"bcd", b"abc", b"d", b"bc"]))
    assert t.align([0, 1, 3], [0, 1]) == ([0, 1, ta.SHIFT + 1, 3 * ta.SHIFT + 1], "0,1,3|0,1")
    assert t.align([2, 3], [0, 4, 3]) == ([2 * ta.SHIFT, 2 * ta.SHIFT + 4, 3 * ta.SHIFT + 3], "2|0,4;3|3")
    assert t.align([], []) == ([], "")
    assert t.align([0], [1]) is None and t.align([0], [0]) is None and t.align([], [0]) is None and t.align([2], [2, 3]) is None


def test_edges(spark, plain):
    schema = "doc_id long, text string, pairs string, groups string, row string"
    assert ta.token_alignment(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "one two", "", "", ""), (1, "one two", "", "", ""), (None, "one three", "", "", ""), (2, None, "", "", "")]
    got = sorted(tuple(r) for r in ta.token_alignment(spark.createDataFrame(rows, schema)).select("n_links", "n_best", "count_sum").collect())
    want = sorted(x[3:6] for x in brute(plain, [r[1] for r in rows]))
    assert got == want
