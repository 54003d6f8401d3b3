"""Token ids of texts with every white space and control character are the tokenizer's own."""

import random
import sys
import zlib

import numpy as np
from tokenizers import Tokenizer

from lodestrata.llm import packing


def texts():
    odd = sorted({*range(0x00, 0x21), *range(0x7F, 0xA1), 0x200B, *(c for c in range(sys.maxunicode + 1) if chr(c).isspace())})
    return [f"ab{chr(c)}cd, e.{chr(c)}{chr(c)} {chr(c)}" for c in odd] + ["ab\x1ccd", "\x1c", "\x1d\x1e\x1f", "a \x1f b\x1c."]


def test_words_hold_the_tokenizers_ids():
    words = packing.Words(packing.tokenizer_path())
    own = Tokenizer.from_file(packing.tokenizer_path())
    for t, ids in zip(texts(), words.encode(texts()), strict=True):
        want = own.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, repr(t)


def test_packed_pieces_hold_separators(spark):
    own = Tokenizer.from_file(packing.tokenizer_path())
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[d]["start"], got[d]["length"], got[d]["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes()))


def test_fuzz_holds_the_tokenizers_ids():
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "İ", "İ.", "ß", "ΑΣ", "\u0301", "\u0307", "e\u0301", "ﬁ", "½", "²", "٣", "中", "한", "😀", "\x1c", "\x1f", "\x85", "\u200b", "don't", "'LL", "12,5", "Über", "a", "Z", "9", " ", "  ", "\n", *packing._PUNCTUATION, "'", "_", "@", "\x00"]
    words, own = packing.Words(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    made = ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(30_000)]
    made += ["İ-", "x<|endoftext|>y", "<|endoftext|>." * 3, "a" * 20_000, "<|endoftext|>" * 2000]
    for t, ids in zip(made, words.encode(made), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_of_empty_and_clashing_tables(spark):
    schema = "piece string, doc_id long, text string, length string, sequence_id string, offset string, start string, ids_crc32 string, _b string"
    empty = packing.pack_documents(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and empty.count() == 0
    rows = [("p", i, t, *["c"] * 6) for i, t in ((1, "a b c"), (1, "a b c"), (None, None), (2, ""))]
    got = packing.pack_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"]) for r in got) == [(0, 0, 1), (1, 0, 4), (1, 0, 4), (2, 0, 1)]
    assert {r["sequence_id"] for r in got} == {got[0]["sequence_id"]}
    assert sorted(r["offset"] for r in got) == sorted([0, *np.cumsum([r["length"] for r in sorted(got, key=lambda r: r["offset"])])[:-1].tolist()])
