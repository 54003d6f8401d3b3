"""Operator 4, best-fit packing: pattern packing by non-negative least squares.

Documents become pieces of at most ``most`` tokens in one pass over the texts. The histogram of piece lengths, which has
``most`` bins whatever the input, goes to the driver; patterns of two and three lengths that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded down, and the residual
counts packed best-fit decreasing, still on the histogram. The plan is a table of slots; each piece finds its slot by its
rank among the pieces of its length, and ranks are counted over hash buckets, so no length meets in one task.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

NAME = "op4_packing"

MOST = 2048
#: The middle length of a three-document pattern is a multiple of this, which bounds the patterns to about most**2 / 12 / GRID.
GRID = 32
#: Pieces that share a hash bucket, at most, about.
PER_BUCKET = 100_000
#: Words, and words without their punctuation, whose ids a worker remembers; about 200 bytes each.
WORDS, CORES = 900_000, 800_000
STEPS = 400

#: White space to Python's split, but not to the tokenizer, which gives it ids; and what the tokenizer's special tokens begin with.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPECIAL = "<|"
_PUNCTUATION = ".,!?;:#*&%$|\"()[]{}<>=-"
_state: dict = {}


class Words:
    """Token ids of words, remembered. The tokenizer cuts at white space and drops it, so words are independent.

    A word whose last letter or digit, lower-cased, is one as well and is followed by ASCII punctuation is cut there too,
    as the tokenizer does, and ASCII words are lower-cased first, as it lower-cases anyway; that makes far fewer different
    words. A word that may hold a special token, and a text with separators that aren't white space to the tokenizer, go to
    it as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level BPE shows bytes as letters: printable Latin-1 as itself, the others from U+0100 on, in order
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = (b for b in range(256) if b not in plain)
        self.byte_letters = {b: 0x100 + k for k, b in enumerate(others)}
        self.words = _Remembered(self.word)
        self.cores = _Remembered(self.core)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def core(self, c: str) -> bytes:
        if c.isalpha() and (c.isascii() or (c == c.lower() and unicodedata.is_normalized("NFC", c))):
            # one run of letters that normalising leaves as it is: straight to the merges
            seen = c if c.isascii() else c.encode().decode("latin-1").translate(self.byte_letters)
            return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(seen)])
        return self._whole(c)

    def word(self, w: str) -> bytes:
        if _SPECIAL in w:
            return self._whole(w)
        low = w.lower() if w.isascii() else w
        core = low.rstrip(_PUNCTUATION)
        if core and core[-1].lower().isalnum():
            return self.cores[core] + self.cores[low[len(core) :]] if len(core) < len(low) else self.cores[core]
        return self.cores[low]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.cores) > CORES:
            self.cores.clear()
        get = self.words.__getitem__
        return [self._whole(t) if _SEPARATORS.search(t) else b"".join(map(get, t.split())) for t in texts]


class _Remembered(dict):
    """What a function has returned, by its argument."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        v = self[key] = self.f(key)
        return v


def _words(path: str) -> Words:
    if _state.get("path") != path:
        _state.update(path=path, words=Words(path))
    return _state["words"]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, most: int = MOST, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all documents: their ids and ``end_id``, cut every ``most`` tokens."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * most):
                        chunk = ids[k : k + 4 * most]
                        for column, x in zip(out, (doc, k // (4 * most), k // 4, len(chunk) // 4, zlib.crc32(chunk)), strict=True):
                            column.append(x)
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(most: int, grid: int) -> np.ndarray:
    """Lengths i >= j >= k >= 0 that fill a sequence: all pairs (k = 0), and the triples whose middle is on the grid."""
    i, j = np.meshgrid(np.arange(1, most), np.arange(1, most), indexing="ij")
    k = most - i - j
    ok = (i >= j) & (j >= k) & ((k == 0) | ((k > 0) & (j % grid == 0)))
    return np.stack([i[ok], j[ok], k[ok]], axis=1)


def fit(counts: np.ndarray, rows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, least squares to the histogram: accelerated projected gradient.

    A pattern uses three bins at most, so the matrix is three index columns; bin 0 stands for no document.
    """
    size = len(counts)
    weight = np.ones(size)
    weight[0] = 0.0

    def product(x):
        return sum(np.bincount(rows[:, c], weights=x, minlength=size) for c in range(3)) * weight

    def gradient(residual):
        residual = residual * weight
        return residual[rows[:, 0]] + residual[rows[:, 1]] + residual[rows[:, 2]]

    v = np.random.default_rng(0).random(len(rows))
    for _ in range(20):  # largest eigenvalue, for the step
        v = gradient(product(v))
        v /= np.linalg.norm(v) or 1.0
    bound = 1.02 * float(np.linalg.norm(gradient(product(v)))) or 1.0
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(y - gradient(product(y) - counts) / bound, 0)
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def best_fit(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, repeats). Sequences that hold the same lengths are handled at once."""
    room: list[list[list]] = [[] for _ in range(most + 1)]  # by free space: [lengths, repeats]
    left = np.zeros(most + 1, dtype=np.int64)  # sequences by free space
    for length in range(most, 0, -1):
        todo = int(counts[length])
        while todo:
            free = np.flatnonzero(left[length:])
            if len(free):
                space = length + int(free[0])
                group = room[space][-1]
                n = min(todo, group[1])
                group[1] -= n
                left[space] -= n
                if not group[1]:
                    room[space].pop()
                held = (*group[0], length)
            else:
                per = most // length
                full, rest = divmod(todo, per)
                if full and per > 1:
                    space = most - per * length
                    room[space].append([(length,) * per, full])
                    left[space] += full
                    todo = rest
                    continue
                n, held, space = (todo, (length,), most) if per == 1 else (1, (length,) * rest, most)
                room[most - len(held) * length].append([held, n])
                left[most - len(held) * length] += n
                todo = 0
                continue
            todo -= n
            room[space - length].append([held, n])
            left[space - length] += n
    return [(tuple(g[0]), g[1]) for groups in room for g in groups if g[1]]


def plan(counts: np.ndarray, most: int = MOST, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that hold exactly the histogram ``counts`` (index: length, 0 unused)."""
    counts = counts.astype(np.int64).copy()
    out = []
    if counts[most]:
        out.append(((most,), int(counts[most])))
        counts[most] = 0
    if counts.sum() and most > 2:
        rows = patterns(most, grid)
        repeats = np.floor(fit(counts.astype(float), rows) + 1e-6).astype(np.int64)
        for r in np.argsort(-repeats, kind="stable"):
            if repeats[r] < 1:
                break
            held = tuple(int(x) for x in rows[r] if x)
            n = int(min(repeats[r], *(counts[x] // held.count(x) for x in set(held))))
            if n:
                out.append((held, n))
                for x in held:
                    counts[x] -= n
    return out + best_fit(counts, most)


def slots(planned: list[tuple[tuple[int, ...], int]], most: int) -> dict[str, np.ndarray]:
    """The plan as columns sorted by (length, first rank): which ranks of a length go to which sequence and offset."""
    taken = np.zeros(most + 1, dtype=np.int64)
    length, first, sequence, offset = [], [], [], []
    base = 0
    for held, n in planned:
        at = 0
        for x in held:
            length.append(x)
            first.append(taken[x])
            sequence.append(base)
            offset.append(at)
            taken[x] += n
            at += x
        base += n
    length, first = np.array(length, dtype=np.int64), np.array(first, dtype=np.int64)
    order = np.lexsort((first, length))
    return {
        "key": np.stack([length, first], axis=1)[order],
        "sequence": np.array(sequence, dtype=np.int64)[order],
        "offset": np.array(offset, dtype=np.int64)[order],
    }


def pack(cut: DataFrame, most: int = MOST, grid: int = GRID) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (``doc_id, piece, start, length, ids_crc32``).

    Every piece gets a place; a sequence's offsets run from 0 without gaps. The table is written before it is counted.
    Rows that repeat are packed each by itself; an empty table gives an empty result.
    """
    cut = durable(cut)
    lengths = cut.groupBy("length").count().collect()  # at most `most` rows
    counts = np.zeros(most + 1, dtype=np.int64)
    for r in lengths:
        counts[r["length"]] = r["count"]
    buckets = max(64, math.ceil(int(counts.sum()) / PER_BUCKET))
    where = slots(plan(counts, most, grid), most)
    keyed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    cells = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = keyed.join(cells, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    spread = int(max((r["count"] for r in lengths), default=0)) + 1  # one number for (length, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = where["key"][:, 0] * spread + where["key"][:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            k = np.searchsorted(starts, length * spread + rank, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(where["sequence"][k] + rank - where["key"][k, 1]), pa.array(where["offset"][k])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, most: int = MOST, grid: int = GRID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of all documents.

    Ids are the tokenizer's own, strings of special tokens included, and id 0 at the end. A null text counts as empty and is
    one token; null and repeated ids and equal rows are documents of their own; long texts are cut, never shortened; extra
    columns are ignored, also ones named like the result's; an empty table gives an empty result.
    """
    return pack(pieces(docs, tokenizer or tokenizer_path(), most), most, grid)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
