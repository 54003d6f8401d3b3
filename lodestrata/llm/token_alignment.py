"""Operator 11, cross-tokenizer alignment: a dangling-suffix transducer over two tokenizations of one text.

Both tokenizations spell the same bytes. The transducer reads whichever side is behind; its state is which side leads and
the bytes of the leader's last token that are still unmatched. A token that it reads overlaps with that last token, which is
a link; if the token is the longer one, it becomes the leader. An empty residual closes a group. Transitions are remembered
by residual and next token, so bytes are compared once for each.

Both tokenizers cut before a space between two words whatever else the text holds, so a group ends there, too, and the
transducer stands at its start again: what it gives for a word is remembered like a transition. (The vocabularies are tested
for it when they are loaded; where a piece could span such a place, whole texts are read at once.)

A pair of ids counts once for each document that links it. Counts are Spark aggregates over all documents; pairs that hold
many links are at most HOT many, so they are broadcast, and documents meet the others in a shuffle.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

NAME = "op11_token_alignment"

#: A pair of ids as one number: the first id times SHIFT plus the second.
SHIFT = 1 << 24
#: Pairs whose counts are broadcast, at most.
HOT = 100_000
#: Words a worker remembers, about 300 bytes each; longer ones than LONG characters aren't.
REMEMBERED, LONG = 400_000, 64
#: Transitions a worker remembers.
TRANSITIONS = 2_000_000
#: Documents, and characters of texts, that are taken at a time.
_ROWS, _CHARACTERS = 200, 1 << 20
#: White space to Python includes all that is white space to either tokenizer, and this one is in old tables.
_CUT = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
_EDGE = re.compile(r"[\s\u180e]")
_SPACE = "\u2581"
_state: dict = {}

A, B = 0, 1


class Transducer:
    """Aligns two token sequences that spell the same bytes; ``spelled`` has the bytes of every token of either side."""

    def __init__(self, spelled: tuple[list[bytes], list[bytes]]):
        self.spelled = spelled
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {(A, b""): 0}
        self.states: list[tuple[int, bytes]] = [(A, b"")]  # by number: leading side, residual
        self.moves: list[dict[int, int]] = [{}]  # by number: next state by next token
        self.size = 0

    def _move(self, state: int, token: int) -> int:
        """The state after a token of the side that is behind; -1 if bytes differ. In state 0 the token's side is A."""
        side, rest = self.states[state]
        if not state:
            after = (A, self.spelled[A][token])
        else:
            new = self.spelled[1 - side][token]
            if rest.startswith(new):
                after = (side, rest[len(new) :])
            elif new.startswith(rest):
                after = (1 - side, new[len(rest) :])
            else:
                after = None
        if after is None:
            number = -1
        elif not after[1]:
            number = 0
        else:
            number = self.numbers.setdefault(after, len(self.states))
            if number == len(self.states):
                self.states.append(after)
                self.moves.append({})
        self.moves[state][token] = number
        self.size += 1
        return number

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], str] | None:
        """Links as a * SHIFT + b, in order, and groups as text ``a1,a2|b1;a3|b2,b3``; None if bytes differ.

        Tokens without bytes aren't expected.
        """
        if self.size > TRANSITIONS:
            self.clear()
        states, moves = self.states, self.moves
        links: list[int] = []
        groups: list[str] = []
        i = j = p = q = 0
        n, m = len(a), len(b)
        while i < n:
            last = a[i]
            i += 1
            state = moves[0].get(last)
            if state is None:
                state = self._move(0, last)
            side = A
            while state > 0:
                if side == A:
                    if j == m:
                        return None
                    token = b[j]
                    j += 1
                    links.append(last * SHIFT + token)
                else:
                    if i == n:
                        return None
                    token = a[i]
                    i += 1
                    links.append(token * SHIFT + last)
                after = moves[state].get(token)
                state = self._move(state, token) if after is None else after
                if state > 0 and states[state][0] != side:  # the token is the longer one and leads now
                    side, last = 1 - side, token
            if state < 0:
                return None
            if i - p == 1 and j - q == 1:
                groups.append(f"{a[p]}|{b[q]}")
            else:
                groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        return (links, ";".join(groups)) if j == m else None


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what a word gives."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        # byte-level BPE shows bytes as letters: printable Latin-1 as itself, the others from U+0100 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        spelled = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            spelled[number] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        other = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.spelled = (spelled, other)
        self.transducer = Transducer(self.spelled)
        self.words: dict[str, tuple[bytes, str, int]] = {}

    def parts(self, parts: list[str]) -> Iterator[tuple[bytes, str, int] | None]:
        """``links, groups, tokens of A`` of texts that begin with a space; None if the tokens spell something else."""
        spelled = self.spelled[A]
        firsts = self.a.encode_batch_fast(parts, add_special_tokens=False)
        seconds = self.b.encode([x[1:] for x in parts], num_threads=1)
        for part, first, second in zip(parts, firsts, seconds, strict=True):
            ids = first.ids
            # what A spells is compared with the text, and what B spells with A
            got = self.transducer.align(ids, second) if b"".join([spelled[x] for x in ids]) == part.encode() else None
            yield got and (array("q", got[0]).tobytes(), got[1], len(ids))

    def texts(self, texts: list[str]) -> list[tuple[bytes, str, int] | None]:
        """The same of whole texts, without the space that is put before them."""
        if not self.apart:
            return list(self.parts([" " + t for t in texts]))
        words = self.words
        if len(words) > REMEMBERED:
            words.clear()
        cut = [t.split(" ") for t in texts]
        missing = set().union(*cut).difference(words)
        odd = {w for w in missing if not w or _EDGE.match(w[0]) or _EDGE.match(w[-1])}
        if odd:  # more white space than single spaces between words: such texts are cut only where it is a single one
            for k, t in enumerate(texts):
                if not odd.isdisjoint(cut[k]):
                    first, *others = _CUT.split(t)
                    cut[k] = [first, *[x[1:] for x in others]]
            missing = set().union(*cut).difference(words)
        new = list(missing)
        once: dict[str, tuple[bytes, str, int] | None] = {}
        for word, got in zip(new, self.parts([" " + w for w in new]), strict=True):
            (once if got is None or len(word) > LONG else words)[word] = got
        out = []
        for k, stretches in enumerate(cut):
            got = [words[w] if w in words else once[w] for w in stretches] if once else list(map(words.__getitem__, stretches))
            if None in got:
                out += self.parts([" " + texts[k]])
            else:
                links, groups, n = zip(*got, strict=True)
                out.append((b"".join(links), ";".join(groups), sum(n)))
        return out


def _tokenizers(first: str, second: str) -> Tokenizers:
    if _state.get("paths") != (first, second):
        _state.update(paths=(first, second), tokenizers=Tokenizers(first, second))
    return _state["tokenizers"]


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``row, doc_id, groups, n_a, n_b, n_groups, n_links, pairs, times`` of every document.

    ``groups`` is the whole alignment as text, ``pairs`` the different links (a * SHIFT + b), ``times`` how often each occurs,
    ``row`` a number of the row. Without tokens they are empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "groups", "n_a", "n_b", "n_groups", "n_links", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers(first, second)
        for batch in batches:
            texts = batch.column(2)
            lo = 0
            while lo < batch.num_rows:
                some: list[str] = []
                size = 0
                while lo + len(some) < batch.num_rows and len(some) < _ROWS and (not some or size < _CHARACTERS):
                    some.append(texts[lo + len(some)].as_py() or "")
                    size += len(some[-1])
                hi = lo + len(some)
                found = iter(own.texts([t for t in some if t]))
                rows, pairs, times = [], [], []
                for got in (next(found) if t else None for t in some):
                    links, groups, n_a = got or (b"", "", 0)
                    x, often = np.unique(np.frombuffer(links, dtype=np.int64), return_counts=True)
                    n_groups, n_links = groups.count(";") + 1 if groups else 0, len(links) // 8
                    rows.append((groups, n_a, n_links + n_groups - n_a, n_groups, n_links))
                    pairs.append(x)
                    times.append(often)
                columns = list(zip(*rows, strict=True))
                cuts = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
                out = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(columns[0], pa.string())]
                out += [pa.array(c, pa.int64()) for c in columns[1:]]
                out += [pa.ListArray.from_arrays(cuts, np.concatenate(x)) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(out, names=names)
                lo = hi

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, doc_id {kind}, groups string, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<long>"
    return numbered.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents link a pair of ids, and whether no other pair of its first id has more."""
    counts = durable(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.expr(f"pair div {SHIFT}").alias("a")).agg(F.max("n").alias("top"))  # a row for an id of the vocabulary
    marked = counts.withColumn("a", F.expr(f"pair div {SHIFT}")).join(F.broadcast(most), "a")
    return marked.select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``row, n_best, count_sum``: links whose pair is a best one, and the sum of all links' counts; no row without links."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > F.lit(total / hot)  # fewer than ``hot`` pairs, as their counts add up to the total
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = F.broadcast(counts.where(often))
    rare = each.join(F.broadcast(counts.where(often).select("pair")), "pair", "left_anti").join(counts.where(~often), "pair")

    def summed(rows: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return rows.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    both = summed(each.join(known, "pair")).unionByName(summed(rare))
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_alignment(docs: DataFrame, first: str | None = None, second: str | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``first`` is a byte-level BPE file that reads a space and the text, ``second`` a sentence-piece model that reads the text.
    Strings of special tokens are plain text. Texts that are null or empty, or that the tokens don't spell byte by byte, have
    no tokens: zeros and an empty string. Repeated rows and ids are rows of their own, whole texts are read, extra columns
    are ignored, and an empty table gives an empty result.
    """
    paths = first or tokenizer_path("byte_bpe_50k.json"), second or tokenizer_path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = durable(align(docs, *paths).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    counts = durable(pair_counts(aligned))
    scores = link_scores(aligned, counts, hot)
    out = aligned.drop("pairs", "times").join(scores, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizations of all documents."""
    return token_alignment(table(spark, sf_dir, "documents"))
