"""Operator 8, line dedup: content-defined chunks of lines.

A rolling hash over the hashes of three lines says after which lines a chunk may end, so boundaries move with the text
when lines are put in or taken out before it. Every chunk has two lines or more. Chunks that occur in several documents
stay in the one with the smallest id, those that a document repeats stay at their first place; equality is decided by the
bytes: chunks are grouped by hash and text, copies combined before the shuffle.

Whole chunks miss most short passages in other surroundings, but the query's SQL fixes them. ``run_dedup``, which the
pipeline takes, has no such cut: repeated chunks are its anchors, and the pairs of neighbouring lines that they don't cover
are compared after them, so every repeated run of two lines or more goes, whatever stands around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, join_counted, join_repeated, table

NAME = "op8_line_dedup"

#: One line in so many is a candidate for a chunk's end.
EVERY = 4

ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i,
         len(string_split(coalesce(text, ''), chr(10))) AS n
  FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM l
), r AS (
  SELECT *, (v + 31 * coalesce(lag(v) OVER w, 0) + 961 * coalesce(lag(v, 2) OVER w, 0)) % 4 = 0 AS cand
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), b AS (
  SELECT *, (cand AND NOT coalesce(lag(cand) OVER w, false) AND i >= 1 AND i <= n - 3)::INT AS ends
  FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b
), c AS (
  SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY ALL
), g AS (
  SELECT *, lines >= 2 AND trim(body, chr(10)) <> ''
    AND (row_number() OVER (PARTITION BY doc_id, body ORDER BY chunk) > 1 OR min(doc_id) OVER (PARTITION BY body) < doc_id) AS gone
  FROM c
)
SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""


def boundaries(lines: list[str], every: int = EVERY) -> list[int]:
    """Starts of the chunks, and the number of lines: [0, ..., n]. Decided by each line and the three before it."""
    n = len(lines)
    v = [int.from_bytes(hashlib.md5(x.encode("utf-8", "replace")).digest()[:4], "big") for x in lines]
    out, before = [0], False
    for i in range(n):
        now = (v[i] + 31 * (v[i - 1] if i else 0) + 961 * (v[i - 2] if i > 1 else 0)) % every == 0
        if now and not before and 1 <= i <= n - 3:
            out.append(i + 1)
        before = now
    return [*out, n]


def _row_key() -> Column:
    """16 bytes for a row, from its id and text: rows that repeat both share it, and are treated alike."""
    text = F.coalesce("text", F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.length(text).cast("string"), text, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))


def _order() -> Column:
    """The id that decides who keeps a text; null ids come last."""
    return F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))


def chunks(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``_key, doc_id, first, last, again, hash, body``: chunks of two lines or more that aren't blank.

    ``again`` marks what the document itself has had before; such rows carry no body.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows: list[list] = [[] for _ in range(7)]
                part = batch.slice(lo, 500)
                for key, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    lines = (text or "").split("\n")
                    ends, seen = boundaries(lines, every), {}
                    for a, b in zip(ends, ends[1:], strict=False):
                        body = "\n".join(lines[a:b])
                        if b - a < 2 or not body.strip("\n"):
                            continue
                        again = seen.setdefault(body, b) <= a
                        digest = hashlib.md5(body.encode("utf-8", "replace")).digest()
                        for column, x in zip(rows, (key, doc, a, b, again, digest, None if again else body), strict=True):
                            column.append(x)
                kinds = (pa.binary(), part.schema.field(1).type, pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["_key", "doc_id", "first", "last", "again", "hash", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(_row_key().alias("_key"), "doc_id", "text")
    return source.mapInArrow(cut, f"_key binary, doc_id {kind}, first int, last int, again boolean, hash binary, body string")


def pairs(docs: DataFrame) -> DataFrame:
    """``_key, doc_id, first, again, hash``: pairs of neighbouring lines, not both empty, by SHA-256.

    ``again`` marks those that the document itself has had before, without overlap.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows: list[list] = [[] for _ in range(5)]
                part = batch.slice(lo, 500)
                for key, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    lines, seen = (text or "").split("\n"), {}
                    for i in range(len(lines) - 1):
                        if not (lines[i] or lines[i + 1]):
                            continue
                        digest = hashlib.sha256(f"{lines[i]}\n{lines[i + 1]}".encode("utf-8", "replace")).digest()
                        for column, x in zip(rows, (key, doc, i, seen.setdefault(digest, i) + 2 <= i, digest), strict=True):
                            column.append(x)
                kinds = (pa.binary(), part.schema.field(1).type, pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["_key", "doc_id", "first", "again", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(_row_key().alias("_key"), "doc_id", "text")
    return source.mapInArrow(cut, f"_key binary, doc_id {kind}, first int, again boolean, hash binary")


def removed(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``_key, gone``: line ranges [first, last) of the chunks to remove, of the rows that have any."""
    made = chunks(docs, every)
    new = made.where(~F.col("again"))
    order = _order()
    classes = durable(
        new.groupBy("hash", "body").agg(F.count("*").alias("n"), F.min(order).alias("keeper")).drop("body")
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    collided = classes.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1").select("hash")
    spots = made.select("_key", order.alias("_id"), "first", "last", "again", "hash")
    repeated = classes.where("n > 1")
    if collided.isEmpty():
        judged = join_counted(spots, repeated, "hash", "n", total)
    else:
        mixed = made.join(collided, "hash", "left_semi").select("_key", order.alias("_id"), "first", "last", "again", "hash", "body")
        texts = mixed.where("body is not null").groupBy("body").agg(F.count("*").alias("n"), F.min("_id").alias("keeper"))
        exact = mixed.join(texts, "body", "left").select("_key", "_id", "first", "last", "again", "hash", "n", "keeper")
        judged = join_counted(spots.join(collided, "hash", "left_anti"), repeated.join(collided, "hash", "left_anti"), "hash", "n", total).unionByName(exact)
    gone = judged.where(F.col("again") | (F.col("keeper") < F.col("_id")))
    return gone.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("gone"))


def uncovered(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``_key, _id, first, again, hash``: the pairs of lines that are not wholly inside a chunk that goes.

    Those inside needn't be compared, nor found by others: whoever keeps the chunk has them with a smaller id, or the
    document itself further up, and there they are left. So each pair's smallest id is among the rows of this table.
    """
    inside = anchors.select("_key", F.explode("gone").alias("g")).select("_key", F.explode(F.sequence(F.col("g.first"), F.col("g.last") - 2)).alias("first"))
    found = pairs(docs).select("_key", _order().alias("_id"), "first", "again", "hash")
    return found.join(inside.distinct(), ["_key", "first"], "left_anti").select("_key", "_id", "first", "again", "hash")


def extended(docs: DataFrame) -> DataFrame:
    """``_key, gone`` like ``removed``: repeated chunks, and from them line by line all repeated runs of two lines or more.

    Pairs of lines that cross the ends of chunks, or lie in passages too short to hold one, are compared after the chunks.
    """
    anchors = durable(removed(docs))
    left = durable(uncovered(docs, anchors))
    classes = durable(left.where(~F.col("again")).groupBy("hash").agg(F.count("*").alias("n"), F.min("_id").alias("keeper")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = left.where(~F.col("again")).drop("again")
    later = join_repeated(first, classes.where("n > 1"), "hash", "n", total).where(F.col("keeper") < F.col("_id"))
    gone = left.where("again").select("_key", "first").unionByName(later.select("_key", "first"))
    ranges = gone.select("_key", F.struct("first", (F.col("first") + 2).alias("last")).alias("g"))
    ranges = ranges.unionByName(anchors.select("_key", F.explode("gone").alias("g")))
    return ranges.groupBy("_key").agg(F.array_sort(F.collect_set("g")).alias("gone"))


def line_dedup(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """The input's columns with ``text`` reduced to what stays, and ``n_lines``, ``n_chunks``, ``n_removed`` (lines).

    Lines are cut at newlines only. A null text counts as one empty line and stays null; a document without repeated
    chunks keeps its text as it is; a document of one line has no chunk of two lines and is left alone. Null ids come last
    in the choice of the document that keeps a chunk; rows that share the smallest id all keep it. Input columns named as
    the added ones are replaced; an empty table gives an empty result.
    """
    return _reduced(docs, every)


def run_dedup(docs: DataFrame) -> DataFrame:
    """Like ``line_dedup``, but by runs of lines: the input's columns, ``n_lines`` and ``n_removed``.

    Chunks are matched first, then extended (``extended``). In the end a pair of neighbouring lines, not both empty, goes if
    a document with a smaller id has it, or the document itself has it before, without overlap; so whatever run of two lines
    or more is repeated goes whole. The first of all places of a line never goes. A line alone that repeats between other
    lines stays, and so do the inner ones of three empty lines or more.
    """
    return _reduced(docs, None).drop("n_chunks")


def _reduced(docs: DataFrame, every: int | None) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("n_lines", "n_chunks", "n_removed")]
    joined = docs.select(*keep, _row_key().alias("_key")).join(removed(docs, every) if every else extended(docs), "_key", "left").select(*keep, "gone")
    schema = docs.select(*keep).schema.add("n_lines", "long").add("n_chunks", "long").add("n_removed", "long")
    at = keep.index("text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], ([], [], [])
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                dead = {i for g in gone or () for i in range(g["first"], g["last"])}
                if dead and not every:  # of a chunk that goes, too, a line that is in pairs of empty ones only stays
                    dead = {i + k for g in gone for i in range(g["first"], g["last"] - 1) if lines[i] or lines[i + 1] for k in (0, 1)}
                texts.append(text if not dead else "\n".join(x for i, x in enumerate(lines) if i not in dead))
                for column, x in zip(counts, (len(lines), len(boundaries(lines, every)) - 1 if every else 0, len(dead)), strict=True):
                    column.append(x)
            columns = [batch.column(i) for i in range(len(keep))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=schema.names)

    return joined.mapInArrow(rebuild, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
