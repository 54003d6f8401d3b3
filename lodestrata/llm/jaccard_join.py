"""Operator 9, n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal shingle sets are one row of the matrix (a class). The product is taken over the columns that can
decide: each class's shingles are put in one global order, rare ones first, and two classes of similarity t must share a
column among the first n - ceil(t n) + 1 of both. Those columns are dealt into blocks; a block multiplies its postings and
drops pairs whose sizes, or whose places of the shared column, bound the overlap below what t asks for. Columns with few
postings give all pairs. Columns with many give each posting and a leader, the one with the fewest rarer shingles. They
come back, once linked classes are known: first with one posting of each component against the column's leader, then,
where components are still apart, in square tiles of postings, in which sizes, places and a parity sketch of the whole
sets bound the overlap before a pair is given. So the work follows the links that are needed for the components, and no
link between components is lost. Overlaps of the remaining pairs are counted on whole sets.

Columns that hold many postings in all are dealt over several blocks, by size and class. Rows of hubs, of large components
and of leaders are spread by salts, so no key meets whole in one task.

The order of the shingles comes from a table of counters of fixed size, filled over all documents. It decides how much is
compared, never what is found.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counters
from .common import HOT_SHARE, durable, join_counted, table
from .counters import COUNTERS, cells
from .words import IN_WORD, LOWER, hashes, mix

NAME = "op9_jaccard_join"

WORDS = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
BLOCKS_PER_PARTITION = 8
#: Columns with at most so many classes give all their pairs at once.
FEW = 6
#: Postings of a column that stay together in a block, about; postings on one side of a tile.
TOGETHER = 50_000
TILE = 512
#: Bits of a parity sketch.
SKETCH = 1024
_DEALT = 1 << 31
_U = np.uint64

ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id, doc_id AS c FROM n
  UNION
  SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(c) FROM r WHERE r.doc_id = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


#: Bytes of whole texts that are taken at a time.
_CHUNK = 1 << 21


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words, A-Z lower-cased, and their 64-bit hashes. Words end at the places of ``cuts``, too."""
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = cuts[cuts < len(data)]
    first[at] = inside[at]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, hashes(data, starts, ends, LOWER)


def _windows(v: np.ndarray, size: int) -> np.ndarray:
    m = max(0, len(v) - size + 1)
    h = np.full(m, size, dtype=np.uint64)
    for i in range(size):
        h *= _U(0x9E3779B97F4A7C15)
        h += v[i : m + i]
    return mix(h)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct hashes of its shingles; of all its words, if it has fewer than ``k``."""
    texts = texts.fill_null("")
    if not len(texts):
        return
    offset = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=offset)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _CHUNK, side="right")) - 1)
        cuts = at[lo : hi + 1] - at[lo]
        starts, v = _words(whole[at[lo] : at[hi]], cuts)
        word = np.searchsorted(starts, cuts)
        h = _windows(v, k)
        for a, b in zip(word[:-1].tolist(), word[1:].tolist(), strict=True):
            own = h[a : b - k + 1] if b - a >= k else _windows(v[a:b], b - a) if b > a else h[:0]
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        lo = hi


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets(pa.array([text], pa.string()), k))


def _class(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _short(cls: bytes) -> int:
    return int.from_bytes(cls[:8], "little", signed=True)


def _texts(batches: Iterator[pa.RecordBatch], k: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for i, h in enumerate(shingle_sets(batch.column(column), k)):
            yield batch, i, h


def read(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, cls, n`` of every document, and, with ``part`` set, the counters of each task in compressed parts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "cls", "n", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        doc_type, held, size = None, [], 0

        def count() -> None:
            nonlocal size
            if held:
                np.add(counts, np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS), out=counts, casting="unsafe")
            held.clear()
            size = 0

        for batch in batches:
            doc_type = batch.schema.field(1).type
            sets = list(shingle_sets(batch.column(0), k))
            m = len(sets)
            held += [cells(s).astype(np.uint32) for s in sets]
            size += sum(map(len, sets))
            if size > COUNTERS:
                count()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([_class(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=names,
            )
        count()
        if doc_type is not None:
            parts, blobs = counters.packed(counts)
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, doc_type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), parts, blobs], names=names)

    return docs.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, cls binary, n long, part int, counts binary")


_RECORD = np.dtype([("h", "<u8"), ("c", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _pack(r: np.ndarray) -> bytes:
    """Records by columns: hashes as they are, small numbers compressed."""
    return len(r).to_bytes(4, "little") + r["h"].tobytes() + r["c"].tobytes() + zlib.compress(r["n"].tobytes() + r["at"].tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    r = np.empty(n, dtype=_RECORD)
    r["h"] = np.frombuffer(blob, dtype="<u8", count=n, offset=4)
    r["c"] = np.frombuffer(blob, dtype="<i8", count=n, offset=4 + 8 * n)
    small = np.frombuffer(zlib.decompress(blob[4 + 16 * n :]), dtype="<u4")
    r["n"], r["at"] = small[:n], small[n:]
    return r


def _block(r: np.ndarray, scale: np.ndarray, blocks: int, num: int, den: int, together: int) -> np.ndarray:
    """Blocks of postings, by hash; columns that may hold more than ``together`` postings by size and class as well.

    The places of the latter get the bit _DEALT: such a column's postings come back whatever a block sees of them.
    """
    lots = (counters.counted(scale[cells(r["h"])]) / together).astype(np.int64)
    many = np.flatnonzero(lots)
    key = r["h"].copy()
    if len(many):
        band = (np.log(r["n"][many]) / math.log(den / num)).astype(np.uint64) if num < den else r["n"][many].astype(np.uint64)
        lot = (mix(r["c"][many].view(np.uint64)) % (lots[many] + 1).astype(np.uint64)) * _U(1 << 20) + band
        key[many] = mix(key[many] ^ (lot * _U(0x9E3779B97F4A7C15)))
        r["at"][many] |= _DEALT
    return (key % _U(blocks)).astype(np.int64)


def postings(docs: DataFrame, scale, blocks: int, k: int, num: int, den: int, together: int = TOGETHER) -> DataFrame:
    """``block, records``: the first shingles of every class, by block of the shingle's hash. Classes once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = scale.value
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                r = np.concatenate(held)
                b = _block(r, order, blocks, num, den, together)
                by = np.argsort(b, kind="stable")
                r, b = r[by], b[by]
                cut = np.flatnonzero(np.diff(b)) + 1
                starts = np.concatenate([[0], cut])
                blobs = [_pack(x) for x in np.split(r, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(b[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["block", "records"])

        for _, _, h in _texts(batches, k):
            n = len(h)
            if not n:
                continue
            cls = _class(h)
            if cls in seen:
                continue
            seen.add(cls)
            p = n - -(-num * n // den) + 1
            key = (order[cells(h)].astype(np.uint64) << _U(56)) | (h >> _U(8))
            first = np.argsort(key, kind="stable")[:p]
            r = np.empty(p, dtype=_RECORD)
            r["h"], r["c"], r["n"], r["at"] = h[first], _short(cls), n, np.arange(p)
            held.append(r)
            size += p
            if size > 400_000:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "block int, records binary")


def _possible(na, nb, ia, ib, num: int, den: int):
    """Whether sizes, and places of a first shared shingle, leave room for the overlap that num / den asks for."""
    least = -(-num * (na + nb) // (num + den))
    return (np.minimum(na - ia, nb - ib) >= least) & (np.minimum(na, nb) * den >= num * np.maximum(na, nb))


def multiply(blocks: DataFrame, num: int, den: int, few: int) -> DataFrame:
    """``h, a, na, b, nb, at``: pairs to compare (``b`` set), and postings of columns that come back (``b`` null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.unique(np.concatenate([_unpack(x) for x in pdf["records"]]))
        h = r["h"]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(r) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(head, len(r)))
        c, n, at = r["c"], r["n"].astype(np.int64), (r["at"] & (_DEALT - 1)).astype(np.int64)
        long = (size > few) | (r["at"][head] >= _DEALT)
        first, second = [], []
        for s in range(2, few + 1):  # all columns with s classes at once
            heads = head[(size == s) & ~long]
            for i in range(s):
                for j in range(i + 1, s):
                    first.append(heads + i)
                    second.append(heads + j)
        back = []
        for start, s in zip(head[long], size[long], strict=True):
            member = start + np.argsort(n[start : start + s], kind="stable")
            lo = 0
            while lo < s:  # bands of sizes that can be similar to the smallest
                hi = int(np.searchsorted(n[member] * num, n[member[lo]] * den, side="right"))
                band = member[lo:hi]
                leader = band[np.argmin(at[band] / n[band])]
                first.append(np.full(len(band), leader))
                second.append(band)
                lo = hi
            back.append(member)
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        x, y = whole(first), whole(second)
        ok = ((c[x] != c[y]) | (n[x] != n[y])) & _possible(n[x], n[y], at[x], at[y], num, den)
        x, y = x[ok], y[ok]
        swap = c[x] > c[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs = pd.DataFrame({"h": 0, "a": c[x], "na": n[x], "b": c[y], "nb": n[y], "at": 0}).drop_duplicates(["a", "b"])
        m = whole(back)
        rest = pd.DataFrame({"h": h[m].astype(np.int64), "a": c[m], "na": n[m], "b": pd.array([None] * len(m), dtype="Int64"), "nb": 0, "at": at[m]})
        pairs["b"] = pairs["b"].astype("Int64")
        return pd.concat([pairs, rest], ignore_index=True)

    return blocks.groupBy("block").applyInPandas(run, "h long, a long, na long, b long, nb long, at long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``c, cls, h, sketch``: whole shingle sets of the classes in ``wanted`` (column ``c``), and of few others.

    The texts are read again; a bit table of fixed size keeps most other classes out, and the joins with the pairs all of
    them. A class that several tasks meet has a row from each; ``links`` takes one.
    """
    bits = 1 << 23
    parts = wanted.select(F.pmod("c", F.lit(bits)).alias("i")).select((F.col("i") / 2048).cast("int").alias("w"), (F.col("i") % 2048).cast("int").alias("j"))
    rows = parts.groupBy("w").agg(F.collect_set("j").alias("js")).collect()  # bits in all, at most
    mask = np.zeros(bits, dtype=bool)
    for r in rows:
        mask[r["w"] * 2048 + np.array(r["js"], dtype=np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(shared.value).astype(bool)
        seen: set[bytes] = set()
        out: list[list] = [[], [], [], []]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["c", "cls", "h", "sketch"])

        for _, _, h in _texts(batches, k):
            if len(h):
                cls = _class(h)
                if keep[_short(cls) % bits] and cls not in seen:
                    seen.add(cls)
                    for column, x in zip(out, (_short(cls), cls, h.tobytes(), sketch(h)), strict=True):
                        column.append(x)
                    if len(out[0]) == 200:
                        yield batch()
                        out = [[], [], [], []]
        yield batch()

    return docs.select("text").mapInArrow(run, "c long, cls binary, h binary, sketch binary")


def sketch(h: np.ndarray) -> bytes:
    """Parities of how many of the hashes fall on each bit. Where two sketches differ, the sets differ in one hash at least."""
    return np.packbits(np.bincount((h % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``x, y``: classes of the pairs whose whole sets are similar enough. Overlaps are counted exactly.

    A class in very many pairs has its set repeated under salts, over which its pairs are spread.
    """
    least = max(1000.0, pairs.count() * HOT_SHARE)
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).groupBy("k").agg(F.ceil(F.count("*") / least).cast("int").alias("lots"))
    hot = durable(ends.where("lots > 1"))  # 2 / HOT_SHARE rows at most

    def lots(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(F.broadcast(hot.select(F.col("k").alias(key), F.col("lots").alias(name))), key, "left").withColumn(name, F.coalesce(name, F.lit(1)))

    dealt = lots(lots(pairs, "a", "_a"), "b", "_b")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), "_a").cast("int").alias("_a"), F.pmod(F.xxhash64("a"), "_b").cast("int").alias("_b"))
    whole = lots(sets.select("c", "cls", "h"), "c", "_l").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_l") - 1))).drop("_l")
    whole = whole.repartition("c", "_s").dropDuplicates(["c", "_s", "cls"])  # one shuffle serves this and both joins
    right = dealt.join(whole.select(F.col("c").alias("b"), F.col("_s").alias("_b"), F.col("cls").alias("y"), F.col("h").alias("hy")), ["b", "_b"])
    joined = right.join(whole.select(F.col("c").alias("a"), F.col("_s").alias("_a"), F.col("cls").alias("x"), F.col("h").alias("hx")), ["a", "_a"])
    joined = joined.where("x != y").select("x", "hx", "y", "hy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                xs, ys = [], []
                for x, hx, y, hy in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    p, q = np.frombuffer(hx, dtype=np.uint64), np.frombuffer(hy, dtype=np.uint64)
                    both = np.sort(np.concatenate([p, q]))
                    o = np.count_nonzero(both[1:] == both[:-1])
                    if o * den >= num * (len(p) + len(q) - o):
                        xs.append(x)
                        ys.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    return joined.mapInArrow(run, "x binary, y binary")


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: the smallest vertex of each vertex's component. Labels spread to neighbours and jump along labels.

    Neighbours of a hub and vertices of a large component are spread by ``join_counted``.
    """
    both = durable(edges.select("x", "y").union(edges.select("y", "x")).where("x != y").distinct())
    start = both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m"), F.count("*").alias("d"))
    labels = durable(start.select("v", F.least("v", "m").alias("label"), "d"))
    n_edges, n = both.count(), labels.count()
    while True:
        seen = join_counted(both, labels.select(F.col("v").alias("y"), "label", "d"), "y", "d", n_edges)
        near = seen.groupBy(F.col("x").alias("v")).agg(F.min("label").alias("near"))
        step = durable(labels.join(near, "v", "left").select("v", "d", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        size = step.groupBy("label").agg(F.count("*").alias("_n"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far")).join(size, "label")
        new = durable(join_counted(step, jump, "label", "_n", n).select("v", "d", "old", F.least("label", "far").alias("label")))
        labels = new.select("v", "label", "d")
        if new.where("label != old").isEmpty():
            return labels.select("v", "label")


def _columns(back: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """Postings that come back, by shingle and band of sizes, where a column holds several components.

    ``k, c, na, at, label, own, cnt``; sizes that can be similar are in the same band or the next, so a posting is in the
    column of its band, and with ``own`` false in that of the band below.
    """
    marked = durable(back.join(ids.select("c", "label"), "c"))
    width = math.log(den / num) * 1.0001 if num < den else 0.5
    band = F.floor(F.ln("na") / width).cast("int")
    wide = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own"))))
    rows = marked.withColumn("w", wide).select(F.xxhash64("h", "w.band").alias("k"), "c", "na", "at", "label", "w.own")
    several = rows.groupBy("k").agg(F.count("*").alias("cnt"), F.min("label").alias("l"), F.max("label").alias("m"), F.max("own").alias("o"))
    several = several.where("l != m and o").select("k", "cnt", F.col("cnt").alias("size"))
    return join_counted(rows, several, "k", "cnt", 2 * marked.count()).where("cnt is not null").drop("size")


def _led(open_: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: in each column, one posting of each component against the posting with the fewest rarer shingles."""
    one = open_.groupBy("k", "label").agg(F.min(F.struct((F.col("at") / F.col("na")).alias("r"), "c", "na", "at")).alias("s"))
    one = durable(one.select("k", "s"))
    lead = one.groupBy("k").agg(F.min("s").alias("l"), F.count("*").alias("n"))
    rows = join_counted(one, lead, "k", "n", one.count())
    room = F.least(F.col("s.na") - F.col("s.at"), F.col("l.na") - F.col("l.at"))
    rows = rows.where((F.col("s.c") != F.col("l.c")) & (room >= F.ceil(F.lit(num) * (F.col("s.na") + F.col("l.na")) / F.lit(num + den))))
    return rows.select(F.least("s.c", "l.c").alias("a"), F.greatest("s.c", "l.c").alias("b")).distinct()


def _tiled(open_: DataFrame, sketches: DataFrame, blocks: int, num: int, den: int, tile: int) -> DataFrame:
    """``a, b``: pairs of different components in a column that sizes, places and sketches leave room for.

    A column's postings are dealt into lots of about ``tile`` by class; every two lots meet once, in tiles spread over all
    tasks.
    """
    rows = open_.join(sketches, "c").withColumn("lots", F.ceil(F.col("cnt") / tile).cast("int")).withColumn("lot", F.pmod(F.xxhash64("c"), "lots").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    rows = rows.withColumn("i", F.least("lot", "o")).withColumn("j", F.greatest("lot", "o"))
    rows = rows.select(F.xxhash64("k", "i", "j").alias("t"), "k", "i", "j", "lot", "c", "na", "at", "label", "own", "sketch")
    work = open_.agg(F.coalesce(F.sum(F.ceil(F.col("cnt") / tile)), F.lit(0))).first()[0]
    rows = rows.withColumn("block", F.pmod("t", F.lit(max(blocks, int(work) // 100_000))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "i", "j"], kind="stable")
        key = pdf[["k", "i", "j"]].to_numpy()
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        label = pd.factorize(pdf["label"])[0]
        bits = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint64).reshape(len(pdf), -1)
        c, n, at, own, low = (pdf[x].to_numpy() for x in ("c", "na", "at", "own", "lot"))
        first = low == pdf["i"].to_numpy()
        same = pdf["i"].to_numpy() == pdf["j"].to_numpy()
        out = []
        for lo, hi in zip(head, np.append(head[1:], len(pdf)), strict=True):
            left = lo + np.flatnonzero(first[lo:hi])
            right = left if same[lo] else lo + np.flatnonzero(~first[lo:hi])
            for x in np.array_split(left, max(1, len(left) * len(right) // 65_536)):
                i, j = x[:, None], right[None, :]
                ok = (label[i] != label[j]) & (own[i] | own[j]) & ((c[i] < c[j]) if same[lo] else True) & _possible(n[i], n[j], at[i], at[j], num, den)
                p, q = np.nonzero(ok)
                p, q = x[p], right[q]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                good = n[p] + n[q] - apart >= 2 * -(-num * (n[p] + n[q]) // (num + den))
                out.append(np.stack([np.minimum(c[p], c[q]), np.maximum(c[p], c[q])], axis=1)[good])
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("block").applyInPandas(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, few: int = FEW, blocks: int | None = None, together: int = TOGETHER, tile: int = TILE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents link when the Jaccard similarity of their distinct word shingles is num / den or more; ``component_id`` is
    the smallest id reachable by links, the document's own included. Only A-Z is lower-cased; a text of fewer than ``k`` words is one shingle; a null
    text, or one without words, has none and is alone. Null ids are never the smallest; a component of null ids only has
    a null component_id. Repeated rows and ids are rows of their own; extra columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    tasks = docs.rdd.getNumPartitions()
    blocks = blocks or max(8, tasks * BLOCKS_PER_PARTITION)
    known = durable(read(docs, k))
    scale = spark.sparkContext.broadcast(counters.scale(known.where("part is not null").select("part", "counts"), tasks))
    rows = known.where("part is null").select("doc_id", "cls", "n")
    dealt = postings(docs, scale, blocks, k, num, den, together).repartition(blocks, "block")
    product = durable(multiply(dealt, num, den, few))
    pairs = durable(product.where("b is not null").select("a", "b").distinct())
    back = product.where("b is null").select("h", F.col("a").alias("c"), "na", "at").distinct()
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(back.select("c")).distinct()
    sets = durable(_sets(docs, wanted, k))
    edges = durable(links(pairs, sets, num, den))
    labels = components(edges)
    # columns with many postings, where they hold several components: leaders first, then tiles of what is still apart
    for last in (False, True):
        ids = sets.select("c", "cls").distinct().join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left").select("c", F.coalesce("label", "cls").alias("label"))
        open_ = durable(_columns(back, ids, num, den))
        if open_.isEmpty():
            break
        new = _tiled(open_, sets.select("c", "sketch").dropDuplicates(["c"]), blocks, num, den, tile) if last else _led(open_, num, den)
        new = durable(new.join(pairs, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            some = durable(new.select(F.col("a").alias("c")).union(new.select("b")).distinct())
            edges = durable(edges.union(links(new, sets.join(some, "c", "left_semi"), num, den)))
            pairs, labels = pairs.union(new), components(edges)
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("_count"), F.min("doc_id").alias("_min"))
    classes = durable(classes.join(labels.select(F.col("v").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    lowest = classes.groupBy("label").agg(F.min("_min").alias("component_id"), F.count("*").alias("_size"))
    groups = join_counted(classes, lowest, "label", "_size", classes.count()).select("cls", "component_id", "_count")
    out = join_counted(rows, groups, "cls", "_count", rows.count())
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay when one of each component stays: the one with the smallest id, once.

    Documents without words stay. Of rows that repeat the smallest id one stays, of a component of null ids all stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"), **options)
    stay = found.where((F.col("doc_id") == F.col("component_id")) | F.col("component_id").isNull()).select("doc_id").distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, similarity 0.8."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
