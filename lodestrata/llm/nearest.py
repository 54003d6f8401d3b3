"""Operator 3, approximate nearest neighbours: multi-index hashing of learned rotated binary codes.

Vectors are centred and rotated, and the signs are the code; the rotations are learned by iterative quantisation on a
bounded sample. Codes are split into substrings of SUBSTRING bits. By the pigeonhole principle a code within Hamming radius
R of a query is within R // m, or less, of it in some of the m substrings.

Each substring has an index: its rows are dealt into cells by the substring's first bits, and a cell keeps inverted lists
by the substring's value. A query goes to the cells that hold values near enough, takes the lists of those values, checks
the whole codes' distance, and reranks what is left by exact inner products in double precision; a row that several
substrings retrieve is reranked in the first only. Cells with many rows or many queries are split by both.

Equal vectors are one entry of the index with their smallest ids, so neither a query nor the index meets copies one by one.
The radius is measured, not set: SAMPLE_QUERIES queries are compared with all rows, and R is what RECALL of their true
neighbours need. Queries that find fewer than k rows within it are asked again with wider radii, at last with one that
holds every code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import durable, join_counted, table

NAME = "op3_nearest"

K = 20
#: Rows that the rotations are learned on, at most; learned rotations, one code bit for each dimension of each.
SAMPLE = 4000
ROTATIONS = 2
SAMPLE_QUERIES = 100
RECALL = 0.985
#: Bits of a substring; rows and queries that meet in one group, about; bits that name a cell, at most.
SUBSTRING = 32
CELL_ROWS = 16_000
CELL_QUERIES = 8_000
CELL_BITS = 16


def learn(x: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (d, d * rotations) projection: rotations fitted in turn to the signs of what they give, from seeded starts."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    v = x - mean
    out = []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes: one substring of SUBSTRING bits a column, the last filled up with zeros."""
    bits = (x - mean) @ projection > 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
    return np.packbits(bits.reshape(len(x), -1, SUBSTRING), axis=2, bitorder="big").view(">u4")[:, :, 0].astype(np.uint32)


def _hamming(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ q).sum(axis=1, dtype=np.int32)


def limits(radius: int, m: int) -> np.ndarray:
    """How near each of ``m`` substrings is searched: codes within the radius are within the limit in one of them."""
    whole, rest = divmod(radius, m)
    # if the first rest + 1 are all further than whole and the others than whole - 1, the sum is above the radius
    return np.where(np.arange(m) <= rest, whole, whole - 1)


def search(x: np.ndarray, codes: np.ndarray, q: np.ndarray, qc: np.ndarray, j: int, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the ``k`` best, and ties of the last, of the rows that substring ``j`` is the first to retrieve."""
    limit = limits(radius, codes.shape[1])
    by = np.argsort(codes[:, j], kind="stable")
    values, starts = np.unique(codes[by, j], return_index=True)  # inverted lists: rows by[starts[v] : ends[v]]
    size = np.diff(np.append(starts, len(by)))
    x, codes = x[by], codes[by]
    out = ([], [], [])
    for i in range(len(q)):
        near = np.bitwise_count(values ^ qc[i, j]) <= limit[j]
        at = np.flatnonzero(np.repeat(near, size))
        apart = np.bitwise_count(codes[at] ^ qc[i])
        first = apart.sum(axis=1, dtype=np.int32) <= radius
        if j:
            first &= ~(apart[:, :j] <= limit[:j]).any(axis=1)
        at = at[first]
        score = (x[at] * q[i]).sum(axis=1)
        if len(at) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[keep], score[keep]
        for column, v in zip(out, (np.full(len(at), i), by[at], score), strict=True):
            column.append(v)
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=int) for c in out)


def usable(rows: DataFrame, dimensions: int) -> DataFrame:
    """Rows that take part: an id, and a vector of ``dimensions`` finite components that aren't all zero."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") == dimensions) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select("vec_id", "embedding", e.alias("e")).where(ok).where(F.exists("e", lambda v: v != 0)).select("vec_id", "e")


def _name(vector: str) -> Column:
    """A vector's name: 128 bits of hashes, as text."""
    return F.concat_ws(":", F.xxhash64(vector).cast("string"), F.xxhash64(F.lit(1), F.col(vector)).cast("string"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def nearest(rows: DataFrame, step: int = 20, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row whose id is divisible by ``step``.

    Nearest: largest inner product of the original vectors, ties to the smaller id; a row is no candidate for itself, that
    is for its id. Null vectors, zero ones, and those with null or non-finite components take no part, nor do null ids
    and vectors whose length isn't the commonest. Rows that repeat id and vector count once; one id with several vectors
    is several queries' worth of neighbours merged under it. Extra columns are ignored; an empty table gives an empty
    result. Every query gets ``k`` rows where there are so many candidates.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usual = rows.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual["d"]
    valid = durable(usable(rows, d).distinct())
    # an entry for each vector: of equal ones the k + 1 smallest ids, which is all that any query can use
    some = valid.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = durable(some.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("o", _name("e")))
    learned = entries.orderBy("o").limit(sample).select("e").toArrow()
    if learned.num_rows == 0:
        return spark.createDataFrame([], schema)
    mean, projection = learn(_matrix(learned.column("e")))
    queries = valid.where(F.col("vec_id") % step == 0)
    asked = durable(queries.select("e").distinct().withColumn("o", _name("e")))
    count = entries.count()
    if asked.isEmpty():
        return spark.createDataFrame([], schema)

    # the radius: sample queries against all rows
    picked = _matrix(asked.orderBy("o").limit(SAMPLE_QUERIES).select("e").toArrow().column("e"))
    picked_codes = encode(picked, mean, projection)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            s = picked @ x.T
            codes = encode(x, mean, projection)
            q, row, score = [], [], []
            for i in range(len(picked)):
                at = np.argpartition(-s[i], min(k, len(x) - 1))[: k + 1]
                q.append(np.full(len(at), i))
                score.append(s[i, at])
                row.append(_hamming(codes[at], picked_codes[i]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (q, row, score)], names=["q", "h", "s"])

    best = entries.select("e").mapInArrow(measure, "q long, h long, s double")
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "h"))).where(F.col("r") <= k + 1)
    true = np.array([r["h"] for r in best.select("h").collect()])  # SAMPLE_QUERIES * (k + 1) numbers at most
    radius = int(np.quantile(true, recall, method="higher"))

    bits = projection.shape[1]
    m = math.ceil(bits / SUBSTRING)
    prefix = min(CELL_BITS, SUBSTRING, max(2, math.ceil(math.log2(max(1, count / CELL_ROWS)))))

    def coded(some: DataFrame) -> DataFrame:
        """Adds ``subs``: the code's substrings as numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = encode(_matrix(batch.column(names.index("e"))), mean, projection).astype(np.int64)
                subs = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, m), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, subs], names=[*names, "subs"])

        names = some.columns
        return some.mapInArrow(run, StructType([*some.schema.fields, StructField("subs", ArrayType(LongType()))]))

    rows_coded = durable(coded(entries.select("o", "e", "ids")))
    cell = F.shiftright("v", SUBSTRING - prefix)
    posted = rows_coded.select("o", "e", "ids", "subs", F.posexplode("subs").alias("j", "v")).withColumn("cell", cell)

    def lookup(some: DataFrame, radius: int) -> DataFrame:
        """``o, near``: what the vectors in ``some`` find within the radius, the k + 1 best."""
        limit = limits(radius, m).tolist()
        masks = F.array(*[F.array(*[F.lit(x) for x in range(1 << prefix) if x.bit_count() <= r]) if r >= 0 else F.array().cast("array<int>") for r in limit])
        probes = coded(some.select("o", "e")).select("o", "e", "subs", F.posexplode("subs").alias("j", "v"))
        probes = durable(probes.withColumn("mask", F.explode(F.get(masks, F.col("j")))).withColumn("cell", cell.bitwiseXOR(F.col("mask"))).drop("mask", "v"))
        # how cells are split: a row for each cell of a substring, so m * 2 ** CELL_BITS rows at most
        lots = posted.groupBy("j", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("lots"))
        lots = lots.join(probes.groupBy("j", "cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("blocks")), ["j", "cell"])
        lots = F.broadcast(durable(lots))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index = posted.join(lots, ["j", "cell"]).withColumn("lot", F.pmod(F.hash("o"), "lots")).withColumn("block", upto("blocks"))
        asked = probes.join(lots, ["j", "cell"]).withColumn("block", F.pmod(F.hash("o"), "blocks")).withColumn("lot", upto("lots"))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"o": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
            x, q = _matrix(left.column("e")), _matrix(right.column("e"))
            codes, qc = (_matrix(t.column("subs")).astype(np.uint32) for t in (left, right))
            i, at, score = search(x, codes, q, qc, left.column("j")[0].as_py(), radius, k + 1)
            return pa.table({"o": right.column("o").take(pa.array(i)), "ids": left.column("ids").take(pa.array(at)), "score": pa.array(score, pa.float64())})

        keys = ["j", "cell", "lot", "block"]
        found = index.select(*keys, "e", "ids", "subs").groupBy(*keys).cogroup(asked.select(*keys, "o", "e", "subs").groupBy(*keys)).applyInArrow(probe, "o string, ids array<long>, score double")
        # k + 1 entries hold what any of the queries with this vector can use; ties of the last one all stay until ids decide
        found = found.withColumn("r", F.rank().over(Window.partitionBy("o").orderBy(F.desc("score")))).where(F.col("r") <= k + 1)
        flat = found.select("o", "score", F.explode("ids").alias("vec_id"))
        flat = flat.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        return durable(flat.groupBy("o").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near")))

    # a vector that finds k + 1 ids, its own among them, is done; the others look further, until all codes are within reach
    wider = math.ceil(bits / 8)
    if valid.limit(k + 2).count() <= k + 1:
        radius = bits
    lists, left = lookup(asked, radius), asked
    while radius < bits:
        done = lists.where(F.size("near") > k)
        left = durable(left.join(done, "o", "left_anti"))
        if left.isEmpty():
            break
        radius, wider = min(bits, radius + wider), 2 * wider
        lists = done.unionByName(lookup(left, radius))
    own = durable(queries.select(F.col("vec_id").alias("query_id"), _name("e").alias("o")))
    # every query takes its vector's list, without itself; a vector with very many queries is no hot key
    lists = lists.join(own.groupBy("o").agg(F.count("*").alias("_n")), "o")
    hits = join_counted(own, lists, "o", "_n", own.count()).where("near is not null")
    hits = hits.select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    each = hits.select("query_id", F.explode("near").alias("n")).select("query_id", "n.vec_id", (-F.col("n.s")).alias("score"))
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
