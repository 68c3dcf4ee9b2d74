"""Nearest neighbours by cosine over a multi-index of learned binary codes.

Vectors are scaled to length one and rotated; the rotations are learned on a bounded sample
(principal axes, then alternating between signs and the closest rotation), several of them side
by side, and the signs are the code.  A code is split into substrings of one byte; each index
part has for every substring a table from its values to its rows.  By the pigeonhole
principle a code within radius ``m * t + a`` of a query's agrees within ``t`` bits in one of the
first ``a + 1`` of the ``m`` substrings or within ``t - 1`` in another, so probing the tables
with the values that near retrieves every code in the radius.  Those are ranked by the exact
cosine of the original vectors.  The radius is learned too: it holds nearly all true
neighbours of sampled queries within the sample, whose neighbours are farther than those among
all rows.  A query that finds fewer than ``k`` rows is searched again with all codes in reach.

Every row is indexed; parts are the batches of the tasks, so an index of any size is searched
in parallel.  Queries are sent in blocks of bounded size, one pass over the index each.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a null vec_id takes no part; a repeated vec_id counts once
as a candidate, by its best row, and as a query with its smallest vector; ties go to the
smaller vec_id; with fewer than ``k`` candidates all are returned; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.inputs import arrow_schema, table, written

SAMPLE = 20_000
ROTATIONS = 4
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, vectors as doubles."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(good & some)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vector") == (length["d"] if length else 0))


class Codes:
    """The learned rotations and the search radius."""

    def __init__(self, sample: np.ndarray, k: int, rotations: int = ROTATIONS, rounds: int = 20,
                 reach: float = 0.985):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        d = x.shape[1]
        rng = np.random.default_rng(7)
        _, axes = np.linalg.eigh(x.T @ x)
        v = x @ axes
        turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, axis=1)
        self.m = -(-self.turn.shape[1] // 8)
        self.bits = self.m * 8
        self.radius = self.bits
        if len(x) > 10 * k:
            codes = self.encode(sample)
            some = rng.choice(len(x), min(300, len(x)), replace=False)
            far = []
            for i in some:
                s = x @ x[i]
                s[i] = -2
                near = np.argpartition(-s, k)[:k]
                far += list(POPCOUNT[codes[near] ^ codes[i]].sum(axis=1, dtype=np.int64))
            self.radius = int(np.quantile(far, reach))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as bytes (rows x m)."""
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits(x @ self.turn >= 0, axis=1)


class Part:
    """The tables of one part of the index: rows by substring and value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(codes, self.order, axis=0)
        self.start = np.stack([np.searchsorted(ordered[:, j], np.arange(257)) for j in range(codes.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: probed by substring, checked on the whole."""
        m = self.codes.shape[1]
        t, extra = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        values = np.arange(256, dtype=np.uint8)
        for j in range(m):
            near = np.flatnonzero(POPCOUNT[values ^ code[j]] <= (t if j <= extra else t - 1))
            lo, n = self.start[j][near], self.start[j][near + 1] - self.start[j][near]
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen[self.order[at, j]] = True
        rows = np.flatnonzero(seen)
        return rows[POPCOUNT[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


INDEXED = "vec_id long, code binary, vector array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_index(vectors: DataFrame, codes: Codes) -> DataFrame:
    """(vec_id, code, vector) of every valid row."""
    schema = arrow_schema(INDEXED)
    sent = vectors.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        for batch in batches:
            packed = sent.value.encode(_matrix(batch.column("vector"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), pa.array([x.tobytes() for x in packed], pa.binary()),
                 batch.column("vector").cast(schema.field("vector").type)], schema=schema)

    return vectors.mapInArrow(run, INDEXED)


FOUND = "query_id long, vec_id long, score double"


def search(index: DataFrame, queries: list, codes: Codes, k: int, radius: int) -> DataFrame:
    """The best ``k`` rows in the radius, of each task, for one block of (id, vector) queries."""
    schema = arrow_schema(FOUND)
    ids = np.array([q[0] for q in queries], np.int64)
    vectors = np.array([q[1] for q in queries], np.float64)
    sent = index.sparkSession.sparkContext.broadcast(
        (ids, vectors, np.linalg.norm(vectors, axis=1), codes.encode(vectors)))

    def run(batches):
        q_ids, q, q_norm, q_codes = sent.value
        best: list = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = Part(np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            x, own = _matrix(batch.column("vector")), batch.column("vec_id").to_numpy()
            norm = np.linalg.norm(x, axis=1)
            for i in range(len(q_ids)):
                rows = part.within(q_codes[i], radius)
                rows = rows[own[rows] != q_ids[i]]
                if not len(rows):
                    continue
                score = np.einsum("ij,j->i", x[rows], q[i]) / (norm[rows] * q_norm[i])
                score = np.concatenate([best[i][0], score])
                named = np.concatenate([best[i][1], own[rows]])
                order = np.lexsort((named, -score))
                _, first = np.unique(named[order], return_index=True)
                order = order[np.sort(first)[:k]]
                best[i] = score[order], named[order]
        sizes = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([b[1] for b in best] or [[]]).astype(np.int64)),
             pa.array(np.concatenate([b[0] for b in best] or [[]]))], schema=schema)

    return index.select("vec_id", "code", "vector").mapInArrow(run, FOUND)


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", sample: int = SAMPLE, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found of each query.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df, id_col, vector_col)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    result_type = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], result_type)
    codes = Codes(np.array([r["vector"] for r in chosen], np.float64), k)
    index = written(build_index(vectors, codes), "index")
    queries = (index.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks = max(1, -(-queries.count() // block))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
                      .repartition("block"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    parts = []
    for b in range(blocks):
        mine = [(r["vec_id"], r["vector"]) for r in queries.filter(F.col("block") == b).collect()]
        if not mine:
            continue
        found = written(merged(search(index, mine, codes, k, codes.radius)), "found")
        # Too few in the radius: every code is in reach of a second search.
        count = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
        few = [q for q in mine if count.get(q[0], 0) < k]
        if few and codes.radius < codes.bits:
            again = merged(search(index, few, codes, k, codes.bits))
            redone = spark.createDataFrame([(q[0],) for q in few], "query_id long")
            found = found.join(F.broadcast(redone), "query_id", "left_anti").unionByName(again)
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], result_type)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
