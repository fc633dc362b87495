"""Approximate nearest neighbours (operator 8): multi-index hashing.

Codes: the vectors' principal axes, turned by `rotations` learned rotations (each lowers the loss of taking signs), one
bit an axis. A code is cut into substrings of 8 bits, each with its own index of buckets. If two codes differ in at most
`radius` bits, then by the pigeonhole some substring differs in at most radius // substrings bits, so probing the
buckets that near in every index retrieves every code within the radius. What is retrieved is checked against the radius
and reranked by the distance of the original vectors in double precision.

Rotations are fitted on at most `sample` vectors (those of least hash); every valid row is indexed. The query set is
probed in blocks of `block` queries, each a broadcast of a fixed size, against all rows where they lie; a task hands on
at most `k` rows a query. A query that finds fewer than `k` within the radius is searched again without a radius.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take
no part; a null id takes no part; rows that repeat an id are separate candidates of a query, but none is a candidate of a
query with its own id, and of queries that repeat an id the vector of least hash is asked; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

POPCOUNT = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)], np.uint8)


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def learn(x: np.ndarray, rotations: int, axes: int, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the (dimension, bits) matrix whose signs are the code."""
    mean = x.mean(0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    main = vt[:axes].T
    z, turned, rng = (x - mean) @ main, [], np.random.default_rng(seed)
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(main.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ wt).T
        turned.append(main @ r)
    return mean, np.concatenate(turned, axis=1)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as (rows, substrings) bytes."""
    return np.packbits((x - mean) @ turn > 0, axis=1)


class Index:
    """A bucket directory for each 8-bit substring of the codes of one block of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: probed buckets, then a check of the whole code."""
        near = radius // len(code)
        hit = np.zeros(len(self.codes), bool)
        for sub, order, starts in zip(code, self.order, self.starts, strict=True):
            probed = POPCOUNT[sub] <= near
            hit[order[np.repeat(probed, np.diff(starts))]] = True
        rows = np.flatnonzero(hit)
        return rows[POPCOUNT[self.codes[rows], code].sum(1, dtype=np.int64) <= radius]


def searched(rows: DataFrame, queries: DataFrame, model, *, k: int, radius: int | None, block: int) -> DataFrame | None:
    """(query_id, vec_id, score): at most k a query from each task. Queries come in order of id, block by block."""
    spark, (mean, turn, dim) = rows.sparkSession, model
    out, last = None, None
    while True:
        q = queries if last is None else queries.filter(F.col("id") > last)
        part = q.orderBy("id").limit(block).collect()
        if not part:
            return out
        last = part[-1]["id"]
        ids, vectors = np.array([r["id"] for r in part]), np.array([r["v"] for r in part])
        sent = spark.sparkContext.broadcast((ids, vectors, encode(vectors, mean, turn)))

        def run(batches):
            ids, vectors, codes = sent.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                index = Index(encode(x, mean, turn))
                for i, q in enumerate(vectors):
                    found = np.arange(len(x)) if radius is None else index.within(codes[i], radius)
                    found = found[own[found] != ids[i]]
                    if len(found):
                        d, c = np.sqrt(((x[found] - q) ** 2).sum(1)), own[found]
                        d, c = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], c])
                        top = np.lexsort((c, d))[:k]
                        best[i] = (d[top], c[top])
            n = [len(d) for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate([c for _, c in best]), pa.int64()), pa.array(np.concatenate([d for d, _ in best]), pa.float64())], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionAll(found)


def neighbours(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, rotations: int = 2, axes: int = 64, radius: int = 56, sample: int = 20_000, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every valid query among all other valid rows."""
    spark = vectors.sparkSession
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    rows = rows.filter(F.size("v") == dim)
    asked = asked.filter(F.size("v") == dim).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    fitted = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()])
    mean, turn = learn(fitted, rotations, min(axes, dim, len(fitted)))
    model = (mean, turn, dim)
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    empty = spark.createDataFrame([], "query_id long, vec_id long, score double")
    first = checkpointed(best(searched(rows, asked, model, k=k, radius=radius, block=block) or empty))
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = searched(rows, asked.join(full, "id", "left_anti"), model, k=k, radius=None, block=block)
    out = first.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
    if short is not None:
        out = out.unionByName(best(short))
    return out.select("query_id", "rank", "vec_id", "score")
