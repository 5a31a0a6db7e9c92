"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Fit (bounded sample): principal axes, then iterative quantisation: a rotation is learned that brings the rotated
sample closest to the corners of the sign cube. ``CODES`` such rotations from different starts give one long
code. The search radius is learned too: the Hamming distance within which ``target`` of the sample's true
neighbours lie. Neighbours in the whole table are nearer than those in a sample, so this errs on the wide side.

Index: every row's code is cut into 16-bit substrings, and each block of rows keeps, per substring, its distinct
values with the rows that have them. Probing follows the pigeonhole: a code within radius r of the query agrees
with it to within r // m bits in at least one of m substrings. So the buckets that near in some substring hold
every code of the radius; those are compared in full, and the codes within the radius are reranked by the exact
cosine of the original vectors. A block in which the radius holds fewer than k rows widens it until it does.

Distribution: index blocks and query blocks are of bounded size, dealt by hash; a cell (query block, index block)
is one task's work and returns k rows a query. Only the stated query set is compared with the table, block by
block; no pairs are written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 8_000          # rows the rotations and the radius are fitted on, at most
SAMPLE_QUERIES = 200    # of them, those whose true neighbours set the radius
CODES = 4               # rotations; code length is CODES x dimensions
TARGET = 0.97
BLOCK = 8_192           # rows of an index block
QUERY_BLOCK = 2_048
SUBSTRING = 16


def _pca_itq(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Dimensions x dimensions projection: principal axes times a rotation fitted to the sign cube."""
    _, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(x.shape[1]))
    v = x @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return axes @ rotation


def _codes(x: np.ndarray, projection: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Signs of the projected unit vectors as 16-bit substrings, rows x m."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = (unit - mean) @ projection > 0
    pad = -bits.shape[1] % SUBSTRING
    bits = np.pad(bits, ((0, 0), (0, pad)))
    return np.packbits(bits, axis=1).reshape(len(x), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, k: int, codes: int = CODES, target: float = TARGET) -> tuple[np.ndarray, np.ndarray, int]:
    """(projection, mean, radius) from sample vectors (rows x dimensions, none of them zero)."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    projection = np.concatenate([_pca_itq(unit - mean, 17 + c) for c in range(codes)], axis=1)
    code = _codes(sample, projection, mean)
    some = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    near = unit[some] @ unit.T
    near[np.arange(len(some)), some] = -2
    k = min(k, len(sample) - 1)
    if k < 1:
        return projection, mean, projection.shape[1]
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    distances = np.sort(_hamming(code[some][:, None, :], code[best]).ravel())
    return projection, mean, int(distances[min(len(distances) - 1, math.ceil(target * len(distances)))])


class _Index:
    """Substring tables of one block: per substring its distinct values and the rows of each."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, at = np.unique(code[order, j], return_index=True)
            self.tables.append((values, np.append(at, len(order)), order))

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of the query's: pigeonhole buckets, then the full distance."""
        m = len(self.tables)
        seen = np.zeros(len(self.code), dtype=bool)
        for j, (values, at, order) in enumerate(self.tables):
            near = np.flatnonzero(np.bitwise_count(values ^ query[j]) <= radius // m)
            size = at[near + 1] - at[near]
            upto = np.cumsum(size)
            seen[order[np.repeat(at[near] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]] = True
        rows = np.flatnonzero(seen)
        return rows[_hamming(self.code[rows], query) <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _search(projection: np.ndarray, mean: np.ndarray, radius: int, k: int):
    def cell(queries: pa.Table, block: pa.Table) -> pa.Table:
        q_ids, ids = queries.column("id").to_numpy(), block.column("id").to_numpy()
        found: list[tuple] = []
        if len(q_ids) and len(ids):
            q, x = _matrix(queries.column("vec")), _matrix(block.column("vec"))
            index = _Index(_codes(x, projection, mean))
            q_code = _codes(q, projection, mean)
            norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            for i in range(len(q_ids)):
                r = radius
                while True:
                    rows = index.probe(q_code[i], r)
                    rows = rows[ids[rows] != q_ids[i]]
                    if len(rows) >= k or r >= projection.shape[1]:
                        break
                    r = min(projection.shape[1], r + SUBSTRING)
                score = (x[rows] @ q[i]) / (norm[rows] * q_norm[i])
                best = np.lexsort((ids[rows], -score))[:k]
                found += [(q_ids[i], ids[rows[b]], score[b]) for b in best]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()),
                         "score": pa.array(c, pa.float64())})

    return cell


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): vectors that are not null or zero and have only finite components."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    ok = F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok & F.exists("vec", lambda c: c != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            codes: int = CODES, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of every query row by cosine, nearest first.

    ``is_query``: a condition on column ``id``. Candidates are all other rows. Ties go to the smaller vec_id.
    Null and zero vectors, null ids, vectors with null or non-finite components and vectors of another length than
    most of the sample take no part. A repeated id is one candidate per row, never of its own query. Other
    columns are not read; an empty table gives no rows.
    """
    v = usable(vectors, id_col, vec_col)
    sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    if sample.num_rows == 0:
        return v.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                        F.lit(0.0).alias("score")).where(F.lit(False))
    lengths = sample.column("vec").combine_chunks().value_lengths().to_numpy()
    size = int(np.bincount(lengths).argmax())
    v = v.where(F.size("vec") == size)
    projection, mean, radius = fit(_matrix(sample.filter(pa.array(lengths == size)).column("vec")), k, codes, target)
    n = v.count()
    queries = v.where(is_query)
    n_queries = queries.count()
    blocks, q_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    salted = F.xxhash64("id", "vec")
    left = (queries.withColumn("qb", F.pmod(salted, F.lit(q_blocks)))
            .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (v.withColumn("ib", F.pmod(F.hash("id", "vec"), F.lit(blocks)))
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))))
    found = (left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib"))
             .applyInArrow(_search(projection, mean, radius, k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("id % 50 = 0"))
