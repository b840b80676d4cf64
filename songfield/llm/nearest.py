"""Nearest neighbours by a block matrix join of int8 product tiles.

Vectors are dealt into blocks and the queries into tiles; each (tile, block)
pair is one group of at most a few thousand rows on either side. In it unit
vectors are rounded to int8 codes on a scale of their own, and one integer
matrix product gives all cosines with a proven error bound: if x = s c + e,
then |x.y - s t c.d| <= |e| |y| + |s c| |f|. A candidate whose upper bound
lies below the k-th largest lower bound can't be among the k nearest; the
others are computed again in double precision from the original vectors and
kept in a heap of k for each query. A top-k merge joins the tiles' heaps.

The queries are a stated set against all rows; both sides are cut into blocks,
so neither a task nor the driver holds either side whole.

Vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor does a null id; vectors are compared only with those of their own
length; of rows that repeat an id the smallest vector counts; ties go to the
smaller id; a query never finds its own id. No queries or no rows give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
TILE = 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, vector: str) -> np.ndarray:
    values = table[vector].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, and the norms of what is lost."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows. Runs of 1,024 columns stay below
    2 ** 24, where single precision holds every integer."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row dot products, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile_nearest(q_ids, q, c_ids, c, k: int):
    """(query, candidate, cosine) of each query's k nearest in one tile."""
    q_sq, c_sq = _in_order(q, q), _in_order(c, c)
    q_code, q_scale, q_lost = quantised(q / np.sqrt(q_sq)[:, None])
    c_code, c_scale, c_lost = quantised(c / np.sqrt(c_sq)[:, None])
    near = product(q_code, c_code) * q_scale[:, None] * c_scale[None, :]
    bound = q_lost[:, None] + (1 + q_lost)[:, None] * c_lost[None, :] + 1e-9
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - bound)
    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    qi, ci = np.nonzero((near + bound >= least[:, None]) & ~own)
    found = []
    for at in range(0, len(qi), 1 << 18):  # bounds the copies of the vectors
        i, j = qi[at : at + (1 << 18)], ci[at : at + (1 << 18)]
        found.append(_in_order(q[i], c[j]) / np.sqrt(q_sq[i] * c_sq[j]))
    score = np.concatenate(found) if found else np.zeros(0)
    heaps: dict[int, list] = {}
    for i, j, s in zip(qi.tolist(), c_ids[ci].tolist(), score.tolist()):
        heap = heaps.setdefault(i, [])
        if len(heap) < k:
            heapq.heappush(heap, (s, -j))
        elif (s, -j) > heap[0]:
            heapq.heapreplace(heap, (s, -j))
    return [(q_ids[i], -j, s) for i, heap in heaps.items() for s, j in heap]


def search(rows: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine for every
    row that ``is_query`` holds for, nearest first."""
    one = rows.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    one = one.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    one = one.withColumn("dim", F.size("v"))
    counts = one.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("m")).filter("m > 0")
    plan = counts.select("dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    dealt = one.join(F.broadcast(plan), "dim")  # one row for each length of vector
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("id")), F.col("blocks")).cast("int")
    tile = F.pmod(F.xxhash64(F.lit("tile"), F.col("id")), F.col("tiles")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = dealt.select("dim", block.alias("block"), every("tiles").alias("tile"), "id", "v")
    queries = dealt.filter("q").select(F.col("dim").alias("q_dim"), every("blocks").alias("q_block"), tile.alias("q_tile"), F.col("id").alias("q_id"), F.col("v").alias("q_v"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = tile_nearest(right["q_id"].to_numpy(), _matrix(right, "q_v"), left["id"].to_numpy(), _matrix(left, "v"), k)
        q, c, s = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    tops = candidates.groupBy("dim", "tile", "block").cogroup(queries.groupBy("q_dim", "q_tile", "q_block")).applyInArrow(pair, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
