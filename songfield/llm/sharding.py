"""Sharding as a uniform shuffle with exact shard sizes.

Rows fall into blocks by a hash of their keys. For the counts of the blocks a
communication matrix is drawn from the multivariate hypergeometric law: entry
(block, shard) says how many rows of the block go to the shard, rows sum to the
block's count and columns to the shard's exact size. Each block is permuted by
itself and cut as its row of the matrix says; the pieces are exchanged; and
each shard is permuted again, in buckets of one shard that are dealt out
evenly, so no task holds a whole shard.

Blocks and orders come from hashes of the keys under a seed, never from where
a row happens to be: a recomputed task gives the same places. Rows that agree
in all keys are interchangeable, and keep one place each. Equal texts get
independent places. Nulls are values like others; texts of any length are hashed
whole. An empty table gives no rows. Columns called shard or slot are an error.
Places follow from the keys, the seed and ``n_blocks``; give the latter where
sessions with other numbers of shuffle partitions must agree.

The exchanges carry the columns that the caller selects. For long texts, place
the keys and join the places back, or select the texts too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songfield.llm.common import partitions, refuse_clash


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without return are good. Numbers of any size: the
    law is summed outwards from its mode until nothing is left of it."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    spread = 1 + int(12 * np.sqrt(max(1.0, n * (good / total) * (bad / total) * max(1, total - n) / max(1, total - 1))))
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    ratio_up = (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
    ratio_down = down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
    law = np.concatenate([np.cumprod(ratio_down)[::-1], [1.0], np.cumprod(ratio_up)])
    at = int(np.searchsorted(np.cumsum(law), rng.random() * law.sum(), side="right"))
    return mode - len(down) + min(at, len(law) - 1)


def communication(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """(blocks, shards) counts: shard sizes are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for b, count in enumerate(counts):
        rest = sum(left)
        for s in range(n_shards):
            rest -= left[s]
            out[b, s] = draw(rng, left[s], rest, count)
            left[s] -= int(out[b, s])
            count -= int(out[b, s])
    return out


def shard(rows: DataFrame, n_shards: int = 8, keys: list[str] | None = None, seed: int = 0, n_blocks: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``n_blocks`` bounds a task: about rows / n_blocks of them. By default it
    follows spark.sql.shuffle.partitions, which grows with the data; the driver
    sees one count for each block.
    """
    spark = rows.sparkSession
    refuse_clash(rows.columns, "shard", "slot")
    n_blocks = n_blocks or 8 * partitions(spark)
    keys = keys or rows.columns

    def hashed(salt: str):
        return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys])

    blocked = rows.withColumn("__block", F.pmod(hashed("block"), F.lit(n_blocks)).cast("int"))
    counts = dict(blocked.groupBy("__block").count().collect())
    matrix = communication([counts.get(b, 0) for b in range(n_blocks)], n_shards, seed)
    ends = np.cumsum(matrix, axis=1)
    table = spark.createDataFrame([(b, [int(x) for x in ends[b]]) for b in sorted(counts)], "__block int, __ends array<bigint>")
    order = Window.partitionBy("__block").orderBy(hashed("first"), *keys)
    cut = blocked.withColumn("__at", F.row_number().over(order)).join(F.broadcast(table), "__block")
    placed = cut.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__at"))).cast("int")).drop("__block", "__at", "__ends")
    # Second permutation: by bucket, then within it.
    per_shard = max(1, -(-n_blocks // n_shards))
    dealt = placed.withColumn("__bucket", F.pmod(hashed("bucket"), F.lit(per_shard)).cast("int"))
    sizes = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("shard", "__bucket").count().collect())
    starts, run, last = [], 0, None
    for s, b, n in sizes:
        run = run if s == last else 0
        starts.append((s, b, run))
        run, last = run + n, s
    offsets = spark.createDataFrame(starts, "shard int, __bucket int, __start bigint")
    inner = Window.partitionBy("shard", "__bucket").orderBy(hashed("second"), *keys)
    return (
        dealt.withColumn("__at", F.row_number().over(inner))
        .join(F.broadcast(offsets), ["shard", "__bucket"])
        .withColumn("slot", F.col("__start") + F.col("__at") - 1)
        .drop("__bucket", "__at", "__start")
        .select(*rows.columns, "shard", "slot")
    )
