"""The map: a fuzzy graph over nearest neighbours, laid out in two dimensions.

Neighbours, their memberships and the graph are Spark jobs. The layout moves
all points at once in each epoch: forces of edges and of sampled others are
joined and summed by point, so points spread over the cluster as rows do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.operators.build import fit_pca, projected
from songfield.operators.similarity import knn_self_join
from songfield.schemas import MIN_DIST, NEGATIVES, SEED, SPREAD, UMAP_K
from songfield.sources.tables import written


def memberships(distances: np.ndarray, k: int) -> np.ndarray:
    """For each row of distances (inf where there is none) 1 at the nearest that
    isn't at 0, falling so that all sum to a logarithm of k. The sums grow with the
    widths, so all rows' widths are halved in at once, on a logarithmic scale."""
    there = np.isfinite(distances)
    rho = np.where(there & (distances > 0), distances, np.inf).min(axis=1, initial=np.inf, keepdims=True)
    beyond = np.maximum(0, distances - np.where(np.isfinite(rho), rho, 0.0))
    low, high = np.full((len(distances), 1), -28.0), np.full((len(distances), 1), 14.0)
    for _ in range(50):
        middle = (low + high) / 2
        over = np.exp(-beyond / np.exp(middle)).sum(axis=1, keepdims=True) > np.log2(k + 1) - 1
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    mean = np.where(there, distances, 0).sum(axis=1, keepdims=True) / np.maximum(1, there.sum(axis=1, keepdims=True))
    return np.exp(-beyond / np.maximum(np.exp(low), np.maximum(1e-3 * mean, 1e-12)))


def fuzzy_graph(rows: DataFrame, k: int = UMAP_K) -> DataFrame:
    """(src, dst, w), each edge in both directions: w + v - w v."""
    near = knn_self_join(rows, k).withColumn("d", F.greatest(F.lit(0.0), 1 - F.col("micro") / 1e6))
    lists = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d", "dst"))).alias("n"))  # k each

    @F.pandas_udf("array<double>")
    def weigh(lists: pd.Series) -> pd.Series:
        sizes = [len(own) for own in lists]
        distances = np.full((len(sizes), max(sizes, default=0)), np.inf)
        for row, own in zip(distances, lists):
            row[: len(own)] = [x["d"] for x in own]
        return pd.Series([row[:n] for row, n in zip(memberships(distances, k), sizes)], dtype=object)

    one = lists.withColumn("w", weigh("n")).select("src", F.explode(F.arrays_zip("n", "w")).alias("x")).select("src", F.col("x.n.dst").alias("dst"), F.col("x.w").alias("w"))
    both = one.select("src", "dst", "w", F.lit(0.0).alias("v")).unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    pair = both.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("v").alias("v"))
    return pair.select("src", "dst", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))


def curve(min_dist: float = MIN_DIST, spread: float = SPREAD) -> tuple[float, float]:
    """A and b of 1 / (1 + a x^2b) nearest to the wanted fall, by grids that shrink."""
    x = np.linspace(0, 3 * spread, 300)
    wanted = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, reach = 1.5, 1.0, 1.0
    for _ in range(60):
        grid_a = np.maximum(1e-3, a + reach * np.linspace(-1, 1, 9))
        grid_b = np.maximum(1e-3, b + reach * 0.5 * np.linspace(-1, 1, 9))
        fit = 1 / (1 + grid_a[:, None, None] * x ** (2 * grid_b[None, :, None]))
        i, j = np.unravel_index(((fit - wanted) ** 2).sum(-1).argmin(), (9, 9))
        a, b, reach = float(grid_a[i]), float(grid_b[j]), reach * 0.8
    return a, b


def initial(rows: DataFrame) -> DataFrame:
    """The first two axes, each from -10 at its least to 10 at its largest, with a
    little noise; an axis without extent is 0."""
    mean, axes = fit_pca(rows, "unit", 2)
    flat = rows.select("id", projected(F.col("unit"), mean, axes).alias("p")).select("id", F.get("p", F.lit(0)).alias("x"), F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)).alias("y"))
    ends = flat.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "low_"), (F.max, "high_"))])  # one row
    noise = lambda salt: (F.pmod(F.xxhash64(F.lit(SEED), F.lit(salt), "id"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 2e-4
    across = lambda c: F.when(F.col(f"high_{c}") > F.col(f"low_{c}"), (F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")) * 20 - 10).otherwise(0.0)
    return flat.crossJoin(F.broadcast(ends)).select("id", (across("x") + noise(0)).alias("x"), (across("y") + noise(1)).alias("y"))


def layout(rows: DataFrame, epochs: int = 50, k: int = UMAP_K, negatives: int = NEGATIVES) -> DataFrame:
    """(id, x, y). Each epoch every point moves by its edges' pull, by
    weight, and the push of ``negatives`` others drawn by a hash of the epoch. Places
    meet edges by shuffles: as broadcasts they would pass through the driver each epoch."""
    n = rows.count()
    if n < 3:
        raise ValueError("a map needs three rows")
    a, b = curve()
    graph = written(fuzzy_graph(rows, k), "graph")
    numbered = written(rows.select("id", F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(n)).cast("bigint").alias("slot")), "slots")
    at = written(initial(rows), "layout")
    clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        here = at.select(F.col("id").alias("src"), "x", "y")
        there = at.select(F.col("id").alias("dst"), F.col("x").alias("u"), F.col("y").alias("v"))
        dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
        d2 = dx * dx + dy * dy
        pull = F.when(d2 > 0, -2 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0) * F.col("w")
        drawn = numbered.select(F.col("id").alias("src"), F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(epoch), F.lit(i), "id"), F.lit(n)) for i in range(negatives)])).alias("slot")).join(numbered.select("slot", F.col("id").alias("dst")).hint("shuffle_hash"), "slot").filter("src <> dst").select("src", "dst")
        push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, b)))
        force = lambda edges, g: edges.join(there.hint("shuffle_hash"), "dst").join(here.hint("shuffle_hash"), "src").select("src", clip(g * dx).alias("fx"), clip(g * dy).alias("fy"))
        total = force(graph, pull).unionByName(force(drawn, push)).groupBy("src").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        moved = at.join(total.withColumnRenamed("src", "id").hint("shuffle_hash"), "id", "left")
        step = lambda c, f: (F.col(c) + rate * 0.2 * clip(F.coalesce(f, F.lit(0.0)))).alias(c)  # noqa: B023, E731
        at = written(moved.select("id", step("x", "fx"), step("y", "fy")), "layout")
    return at
