"""Building the space: statistics over all rows, then one pass per block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songfield.functions.music import finite
from songfield.functions.vectors import quantised
from songfield.operators.numbering import medians, numbered
from songfield.schemas import LANGUAGE_LEAST, LANGUAGE_MOST, PHRASES_MOST


def imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What isn't finite becomes the column's exact median; 0 if nothing is."""
    middle = medians(rows.select(*[finite(F.col(c)).alias(c) for c in columns]), columns)
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(float(middle[c] or 0.0))) for c in columns})


def column_stats(rows: DataFrame, block: str, width: int) -> list[tuple[float, float]]:
    """Mean and population spread of each column of an array, what isn't
    finite as 0; a spread below 1e-9 is 1."""
    value = lambda i: F.coalesce(finite(F.get(F.col(block), F.lit(i))), F.lit(0.0))
    row = rows.agg(*[f for i in range(width) for f in (F.avg(value(i)), F.stddev_pop(value(i)))]).first()
    return [(row[2 * i] or 0.0, row[2 * i + 1] if (row[2 * i + 1] or 0.0) >= 1e-9 else 1.0) for i in range(width)]


def normalised(rows: DataFrame, block: str, width: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Columns to mean 0 and spread 1, then rows to length 1."""
    stats = column_stats(rows, block, width)
    scaled = F.array(*[(F.coalesce(finite(F.get(F.col(block), F.lit(i))), F.lit(0.0)) - m) / s for i, (m, s) in enumerate(stats)])
    out = rows.withColumn("__z", scaled)
    length = F.greatest(F.sqrt(F.aggregate("__z", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    return out.withColumn("__n", length).withColumn(block, F.transform("__z", lambda x: x / F.col("__n"))).drop("__z", "__n"), stats


def scatter(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and product matrix of all rows: each task adds its own up,
    then sums of sums are added, so the driver sees one d by d matrix."""
    def part(frames):
        n, s, p = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(np.float64)
                n, s, p = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if p is None else p)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "p": [p.ravel()]})

    def total(frames):
        held = [f for f in frames if len(f)]
        if held:
            f = pd.concat(held)
            yield pd.DataFrame({"n": [f["n"].sum()], "s": [np.sum(f["s"].to_list(), axis=0)], "p": [np.sum(f["p"].to_list(), axis=0)]})

    schema = "n bigint, s array<double>, p array<double>"
    sums = rows.select(F.col(vector).alias("v")).mapInPandas(part, schema).repartition(16).mapInPandas(total, schema).collect()
    d = len(sums[0]["s"])
    return sum(r["n"] for r in sums), np.sum([r["s"] for r in sums], axis=0), np.sum([r["p"] for r in sums], axis=0).reshape(d, d)


def fit_pca(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first k axes, by falling variance; each axis's largest
    coefficient is positive."""
    n, total, products = scatter(rows, vector)
    mean = total / n
    values, axes = np.linalg.eigh(products - n * np.outer(mean, mean))
    axes = axes[:, np.argsort(-values, kind="stable")].T[: min(k, n, len(mean))]
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(vector: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Centred, then onto the axes."""
    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(np.float64) - mean) @ axes.T)) if len(v) else pd.Series([], dtype=object)

    return project(vector)


def axis_scores(vector: Column, directions: np.ndarray) -> Column:
    """One product for each direction, such as a phrase less its opposite."""
    return projected(vector, np.zeros(directions.shape[1]), directions)


def semantic(vector: Column, mean: np.ndarray, axes: np.ndarray, stats: list[tuple[float, float]]) -> Column:
    """A phrase as a row of the semantic block."""
    m, s = np.array([x for x, _ in stats]), np.array([x for _, x in stats])

    @F.pandas_udf("array<double>")
    def place(v: pd.Series) -> pd.Series:
        z = (((np.stack(v.to_numpy()).astype(np.float64) - mean) @ axes.T) - m) / s
        return pd.Series(list(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)))

    return place(vector)


def phrase_rows(segments: DataFrame, visible: DataFrame, mean: np.ndarray, axes: np.ndarray, stats: list[tuple[float, float]]) -> DataFrame:
    """(number, track_id, first, count, starts, rows) for every visible track with a
    phrase, in the order of ids: where each of its phrases begins, and what it is in the
    semantic block, in bytes; its phrases are numbers first to first + count - 1 of all.

    ``segments`` are (track_id, pos, start, embedding), a row each. Of a track's first
    65,535 those count whose vector is as wide as the model's; a track without any has
    no row. Equal positions keep their order by start."""
    if axes.ndim != 2 or axes.shape[1] != len(mean) or axes.shape[0] != len(stats):
        raise ValueError("the model does not fit the semantic block")
    own = segments.filter((F.col("pos") < PHRASES_MOST) & (F.size("embedding") == len(mean))).join(visible.select(F.col("id").alias("track_id")).distinct(), "track_id", "left_semi")
    placed = own.select("track_id", "pos", F.col("start").cast("float").alias("start"), F.transform(semantic(F.col("embedding"), mean, axes, [(m, max(s, 1e-9)) for m, s in stats]), quantised).alias("row"))
    # No more than 65,535 phrases meet in a row.
    packed = placed.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "row"))).alias("p"))
    packed = packed.select("track_id", F.size("p").cast("bigint").alias("count"), F.col("p.start").alias("starts"), F.flatten("p.row").alias("rows"))
    return numbered(packed, [F.col("track_id")], weight=F.col("count"), start="first").select("number", "track_id", "first", "count", "starts", "rows")


def language_columns(rows: DataFrame, language: str = "language", least: int = LANGUAGE_LEAST, most: int = LANGUAGE_MOST) -> list[str]:
    """The commonest languages, ties by code."""
    n = rows.filter(F.col(language).isNotNull()).groupBy(language).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return [r[0] for r in n.orderBy(F.col("n").desc(), language).limit(most).collect()]


def one_hot(language: Column, codes: list[str]) -> Column:
    """Unscaled, so a row without a listed language is zero."""
    return F.array(*[F.when(language == c, 1.0).otherwise(0.0) for c in codes]) if codes else F.array().cast("array<double>")


def build(rows: DataFrame, blocks: dict[str, int]) -> tuple[DataFrame, list[dict]]:
    """The given array columns, in order, as one raw row; all but the
    language block are normalised. Returns rows (… , raw) and the blocks' manifest."""
    at, manifest = 0, []
    for name, width in blocks.items():
        stats = [(0.0, 1.0)] * width
        if name != "language":
            rows, stats = normalised(rows, name, width)
        manifest.append({"name": name, "start": at, "end": at + width, "mean": [m for m, _ in stats], "std": [s for _, s in stats]})
        at += width
    raw = F.concat(*[F.col(b) for b in blocks])
    return rows.withColumn("raw", F.transform(raw, lambda x: x.cast("float"))), manifest
