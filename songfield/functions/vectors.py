"""Vectors as column expressions: arithmetic is double, storage is float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    """V1: summed from the first component to the last."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its norm, which counts as 1e-9 at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(FLOOR)))


def scales(blocks: list[tuple[str, int, int]], weights: dict[str, float], defaults: dict[str, float]) -> list[float]:
    """One factor for each column: the weight of its block. A block without a
    weight gets its default; names of no block are ignored."""
    out = []
    for name, start, end in blocks:
        out += [float(weights.get(name, defaults.get(name, 1.0)))] * (end - start)
    return out


def weighted(raw: Column, factors: list[float]) -> Column:
    """V2's scaling: each column by its block's weight. ``unit`` comes after."""
    table = F.array(*[F.lit(f) for f in factors])
    return F.zip_with(raw, table, lambda x, w: x.cast("double") * w)


def quantised(x: Column) -> Column:
    """To a byte, halves away from zero."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127).cast("tinyint")


def unquantised(b: Column) -> Column:
    return b.cast("double") / 127


def micro(x: Column) -> Column:
    """A score as millionths, for comparisons that don't hang on the last bit."""
    return F.floor(x * 1e6 + 0.5).cast("bigint")
