"""Groups that chains of links make, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.sources.tables import written


def _large_stars(links: DataFrame) -> DataFrame:
    """Each id's larger neighbours, linked with the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
    least = both.groupBy("low").agg(F.min("high").alias("least"))
    return links.join(least, "low").select(F.least("low", "least").alias("low"), "high").distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours, linked with the smallest of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    others = links.join(least, "high").filter("low <> least").select(F.col("least").alias("low"), F.col("low").alias("high"))
    return others.unionByName(least.select(F.col("least").alias("low"), "high")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): the component's smallest id. A
    link of an id with itself, or with null, is none.

    Large and small stars by turns, until each id hangs on one that hangs on none: a star
    takes one round, a chain as many as the logarithm of its length, and there are never
    more links than before. Hubs meet in aggregates, which combine before they shuffle,
    and in joins, which adaptive execution splits.
    """
    left = written(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), "links")
    while True:
        roots = left.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(left.select(F.col("low").alias("id"), F.col("low").alias("component")))
        ends = roots.groupBy("id").agg(F.min("component").alias("component"), F.max("component").alias("last"))
        if ends.filter("component < last").isEmpty():
            return ends.select("id", "component")
        left = written(_small_stars(written(_large_stars(left), "stars")), "links")
