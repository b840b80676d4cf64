"""What a map shows: bounds, regions, cells, hits and bins, all by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.functions.music import place_hash
from songfield.operators.numbering import numbered


def bounds(rows: DataFrame) -> DataFrame:
    """M1: the rectangle of all places; zeros for none."""
    zero = lambda f, c, n: F.coalesce(f(c), F.lit(0.0)).alias(n)
    return rows.agg(zero(F.min, "x", "x0"), zero(F.max, "x", "x1"), zero(F.min, "y", "y0"), zero(F.max, "y", "y1"))


def genre_numbers(rows: DataFrame) -> DataFrame:
    """M1: genres numbered by their first row; as many rows as genres."""
    firsts = rows.groupBy("genre").agg(F.min("row_no").alias("first"))
    return numbered(firsts, [F.col("first")]).select("genre", F.col("number").cast("int").alias("number"))


def grid_side(n: int) -> int:
    """M3: about two points a cell."""
    return max(1, min(512, round((n / 2) ** 0.5)))


def celled(rows: DataFrame, side: int) -> DataFrame:
    """M3: each row's cell on a grid over the bounds, sorted by cell in its partition."""
    b = F.broadcast(bounds(rows))
    cell = lambda c, lo, hi: F.least(F.lit(side - 1), F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-12)) * side)).cast("int")
    return rows.crossJoin(b).withColumns({"cx": cell("x", "x0", "x1"), "cy": cell("y", "y0", "y1")}).drop("x0", "x1", "y0", "y1")  # one row


def inside(rows: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """M4."""
    return rows.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def hit(rows: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """M5: the nearest row within the radius, the first of equals."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return rows.withColumn("d2", d2).filter(F.col("d2") < radius * radius).orderBy("d2", "row_no").limit(1)


def _around(cells: DataFrame, reach: int) -> DataFrame:
    """Cells (genre, cx, cy, n) repeated at every cell up to ``reach`` away."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return cells.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))


def regions(rows: DataFrame, side: int = 40, share: float = 0.4, apart: int = 5) -> DataFrame:
    """M2: places where a genre is dense: over 3 by 3 cells it has enough points,
    its share, and more than its even density; no denser place of it within two
    cells, nor a denser region of it within ``apart``; the centre of its points."""
    n = rows.count()
    placed = celled(rows, side)
    cells = placed.groupBy("genre", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    spread = _around(cells, 1).select("genre", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "n", "sx", "sy")
    box = spread.groupBy("genre", "cx", "cy").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    every = box.groupBy("cx", "cy").agg(F.sum("n").alias("all"))
    sizes = cells.groupBy("genre").agg(F.sum("n").alias("size"))
    dense = box.join(every, ["cx", "cy"]).join(sizes, "genre").filter((F.col("cx").between(0, side - 1)) & F.col("cy").between(0, side - 1))
    even = F.col("size") * 9.0 / (side * side)
    good = (F.col("n") >= max(10, n / 2000)) & (F.col("n") >= share * F.col("all")) & (F.col("n") >= 1.5 * even)
    rank = F.struct(F.col("n"), (-(F.col("cy") * side + F.col("cx"))).alias("cell"))
    peaks = dense.filter(good).withColumn("rank", rank)
    for reach in (2, apart - 1):
        near = _around(peaks.select("genre", "cx", "cy", "rank"), reach).filter("dx <> 0 OR dy <> 0")
        best = near.select("genre", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "rank").groupBy("genre", "cx", "cy").agg(F.max("rank").alias("other"))
        peaks = peaks.join(best, ["genre", "cx", "cy"], "left").filter(F.col("other").isNull() | (F.col("rank") > F.col("other"))).drop("other")
    return peaks.select("genre", "n", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"))


def bins(rows: DataFrame, scale: float, size: float, most: float = 8.0) -> DataFrame:
    """M6: screen bins with a blurred count; in a crowded one only the points whose
    hash is below the room; their centre, number, box and leading genre's share."""
    placed = rows.withColumns({"bx": F.floor(F.col("x") * scale / size).cast("bigint"), "by": F.floor(F.col("y") * scale / size).cast("bigint")})
    counts = placed.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    weight = lambda d: F.when(F.col(d) == 0, 2).otherwise(1)
    blurred = _around(counts.withColumnsRenamed({"bx": "cx", "by": "cy"}), 1).select((F.col("cx") + F.col("dx")).alias("bx"), (F.col("cy") + F.col("dy")).alias("by"), (F.col("n") * weight("dx") * weight("dy")).alias("w")).groupBy("bx", "by").agg((F.sum("w") / 16.0).alias("blur"))
    crowd = placed.join(blurred, ["bx", "by"]).withColumn("crowding", F.greatest(F.lit(1.0), F.col("blur") / most))
    kept = crowd.filter(place_hash(F.col("id")) < 1 / F.col("crowding"))
    genres = kept.groupBy("bx", "by", "genre").agg(F.count(F.lit(1)).alias("g"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return genres.groupBy("bx", "by").agg(
        (F.sum("x") / F.sum("g")).alias("x"), (F.sum("y") / F.sum("g")).alias("y"), F.sum("g").alias("n"),
        F.max_by("genre", F.struct("g", "genre")).alias("genre"), (F.max("g") / F.sum("g")).alias("share"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )
