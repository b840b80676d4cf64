"""Numbers over all rows, and exact ranks, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.sources.tables import written

#: Pivots of a round, and values below which a bucket is sorted as it is.
PIVOTS, FEW = 64, 10_000


class Down:
    """An order from the largest down; nulls last."""

    def __init__(self, by: Column):
        self.by = by

    def of(self, value: Column) -> Column:
        return value.desc_nulls_last()


def _plain(order: Column | Down) -> Column:
    """The value that a sort order sorts by."""
    return order.by if isinstance(order, Down) else order


def _like(order: Column | Down, value: Column) -> Column:
    return order.of(value) if isinstance(order, Down) else value.asc_nulls_last()


def numbered(rows: DataFrame, order: list[Column | Down], within: list[str] = (), name: str = "number", weight: Column | None = None, start: str = "start") -> DataFrame:
    """``rows`` with their place from 0 in ``order``, apart for each
    value of ``within``, and with a ``weight`` what the rows before add up to.

    Rows are dealt into ranges of the order; each range is numbered by itself and begins
    where the ranges before it end. A group of any size is in as many ranges as it has
    parts of the rows, so none is a task of its own. Rows that are equal in all of
    ``order`` take any order among themselves; a null weight is 0."""
    keys = [f"__o{i}" for i in range(len(order))]
    weighed = rows.select("*", *[_plain(o).alias(k) for o, k in zip(order, keys)], (F.lit(0) if weight is None else F.coalesce(weight, F.lit(0))).cast("bigint").alias("__weight"))
    places = [_like(o, F.col(k)) for o, k in zip(order, keys)]
    spread = written(weighed.repartitionByRange(*[F.col(c) for c in within], *places).withColumn("__part", F.spark_partition_id()), "ranges")
    apart = ["__part", *within]
    # One row for each range and each group that it holds some of: ranges in all, and one more for each group.
    sums = spread.groupBy(*apart).agg(F.count(F.lit(1)).alias("__rows"), F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*apart, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__held"))
    own = Window.partitionBy(*apart).orderBy(*places)
    here = spread.withColumn("__own", F.row_number().over(own) - 1)
    if weight is not None:
        here = here.withColumn("__mine", F.coalesce(F.sum("__weight").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if within:
        same = [here[c].eqNullSafe(before[c]) for c in apart]
        joined = here.join(before, same).select(*[here[c] for c in here.columns], "__before", "__held")
    else:
        joined = here.join(F.broadcast(before), "__part")  # a row for each range
    out = joined.withColumn(name, (F.col("__before") + F.col("__own")).cast("bigint"))
    if weight is not None:
        out = out.withColumn(start, (F.col("__held") + F.col("__mine")).cast("bigint"))
    return out.select(*rows.columns, name, *([start] if weight is not None else []))


def at_ranks(rows: DataFrame, wanted: dict[str, list[int]], few: int = FEW) -> dict[str, list]:
    """A10: the values that stand at the given places, from 0, in each column's order;
    nulls don't count. A sketch gives pivots, rows between pivots are counted, and only
    the bucket with the place is read on, until it holds ``few`` values or one value
    alone. The driver sees pivots and counts, and at the end ``few`` values a place."""
    found: dict[tuple[str, int], object] = {}
    # For each place: what is larger than low and not larger than high, and how many values come before.
    open_: dict[tuple[str, int], tuple] = {(c, r): (None, None, r) for c, rs in wanted.items() for r in rs}
    while open_:
        cells = []
        for n, ((column, _), (low, high, _)) in enumerate(open_.items()):
            value = F.col(column).cast("double")
            inside = value.isNotNull() & (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value <= high)
            cells.append(F.when(inside, F.struct(F.lit(n).alias("n"), value.alias("v"))))
        values = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.n", "x.v")
        shares = F.array(*[F.lit(k / PIVOTS) for k in range(1, PIVOTS)])
        seen = {r["n"]: r for r in values.groupBy("n").agg(F.count("v").alias("count"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", shares, F.lit(10 * PIVOTS)).alias("pivots")).collect()}
        keys = list(open_)
        small = [n for n, r in seen.items() if r["count"] <= few and r["least"] != r["most"]]
        if small:
            for r in values.filter(F.col("n").isin(small)).groupBy("n").agg(F.sort_array(F.collect_list("v")).alias("all")).collect():
                found[keys[r["n"]]] = r["all"][open_[keys[r["n"]]][2]]
        bounds = {n: sorted({*r["pivots"], r["most"]}) for n, r in seen.items() if n not in small and r["least"] != r["most"]}
        counts = {}
        if bounds:
            table = F.create_map(*[x for n, b in bounds.items() for x in (F.lit(n), F.array(*map(F.lit, b)))])
            bucket = F.size(F.filter(F.element_at(table, F.col("n")), lambda p: p < F.col("v")))
            counts = {(r["n"], r["b"]): r["count"] for r in values.filter(F.col("n").isin(list(bounds))).groupBy("n", bucket.alias("b")).count().collect()}
        still = {}
        for n, key in enumerate(keys):
            low, _, rank = open_[key]
            if n not in seen:
                found[key] = None  # nothing is there
            elif seen[n]["least"] == seen[n]["most"]:
                found[key] = seen[n]["least"]
            elif n in bounds:
                for b, bound in enumerate(bounds[n]):
                    here = counts.get((n, b), 0)
                    if rank < here:
                        still[key] = (low if b == 0 else bounds[n][b - 1], bound, rank)
                        break
                    rank -= here
                else:
                    found[key] = None
        open_ = still
    return {c: [found[c, r] for r in rs] for c, rs in wanted.items()}


def medians(rows: DataFrame, columns: list[str], few: int = FEW) -> dict[str, float | None]:
    """Each column's exact median, of an even number of values the mean of the
    two in the middle; None where there is none."""
    n = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    got = at_ranks(rows, {c: sorted({(n[c] - 1) // 2, n[c] // 2}) for c in columns if n[c]}, few)
    return {c: sum(got[c]) / len(got[c]) if n[c] else None for c in columns}
