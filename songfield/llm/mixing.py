"""Mixing sources to target weights.

Sizes are summed by source; the targets follow from those sums by filling:
each source gets its weight's part of what is left, none more than ``most``
times its size, and what a full source can't take goes to the others. A
source's target over its size is its rate, and a document is emitted
floor(rate) times, plus once more if its own hash falls below the fraction: below
that part of its source's hashes that holds the fraction of the source's words.
Drawn so, a source's words miss its target by no more than the half of one
document's (equal hashes count as one), where independent draws would miss it by
the luck of a few long texts. The bar is found by sums over at most 2^16 ranges of
hashes of a source, then over the hashes of one range, so that a source of a third
of all rows is split like any other data. After that each document decides alone,
no text is shuffled, and a rerun emits the same rows.

A null text has size 0; a null source is a source like the others, last in
order; repeated rows (same id and size) share their draw; a very long text counts
with all its words, and no copy of it is cut; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.llm.common import refuse_clash, words_of, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def _numbered(sums: DataFrame) -> DataFrame:
    """Sources in code-point order, numbered from 0: ranges are numbered apart,
    and each range starts where those before it end."""
    spread = written(
        sums.select(F.col("source").isNull().alias("__last"), "source", "source_size").repartitionByRange(F.col("__last"), F.col("source")).withColumn("__part", F.spark_partition_id()),
        "sources",
    )
    parts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__last", "source"))
    return spread.withColumn("__own", own).join(F.broadcast(before), "__part").select("source", "source_size", (F.col("__before") + F.col("__own") - 1).alias("rank"))


def targets(docs: DataFrame, size: str = "size", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) for every source of ``docs``."""
    sums = docs.groupBy("source").agg(F.sum(size).cast("bigint").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(_numbered(sums).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # The level is the target for a weight of 1. Each round raises it until no further source is full.
    level, full = 0.0, None
    while True:
        is_full = F.lit(False) if full is None else F.col("cap") <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(is_full, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (float(total) - row["taken"]) / row["open"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def drawn(seed: int, *parts: str) -> Column:
    """The first 32 bits of an MD5 over the seed and these columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def bars(draws: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with ``bar``: the largest draw of a source at which what was drawn
    before, and half of what is drawn there, is within the fraction of its words;
    null where nothing is drawn. ``draws`` are (source, draw, size)."""
    range_ = F.shiftright("draw", 16).alias("range")
    ranges = written(draws.groupBy("source", range_).agg(F.sum("size").alias("held"), F.sum(F.lit(1)).alias("n")), "draws")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    want = rates.select("source", ((F.col("rate") - F.floor("rate")) * F.col("source_size")).alias("want")).filter("want > 0")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = ranges.select("source", "range", "held", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    crossed = sums.join(want, same(sums, want)).filter("before <= want").groupBy(sums["source"]).agg(F.max(F.struct("range", "before", "want")).alias("at"))
    crossed = written(crossed.select("source", "at.range", "at.before", "at.want"), "crossed")
    near = draws.join(crossed, same(draws, crossed) & (range_ == crossed["range"])).groupBy(draws["source"], "draw", "before", "want").agg(F.sum("size").alias("held"))
    own = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    until = near.withColumn("middle", F.col("before") + F.coalesce(F.sum("held").over(own), F.lit(0)) + F.col("held") / 2.0)
    # Where no draw of the range is within it, all ranges before are.
    inside = until.groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("want"), F.col("draw"))).alias("last"))
    bar = crossed.join(inside, same(crossed, inside), "left").select(crossed["source"].alias("__s"), F.coalesce("last", F.shiftleft(crossed["range"], 16) - 1).alias("bar"))
    return rates.join(bar, rates["source"].eqNullSafe(bar["__s"]), "left").drop("__s")


def planned(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, prefix: str = "") -> DataFrame:
    """``docs`` with size, source_size, target, rate and ``copies``, whose names begin
    with ``prefix``; a column that is called like one of them is an error."""
    size, source_size, target, rate, copies = (prefix + x for x in ("size", "source_size", "target", "rate", "copies"))
    refuse_clash(docs.columns, size, source_size, target, rate, copies)
    sized = docs.withColumn(size, word_count(F.col("text")))
    draw = drawn(seed, "doc_id", size)
    skeleton = written(sized.select("source", draw.alias("draw"), F.col(size).alias("size")), "sizes")
    bar = f"{prefix}__bar"
    # A table, so that Spark knows its size and deals no document by its source where it is small.
    named = written(bars(skeleton, written(targets(skeleton, "size", weights, most), "rates")), "bars")
    rates = named.select(F.col("source").alias("__source"), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate), F.col("bar").alias(bar))
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    extra = F.coalesce(draw <= F.col(bar), F.lit(False)).cast("bigint")
    return joined.withColumn(copies, (F.floor(F.col(rate)) + extra).cast("bigint")).drop(bar)


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, number: str | None = "copy") -> DataFrame:
    """The mix itself: each document as often as its copies say, numbered from 1 by the
    column ``number`` (None for none). All columns of ``docs`` keep their values."""
    if number:
        refuse_clash(docs.columns, number)
    plan = planned(docs, seed, weights, most, "__mix_").filter(F.col("__mix_copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__mix_copies"))).alias(number or "__mix_copy")
    return plan.select(*docs.columns, copies).select(*docs.columns, *([number] if number else []))
