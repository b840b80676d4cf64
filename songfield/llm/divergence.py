"""How far the sources of a language are from each other in their words.

Plain relational steps, each of which combines before it shuffles:

1. Every match of the term pattern is exploded; (lang, source, term) get their
   occurrences and the number of documents that hold them. A text's terms are
   sorted first, so the first of equal ones counts the document and nothing needs
   to be told by its document in a shuffle.
2. A language keeps the terms that enough of its documents hold.
3. Groups, that is languages' sources, are crossed with the kept terms of their
   language by an equi-join, dealt over slices of the vocabulary so that a large
   language is in many tasks; terms that a group lacks count 0 there.
4. Those rows join themselves on language and term, each two groups once; the
   differences are summed and the sums mirrored.
5. Ranks are windows over a group's rows.

Probabilities are whole billionths, smoothed by ``SMOOTH`` and computed without
rounding beyond the stated floor, in decimals where 64 bits would not do.

Null texts, languages and sources are empty strings; a group whose texts are null,
empty or without terms is a group like the others, at equal probabilities, and in a
language that keeps no term every distance is 0. Equal values are ranked by the
item. Repeated rows are documents of their own. A very long text is one row, whose
terms are exploded in the task that reads it. An empty table has no rows. Other
columns aren't read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songfield.llm.common import dropped, partitions, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term at least; what is added to a count;
#: ranks of the terms of a group.
HELD, SMOOTH, TERMS = 30, 5, 50
BILLION = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, held): occurrences, and rows that hold the term. Rows
    without any term count under a null term, so that their group is known."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    sorted_terms = docs.select(blank("lang"), blank("source"), F.sort_array(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("terms"))
    every = sorted_terms.select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term"))
    new = F.col("at").isNull() | (F.col("at") == 0) | (F.get(F.col("terms"), F.col("at") - 1) != F.col("term"))
    return every.groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.sum(new.cast("bigint")).alias("held"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact: in whole longs, or
    in decimals where the product would not fit."""
    div = lambda a, b: F.call_function("div", a, b)
    above, below = count + SMOOTH, total + SMOOTH * terms
    wide = above.cast("decimal(19,0)") * F.lit(BILLION).cast("decimal(10,0)")
    fits = above < F.lit((1 << 63) // BILLION)
    return F.lit(1).cast("bigint") + F.when(fits, div(F.when(fits, above).otherwise(F.lit(0)) * F.lit(BILLION).cast("bigint"), below)).otherwise(div(wide, below.cast("decimal(20,0)")))


def divergence(docs: DataFrame, held: int = HELD, top: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the summed difference
    of a group from each other source of its language, all ranks. Part ``term``: the
    kept terms that a group favours over its language, ``top`` ranks."""
    spark = docs.sparkSession
    counts = written(term_counts(docs), "term-counts")
    of_lang = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("held").alias("held"))
    kept = written(of_lang.filter(F.col("held") >= held).select("lang", "term", "n_lang"), "kept-terms")
    # A table before it is joined, so that a language's or a common term's rows can be split.
    held_here = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept-counts")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = held_here.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    groups = every.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "total_lang", "total"])
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "groups")

    slices = partitions(spark)
    slice_of = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")
    sliced = groups.filter("v > 0").select("lang", "source", "g", "v", "total", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    cells = kept.select("lang", "term", slice_of.alias("slice")).join(sliced, ["lang", "slice"])
    dense = cells.join(held_here.drop("n_lang"), ["lang", "source", "term"], "left")
    dense = written(dense.select("lang", "term", "g", probability(F.coalesce("n", F.lit(0).cast("bigint")), F.col("total"), F.col("v")).alias("p")), "dense")
    one = dense.select("lang", "term", F.col("g").alias("a"), F.col("p").alias("pa"))
    other = dense.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"))
    half = written(one.join(other, ["lang", "term"]).filter("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value")), "distances")
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))

    own, item = groups.select("lang", "source", F.col("g").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pairs = own.join(item, "lang").filter("a <> b").join(both, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    sums = groups.select("lang", "source", "v", "total", "total_lang")
    p = probability(F.col("n"), F.col("total"), F.col("v"))
    q = probability(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    terms = held_here.join(sums, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    found = pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))
    found = written(found, "divergence")
    dropped(counts, kept, held_here, groups, dense, half)
    return found
