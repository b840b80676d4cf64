"""What a chain of filters removes in each order, by a packed bitmap index.

1. One pass over the texts gives each row the failures of the filters that a text
   decides alone, and a digest of the text; no text goes further. The smallest id
   of each digest is an aggregate, and says which rows repeat an earlier one.
2. Each partition packs its rows into NumPy bitsets: one for every filter, label and
   part. For each subset of filters that may come first, AND-NOT leaves the rows
   that all of them keep, and popcounts against the other bitsets are the
   partition's counts. A partition goes block by block, so its bitsets stay small.
3. Counts of all partitions are summed. An order's step is the subset before it
   and a filter, so the 120 orders read 32 subsets' counts.

Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals
``[A-Z]`` > 10 * code points; D holds any of ``#$%&*|``; E equal to the text of a
smaller id, wherever that is and whether or not it was removed.

A null text is empty; so A and E can take it, B to D don't. A null language is the
empty part. A row without an id has no smaller one, and is none for others, so E
never takes it, and it has no labels. Rows that repeat an id aren't smaller than
each other; labels that repeat an id count if any of them is 1. A very long text is
one row in one task. An empty table has no parts and no rows. Other columns aren't
read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.llm.common import dropped, written

FILTERS = "ABCDE"
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a partition whose bitsets are made at once.
BLOCK = 1 << 16
FEATURES = "doc_id bigint, part string, digest binary, bits int"
COUNTED = "part string, subset int, kept bigint, removed array<bigint>, good array<bigint>, toxic array<bigint>"


def text_bits(data: bytes, length: int) -> int:
    """Failures of A to D of a text of ``length`` code points, as bits from the lowest."""
    words = data.split()
    n, distinct = len(words), len(set(words))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (n < 100) | (100 * distinct < 80 * n) << 1 | (100 * capitals > 10 * length) << 2 | (MARKS.search(data) is not None) << 3


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, bits) of every row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bits = [], []
            for text in batch.column(2):
                own = text.as_py() or ""
                data = own.encode()
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                bits.append(text_bits(data, len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())], ["doc_id", "part", "digest", "bits"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, FEATURES)


def subset_counts(rows: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, list, list, list]]:
    """(subset, kept, removed, good, toxic) of the bitsets of a block: ``rows`` are the
    part's rows, ``fails`` (filters, bytes) those that fail each filter."""
    out = []
    count = lambda bits: int(np.bitwise_count(bits).sum())
    for subset in range(1 << len(fails)):
        left = rows.copy()
        for f in range(len(fails)):
            if subset >> f & 1:
                left &= ~fails[f]
        gone = [left & own for own in fails]
        out.append((subset, count(left), [count(g) for g in gone], [count(g & good) for g in gone], [count(g & toxic) for g in gone]))
    return out


def partition_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of (part, fails, good, toxic) rows, summed over a partition."""
    sums: dict[str, np.ndarray] = {}
    n = len(FILTERS)

    def block(table: pa.Table) -> None:
        names = table["part"].combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        code, bits = names.indices.to_numpy(), table["fails"].to_numpy()
        labels = [table[k].to_numpy(zero_copy_only=False).astype(bool) for k in ("good", "toxic")]
        own = np.stack([np.packbits((bits >> f & 1).astype(bool)) for f in range(n)])
        good, toxic = (np.packbits(x) for x in labels)
        for i, name in enumerate(names.dictionary.to_pylist()):
            rows = np.packbits(code == i)
            found = subset_counts(rows, own, good, toxic)
            flat = np.array([[k, *r, *g, *t] for _, k, r, g, t in found], np.int64)
            sums[name] = sums.get(name, 0) + flat

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            block(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        block(pa.Table.from_batches(held))
    for name, flat in sums.items():
        three = [pa.array(flat[:, 1 + n * i : 1 + n * (i + 1)].tolist(), pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat[:, 0]), *three], ["part", "subset", "kept", "removed", "good", "toxic"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): a row for every part, order of the filters and step."""
    spark, n = docs.sparkSession, len(FILTERS)
    rows = written(features(docs), "features")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    firsts = written(firsts.select("digest", "first"), "firsts")  # so that the rows of a common text can be split
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = written(known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "labels")
    repeats = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    no = F.lit(False)
    marked = rows.join(firsts, "digest", "left").select("doc_id", "part", F.col("bits").bitwiseOR(F.shiftleft(repeats, n - 1)).alias("fails")).join(known, "doc_id", "left")
    marked = marked.select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    one = marked.mapInArrow(partition_counts, COUNTED).select("part", "subset", "kept", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("f", "c"))
    counts = written(one.groupBy("part", "subset", "f").agg(F.sum("kept").alias("kept"), F.sum("c.removed").alias("removed"), F.sum("c.good").alias("good"), F.sum("c.toxic").alias("toxic")), "subset-counts")
    dropped(rows, firsts, known)
    return _by_order(spark, counts)


def _by_order(spark, counts: DataFrame) -> DataFrame:
    """The orders' rows from the counts of (part, subset, f)."""
    n = len(FILTERS)
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    # 600 rows, whatever the data.
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, f int, subset int, after int"))
    alone = counts.filter(F.col("subset") == 0).select("part", "f", F.col("removed").alias("failing"))
    only = counts.filter(F.col("subset") == F.expr(f"shiftleft(1, f) ^ {(1 << n) - 1}")).select("part", "f", F.col("removed").alias("unique_fails"))
    reached = counts.join(orders, ["subset", "f"])
    shapley = reached.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    found = reached.join(alone, ["part", "f"]).join(only, ["part", "f"]).join(shapley, ["part", "f"])
    return found.select(
        "part", "filter_order", "step", (F.col("kept") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
