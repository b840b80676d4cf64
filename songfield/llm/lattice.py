"""SentencePiece encoding and decoding as a relational lattice.

Texts fall apart into words that no piece reaches across, so distinct words are
encoded once. Their substrings, no longer than the longest piece, are exploded
and equi-joined to the piece table; the joined edges are grouped by word, and
a higher-order ``aggregate`` folds each word's lattice into its best cut.

For a unigram table the fold is Viterbi: it takes the edges by where they end,
keeps for each place the least cost that leads there, and goes back from the
word's end. A BPE model's own scores don't add up; for one the fold merges: its
state is a bit mask of the boundaries still standing, and each step takes down
the one inside the best-scored edge that spans just two neighbours. Words beyond
``WIDE`` (for merges ``MASKED``) characters are cut by the same rules in the worker.

A worker reads its texts once, and deals them into slices: a slice has at most
about ``HELD`` distinct words and ``LONG`` words, or one document beyond that. Of
a slice there are its distinct words, numbered, and each document's words as
those numbers. The words go to where they are encoded, one row for each slice
that has the word, and their ids come back to the slice, where documents are put
together. So the result is one row for each row of ``docs``, whatever the size or
the commonness of words; no text is shuffled, nothing is broadcast but the pieces,
and a task holds one slice at a time.

A null or empty text has no ids; an empty table has no rows; a very long text
is a slice of its own; repeated rows repeat their result; a null id keeps its
text's ids; other columns aren't carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from songfield.llm.common import once, returned, returning, written
from songfield.llm.pieces import BYTE, CONTROL, DEFAULT_MODEL, Pieces, load
from songfield.llm.tokencounts import split

#: Characters of a word that is folded: places in an edge's code, and bits of a mask.
WIDE, MASKED = 1000, 60
#: Distinct words and words of a slice, words of one row of them, bytes of a batch.
HELD, LONG, CHUNK, BATCH = 1 << 19, 1 << 23, 1 << 14, 1 << 20
#: Words whose ids are sorted by slice at once, and rows that are decoded at once.
TOGETHER, DECODED = 1 << 17, 256
#: Bits of an edge's places, id and cost: its end, its cost, its start and its id, from the top.
PLACE_BITS, ID_BITS, COST_BITS = 10, 17, 26
NO_PIECE = (1 << ID_BITS) - 1
SLICED = "slice bigint, docs array<bigint>, counts array<int>, codes binary, first int, words binary, size int"
ENTRIES = "slice bigint, steps array<int>, sizes array<smallint>, ids array<{id}>, wide array<string>"
ENCODED = "doc_id bigint, n_words bigint, ids array<int>"


def sliced(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """SLICED rows of two kinds: some documents with how many words each has and their
    numbers in the slice, and the words of a slice from number ``first`` on."""
    pattern = pieces.words  # a worker that only splits texts needs no pieces

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, length = TaskContext.get().partitionId() << 24, 0, 0
        known, ids, codes = defaultdict(count().__next__), [], []
        names, kinds = ["slice", "docs", "counts", "codes", "first", "words", "size"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.int32()]

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((number, *values), kinds)], names)

        def documents():
            # By bytes of one weight, of which the upper ones are mostly 0.
            planes = np.concatenate(codes).view(np.uint8).reshape(-1, 4).T.tobytes()
            return row(ids, [len(c) for c in codes], pa.Codec("zstd", 9).compress(planes, asbytes=True), None, None, None)

        def vocabulary():
            words = list(known)
            for at in range(0, len(words), CHUNK):
                # One word a line; the only word that holds a line end is that itself, and no word is empty.
                text = "\n".join([w if w != "\n" else "" for w in words[at : at + CHUNK]]).encode()
                yield row(None, None, None, at, pa.Codec("zstd", 9).compress(text, asbytes=True), len(text))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split(text.as_py(), pattern)
                ids.append(doc)
                codes.append(np.fromiter(map(known.__getitem__, words), "<u4", len(words)))
                size += len(words)
                length += len(words)
                full = len(known) >= HELD or length >= LONG
                if size >= BATCH // 4 or full:
                    yield documents()
                    ids, codes, size = [], [], 0
                if full:
                    yield from vocabulary()
                    number, length, known = number + 1, 0, defaultdict(count().__next__)
                    returned()  # the next task may run in another worker
            del batch, text  # else it stays while the next is read
        if ids:
            yield documents()
        if known:
            yield from vocabulary()

    return texts.mapInArrow(rows, SLICED)


def _words(slices: DataFrame) -> DataFrame:
    """(word, slice, number) of all slices."""

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, first, words, size in zip(*(batch.column(i) for i in (0, 4, 5, 6))):
                if words.is_valid:
                    lines = pa.decompress(words.as_buffer(), size.as_py(), "zstd", asbytes=True).decode().split("\n")
                    own, n = pa.array([w or "\n" for w in lines], pa.string()), len(lines)
                    columns = [own, pa.array(np.full(n, number.as_py())), pa.array(np.arange(first.as_py(), first.as_py() + n, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "slice", "number"])

    return slices.mapInArrow(rows, StructType([StructField("word", StringType(), False), StructField("slice", LongType(), False), StructField("number", IntegerType(), False)]))


def _entries(words: DataFrame, pieces: Pieces) -> DataFrame:
    """ENTRIES: the words (slice, number, ids, wide) of one slice that are at hand
    together in one row, by their numbers, each as its step from the one before. A
    word too wide to be folded has the size -1 and its text."""
    kind, code = ("smallint", np.int16) if len(pieces.text_of) <= 1 << 15 else ("int", np.int32)

    @returning
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.lexsort((table["number"].to_numpy(), table["slice"].to_numpy()))))
            own, numbers, lists = table["slice"].to_numpy(), table["number"].to_numpy(), table["ids"].combine_chunks()
            new = own[1:] != own[:-1]
            ends = np.append(np.nonzero(new)[0] + 1, len(own))
            steps = np.concatenate([numbers[:1], np.where(new, numbers[1:], numbers[1:] - numbers[:-1])])
            sizes = lists.value_lengths().fill_null(-1).to_numpy().astype(np.int16)
            upto = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)[ends - 1]]).astype(np.int32))
            each = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            wide = table["wide"].combine_chunks()
            columns = [pa.array(own[ends - 1]), *(pa.ListArray.from_arrays(each, pa.array(x)) for x in (steps, sizes))]
            columns += [pa.ListArray.from_arrays(upto(np.maximum(sizes, 0)), pa.array(lists.flatten().to_numpy().astype(code))), pa.ListArray.from_arrays(upto(sizes < 0), wide.drop_null())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "steps", "sizes", "ids", "wide"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= TOGETHER:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return words.select("slice", "number", "ids", "wide").mapInArrow(rows, ENTRIES.format(id=kind))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def _part(code: Column, low: int, bits: int) -> Column:
    return F.shiftright(code, low).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(hash, text, low): a piece's id and cost in the low bits of an edge's code, for
    merges its id below the rank of its score, the best first. Pieces are found by
    a hash of their text, which a join looks up faster, and then compared."""
    if len(pieces.text_of) >= NO_PIECE:
        raise ValueError("more pieces than an edge has bits for")
    if pieces.unigram:
        if min(pieces.unknown_score, *pieces.score_of.values()) <= -(1 << COST_BITS) or max(pieces.score_of.values()) > 0:
            raise ValueError("a score that an edge has no bits for")
        rows = [(t, (-pieces.score_of[t] << (PLACE_BITS + ID_BITS)) | i) for t, i in pieces.id_of.items()]
    else:
        rank = {s: r for r, s in enumerate(sorted(set(pieces.score_of.values()), reverse=True))}
        rows = [(t, (rank[pieces.score_of[t]] << (12 + ID_BITS)) | i) for t, i in pieces.id_of.items()]
    return spark.createDataFrame(rows, "text string, low bigint").coalesce(1).select(F.xxhash64("text").alias("hash"), "text", "low")


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, size, edges): the codes, in order, of the pieces in a word of ``size``
    characters; a character that is no piece is an edge with the id NO_PIECE. Rows
    of a word never leave their partition, so nothing is shuffled where ``words``
    is dealt by word."""
    size = F.length("word")
    starts = words.select("word", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    stop = F.least(F.col("size"), F.col("s") + pieces.longest)
    spans = starts.select("word", "size", "s", F.explode(F.sequence(F.col("s") + 1, stop)).alias("e"))
    cut = spans.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")))
    found = cut.withColumn("hash", F.xxhash64("piece")).join(F.broadcast(piece_table(words.sparkSession, pieces)), "hash", "left")  # the model's size
    found = found.withColumn("low", F.when(F.col("text") == F.col("piece"), F.col("low"))).filter(F.col("low").isNotNull() | (F.col("e") == F.col("s") + 1))
    s, e = F.col("s").cast("bigint"), F.col("e").cast("bigint")
    if pieces.unigram:
        unknown = F.lit((-pieces.unknown_score << (PLACE_BITS + ID_BITS)) | NO_PIECE).cast("bigint")
        place = (e * (1 << (COST_BITS + PLACE_BITS)) + s) * (1 << ID_BITS)
    else:
        unknown = F.lit((1 << 60) | NO_PIECE).cast("bigint")
        place = (s * 64 + e) * (1 << ID_BITS)
    return found.groupBy("word", "size").agg(F.sort_array(F.collect_list(F.coalesce("low", unknown) + place)).alias("edges"))


def _spelled(char: Column, pieces: Pieces) -> Column:
    """The ids of a character that is no piece."""
    if not pieces.byte_id:
        return F.array(F.lit(pieces.unknown_id))
    code = F.hex(F.encode(char, "UTF-8"))
    one = lambda i: F.conv(F.substring(code, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    table = F.array(*[F.lit(i) for i in pieces.byte_id])
    return F.transform(F.sequence(F.lit(1), F.octet_length(char)), lambda i: F.element_at(table, one(i) + 1))


def _viterbi(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) with the least sum of costs; of equals the last piece that begins
    first. An edge's end only grows, so what leads to the ends before is settled."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("best"))
    long = lambda x: F.lit(x).cast("bigint")
    below, place = long((1 << (COST_BITS + PLACE_BITS + ID_BITS)) - 1), long((1 << (PLACE_BITS + ID_BITS)) - 1)

    def step(a: Column, x: Column) -> Column:
        # A state is laid out as an edge below its end is: the cost so far, where the last piece begins, its id.
        e, s = F.shiftright(x, COST_BITS + PLACE_BITS + ID_BITS).cast("int"), _part(x, ID_BITS, PLACE_BITS)
        before = F.when(s == a["e"], a["best"]).otherwise(F.get(a["done"], s))
        new = x.bitwiseAND(below) + before.bitwiseAND(F.bitwise_not(place))
        same = e == a["e"]
        return F.struct(
            F.when(same, a["done"]).otherwise(F.concat(a["done"], F.array(a["best"]))).alias("done"),
            e.alias("e"),
            F.when(same, F.least(a["best"], new)).otherwise(new).alias("best"),
        )

    states = F.aggregate("edges", start, step, lambda a: F.concat(a["done"], F.array(a["best"])))

    def back(a: Column, _: Column) -> Column:
        x = F.get(F.col("states"), a["at"])
        own = _part(x, 0, ID_BITS)
        ids = F.when(own == NO_PIECE, _spelled(F.substring(F.col("word"), a["at"], F.lit(1)), pieces)).otherwise(F.array(own))
        return F.when(a["at"] <= 0, a).otherwise(F.struct(_part(x, ID_BITS, PLACE_BITS).alias("at"), F.concat(ids, a["ids"]).alias("ids")))

    end = F.struct(F.col("size").alias("at"), F.array().cast("array<int>").alias("ids"))
    ids = F.aggregate(F.sequence(F.lit(1), F.col("size")), end, back, lambda a: a["ids"])
    return lattice.select("word", "size", once(states).alias("states")).select("word", once(ids).alias("ids"))


def _merged(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) by the model's merges."""

    def opened(code: Column) -> Column:
        s, e = _part(code, ID_BITS + 6, 6), _part(code, ID_BITS, 6)
        ends, inner = _bit(s).bitwiseOR(_bit(e)), (_bit(e) - 1).bitwiseAND(F.bitwise_not(_bit(s + 1) - 1))
        return F.struct(s.alias("s"), e.alias("e"), _part(code, 0, ID_BITS).alias("id"), ends.alias("ends"), inner.alias("inner"))

    def step(mask: Column, _: Column) -> Column:
        fits = F.filter("edges", lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])), mask)

    whole = lattice.withColumn("edges", once(F.transform("edges", opened)))
    mask = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), _bit(F.col("size") + 1) - 1, step)
    stands = lambda p: F.call_function("shiftright", F.col("mask"), p).bitwiseAND(F.lit(1).cast("bigint")) == 1
    bounds = whole.withColumn("mask", once(mask)).select("word", "edges", once(F.filter(F.sequence(F.lit(0), F.col("size")), stands)).alias("at"))

    def ids(s: Column, i: Column) -> Column:
        own = F.get(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == F.get(F.col("at"), i + 1))), F.lit(0))["id"]
        return F.when(own == NO_PIECE, _spelled(F.substring(F.col("word"), s + 1, F.lit(1)), pieces)).otherwise(F.array(own))

    inside = F.slice("at", F.lit(1), F.size("at") - 1)
    return bounds.select("word", once(F.flatten(F.transform(inside, ids))).alias("ids"))


def encoded_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct words, none too wide to fold."""
    lattice = edges(words, pieces)
    return _viterbi(lattice, pieces) if pieces.unigram else _merged(lattice, pieces)


def taken(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``at`` names, strung together, and their sizes."""
    own = sizes[at]
    ends = np.cumsum(own)
    where = np.repeat(starts[at] - (ends - own), own)
    where += np.arange(len(where))
    return values[where], own


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, id: str = "doc_id", scores: str = "rank", settled: bool = False) -> DataFrame:
    """(doc_id, n_words, ids) of every row of ``docs``. ``scores`` says which scores:
    "rank" for the unigram table of the model's pieces, "model" for the file's own.
    Words are numbered as they come, and a task that is run again must number them
    alike. ``settled`` says that ``docs`` is read straight from files, whose rows come in
    the same order each time; other rows are written as a table first."""
    spark, pieces = docs.sparkSession, load(model, scores)
    texts = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not settled:
        texts = written(texts, "texts")
    slices = sliced(texts, pieces).repartition("slice")
    words = _words(slices).repartition("word")
    # Read whole, so that one exchange serves this and the join: a filter pushed below it would make another.
    first = words.groupBy("word").agg(F.min("slice").alias("slice"), F.min("number").alias("number"))
    narrow = F.when((F.spark_partition_id() >= 0) & (F.col("slice") >= 0) & (F.col("number") >= 0), F.length("word") <= (WIDE if pieces.unigram else MASKED))
    ids = words.join(encoded_words(first.filter(narrow).select("word"), pieces).hint("shuffle_hash"), "word", "left")  # a partition's distinct words
    back = _entries(ids.withColumn("wide", F.when(F.col("ids").isNull(), F.col("word"))), pieces)
    shared = spark.sparkContext.broadcast(vars(pieces))  # the model's size

    def assembled(rows: pa.Table, words: pa.Table) -> pa.Table:
        steps, sizes, values = (words[c].combine_chunks().flatten().to_numpy() for c in ("steps", "sizes", "ids"))
        values = values.astype(np.int32)
        counts, sizes, numbers = words["steps"].combine_chunks().value_lengths().to_numpy(), sizes.astype(np.int64), np.cumsum(steps, dtype=np.int64)
        first = np.cumsum(counts) - counts
        numbers -= np.repeat(numbers[first] - steps[first], counts)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        wide = np.nonzero(sizes < 0)[0]
        if len(wide):
            own = Pieces(**shared.value)
            cut = [own.cut(w) for w in words["wide"].combine_chunks().flatten().to_pylist()]
            sizes[wide] = [len(x) for x in cut]
            starts[wide] = len(values) + np.cumsum(sizes[wide]) - sizes[wide]
            values = np.concatenate([values, np.array([i for x in cut for i in x], np.int32)])
        place = np.empty(len(sizes), np.int64)
        place[numbers] = np.arange(len(sizes))
        starts, sizes = starts[place], sizes[place]
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("ids", pa.list_(pa.int32()))])
        out = []
        rows = rows.filter(rows["codes"].is_valid())
        for docs, counts, codes in zip(rows["docs"], rows["counts"], rows["codes"]):
            counts = counts.values.to_numpy().astype(np.int64)
            planes = pa.decompress(codes.as_buffer(), 4 * int(counts.sum()), "zstd")
            found, each = taken(starts, sizes, values, np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel())
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
            out.append(pa.RecordBatch.from_arrays([docs.values, pa.array(counts), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))], schema=schema))
        returned()  # what the slice before has left, too
        return pa.Table.from_batches(out, schema)

    return slices.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(assembled, ENCODED)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``into``, which is replaced if
    there is one: pieces are strung together, bytes put together to characters, and
    the space before the text is dropped. No ids and null give an empty text. An id
    that the model doesn't have, or null, gives U+FFFD."""
    pieces = load(model)
    code = [b"" if k == CONTROL else bytes([pieces.byte_id.index(i)]) if k == BYTE else t.encode() for i, (t, k) in enumerate(zip(pieces.text_of, pieces.kind_of))]
    shared = encoded.sparkSession.sparkContext.broadcast([*code, "�".encode()])  # the model's size

    @F.arrow_udf("string")
    def spelled(column: pa.Array) -> pa.Array:
        table = shared.value
        sizes = np.array([len(c) for c in table], np.int64)
        values, starts, last = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, len(table) - 1
        out = [pa.array([], pa.string())]
        for first in range(0, len(column), DECODED):  # what is put together takes many times the ids' room
            part = column.slice(first, DECODED)
            at = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.where((at >= 0) & (at < last), at, last).astype(np.int64)
            chars, each = taken(starts, sizes, values, at)
            upto = np.concatenate([[0], np.cumsum(each)])[np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)].tolist()
            out.append(pa.array([chars[s:e].tobytes().decode("utf-8", "replace").removeprefix(" ") for s, e in zip([0, *upto], upto)], pa.string()))
        returned()
        return pa.concat_arrays(out)

    return encoded.withColumn(into, spelled(F.col(ids)))
