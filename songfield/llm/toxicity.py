"""A convolutional text classifier for toxicity.

A word is three hashes: of itself and of its first four and five letters, so
that inflected forms share what they have in common. Hashes that the training
texts hold often enough own an embedding, the others are zero; a word's vector
is the sum of its three. Filters of several widths slide over the whole text,
the strongest answer of each is kept (max pooling), and a logistic layer turns
those into a probability. All of it is trained by Adam on all
labelled rows, by tasks whose models are averaged after each epoch: gradients go only
to the places that won the pooling.

Scores come from the text alone. In the fit, each language has the same say in
each label, so that a rare one isn't lost to the common ones' threshold; and a
hash that few texts hold says little, so that it isn't learned by heart.
Thresholds by language are calibrated on the same rows afterwards, and add a
column; they change no score. Where more hashes own an embedding than the table
has rows, those that tell least share rows; none is dropped.

A null or empty text, or one without letters, gets the score of a text that
answers no filter; very long texts are scored in full, in pieces that overlap
by the widest filter; repeated rows get equal scores. Without labelled rows
of both kinds every score is their rate, 0 for no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songfield.llm.common import written

#: Labelled texts that one task of an epoch goes over, about.
SHARE = 6000
WORD_BITS, STEM_BITS = 22, 20
#: Rows of the table of embeddings; row 0 is for hashes without one.
ROWS = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, RATE, BATCH = 6, 0.01, 32
#: Labelled texts that hold a hash that has an embedding, at least; and those by which its odds are drawn to their rate.
LEAST, PRIOR = 12, 100.0
#: What a labelled row of a rare language counts at most.
MOST_SAY = 4.0
#: Tokens that are scored at once.
PIECE = 1 << 16
#: log2 of the bits that tell which ids have a label.
MARK_BITS = 24


def tokens(text: Column) -> Column:
    """For each word its hash and the hashes of its stems, packed into a bigint."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")

    def packed(w: Column) -> Column:
        word = F.pmod(F.xxhash64(w), F.lit(1 << WORD_BITS))
        four = F.pmod(F.xxhash64(F.substring(w, 1, 4)), F.lit(1 << STEM_BITS))
        five = F.pmod(F.xxhash64(F.substring(w, 1, 5)), F.lit(1 << STEM_BITS))
        return F.shiftleft(word, 2 * STEM_BITS).bitwiseOR(F.shiftleft(four, STEM_BITS)).bitwiseOR(five)

    return F.transform(words, packed)


def buckets(packed: np.ndarray) -> np.ndarray:
    """(tokens, 3) bucket numbers: words first, then both kinds of stems."""
    low = (1 << STEM_BITS) - 1
    word, four, five = packed >> (2 * STEM_BITS), (packed >> STEM_BITS) & low, packed & low
    return np.stack([word, four + (1 << WORD_BITS), five + (1 << WORD_BITS) + (1 << STEM_BITS)], axis=1)


N_BUCKETS = (1 << WORD_BITS) + 2 * (1 << STEM_BITS)


@dataclass
class Model:
    row_of: np.ndarray  # bucket -> row of the table, 0 for none
    table: np.ndarray  # row 0 is zero
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float

    def pooled(self, text: np.ndarray, where: bool = False):
        """The strongest answer of each filter over one text, at least 0. ``text`` is
        packed tokens, or the rows of their three hashes."""
        n = sum(f.shape[2] for f in self.filters)
        best, at = np.zeros(n, dtype=np.float32), np.full(n, -1)
        widest = max(f.shape[0] for f in self.filters)
        for start in range(0, len(text), PIECE):
            part = text[start : start + PIECE + widest - 1]
            rows = self.row_of[buckets(part)] if part.ndim == 1 else part
            x = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
            done = 0
            for f, b in zip(self.filters, self.bias):
                width, count = f.shape[0], f.shape[2]
                if len(x) >= width:
                    y = x[: len(x) - width + 1] @ f[0]
                    for o in range(1, width):
                        y += x[o : len(x) - width + 1 + o] @ f[o]
                    top = y.argmax(axis=0)
                    value = y[top, np.arange(count)] + b
                    higher = value > best[done : done + count]
                    best[done : done + count][higher] = value[higher]
                    at[done : done + count][higher] = start + top[higher]
                done += count
        return (best, at) if where else best

    def score(self, packed: np.ndarray) -> float:
        z = float(self.pooled(packed) @ self.weight + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def even_say(labels: np.ndarray, langs: list) -> np.ndarray:
    """Weights by which, of each label, every language has the same say in a fit, however
    few of its rows are labelled; a row has ``MOST_SAY`` at most."""
    say = np.ones(len(labels))
    keys = np.array([x or "" for x in langs], dtype=object)
    for label in np.unique(labels):
        own = labels == label
        kinds = sorted(set(keys[own]))
        for kind in kinds:
            these = own & (keys == kind)
            say[these] = min(MOST_SAY, own.sum() / (len(kinds) * these.sum()))
    return say


def table_rows(frequent: np.ndarray, tells: np.ndarray, most: int) -> np.ndarray:
    """A row from 1 below ``most`` for each frequent bucket: its own while there is room,
    else three quarters of the rows go to those that tell most and the others share the
    rest by their number. No bucket goes without."""
    if len(frequent) < most:
        return np.arange(1, len(frequent) + 1)
    alone = 3 * most // 4
    first = np.argsort(-tells, kind="stable")
    rows = np.empty(len(frequent), dtype=np.int64)
    rows[first[:alone]] = np.arange(1, alone + 1)
    rest = first[alone:]
    rows[rest] = alone + 1 + frequent[rest] % (most - alone - 1)
    return rows


def odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """How much likelier the label makes a bucket; as if PRIOR more texts of the rows'
    rate held it: what few texts say counts little."""
    return np.log((toxic + PRIOR * rate) / rate) - np.log((clean + PRIOR * (1 - rate)) / (1 - rate))


def begin(rate: float, frequent: np.ndarray, held: np.ndarray, toxic: np.ndarray, seed: int) -> Model:
    """A model before its first epoch, from the buckets that own an embedding and the
    texts that hold them, all and those with the label."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    row_of = np.zeros(N_BUCKETS, dtype=np.int32)
    offset = float(np.log(max(rate, 1e-13) / max(1 - rate, 1e-13)))
    if rate in (0.0, 1.0):
        return Model(row_of, np.zeros((1, DIM), dtype=np.float32), filters, bias, np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), offset)
    rows = table_rows(frequent, np.abs(odds(toxic, held - toxic, rate)), ROWS)
    row_of[frequent] = rows
    count = int(rows.max(initial=0)) + 1
    table = rng.normal(0, 0.05, (count, DIM)).astype(np.float32)
    table[:, 0] = odds(*(np.bincount(rows, x, count) for x in (toxic, held - toxic)), rate)
    table[0] = 0
    for f in filters:
        f[:, 0, : FILTERS // 2] = 0.5 / f.shape[0]
    # Filters that read the likelihoods start with a say, the others with next to none.
    weight = np.concatenate([np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, 0.0) + rng.normal(0, 0.05, FILTERS) for _ in WIDTHS]).astype(np.float32)
    return Model(row_of, table, filters, bias, weight, offset - 2)


def carried(model: Model) -> dict:
    """A model as a broadcast takes it: only the buckets that own an embedding."""
    at = np.flatnonzero(model.row_of)
    return vars(model) | {"row_of": (at, model.row_of[at])}


def arrived(values: dict) -> Model:
    at, rows = values["row_of"]
    row_of = np.zeros(N_BUCKETS, dtype=np.int32)
    row_of[at] = rows
    return Model(**values | {"row_of": row_of})


def small(model: Model) -> list[np.ndarray]:
    """What a model learns besides its table, in place but for the offset."""
    return [model.weight, *model.filters, *model.bias]


def learn(model: Model, state: dict, texts: list[np.ndarray], labels: np.ndarray, say: np.ndarray, slow: float, rng: np.random.Generator) -> None:
    """Goes once over some texts. ``state`` has Adam's step and moments."""

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = state["moments"][name]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.999
        v += 0.001 * grad * grad
        value -= slow * RATE * (m / (1 - 0.9 ** state["step"])) / (np.sqrt(v / (1 - 0.999 ** state["step"])) + 1e-8)

    table, filters, bias, n = model.table, model.filters, model.bias, len(model.weight)
    held_rows = [model.row_of[buckets(x)] for x in texts]
    free = np.array([model.offset])
    order = rng.permutation(len(texts))
    for b in range(0, len(order), BATCH):
        state["step"] += 1
        batch = order[b : b + BATCH]
        g_weight, g_free = np.zeros(n, dtype=np.float32), np.zeros(1)
        g_filters, g_bias = [np.zeros_like(f) for f in filters], [np.zeros_like(x) for x in bias]
        won, moved = [], []  # rows of the table that won a place, and their gradients
        for i in batch:
            rows = held_rows[i]
            best, at = model.pooled(rows, where=True)
            z = np.clip(float(best @ model.weight + free[0]), -30, 30)
            error = say[i] * (1 / (1 + np.exp(-z)) - labels[i]) / len(batch)
            g_weight += np.float32(error) * best
            g_free += error
            g = np.float32(error) * model.weight * (at >= 0)
            for w, f in enumerate(filters):
                own = slice(w * FILTERS, (w + 1) * FILTERS)
                if len(rows) < f.shape[0] or not g[own].any():
                    continue
                places = rows[np.maximum(at[own], 0)[:, None] + np.arange(f.shape[0])]
                g_bias[w] += g[own]
                g_filters[w] += (table[places].sum(axis=2) * g[own, None, None]).transpose(1, 2, 0)
                won.append(places.reshape(-1))
                moved.append(np.repeat((f.transpose(2, 0, 1) * g[own, None, None]).reshape(-1, DIM), 3, axis=0))
        adam("weight", model.weight, g_weight + 1e-4 * model.weight)
        adam("free", free, g_free)
        for w in range(len(WIDTHS)):
            adam(f"f{w}", filters[w], g_filters[w])
            adam(f"b{w}", bias[w], g_bias[w])
        if won:
            np.subtract.at(table, np.concatenate(won), np.float32(0.05 * slow) * np.concatenate(moved))
            table[0] = 0
        model.offset = float(free[0])


def flat(model: Model, state: dict) -> np.ndarray:
    """All that is learned but the table, as one vector."""
    moments = [x for name in sorted(state["moments"]) for x in state["moments"][name]]
    return np.concatenate([np.ravel(x).astype(np.float64) for x in (*small(model), [model.offset], *moments)])


def unflat(values: np.ndarray, model: Model, state: dict) -> None:
    at = 0
    for x in small(model):
        x[...] = values[at : at + x.size].reshape(x.shape)
        at += x.size
    model.offset, at = float(values[at]), at + 1
    for name in sorted(state["moments"]):
        for x in state["moments"][name]:
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.int64), column.offsets.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def bars(cells: list, grid: np.ndarray, least: float = 0.3) -> dict:
    """For each language the score with the best F1 over the rows that were fitted, from
    their numbers by (lang, y, cell), a cell being how many of the grid a score reaches;
    ``least`` where there are fewer than 10 labels of either kind."""
    out = {}
    for lang in {r["lang"] for r in cells if r["lang"] is not None}:
        n = np.zeros((2, len(grid) + 1))
        for r in cells:
            if r["lang"] == lang:
                n[r["y"], r["cell"]] += r["n"]
        clean, toxic = n[0].sum(), n[1].sum()
        above = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # by threshold
        f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + toxic)
        out[lang] = least if min(clean, toxic) < 10 else float(grid[int(np.argmax(f1))])
    return out


def marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is one of ``known``, and few others: whatever else
    there is stays out of the join's exchange. Told by 2 ** MARK_BITS bits, which are
    broadcast as at most 2 ** (MARK_BITS - 6) rows for any table."""
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - MARK_BITS)
    place = slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    bits = known.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("bits"))
    stands = F.call_function("shiftright", F.col("bits"), place).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return docs.join(F.broadcast(bits), (F.shiftright(slot, 6) == F.col("word")) & stands, "left_semi")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 0, share: int = SHARE) -> tuple[Model, dict]:
    """A model and its thresholds from all rows of ``labels`` (doc_id, label) and the
    texts of ``docs`` (doc_id, text, lang).

    Hashes are counted by aggregates. In each epoch, tasks of some ``share`` rows each go
    on from one model, and what they learn is averaged: of the table, each row by those
    tasks that moved it. The driver sees languages' counts, the hashes that own an
    embedding, and for each epoch one model; no text."""
    named = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), label)  # a hash is of a type
    known = named.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label).cast("int") > 0).cast("int").alias("y"))
    texts = marked(docs.select("doc_id", "lang", "text"), known)
    # Few labels would be broadcast and many not; so every size goes the way that large ones go.
    rows = written(texts.join(known.hint("shuffle_hash"), "doc_id").select(F.col("lang").cast("string").alias("lang"), "y", tokens(F.col("text")).alias("t")), "labelled")
    groups = rows.groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    n, toxic = sum(r["n"] for r in groups), sum(r["n"] for r in groups if r["y"])
    rate = toxic / n if n else 0.0
    spark = docs.sparkSession

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, N_BUCKETS), dtype=np.int32)
        for batch in batches:
            for packed, y in zip(_lists(batch.column(2)), batch.column(1).to_numpy()):
                held[y, np.unique(buckets(packed))] += 1
        own = np.flatnonzero(held.any(axis=0))
        for s in range(0, len(own), 1 << 16):
            at = own[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x[at].astype(np.int64)) for x in (held.sum(axis=0), held[1]))], ["bucket", "held", "toxic"])

    if rate in (0.0, 1.0):
        none = np.zeros(0, dtype=np.int64)
        model = begin(rate, none, none, none, seed)
    else:
        pieces = rows.coalesce(max(1, -(-n // share)))
        found = pieces.mapInArrow(counted, "bucket bigint, held bigint, toxic bigint").groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic")).filter(F.col("held") >= LEAST).toArrow().sort_by("bucket")
        model = begin(rate, *(found[c].to_numpy() for c in ("bucket", "held", "toxic")), seed)
        names = {"weight": model.weight, "free": np.zeros(1)} | {f"f{w}": f for w, f in enumerate(model.filters)} | {f"b{w}": b for w, b in enumerate(model.bias)}
        state = {"step": 0, "moments": {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in names.items()}}
        kinds = {y: [r for r in groups if r["y"] == y] for y in (0, 1)}
        says = {(r["lang"], y): min(MOST_SAY, sum(x["n"] for x in own) / (len(own) * r["n"])) for y, own in kinds.items() for r in own}
        columns = [f"d{i}" for i in range(DIM)]
        for epoch in range(EPOCHS):
            shared = spark.sparkContext.broadcast((carried(model), state, says))
            slow = 1.0 if epoch < EPOCHS - 1 else 0.3

            def learned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                import copy

                from pyspark import TaskContext

                values, own_state, say = copy.deepcopy(shared.value)
                own, rng, seen = arrived(values), np.random.default_rng([seed, epoch, TaskContext.get().partitionId()]), 0
                before = own.table.copy()
                for batch in batches:
                    if batch.num_rows:
                        y = batch.column(1).to_numpy().astype(np.float64)
                        weights = np.array([say[k] for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
                        learn(own, own_state, _lists(batch.column(2)), y, weights, slow, rng)
                        seen += batch.num_rows
                if seen:
                    rest = np.append(flat(own, own_state), own_state["step"])
                    rest = np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)
                    moved = np.flatnonzero((own.table != before).any(axis=1))
                    data = np.concatenate([rest, own.table[moved].astype(np.float64)])
                    at = np.concatenate([-1 - np.arange(len(rest)), moved])
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(data[:, i]) for i in range(DIM))], ["at", *columns])

            mean = pieces.mapInArrow(learned, "at bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*[F.avg(c).alias(c) for c in columns]).toArrow().sort_by("at")
            at, data = mean["at"].to_numpy(), np.stack([mean[c].to_numpy() for c in columns], axis=1)
            model.table[at[at >= 0]] = data[at >= 0]
            rest = data[at < 0][::-1].ravel()
            length = len(flat(model, state))
            unflat(rest[:length], model, state)
            state["step"] = round(float(rest[length]))
            shared.destroy()  # its epoch is over
    shared_model, grid = spark.sparkContext.broadcast(carried(model)), np.linspace(0.02, 0.98, 49)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = arrived(shared_model.value)
        for batch in batches:
            cell = np.searchsorted(grid, [own.score(t) for t in _lists(batch.column(2))], side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], ["lang", "y", "cell"])

    cells = rows.mapInArrow(placed, "lang string, y int, cell bigint").groupBy("lang", "y", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    return model, bars(cells, grid)


def score(docs: DataFrame, model: Model, lang_thresholds: dict | None = None, id: str = "doc_id") -> DataFrame:
    """(id, lang, score, lang_threshold, lang_toxic) for every document. The
    model is broadcast; its size is set by ROWS and the hash bits."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(carried(model))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = arrived(shared.value)
        for batch in batches:
            column = batch.column(2)
            values = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = column.offsets.to_numpy(zero_copy_only=False)
            found = [own.score(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], [id, "lang", "score"])

    rows = docs.select(F.col(id).cast("bigint").alias(id), F.col("lang").cast("string").alias("lang"), tokens(F.col("text")).alias("t"))
    out = rows.mapInArrow(scored, f"{id} bigint, lang string, score double")
    bar = F.lit(0.3)
    for lang, t in sorted((lang_thresholds or {}).items()):
        bar = F.when(F.col("lang") == lang, F.lit(t)).otherwise(bar)
    return out.withColumn("lang_threshold", bar).withColumn("lang_toxic", F.col("score") >= F.col("lang_threshold"))
