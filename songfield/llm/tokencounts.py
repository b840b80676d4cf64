"""Token counts by dynamic programming over a trie of distinct words.

Words of a batch of documents are made distinct and put into a trie, which is
walked in order: a node's forward state (the best cut of the text that leads
to it, and how many tokens that has) is computed once and shared by all words
below it. The state at a word's end is its count; a document's count is the
sum over its words. Counts of the words met first stay with the worker, up to a
fixed number.

For a unigram table the forward state holds the best score. A BPE model's own
scores say when to merge and don't add up; with ``scores="model"`` on one the
state holds the last piece, and the next piece is the one that the merges put
after it. The cut of a text's start is the start of its cut in either kind,
which is what makes states of prefixes enough.

A null or empty text has no tokens; a word costs time in proportion to its
length, however long; repeated rows give repeated results; there is no
exchange, and no task keeps more than a slice of documents and a bounded store;
an empty table gives no rows. A column that is called as the count is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songfield.llm.pieces import DEFAULT_MODEL, SPACE, Pieces, load

#: Words whose counts a worker keeps, and characters of a slice of documents.
KEPT = 1 << 19
SLICE = 4 << 20


def split(text: str | None, words: str) -> list[str]:
    """The words of a text as the model sees it, with a space before it, by the pattern
    that the model's pieces have for them."""
    return re.findall(words, " " + text.replace(SPACE, " ")) if text else []


class Trie:
    """Forward states along the path to the word that was inserted last."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.word = ""
        self.count = [0]
        self.last = [""]  # BPE: the piece that ends here
        self.total = [0]  # unigram: the best score up to here
        self.nodes = 0

    def insert(self, word: str) -> int:
        """The word's count. Words in sorted order share all that they can."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        for states in (self.count, self.last, self.total):
            del states[shared + 1 :]
        step = self._unigram if self.p.unigram else self._bpe
        for end in range(shared + 1, len(word) + 1):
            step(word, end)
        self.nodes += len(word) - shared
        self.word = word
        return self.count[-1]

    def _cost(self, piece: str) -> int:
        return 1 if piece in self.p.id_of else len(self.p.spelled(piece))

    def _bpe(self, word: str, end: int) -> None:
        p, last = self.p, self.last
        ids, follows = p.id_of, p.follows
        for start in range(max(0, end - p.longest), end - 1):
            piece = word[start:end]
            if piece in ids and follows(last[start], piece):
                break
        else:
            start = end - 1
            piece = word[start:end]
        last.append(piece)
        self.count.append(self.count[start] + self._cost(piece))
        self.total.append(0)

    def _unigram(self, word: str, end: int) -> None:
        p, total = self.p, self.total
        value, start = total[end - 1] + p.score_of.get(word[end - 1], p.unknown_score), end - 1
        for s in range(end - 2, max(-1, end - p.longest - 1), -1):
            score = p.score_of.get(word[s:end])
            if score is not None and total[s] + score >= value:
                value, start = total[s] + score, s
        total.append(value)
        self.last.append("")
        self.count.append(self.count[start] + self._cost(word[start:end]))


def counts(texts: list[str | None], pieces: Pieces, kept: dict[str, int]) -> list[int]:
    """Tokens of each text. ``kept`` is read and, up to KEPT words, added to."""
    words = [split(t, pieces.words) for t in texts]
    new = sorted(set().union(*words).difference(kept))
    trie = Trie(pieces)
    for w in new:
        kept[w] = trie.insert(w)
    out = [sum(map(kept.__getitem__, own)) for own in words]
    for _ in range(len(kept) - KEPT):
        kept.popitem()  # the newest first
    return out


def count_tokens(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", into: str = "n_tokens", scores: str = "rank") -> DataFrame:
    """``docs`` without its text but with its token count, by the unigram table of the
    model's pieces or (``scores="model"``) by the model's own scores. Columns that are
    neither an id nor short belong elsewhere: select before."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(load(model, scores)))  # the model file's size
    rest = [f for f in docs.schema.fields if f.name not in (text, into)]
    names = [f.name for f in rest]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, kept = Pieces(**shared.value), {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            out, at = [], 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE):
                    size += len(texts[end] or "")
                    end += 1
                out += counts(texts[at:end], pieces, kept)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.int64())], [*names, into])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rest, StructField(into, LongType())])
    return docs.select(*names, F.col(text).cast("string").alias(text)).mapInArrow(counted, schema)
