"""A SentencePiece model's pieces, read from its file, and what follows from them.

The file's path is a parameter; nothing is trained and nothing is copied. The
two kinds of models differ in how a word is cut into pieces: a unigram model
takes the cut with the best sum of scores, a BPE model the one its merges
lead to. Both only ever cut a word where its text allows, so a text falls apart
into words that are cut by themselves.

A BPE model's own scores say which merge comes first and don't add up. ``load``
can therefore read any model's pieces as a unigram table by a stated rule
(``scores="rank"``): a piece's probability falls as one over its place among the
model's pieces (Zipf's law), so its score is minus the logarithm of that place.
Scores of unigram tables are whole millionths, so that sums are exact, equal
wherever they are computed, and ties are ties.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

#: Where the public tokenizers' files are, unless another path is given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: A unigram score's unit is one millionth.
UNIT = 1_000_000


@dataclass
class Pieces:
    """Pieces are keyed by their text with plain spaces."""

    unigram: bool
    id_of: dict[str, int]
    score_of: dict[str, float]  # whole millionths in a unigram table
    byte_id: list[int]
    unknown_id: int
    unknown_score: float
    longest: int
    text_of: list[str]
    kind_of: list[int]
    words: str  # letters with the spaces and marks before them, line ends, marks, spaces; no piece goes on past their ends
    _fits: dict = field(default_factory=dict, repr=False)

    def spelled(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown_id]

    def merged(self, word: str) -> list[str]:
        """A word's pieces by the model's merges: of all neighbours that join to a
        piece, the best-scored join first, the leftmost of equals."""
        n = len(word)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap: list = []

        def offer(a: int, b: int) -> None:
            joined = word[a : a + size[a] + size[b]]
            score = self.score_of.get(joined) if len(joined) <= self.longest else None
            if score is not None:
                heapq.heappush(heap, (-score, a, size[a], b, size[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, size_a, b, size_b = heapq.heappop(heap)
            if size[a] != size_a or size[b] != size_b or after[a] != b:
                continue
            size[a] += size_b
            size[b] = 0
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        out, at = [], 0
        while at < n:
            out.append(word[at : at + size[at]])
            at += size[at]
        return out

    def best(self, word: str) -> list[str]:
        """A word's pieces with the best sum of scores; of equals the last piece that
        begins first."""
        total, start = [0], [0]
        for end in range(1, len(word) + 1):
            options = [(total[end - 1] + self.score_of.get(word[end - 1], self.unknown_score), end - 1)]
            for s in range(max(0, end - self.longest), end - 1):
                if (score := self.score_of.get(word[s:end])) is not None:
                    options.append((total[s] + score, s))
            value, s = max(options, key=lambda x: (x[0], -x[1]))
            total.append(value)
            start.append(s)
        out, end = [], len(word)
        while end:
            out.append(word[start[end] : end])
            end = start[end]
        return out[::-1]

    def cut(self, word: str) -> list[int]:
        """The ids of one word."""
        parts = self.best(word) if self.unigram else self.merged(word)
        return [i for p in parts for i in ([self.id_of[p]] if p in self.id_of else self.spelled(p))]

    def follows(self, left: str, right: str) -> bool:
        """Whether a BPE model, given both texts as one, cuts it just there."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 1 << 18:
                self._fits.clear()
            known = self._fits[key] = self.merged(left + right) == [x for x in key if x]
        return known


def load(path: str = DEFAULT_MODEL, scores: str = "model") -> Pieces:
    """Reads a model file, and checks that it is one whose words stand apart.
    ``scores`` is "model" for the file's own, or "rank" for the unigram table that
    follows from the places of its pieces."""
    if scores not in ("model", "rank"):
        raise ValueError(f"scores are the model's or by rank, not {scores!r}")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
    if kind not in (1, 2) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only unigram and BPE models without a normalisation of their own")
    text_of = [p.piece.replace(SPACE, " ") for p in proto.pieces]
    kind_of = [p.type for p in proto.pieces]
    if {USER, UNUSED} & set(kind_of):
        raise ValueError("models with user-defined or unused pieces aren't supported")
    id_of = {t: i for i, (t, k) in enumerate(zip(text_of, kind_of)) if k == NORMAL}
    # Python's word characters hold some numerals too; those that pieces use aren't letters here.
    numerals = "".join(sorted({c for t in id_of for c in t if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
    letters, others = rf"[^\W\d_{numerals}]", rf"(?:[^\w \n]|[\d_{numerals}])"
    letter = re.compile(letters)
    for t in id_of:
        for a, b in zip(t, t[1:]):
            if (letter.match(a) and not letter.match(b)) or (b == " " and a != " ") or "\n" in (a, b):
                raise ValueError(f"piece {t!r} goes on past the end of a word")
    byte_id = [i for i, k in enumerate(kind_of) if k == BYTE]
    unigram = kind == 1 or scores == "rank"
    own = {t: proto.pieces[i].score for t, i in id_of.items()} if scores == "model" else {t: -math.log(place) for place, t in enumerate(id_of, 1)}
    score_of = {t: round(x * UNIT) for t, x in own.items()} if unigram else own
    unknown = min(score_of.values()) - UNKNOWN_PENALTY * (UNIT if unigram else 1)
    return Pieces(
        unigram, id_of, score_of, byte_id, proto.trainer_spec.unk_id, int(unknown) if unigram else unknown,
        max(map(len, id_of)), text_of, kind_of, rf" ?{letters}++| *+{others}++(?:{letters}++)?|\n| ++{letters}++| ++",
    )
