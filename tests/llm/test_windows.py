import numpy as np
import pytest

from songfield.llm import substrings


@pytest.mark.parametrize("jumps", [0, 1, 8])
def test_nearest_smaller_before(jumps, monkeypatch):
    monkeypatch.setattr(substrings, "JUMPS", jumps)
    rng = np.random.default_rng(5)
    for values in (np.arange(300), np.arange(300)[::-1], np.append(np.arange(1, 300), 0), *(rng.permutation(n) for n in range(40))):
        naive = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert substrings.smaller_before(values.astype(np.uint64)).tolist() == naive


def test_texts_are_read_once_for_all_windows(spark, tmp_path, monkeypatch):
    seen, kind = [], type(spark.range(0))

    def noted(self, function, *rest, plain=kind.mapInArrow):
        seen.append((function.__name__, "text" in self.columns))
        return plain(self, function, *rest)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other"), (4, None)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["source_id"]) for r in substrings.find(docs).collect()]
    assert got == [(2, 0, 60, 1)]
    assert [with_text for name, with_text in seen[: [n for n, _ in seen].index("joined")]].count(True) == 1
