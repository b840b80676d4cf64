import os
import subprocess
import sys

import pytest

from songfield.llm import lattice, substrings
from songfield.llm.pieces import load

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A process of its own, as a worker is: MB held before a task, in it and after it.
TASK = """
import re
from pathlib import Path
import numpy as np, pyarrow as pa
from songfield.llm.common import returning

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

@returning
def rows(batches):
    own = [np.full(8192, i) for i in batches]  # each below what the system is asked for by itself
    own += [pa.array(range(1 << 16)) for _ in range(64)]
    yield held()

before = held()
during, = rows(range(1500))
print(before, during, held())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from Linux's files")
def test_memory_goes_back_after_a_task():
    env = os.environ | {"PYTHONPATH": ROOT, "MALLOC_MMAP_THRESHOLD_": str(1 << 25)}  # as after large arrays were freed
    before, during, after = map(float, subprocess.run([sys.executable, "-c", TASK], env=env, capture_output=True, text=True, check=True).stdout.split())
    assert during - before > 100 and after - before < 0.25 * (during - before)


@pytest.mark.parametrize("rows", [1, 2, 256])
def test_rows_are_decoded_in_parts_alike(spark, rows, monkeypatch):
    monkeypatch.setattr(lattice, "DECODED", rows)
    texts = ["a tale", None, "", "日本 é\n x", "▁ end", "two  spaces"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: r["text"] for r in lattice.decode(lattice.encode(docs)).collect()}
    assert got == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


def test_texts_are_split_without_the_pieces(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("pieces sent to workers that only split")

    texts = spark.createDataFrame([(1, "a tale")], "doc_id bigint, text string")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    assert lattice.sliced(texts, load()).columns[0] == "slice"


def test_only_texts_with_passages_are_cut_in_workers(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, None), (4, "a b")], "doc_id bigint, text string")
    found = docs.selectExpr("doc_id", "xxhash64(text) digest", "1 start_word", "int(doc_id * 2) end_word").filter("doc_id IN (1, 4)")
    left = substrings.remove(docs, found)
    assert sorted(map(tuple, left.collect())) == [(1, "a  c d"), (2, "x"), (3, None), (4, "a ")]
    assert "rest(CASE WHEN isnotnull(__spans" in left._jdf.queryExecution().optimizedPlan().toString()
