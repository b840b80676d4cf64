"""Places over all rows and exact ranks against plain Python."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from songfield.operators.numbering import Down, at_ranks, medians, numbered


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows in one group, null groups and values, and ties."""
    rng = random.Random(2)
    data = [(i, rng.choice(["hot", None, *map(str, range(40))]) if i % 3 else "hot", rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 7])) for i in range(5000)]
    return data, spark.createDataFrame(data, "id bigint, g string, v int, w int").cache()


@pytest.mark.parametrize("down", [False, True])
def test_places_over_all_rows(rows, down):
    data, table = rows
    got = {r["id"]: r["number"] for r in numbered(table, [Down(F.col("v")) if down else F.col("v"), F.col("id")]).collect()}
    want = sorted(data, key=lambda r: (r[2] is None, (-1 if down else 1) * (r[2] or 0), r[0]))
    assert got == {r[0]: n for n, r in enumerate(want)}


def test_places_and_offsets_in_groups(rows):
    data, table = rows
    got = {r["id"]: (r["at"], r["start"]) for r in numbered(table, [F.col("v"), F.col("id")], ["g"], name="at", weight=F.col("w")).collect()}
    want, n, held = {}, {}, {}
    for i, g, v, w in sorted(data, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = (n.get(g, 0), held.get(g, 0))
        n[g], held[g] = n.get(g, 0) + 1, held.get(g, 0) + (w or 0)
    assert got == want


def test_a_hot_group_is_in_several_ranges(spark, rows):
    _, table = rows
    plan = numbered(table, [F.col("id")], ["g"])._jdf.queryExecution().toString()
    assert "__part" in plan and "SinglePartition" not in plan
    assert numbered(table.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("values", [[], [None, 3.5], [1.0] * 900, [1.0] * 450 + [2.0] * 450, list(range(5000)), [x % 7 for x in range(5001)] + [None] * 9, [-1e300, 1e300, 0.0, 5e-324]])
def test_exact_medians_with_few_values_a_task(spark, values):
    rng = random.Random(1)
    rng.shuffle(values)
    table = spark.createDataFrame([(None if v is None else float(v), 1.0) for v in values], "a double, b double").repartition(4)
    own = sorted(v for v in values if v is not None)
    want = None if not own else (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
    assert medians(table, ["a", "b"], few=20) == {"a": want, "b": 1.0 if values else None}
    if own:
        places = [0, len(own) // 3, len(own) - 1]
        assert at_ranks(table, {"a": places}, few=20)["a"] == [own[p] for p in places]


def test_no_window_without_partition():
    for path in Path(__file__).parent.parent.joinpath("songfield").rglob("*.py"):
        assert "llm" in path.parts or not re.search(r"over\(Window\.orderBy", path.read_text()), path
