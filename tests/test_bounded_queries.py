"""Queries whose steps are bounded, whatever the tables."""

import random

import pytest

from orrery.operators import graph
from orrery.sources import anchors


@pytest.mark.parametrize("percent", [18, 60, 90])
def test_pairs_of_lists_are_counted_and_never_travel(spark, percent):
    """Every pair that reaches the share, over many blocks."""
    rng = random.Random(percent)
    lists = {}
    for i in range(90):
        own = set(rng.sample(range(80), rng.randint(10, 30)))
        lists[f"w{i:03d}"] = own if i % 3 or not i else (set(rng.sample(sorted(lists[f"w{i - 1:03d}"]), 9)) | {rng.randint(0, 80)} | set(rng.sample(range(80), 2)))
    lists["w200"] = lists["w007"]
    want = {(min(w for w, m in lists.items() if m == lists[w7]), w7) for w7 in lists if len(lists[w7]) >= 10} - {(w, w) for w in lists}
    heads = [w for w in sorted(lists) if len(lists[w]) >= 10 and not any(b == w for _, b in want)]
    want |= {(a, b) for a in heads for b in heads if a < b and 100 * len(lists[a] & lists[b]) >= percent * len(lists[a] | lists[b])}
    refs = spark.createDataFrame([(w, r) for w, m in lists.items() for r in m], "id string, ref int").repartition(3)
    got = [(r.a, r.b) for r in graph.shared_reference_pairs(refs, percent=percent, block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_heads_of_legs_are_lengthened_until_they_suffice(spark):
    """A leg that names one repository 400 times before the next: its first head has one repository only."""
    rows = [(0, i, "same") for i in range(400)] + [(0, 400 + i, f"a{i}") for i in range(9)] + [(1, i, "same") for i in range(500)]
    got = anchors.seat_by_turns(spark.createDataFrame(rows, "leg int, pos int, full_name string"), [2, 1], limit=5)
    assert [r.full_name for r in got.collect()] == ["same", "a0", "a1", "a2", "a3"]
