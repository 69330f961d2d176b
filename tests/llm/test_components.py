import random

import pytest

from corvane.llm.components import connected_components, match_links

EDGES = "l string, r string, child string, root string"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bound", [2_000_000, 300, 20])
def test_equals_union_find(spark, bound):
    rng = random.Random(3)
    pairs = [(f"v{i:04}", f"v{i + 1:04}") for i in range(150)]  # a chain
    pairs += [("hub", f"h{i:03}") for i in range(300)]  # a hub with a third of all edges
    pairs += [(f"r{rng.randrange(400):03}", f"r{rng.randrange(400):03}") for _ in range(250)]
    pairs += pairs[:30] + [(b, a) for a, b in pairs[:30]] + [("self", "self"), (None, "x"), ("y", None), ("", "empty")]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "c", "d") for a, b in pairs], EDGES).repartition(6)
    got = {r.record_id: r.group_id for r in connected_components(df, "l", "r", max_task_edges=bound, fan=2).collect()}
    assert got == brute(pairs)


def test_empty_and_links(spark):
    assert connected_components(spark.createDataFrame([], EDGES), "l", "r").count() == 0
    rows = [("a", "b", 1.0, " Match"), ("a", "c", 16.0, None), ("a", "d", 15.9, None), ("a", "e", 99.0, "review"), ("a", "f", None, None), ("a", "g", 20.0, "  ")]
    s = spark.createDataFrame(rows, "left_record_id string, right_record_id string, total double, zone string")
    assert {r.right_record_id for r in match_links(s).collect()} == {"b", "c", "g"}
