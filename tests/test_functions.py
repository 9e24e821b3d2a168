"""Places in an order and components, against plain Python."""

import random

import pytest

from cohortpanel.functions import components, placing
from pyspark.sql import functions as F


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


GRAPHS = {
    "chain": [(k, k + 1) for k in range(300)],
    "star around the largest": [(999, k) for k in range(200)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3), (4, 4)],
    "random": [(random.Random(1).randrange(400), k) for k in range(300)] + [(random.Random(k).randrange(300), random.Random(k + 1).randrange(300)) for k in range(150)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name, monkeypatch):
    monkeypatch.setattr(components, "HUB_SHARE", 5)  # hubs from a fifth of all rows on
    edges = GRAPHS[name]
    got = {}
    for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == plain_components(edges)
    assert all(root in members for root, members in got.items())


def test_components_of_texts_and_of_nothing(spark):
    rows = components.components(spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "e")], "a string, b string")).collect()
    assert len({r["root"] for r in rows}) == 2 and len(rows) == 5
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_meeting_keeps_hubs_in_place(spark):
    rows = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(600)], "key int, v int")
    facts = rows.groupBy("key").agg(F.count("*").alias("k"), F.max("v").alias("m"))
    met = components.meet(rows, facts, "key", 600)
    assert met.count() == 600 and "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()


def test_places(spark):
    r = random.Random(3)
    values = [(r.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(values, "x int, y int").repartition(7)
    got = sorted((q["place"], q["x"], q["y"]) for q in placing.numbered(df, "place", "x", "y").collect())
    assert got == [(k + 1, x, y) for k, (x, y) in enumerate(sorted(values))]
    order = placing.ordered(df, "x", "y", value="x")
    assert order.size == 500 and len(order.ranges) > 1
    want = sorted(x for x, _ in values)
    assert order.values_at("x", [1, 250, 500, 501]) == {1: want[0], 250: want[249], 500: want[499]}
    assert placing.numbered(df.limit(0), "place", "x").count() == 0


@pytest.mark.parametrize("values", [[1, 2, 3, 10, 11, 19], [5], [], [4, 4, 4], [0, 1, 9, 10, 18], list(range(0, 900, 3)) + [2000]])
def test_largest_gap(spark, values):
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(values)], "d double, k int").repartition(5)
    got = placing.ordered(df, "d", "k", value="d").largest_gap("d")
    values = sorted(values)
    gaps = [b - a for a, b in zip(values, values[1:])]
    assert got == (values[gaps.index(max(gaps))] if gaps else values[0] if values else None)
