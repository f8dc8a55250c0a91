"""Components against a plain union-find, with nodes that take most of the edges."""

import random

import pytest
from pyspark.sql import functions as F

from moraine.llm import components as module


def _plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _edges(seed):
    draw = random.Random(seed)
    hub = [(5000, x) for x in range(300)] + [(1, x) for x in range(6000, 6400)]
    chains = [(x, x + 1) for x in range(7000, 7040)] + [(9000 - x, 8999 - x) for x in range(30)]
    loose = [(draw.randrange(400), draw.randrange(7000, 7500)) for _ in range(40)]
    return hub + chains + loose + [(3, 3), (None, 4), (4, None), (5000, 7), (7, 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_nodes(spark, seed):
    edges = _edges(seed)
    got = module.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == _plain(edges)


def test_crowded_nodes_are_found_and_bounded(spark):
    edges = module._ordered(spark.createDataFrame(_edges(1), "u long, v long"))
    settled, crowded = module._state(edges)
    assert not settled and {r["u"] for r in crowded.collect()} == {1, 5000}
    beside = module._beside_lows(module._both(edges), crowded)
    plain = module._beside_lows(module._both(edges), None)
    assert sorted(beside.collect()) == sorted(plain.collect())


def test_no_edges_and_settled_stars(spark):
    none = spark.createDataFrame([], "u string, v string")
    assert module.components(none).count() == 0
    stars = spark.range(1, 2000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert module._state(stars) == (True, None)
