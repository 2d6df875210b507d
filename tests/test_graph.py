import random

import pytest

from ledgerloom.operators.graph import components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_no_edges_and_a_hot_node(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    star = components(spark.range(1, 3000).selectExpr("id as a", "7000 as b"), "a", "b")
    assert star.where("root = 1").count() == 3000
