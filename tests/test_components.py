import random

from tonalis.operators.components import connected_components


def roots(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long, root string")
    return {r.node: r.root for r in connected_components(df).collect()}


def test_chain_star_loop_and_nulls(spark):
    got = roots(spark, [(1, 2, ""), (2, 3, ""), (9, 9, ""), (None, 4, ""), (5, 4, ""), (1, 2, "")])
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 4: 4, 5: 4}


def test_empty(spark):
    assert roots(spark, []) == {}


def test_random_graph_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400), "") for _ in range(260)] + [(1000 + i, 1001 + i, "") for i in range(150)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert roots(spark, edges) == {x: find(x) for x in list(parent)}
