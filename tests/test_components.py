import random

from weftline.operators.components import components, pairs_within


def find_all(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_random_graph_chain_and_star(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == find_all([e for e in edges if e[0] != e[1]])


def test_nulls_loops_repeats_and_empty_input(spark):
    df = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "y"), ("z", "z"), (None, "q"), ("q", None)], "a string, b string")
    assert {tuple(r) for r in components(df).collect()} == {("x", "x"), ("y", "x")}
    assert components(df.limit(0)).count() == 0


def test_pairs_within_groups(spark):
    df = spark.createDataFrame([("g", 3), ("g", 1), ("g", 1), ("h", 2)], "g string, i int")
    assert [tuple(r) for r in pairs_within(df, "g", "i", "a", "b").collect()] == [(1, 3)]
