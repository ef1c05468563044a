import random

from pyspark.sql import functions as F

from locuspark.operators.components import connected_components
from locuspark.plans.ordering import numbered


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(500, 600 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (2, 2)], "a long, b long")).count() == 0


def test_numbering_is_global(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(1).sample(range(200), 200)] + [(None,)], "k string").repartition(7)
    rows = sorted((r["row_no"], r["k"]) for r in numbered(df, [F.col("k").asc_nulls_last()]).collect())
    assert [r[0] for r in rows] == list(range(201))
    assert [r[1] for r in rows] == [f"k{i:03d}" for i in range(200)] + [None]
