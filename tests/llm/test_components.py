import random

import pytest

from curator.llm import components as m


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


@pytest.mark.parametrize("hot", [100_000, 8])
def test_components_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT", hot)
    r = random.Random(2)
    edges = {tuple(sorted(r.sample(range(300), 2))) for _ in range(170)}
    edges |= {(1000, 1000 + i) for i in range(1, 60)} | {(2000 + i, 2100) for i in range(60)} | {(3000 + i, 3001 + i) for i in range(40)}
    d = spark.createDataFrame([*edges, (5, 5)], "a long, b long").repartition(3)
    got = m.components(d).collect()
    assert {x.node: x.root for x in got} == brute(edges) and len(got) == len(brute(edges))


def test_no_edges(spark):
    assert m.components(spark.createDataFrame([], "a long, b long")).collect() == []
