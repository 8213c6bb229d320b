"""Components and groups that several operators share."""

import numpy as np

from sievewright.llm import shared


def closure(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


def run(spark, monkeypatch, edges):
    steps, write = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: steps.append(name) or write(df, name))
    got = shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    monkeypatch.setattr(shared, "stored", write)
    return {r.node: r.component for r in got}, steps


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (30, 20), (200, 150), (200, 400)):
        edges = [(int(a), int(b)) for a, b in rng.integers(-n, n, (m, 2))]
        got, _ = run(spark, monkeypatch, edges)
        assert got == closure(edges)


def test_components_of_long_paths(spark, monkeypatch):
    ids = list(range(1000))
    got, steps = run(spark, monkeypatch, list(zip(ids, ids[1:])))
    assert set(got.values()) == {0} and steps.count("parents") <= 15
    np.random.default_rng(1).shuffle(ids)
    path = [(int(a), int(b)) for a, b in zip(ids, ids[1:])]
    got, steps = run(spark, monkeypatch, path)
    assert set(got.values()) == {0} and steps.count("edges") <= 12
    # A star whose centre is the largest id, and a path that climbs and falls.
    star = [(500, k) for k in range(300)]
    comb = [(k, 1000 - k) for k in range(300, 400)] + [(1000 - k, k + 1) for k in range(300, 400)]
    got, steps = run(spark, monkeypatch, star + comb)
    assert got == closure(star + comb) and steps.count("edges") <= 4
