"""Components of graphs and of shared hubs against union and find."""

import random

import pytest

from inkwell.llm import graph
from inkwell.scratch import Scratch


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def graphs():
    rng = random.Random(2)
    yield "chain", [(i, i + 1) for i in range(60)]
    yield "shuffled chain", (lambda p: [*zip(p[:-1], p[1:], strict=True)])(rng.sample(range(1000), 60))
    yield "star", [(500, i) for i in range(60)]
    yield "random", [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    yield "loops and repeats", [(1, 1), (2, 3), (3, 2), (2, 3)]
    yield "empty", []


@pytest.mark.parametrize(("name", "edges"), [*graphs()])
def test_components(spark, name, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(frame, Scratch(spark, "graph"), "g").collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({n for e in real for n in e}, real)


@pytest.mark.parametrize("seed", range(3))
def test_contracted_groups(spark, seed):
    rng = random.Random(seed)
    members = {k: rng.sample(range(120), rng.randint(1, 5)) for k in range(70)}
    rows = [(n, min(group)) for group in members.values() for n in group]
    got = {r.node: (r.near, r.root) for r in graph.contracted(spark.createDataFrame(rows, "node long, hub long"), Scratch(spark, "graph"), "g").collect()}
    nodes = {n for n, _ in rows}
    want = roots(nodes, rows)
    assert {n: root for n, (_, root) in got.items()} == want
    assert all(near == min(h for n2, h in rows if n2 == n) for n, (near, _) in got.items())
    assert graph.contracted(spark.createDataFrame([], "node long, hub long"), Scratch(spark, "graph"), "g").count() == 0


def test_bands_of_a_low_threshold_are_refused():
    from inkwell.llm import ngram_join

    with pytest.raises(ValueError, match="hash functions"):
        ngram_join.bands_and_rows(0.02)
