"""Components by joins against a plain union of sets."""

import random

import pytest

from reasonloom.llm.components import components


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def path(n, rnd):
    names = list(range(n))
    rnd.shuffle(names)
    return list(zip(names, names[1:]))


RND = random.Random(2)
GRAPHS = {
    "sparse": [(RND.randrange(300), RND.randrange(300)) for _ in range(150)],
    "dense": [(RND.randrange(60), RND.randrange(60)) for _ in range(400)],
    "shuffled path": path(300, RND),
    "sorted path": [(i, i + 1) for i in range(300)],
    "star": [(i, 500) for i in range(200)],
    "stars of stars": [(i, i % 10 + 1000) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(8)],
    "odd": [(1, 1), (None, 2), (3, None), (None, None), (4, 5), (5, 4), (4, 5)],
    "loops": [(7, 7)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = spark.createDataFrame(GRAPHS[name], "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges, "a", "b").collect()}
    assert found == plain(GRAPHS[name])
