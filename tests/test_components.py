"""Connected components against union-find on random graphs."""

from __future__ import annotations

import random

from annalist.scratch import components


def united(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_random_graphs_and_a_chain(spark):
    rng = random.Random(5)
    graphs = [[(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (10, 40)]
    graphs.append([(k, k + 1) for k in range(40)])
    for edges in graphs:
        found = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.id: r.component for r in found.collect()} == united([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
