from __future__ import annotations

import random

from tellurix.llm.common import Scratch
from tellurix.llm.graph import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent if root(x) != x}


def test_components(spark):
    r = random.Random(4)
    path = list(range(1000, 1064))
    r.shuffle(path)
    cases = [[], [(1, 1)], [(2, 1), (1, 2), (2, 1)], list(zip(path, path[1:], strict=False)), [(5, i) for i in range(6, 300)], [(900, i) for i in range(300)], [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)]]
    cases.append([e for c in cases for e in c])
    for edges in cases:
        out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
        assert {x.id: x.component for x in out} == brute(edges) and len(out) == len(brute(edges))
