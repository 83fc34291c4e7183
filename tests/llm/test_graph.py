import random

import pytest

from tracelight.llm.graph import connected_components


@pytest.mark.parametrize("one_task_edges", [0, 1000])
def test_components(spark, one_task_edges):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(90)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(30)]
    edges += [(-5, -7), (7, 7), (500, 500), (None, 3), (3, None), (0, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), one_task_edges=one_task_edges).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("one_task_edges", [0, 1000])
def test_no_edges(spark, one_task_edges):
    assert connected_components(spark.createDataFrame([], "a long, b long"), one_task_edges=one_task_edges).count() == 0
