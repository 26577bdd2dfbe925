"""Connected components against a plain union-find, in one task and in rounds."""

import random

import pyarrow as pa
import pytest

from rastrum.operators import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def some_edges(seed, n=60, m=45):
    r = random.Random(seed)
    return [(r.randrange(n) - 20, r.randrange(n) - 20) for _ in range(m)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(1, 9)] + [(5, 5), (None, 3), (3, None), (100, 101)]


@pytest.mark.parametrize("one_task", [400_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    edges = some_edges(1)
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3))
    assert sorted((r.node, r.component) for r in got.collect()) == sorted(plain(edges).items())
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_contraction_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 7)
    edges = [(max(e), min(e)) for e in some_edges(2, 40, 80) if None not in e and e[0] != e[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges[i : i + 20]], pa.int64()) for k in (0, 1)], ["u", "v"]) for i in range(0, len(edges), 20)]
    left = [(a, b) for out in graph._contracted(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert len(left) <= len(edges) and plain(left) == plain(edges)
