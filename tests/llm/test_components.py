"""Components of links: runs of edges thinned to star links, with and without the star rounds after them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tempora.llm import components as module
from tempora.llm.components import components, spanning


def labels(pairs):
    label = {x: x for p in pairs for x in p}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {x: find(x) for x in label if find(x) != x}


def test_dense_links_are_thinned_before_any_join(spark, monkeypatch):
    """Links found again within one group don't reach a join of edges, whose rows grew with them."""
    pairs = [(a, b) for a in range(60) for b in range(a)] + [(1000 + i, 1001 + i) for i in range(50)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    expected = labels(pairs)

    def joined(now):
        raise AssertionError("edges were joined")

    monkeypatch.setattr(module, "_large_star", joined)
    assert {r.u: r.v for r in components(edges).collect()} == expected
    # the same when no run holds all edges, as long as the forests do
    assert {r.u: r.v for r in components(edges, run_of=600).collect()} == expected


@pytest.mark.parametrize("run_of", [1, 7, 40, 200])
def test_runs_and_rounds_agree(spark, run_of):
    """Where runs thin nothing, as with links that stand apart in a path, star rounds go on to the end."""
    rng = random.Random(run_of)
    path = [(3000 + i, 3001 + i) for i in range(40)]
    rng.shuffle(path)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(-5, 2000 + i) for i in range(60)] + path
    edges = spark.createDataFrame([*pairs, (9, 9), (None, 4)], "u long, v long").repartition(3)
    rows = components(edges, run_of).collect()
    assert len(rows) == len({r.u for r in rows})
    assert {r.u: r.v for r in rows} == labels([p for p in pairs if p[0] != p[1]])


def test_runs_end_within_batches(spark):
    pairs = [(i, i + 1) for i in range(2500)]
    rows = module._forests(spark.createDataFrame(pairs, "u long, v long").coalesce(1), 1, 700).collect()
    assert len(rows) == 2500 and len({r.v for r in rows}) == 4
    u, v = spanning(np.array([r.u for r in rows]), np.array([r.v for r in rows]))
    assert len(u) == 2500 and set(v.tolist()) == {0}
