"""Sweeps by heaps and by supersteps, against plain searches."""

import heapq
import random

import pytest
from graphs_for_tests import TWO_TRIANGLES, frame
from pyspark.sql import functions as F

from graphspan.operators.sweeps import double_sweep, longest_between


def _distances(edges, start):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        for y, w in near[x] if d == best[x] else ():
            if d + w < best.get(y, 1 << 60):
                best[y] = d + w
                heapq.heappush(heap, (d + w, y))
    return best


def _forest(seed=3, parts=40):
    rng, edges = random.Random(seed), {}
    for p in range(parts):
        ids = [1000 * p + i for i in range(rng.randint(2, 9))]
        for i in range(1, len(ids)):
            edges[rng.choice(ids[:i]), ids[i]] = rng.randint(0, 9)
        for _ in range(rng.randint(0, 4)):
            edges[tuple(sorted(rng.sample(ids, 2)))] = rng.randint(0, 9)
    return [(u, v, w) for (u, v), w in edges.items()]


def _components(edges):
    left, out = {x for u, v, _ in edges for x in (u, v)}, []
    while left:
        found = set(_distances(edges, min(left)))
        out.append(sorted(found))
        left -= found
    return out


def _swept(edges):
    far = lambda x: min(_distances(edges, x).items(), key=lambda t: (-t[1], t[0]))
    out = []
    for nodes in _components(edges):
        start = far(nodes[0])[0]
        out.append((nodes[0], start, *far(start)))
    return sorted(out)


@pytest.mark.parametrize("heap_edges", [1_000_000, 7, 4])
def test_double_sweeps(spark, heap_edges):
    edges = [*_forest(parts=40 if heap_edges > 7 else 12), *((50_000 + u, 50_000 + v, w) for u, v, w in TWO_TRIANGLES)]
    assert sorted(map(tuple, double_sweep(frame(spark, edges), heap_edges).collect())) == _swept(edges)


def test_sweeps_of_no_edges(spark):
    none = frame(spark, [(1, 2, 3)]).filter("false")
    assert double_sweep(none).count() == 0
    assert longest_between(none, spark.createDataFrame([], "id long, add long")).count() == 0


def _longest(edges, add):
    return {nodes[0]: max(d + add[x] + add[y] for x in nodes for y, d in _distances(edges, x).items()) for nodes in _components(edges)}


@pytest.mark.parametrize("heap_edges", [1_000_000, 9])
def test_longest_between(spark, heap_edges):
    rng = random.Random(heap_edges)
    edges = _forest(5, 30 if heap_edges > 9 else 8)
    add = {x: rng.randint(0, 6) for u, v, _ in edges for x in (u, v)}
    got = longest_between(frame(spark, edges), spark.createDataFrame(list(add.items()), "id long, add long"), heap_edges).collect()
    assert {r["component"]: r["sweep"] + add[r["start"]] + add[r["far"]] for r in got} == _longest(edges, add)
    for r in got:
        assert _distances(edges, r["start"])[r["far"]] == r["sweep"]


def test_few_nodes_are_searched_from(spark):
    rng = random.Random(1)
    side = 25
    edges = [(side * i + j, side * i + j + 1, rng.randint(5, 9)) for i in range(side) for j in range(side - 1)] + [(side * i + j, side * i + j + side, rng.randint(5, 9)) for i in range(side - 1) for j in range(side)]
    add = spark.range(side * side).select("id", (F.col("id") % 3).alias("add"))
    row = longest_between(frame(spark, edges), add).first()
    assert row["searched"] < side * side / 10
    best = max(d + x % 3 + y % 3 for x in range(side * side) for y, d in _distances(edges, x).items())
    assert row["sweep"] + row["start"] % 3 + row["far"] % 3 == best
