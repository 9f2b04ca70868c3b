"""Longest distances of every component: double sweeps, and exact ones between weighted ends.

Components of up to `heap_edges` edges are dealt into bins, a task each, and searched there with a
heap, so that any number of small components costs one grouped pass. Larger ones, of which there
are few, run as supersteps over the whole cluster, all at once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphspan.operators.adjacency import adjacency
from graphspan.operators.components import connected_components
from graphspan.operators.fixpoint import Best
from graphspan.session import discard, materialise, materialise_with, once

HEAP_EDGES = 1_000_000
SWEEPS = "component long, start long, far long, sweep long"


class Component:
    """A component's nodes, in order of their ids, and its edges from both ends."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        other = np.concatenate([at[len(u) :], at[: len(u)]])
        order = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[order], np.arange(len(self.ids) + 1)).tolist()
        self.to, self.cost = other[order].tolist(), np.concatenate([w, w])[order].tolist()

    def distances(self, start: int) -> np.ndarray:
        """From one node, by its place, to all."""
        first, to, cost = self.first, self.to, self.cost
        best = [math.inf] * len(self.ids)
        best[start] = 0
        heap = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in range(first[x], first[x + 1]):
                y, far = to[e], d + cost[e]
                if far < best[y]:
                    best[y] = far
                    heapq.heappush(heap, (far, y))
        return np.array(best).astype(np.int64)


def _in_bins(labelled: DataFrame, edges: int, heap_edges: int, work: Callable[[int, pa.Table], list[tuple]], shape: str) -> DataFrame:
    """work on the edges of each component (component and others), many components a task."""
    bins = max(1, math.ceil(edges / heap_edges))
    names = [x.split()[0] for x in shape.split(", ")]

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("component")
        component = table["component"].to_numpy()
        cut = np.append(np.flatnonzero(np.diff(component, prepend=component[0] - 1)), len(component))
        rows = [r for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()) for r in work(int(component[a]), table.slice(a, b - a))]
        return pa.table({x: pa.array([r[i] for r in rows], pa.int64()) for i, x in enumerate(names)})

    return labelled.withColumn("__bin", F.pmod(F.xxhash64("component"), F.lit(bins))).groupBy("__bin").applyInArrow(lambda t: each(t.drop_columns("__bin")), shape)


def _by_size(edges: DataFrame, heap_edges: int) -> tuple[DataFrame, DataFrame | None, int, DataFrame]:
    """(edges of small components with their component, those of large ones or None, how many edges the small have, components)."""
    edges = once(edges)
    parts = materialise(connected_components(edges), "components")
    labelled = materialise(edges.join(parts.withColumnRenamed("id", "u"), "u"), "labelled")
    is_small = F.col("n") <= heap_edges
    sizes, seen = materialise_with(labelled.groupBy("component").agg(F.count("*").alias("n")), "sizes", small=F.sum(F.when(is_small, F.col("n"))), large=F.count(F.when(~is_small, 1)))
    if not seen["large"]:
        return labelled, None, seen["small"] or 0, parts
    large = F.broadcast(sizes.filter(~is_small).select("component"))  # one for every heap_edges edges at most
    return labelled.join(large, "component", "left_anti"), labelled.join(large, "component", "left_semi"), seen["small"] or 0, parts


def _reached(roots: DataFrame, adj: DataFrame) -> DataFrame:
    best = Best(roots.select("id", F.lit(0).cast("long").alias("value")), ["id"])
    best.spread(adj, F.col("value") + F.col("w"))
    return best.known().withColumnRenamed("value", "distance")


def double_sweep(edges: DataFrame, heap_edges: int = HEAP_EDGES) -> DataFrame:
    """(component, start, far, sweep) for each component.

    From the component's smallest id to the node farthest from it (start; the smallest of several),
    and from there again (far, at distance sweep): a lower bound on the component's diameter, and
    the diameter itself of a tree.
    """
    small, large, n, parts = _by_size(edges, heap_edges)

    def swept(component: int, table: pa.Table) -> list[tuple]:
        graph = Component(*(table[x].to_numpy() for x in ("u", "v", "w")))
        start = int(graph.distances(0).argmax())  # the first of several is the smallest id
        reached = graph.distances(start)
        far = int(reached.argmax())
        return [(component, int(graph.ids[start]), int(graph.ids[far]), int(reached[far]))]

    out = materialise(_in_bins(small.select("component", "u", "v", "w"), n, heap_edges, swept, SWEEPS), "sweeps")
    if large is not None:
        adj = adjacency(large.select("u", "v", "w"))
        mine = materialise(parts.join(F.broadcast(large.select("component").distinct()), "component", "left_semi"), "large")

        def farthest(roots: DataFrame) -> DataFrame:
            best = F.max(F.struct("distance", (-F.col("id")).alias("minus")))
            met = _reached(roots, adj).join(mine, "id").groupBy("component").agg(best.alias("x"))
            return materialise(met.select("component", (-F.col("x.minus")).alias("id"), F.col("x.distance").alias("distance")), "sweep")

        first = farthest(mine.filter("id = component"))
        second = farthest(first)
        both = second.select("component", F.col("id").alias("far"), F.col("distance").alias("sweep")).join(first.select("component", F.col("id").alias("start")), "component")
        out = out.union(materialise(both.select("component", "start", "far", "sweep"), "sweeps"))
        discard(adj)
    return out


def longest_between(edges: DataFrame, ends: DataFrame, heap_edges: int = HEAP_EDGES) -> DataFrame:
    """(component, start, far, sweep, searched): of each component the pair of nodes for which the
    distance and what both ends add is largest, exactly, and how many nodes were searched from.

    ends (id, add) has every node's addition. A search from s that finds at most f (distance and the
    far end's addition) tells of every other node x that it finds at most d(s, x) + f. Nodes whose
    bound, with their own addition, is no more than the best pair so far need no search; the next
    is from the node of the largest bound. No table of all pairs is ever made.
    """
    small, large, n, parts = _by_size(edges, heap_edges)
    shape = SWEEPS + ", searched long"
    a, b = ends.select(F.col("id").alias("u"), F.col("add").alias("a")), ends.select(F.col("id").alias("v"), F.col("add").alias("b"))

    def searched(component: int, table: pa.Table) -> list[tuple]:
        u, v, w, a, b = (table[x].to_numpy() for x in ("u", "v", "w", "a", "b"))
        graph = Component(u, v, w)
        add = np.zeros(len(graph.ids), np.int64)
        add[np.searchsorted(graph.ids, u)], add[np.searchsorted(graph.ids, v)] = a, b
        upper, best, pair, searches = np.full(len(add), np.iinfo(np.int64).max), -1, (0, 0, 0), 0
        while upper.max() > best:
            start = int(upper.argmax())
            reached = graph.distances(start)
            searches += 1
            far = int((reached + add).argmax())
            found = int(reached[far] + add[far])
            if add[start] + found > best:
                best, pair = int(add[start] + found), (int(graph.ids[start]), int(graph.ids[far]), int(reached[far]))
            upper = np.minimum(upper, add + reached + found)
            upper[start] = min(upper[start], best)
        return [(component, *pair, searches)]

    rows = small.select("component", "u", "v", "w").join(a, "u").join(b, "v")
    out = materialise(_in_bins(rows, n, heap_edges, searched, shape), "sweeps")
    return out if large is None else out.union(_longest_large(large, ends, parts, shape))


def _longest_large(edges: DataFrame, ends: DataFrame, parts: DataFrame, shape: str) -> DataFrame:
    """longest_between() of large components: a round searches from one node of each."""
    spark, adj = edges.sparkSession, adjacency(edges.select("u", "v", "w"))
    own = parts.join(F.broadcast(edges.select("component").distinct()), "component", "left_semi").join(ends, "id")
    bounds = materialise(own.select("component", "id", "add", F.lit((1 << 63) - 1).alias("upper")), "bounds")
    best: dict[int, tuple[int, int, int, int]] = {}  # of each large component, which are few
    searches: dict[int, int] = {}
    while True:
        top = bounds.groupBy("component").agg(F.max(F.struct("upper", (-F.col("id")).alias("minus"), "add")).alias("x")).collect()
        roots = [(r["component"], -r["x"]["minus"], r["x"]["add"]) for r in top if r["x"]["upper"] > best.get(r["component"], (-1,))[0]]
        if not roots:
            break
        reached = _reached(spark.createDataFrame([(x,) for _, x, _ in roots], "id long"), adj).join(bounds, "id")
        reached = materialise(reached, "reached")
        found = reached.groupBy("component").agg(F.max(F.struct((F.col("distance") + F.col("add")).alias("f"), (-F.col("id")).alias("minus"), "distance")).alias("x")).collect()
        far = {r["component"]: (r["x"]["f"], -r["x"]["minus"], r["x"]["distance"]) for r in found}
        for component, start, add in roots:
            f, end, distance = far[component]
            searches[component] = searches.get(component, 0) + 1
            best[component] = max(best.get(component, (-1, 0, 0, 0)), (add + f, start, end, distance), key=lambda t: t[0])
        told = F.broadcast(spark.createDataFrame([(c, far[c][0], start, best[c][0]) for c, start, _ in roots], "component long, f long, root long, best long"))
        new = reached.join(told, "component")
        less = F.least("upper", F.col("add") + F.col("distance") + F.col("f"))
        new = new.select("component", "id", "add", F.when(F.col("id") == F.col("root"), F.least(less, "best")).otherwise(less).alias("upper"))
        rest = bounds.join(told.select("component"), "component", "left_anti")
        after = materialise(new.unionByName(rest), "bounds")
        discard(bounds)
        discard(reached)
        bounds = after
    discard(adj)
    return spark.createDataFrame([(c, *best[c][1:], searches[c]) for c in best], shape)
