"""Distances from roots: by hops, by weight, in buckets; eccentricities and double sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphspan.operators.adjacency import adjacency, adjacency_with, only
from graphspan.operators.fixpoint import Best
from graphspan.operators.sweeps import double_sweep
from graphspan.session import discard, materialise, materialise_with, once


def default_root(edges: DataFrame) -> int | None:
    """The smallest id that has an edge."""
    return edges.agg(F.min(F.least("u", "v"))).first()[0]


def _relaxed(roots: DataFrame, adj: DataFrame, cost: Column) -> DataFrame:
    """(id, distance) of everything reachable from roots (id, distance), each by its shortest path."""
    best = Best(roots.select("id", F.col("distance").alias("value")), ["id"])
    best.spread(adj, F.col("value") + cost)
    return best.known().withColumnRenamed("value", "distance")


def _from_root(edges: DataFrame, root: int | None) -> DataFrame:
    root = default_root(edges) if root is None else root
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).filter(F.col("id") == F.lit(root)).distinct()
    return nodes.select(F.col("id").cast("long"), F.lit(0).cast("long").alias("distance"))


def _distances(edges: DataFrame, root: int | None, cost: Column) -> DataFrame:
    edges = once(edges)
    adj = adjacency(edges)
    found = _relaxed(_from_root(edges, root), adj, cost)
    discard(adj)
    return found


def bfs(edges: DataFrame, root: int | None = None) -> DataFrame:
    """(id, distance) in hops; weights are ignored. Unreached nodes are not in the result."""
    return _distances(edges, root, F.lit(1).cast("long"))


def sssp(edges: DataFrame, root: int | None = None) -> DataFrame:
    """(id, distance) by weight, weights being non-negative."""
    return _distances(edges, root, F.col("w"))


def delta_stepping(edges: DataFrame, delta: int, root: int | None = None, log: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """(id, distance) by weight, settled bucket by bucket of width delta.

    Light edges (w <= delta) of a bucket are relaxed until it stands still, then the heavy ones once
    from the nodes it settled. The next bucket is the one of the nearest node left, so that empty
    buckets cost nothing. Distances are those of sssp() for every delta >= 1.

    What lies beyond the bucket waits in the tables of changes it came in, and only those are read
    for the next one: a row that waits counts if it is still its node's value.

    log is given (counter, bucket, step, count) rows: Updated, the nodes that a step changed, for
    each step of a bucket from 1, and Heavy, those that its heavy edges changed, after them.
    """
    edges = once(edges)
    adj, seen = adjacency_with(edges, heavy=F.count(F.when(F.col("w") > delta, 1)))
    light, heavy = only(adj, F.col("w") <= delta), only(adj, F.col("w") > delta)
    best = Best(_from_root(edges, root).select("id", F.col("distance").alias("value")), ["id"])
    upto, further, log = 0, F.col("value") + F.col("w"), [] if log is None else log
    waiting = [(best.base, 0)]  # tables with rows of later buckets, and their largest value
    best.pinned = [best.base]
    while waiting:
        rows = _union([t for t, _ in waiting]).filter(F.col("value") >= upto)
        nearest = rows.agg(F.min("value")).first()[0]
        if nearest is None:
            break
        bucket = nearest // delta
        upto, steps = delta * (bucket + 1), 0
        inside = F.col("value") < upto
        frontier, seen_here = materialise_with(best.lookup(rows.filter(inside)).filter("known = value").select("id", "value"), "frontier", n=F.count("*"))
        here, sizes = [frontier], [seen_here["n"]]

        def stepped(senders: DataFrame, most: int, along: DataFrame, counter: str) -> tuple[DataFrame, int]:
            fresh, now = best.step(senders, along, further, most=most, inside=F.count(F.when(inside, 1)), top=F.max("value"))
            log.append((counter, bucket, steps, now["n"]))
            if now["n"] > now["inside"]:
                waiting.append((fresh, now["top"]))
            if now["n"]:
                best.pinned.append(fresh)
            return fresh, now["inside"]

        while sizes[-1]:  # what waited may all have been improved since
            steps += 1
            fresh, within = stepped(here[-1], sizes[-1], light, "Updated")
            if not within:
                break
            here.append(fresh.filter(inside))
            sizes.append(within)
        if seen["heavy"] and steps:
            steps += 1
            stepped(_union(here).groupBy("id").agg(F.min("value").alias("value")), sum(sizes), heavy, "Heavy")
        waiting = [(t, top) for t, top in waiting if top >= upto]
        if len(waiting) > _WAITING:
            merged = materialise(_union([t for t, _ in waiting]).filter(F.col("value") >= upto).groupBy("id").agg(F.min("value").alias("value")), "waiting")
            waiting = [(merged, max(top for _, top in waiting))]
            best.pinned.append(merged)
        for table in [t for t in best.pinned if not best.holds(t, [x for x, _ in waiting])]:
            best.unpin(table)
        discard(frontier)
    discard(adj)
    return best.known().withColumnRenamed("value", "distance")


_WAITING = 6  # tables of later rows that a bucket looks into


def _union(tables: list[DataFrame]) -> DataFrame:
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.union(more)
    return rows


def eccentricity(distances: DataFrame) -> DataFrame:
    """(ecc, lower, upper): bounds on the diameter of the component the distances cover."""
    ecc = F.coalesce(F.max("distance"), F.lit(0))
    return distances.agg(ecc.alias("ecc"), ecc.alias("lower"), (2 * ecc).alias("upper"))


def sequential(edges: DataFrame) -> DataFrame:
    """(diameter): the largest double sweep of any component."""
    return double_sweep(edges).agg(F.coalesce(F.max("sweep"), F.lit(0)).alias("diameter"))


def single_pass(edges: DataFrame) -> DataFrame:
    """(diameter): the weighted eccentricity of the smallest id."""
    return sssp(edges).agg(F.coalesce(F.max("distance"), F.lit(0)).alias("diameter"))
