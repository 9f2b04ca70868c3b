"""Randomised clustering and the diameter estimate through the graph of clusters.

A node is uncovered (it has no value), covered or frozen. In round g every uncovered node becomes a centre with a
probability that grows with g; covered nodes then send their cluster along edges while their
distance is within radius * (1 + g - generation), and what lies within it at the end freezes.
Which node becomes a centre is a hash of seed, round and id, so a run can be repeated anywhere.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from graphspan.functions.bits import hash01
from graphspan.operators.adjacency import adjacency, adjacency_with, along
from graphspan.operators.fixpoint import Best
from graphspan.operators.superstep import triplets
from graphspan.operators.sweeps import double_sweep, longest_between
from graphspan.session import bucketed, discard, materialise, materialise_with, once


def sampled(seed: int, generation: int, probability: float) -> Column:
    """Whether a node becomes a centre in this round."""
    return F.lit(True) if probability >= 1 else hash01(F.lit(seed), F.lit(generation), F.col("id")) < probability


def within(radius: int, round_: int) -> Column:
    """Whether a covered node's `value` lies in the round's reach."""
    return F.col("value.distance") <= F.lit(radius) * (1 + round_ - F.col("value.generation"))


def frozen(radius: int, round_: int, of: str = "value") -> Column:
    """Whether a covered node was in reach at the end of an earlier round; it never changes again."""
    generation = F.col(f"{of}.generation")
    return (generation < round_) & (F.col(f"{of}.distance") <= F.lit(radius) * (round_ - generation))


def message() -> Column:
    """What a covered node tells a neighbour; ordered so that the least one is the one to hear:
    newest generation, then shortest distance, then smallest root."""
    value = F.col("value")
    return F.struct((-value["generation"]).alias("older"), (value["distance"] + F.col("w")).alias("distance"), value["root"].alias("root"))


def wakes(radius: int) -> Column:
    """The round in which a node that didn't lie in reach when it was covered does: the one in which it sends."""
    return F.expr(f"value.generation + (value.distance + {radius - 1}) div {radius} - 1")


def accepts(radius: int, round_: int) -> Column:
    """Whether a node takes the message it heard (the choice among messages came first): an
    uncovered one does, a frozen one doesn't, another if it is nearer, and newer or of its own root."""
    newer = (-F.col("msg.older") > F.col("known.generation")) | (F.col("msg.root") == F.col("known.root"))
    return F.col("known").isNull() | (~frozen(radius, round_, "known") & (F.col("msg.distance") < F.col("known.distance")) & newer)


def _state(step: int, root: Column, distance: Column, generation: Column) -> Column:
    """A covered node's value; the one of the latest step is the largest."""
    return F.struct(F.lit(step).cast("long").alias("step"), root.alias("root"), distance.cast("long").alias("distance"), generation.cast("long").alias("generation"))


def clusters(
    edges: DataFrame, radius: int, base: float = 2.0, seed: int = 1234, reactivate_fringe: bool = False, log: list[tuple[str, int, int, int]] | None = None, adj: DataFrame | None = None
) -> DataFrame:
    """(id, root, distance): every node's cluster and the length of a path to its centre.

    reactivate_fringe lets covered nodes at or beyond the last round's reach send again in the next;
    without it they stay silent until they hear something better.

    log is given (counter, round, step, count) rows: Centers and Uncovered, the new centres and the
    nodes without a cluster, as step 0 of every round that makes centres; Covered and Uncovered, the
    nodes that got one and those still without, for each superstep of a round, from 1. The figures
    ride on the writes of the steps.

    adj is adjacency(edges), if there is one; it is kept.
    """
    laid, nodes, n = _laid_out(edges, adj)
    found, _ = _grown(laid, nodes, n, radius, base, seed, reactivate_fringe, log)
    if adj is None:
        discard(laid)
    return found


def _laid_out(edges: DataFrame, adj: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The edges and nodes as clusterings of any radius read them, and the number of nodes."""
    adj = adjacency(edges) if adj is None else adj
    nodes, seen = bucketed(adj.select(F.col("src").alias("id")).distinct(), ["id"], "nodes", n=F.count("*"))
    return adj, nodes, seen["n"]


def _grown(
    adj: DataFrame, nodes: DataFrame, n: int, radius: int, base: float = 2.0, seed: int = 1234, reactivate_fringe: bool = False, log: list[tuple[str, int, int, int]] | None = None
) -> tuple[DataFrame, int]:
    """clusters() over what _laid_out() made, and how often the radius kept a node from sending.

    If it never did, every node that was covered in a round lay within its reach and froze at its
    end; a larger radius then changes no step, and gives the same clusters.
    """
    if radius < 1:
        raise ValueError("a radius under 1 need not end")
    g, step, withheld = 0, 0, 0
    covered = Best(nodes.filter("false").withColumn("value", _state(0, F.col("id"), F.lit(0), F.lit(0))), ["id"], F.max, F.min)
    last = None  # what the last step changed, and so may send
    bare, log = n, [] if log is None else log  # bare: nodes without a cluster
    while n:
        centres, count = None, 0
        if bare:
            free = covered.lookup(nodes.filter(sampled(seed, g, base**g / n))).filter("known is null")
            centres, seen = materialise_with(free.select("id", _state(step, F.col("id"), F.lit(0), F.lit(g)).alias("value")), "centres", n=F.count("*"))
            count = seen["n"]
        old = [last] if last is not None else []
        if reactivate_fringe:
            old.append(covered.known().filter(F.col("value.distance") >= F.lit(radius) * (g - F.col("value.generation"))))
        senders = [x.filter(within(radius, g) & ~frozen(radius, g)) for x in old] + ([centres] if count else [])
        active, most = bool(count) or any(not x.isEmpty() for x in senders), len(old) * n + count
        if centres is not None:
            covered.add(centres, count)
        bare, inner = bare - count, 0
        if count:
            log += [("Centers", g, 0, count), ("Uncovered", g, 0, bare)]
        if not active and covered.known().filter(frozen(radius, g)).count() == n:
            break
        while active:
            step, inner = step + 1, inner + 1
            rows = senders[0]
            for x in senders[1:]:
                rows = rows.union(x)
            after = _state(step, F.col("msg.root"), F.col("msg.distance"), -F.col("msg.older"))
            last, seen = covered.step(rows, adj, message(), accepts(radius, g), after, most, senders=F.count(F.when(within(radius, g), 1)), wakes=F.min(wakes(radius)))
            senders, most = [last.filter(within(radius, g))], seen["senders"]
            active = most > 0
            withheld += seen["n"] - seen["senders"]
            last, bare = last if seen["n"] else None, bare - seen["new"]
            log += [("Covered", g, inner, seen["new"]), ("Uncovered", g, inner, bare)]
        if bare or reactivate_fringe:
            g += 1
        elif last is None:
            break
        else:  # no round before has centres or senders
            g = seen["wakes"]
    return covered.known().select("id", "value.root", "value.distance"), withheld


def grow_once(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, root, distance): every reachable node with its nearest centre (id), the smallest of several."""
    adj, seen = adjacency_with(edges, far=_far())
    found = _nearest(adj, seen["far"], centres)
    discard(adj)
    return found


def grow_sampled(edges: DataFrame, which: Column) -> DataFrame:
    """grow_once() from the nodes (id) for which `which` holds."""
    adj, seen = adjacency_with(edges, far=_far())
    nodes = materialise(adj.select(F.col("src").alias("id")).distinct(), "nodes")  # or `which` would be asked of both ends of each edge
    found = _nearest(adj, seen["far"], nodes.filter(which))
    discard(adj)
    discard(nodes)
    return found


def _far() -> Column:
    """An aggregate of the adjacency that no path is longer than."""
    return F.sum(F.col("w").cast("double"))


def _nearest(adj: DataFrame, far: float | None, centres: DataFrame) -> DataFrame:
    """grow_once() along adj.

    Distance and root travel as one number, distance times the span of the roots plus the root's place
    in it, since least numbers are found by hashing where structs have to be sorted; where that number
    might not fit a long they are a struct.
    """
    centres = once(centres, "centres")
    low, high = centres.agg(F.min("id"), F.max("id")).first()
    low, span = (0, 1) if low is None else (low, high - low + 1)
    if span * (1 + (far or 0)) < 1 << 62:
        best = Best(centres.select("id", (F.col("id") - F.lit(low)).cast("long").alias("value")), ["id"])
        best.spread(adj, F.col("value") + F.col("w") * F.lit(span))
        root, distance = (F.col("value") % F.lit(span) + F.lit(low)).cast("long"), F.expr(f"value div {span}")
    else:
        nearest = F.struct(F.lit(0).cast("long").alias("distance"), F.col("id").alias("root"))
        best = Best(centres.select("id", nearest.alias("value")), ["id"])
        best.spread(adj, F.struct((F.col("value.distance") + F.col("w")).alias("distance"), F.col("value.root").alias("root")))
        root, distance = F.col("value.root"), F.col("value.distance")
    return best.known().select("id", root.alias("root"), distance.alias("distance"))


def too_near(edges: DataFrame, cluster: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """The rows of cluster (id, root, distance) whose distance is under the true one to their own root,
    wherever the path runs; of a node that no path joins with its root, any distance is.

    A row rests on another of the same root if it is at least that one's distance and the length of a
    path between them. Distances fall from row to row until the root's own, so where all rows rest on
    another, all are right. Most rest on a neighbour (over a positive weight); paths to the others are
    searched for, from all that do. Of a root for which one is not found every row is compared with
    what a search from the root alone finds.

    adj is adjacency(edges), if there is one; it is kept.
    """
    cluster, laid = once(cluster, "cluster").select("id", "root", "distance"), adjacency(edges) if adj is None else adj
    told = along(cluster, laid, hashed=True).filter("w > 0").groupBy(F.col("dst").alias("id"), "root").agg(F.min(F.col("distance") + F.col("w")).alias("least"))
    own = (F.col("id") == F.col("root")) & (F.col("distance") >= 0)
    rests = F.coalesce(own | (F.col("least") <= F.col("distance")), F.lit(False))
    wrong, seen = materialise_with(cluster.join(told, ["id", "root"], "left").filter(~rests).select(*cluster.columns), "doubt", n=F.count("*"))
    if seen["n"]:
        doubt = wrong
        wrong, n = _unreached(laid, doubt, cluster.join(doubt, cluster.columns, "left_anti"))
        discard(doubt)
        if n:
            same = cluster["root"].eqNullSafe(F.col("of"))
            wrong, _ = _unreached(laid, cluster.join(wrong.select(F.col("root").alias("of")).distinct(), same, "left_semi"))
    if adj is None:
        discard(laid)
    return wrong


def _unreached(adj: DataFrame, rows: DataFrame, starts: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Those of rows (id, root, distance) that no path of their distance joins with their root, and their number.

    Searches from every root, and from starts (like rows) at their distances, along all edges as far
    as the root's farthest row, until all rows are reached or nothing improves.
    """
    reach = rows.groupBy("root").agg(F.max("distance").alias("reach"))
    first = rows.select(F.col("root").alias("id"), "root", F.lit(0).cast("long").alias("distance")).distinct()
    first = (first if starts is None else first.union(starts)).join(reach, "root").filter("distance <= reach or id = root")
    best = Best(first.groupBy("id", "root", "reach").agg(F.min("distance").alias("value")), ["id", "root", "reach"])
    further = F.col("value") + F.col("w")
    left, frontier, most = rows.join(reach, "root", "left"), best.base, best.rows
    while True:
        reached = F.coalesce(F.col("known") <= F.col("distance"), F.lit(False))
        now, still = materialise_with(best.lookup(left).filter(~reached).select("id", "root", "distance", "reach"), "unreached", n=F.count("*"))
        discard(left)
        left = now
        if not still["n"] or not most:
            return left.drop("reach"), still["n"]
        frontier, seen = best.step(frontier, adj, F.when(further <= F.col("reach"), further), most=most)
        most = seen["n"]


def quotient(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(u, v, w): the graph of clusters; w is the shortest root-to-root path over one edge."""
    apart = F.when(F.col("a.root") != F.col("b.root"), F.struct(F.least("a.root", "b.root").alias("u"), F.greatest("a.root", "b.root").alias("v"), (F.col("w") + F.col("a.distance") + F.col("b.distance")).alias("w")))
    return triplets(cluster.select("id", "root", "distance"), edges, apart).select("out.*").groupBy("u", "v").agg(F.min("w").alias("w"))


def radii(cluster: DataFrame) -> DataFrame:
    """(root, radius) of each cluster."""
    return cluster.groupBy("root").agg(F.max("distance").alias("radius"))


def estimate(edges: DataFrame, cluster: DataFrame, exact_quotient: bool = False) -> DataFrame:
    """(diameter, max_radius, n_clusters).

    One cluster: twice its radius. Else the largest, over components of the graph of clusters, of a
    double sweep and the radii at its two ends, and no less than the largest radius. A component of
    one cluster counts with its radius alone. A double sweep is a lower bound on the diameter of the
    graph of clusters; exact_quotient takes the longest distance between two clusters with their radii
    itself (longest_between()) and twice the largest radius, and is then no less than the true diameter.
    """
    edges, spread = once(edges), materialise(radii(cluster), "radii")
    whole = spread.agg(F.coalesce(F.max("radius"), F.lit(0)).alias("max_radius"), F.count("*").alias("n_clusters"))
    edges_between = materialise(quotient(edges, cluster), "quotient")
    sweeps = longest_between(edges_between, spread.select(F.col("root").alias("id"), F.col("radius").alias("add"))) if exact_quotient else double_sweep(edges_between)
    a, b = spread.select(F.col("root").alias("start"), F.col("radius").alias("ra")), spread.select(F.col("root").alias("far"), F.col("radius").alias("rb"))
    longest = sweeps.join(a, "start").join(b, "far").agg(F.coalesce(F.max(F.col("sweep") + F.col("ra") + F.col("rb")), F.lit(0)).alias("through"))
    one = F.col("n_clusters") == 1
    least = 2 * F.col("max_radius") if exact_quotient else F.col("max_radius")
    diameter = F.when(one, 2 * F.col("max_radius")).otherwise(F.greatest(least, "through"))
    return whole.join(F.broadcast(longest)).select(diameter.alias("diameter"), "max_radius", "n_clusters")  # one row each


def rand_cluster(
    edges: DataFrame, radius: int, base: float = 2.0, seed: int = 1234, reactivate_fringe: bool = False, exact_quotient: bool = False
) -> DataFrame:
    """(diameter, max_radius, n_clusters) through clusters of the given radius."""
    edges = once(edges)
    return estimate(edges, materialise(clusters(edges, radius, base, seed, reactivate_fringe), "cluster"), exact_quotient)


def guess_clusters(
    edges: DataFrame, memory: int, init: int, step: int, seed: int = 1234, log: list[tuple[str, int, int, int]] | None = None
) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """The clusters of the first radius init * step**k that leaves at most `memory` centres, and what was tried.

    There need not be one: a graph of more than `memory` components has more centres at any radius.
    The search then ends with the first radius that kept no node from sending, since all larger ones
    give the same clusters; the last row of what was tried tells that they don't fit.

    What was tried are (iteration, radius, milliseconds, centres) rows. The base is 2. log has the
    counters of the clustering that was taken, as clusters() tells them.
    """
    if step < 2:
        raise ValueError("a step under 2 need not end")
    adj, nodes, n = _laid_out(edges)
    radius, tried = init, []
    while True:
        began, counted = time.monotonic(), []
        grown, withheld = _grown(adj, nodes, n, radius, 2.0, seed, log=counted)
        found, seen = materialise_with(grown, "cluster", centres=F.count(F.when(F.col("id") == F.col("root"), 1)))
        centres = seen["centres"]
        tried.append((len(tried), radius, round(1000 * (time.monotonic() - began)), centres))
        if centres <= memory or not withheld:
            if log is not None:
                log += counted
            discard(adj)
            discard(nodes)
            return found, tried
        discard(found)
        radius *= step


GUESSES = "iteration long, iteration_radius long, duration_ms long, num_centers long"


def rand_cluster_guess(edges: DataFrame, memory: int, init: int, step: int, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """The estimate through guess_clusters(), and the radii tried as a table of GUESSES."""
    edges = once(edges)
    found, tried = guess_clusters(edges, memory, init, step, seed)
    return estimate(edges, found), edges.sparkSession.createDataFrame(tried, GUESSES)
