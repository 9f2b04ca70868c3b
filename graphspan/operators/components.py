"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from graphspan.operators.skew import may_crowd, split_hot
from graphspan.session import discard, materialise, materialise_with

_HUB = 1_000_000  # edges of one node that a task may well hold


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _met(both.filter("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _met(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows joined with least on u; a hub's edges stay where they are, and its one answer goes to them."""
    if total < _HUB or not may_crowd(rows, "u", total, _HUB):
        return rows.join(least, "u")
    hot, cold = split_hot(rows, least, "u", "n", total, _HUB)
    return hot.union(cold)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _met(down, least, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


_HELD = 200_000  # edges that a task connects at once


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges a-b."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while ((further := label[label]) != label).any():
            label = further


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every _HELD edges or so, each node with the smallest one that they connect it with."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[_least(at[: len(u)], at[len(u) :], len(ids))])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= _HELD:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def _starred(edges: DataFrame) -> DataFrame:
    """(u, v) links that connect what edges (u, v) do, and each of their nodes with itself or a smaller one.

    Where neighbours lie close in the table, as after a grouping, little is left to connect; there
    are never more links than ends of edges.
    """
    whole = edges.select(F.coalesce("u", "v").alias("u"), F.coalesce("v", "u").alias("v")).filter("u is not null")
    if any(f.dataType != T.LongType() for f in whole.schema):
        return whole.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(whole.select(F.least("u", "v"), F.least("u", "v")))
    return whole.mapInArrow(_stars, "u long, v long")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """(id, component) of every id that an edge touches; component is the smallest id reachable.

    Self loops, repeated edges and either direction are allowed; null ends are ignored.
    Tasks first connect what lies together in them; the links that are left go into the rounds.
    Each round rewires every edge to a smaller end (a few joins and partial aggregates), so the
    number of rounds grows with the logarithm of the graph, not with its diameter. The edges of a
    round are written to the shared folder before the next one reads them. No hub's edges meet in
    one task: 10,000 nodes at most, those with most edges, have their answer broadcast instead.
    """
    stars = materialise(_starred(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))).distinct(), "stars")
    nodes = stars.select(F.col("u").alias("id")).distinct()
    start = stars.filter("u <> v")
    mark = {"n": F.count("*"), "s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, seen = materialise_with(start, "cc", **mark)
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        before = seen
        nxt, seen = materialise_with(_small_star(_large_star(now, seen["n"]), seen["n"]).distinct(), "cc", **mark)
        discard(now)
        now = nxt
        if seen == before:
            break
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
