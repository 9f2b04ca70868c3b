"""Neighbourhood growth in registers: rounds until no register changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphspan.functions.bits import hash32, register_index, rho
from graphspan.operators.adjacency import adjacency, along
from graphspan.operators.fixpoint import Best
from graphspan.operators.transforms import node_ids
from graphspan.session import discard, once


def registers(edges: DataFrame, p: int) -> DataFrame:
    """(id, reg, rho): each node's own entry; registers that hold zero have no row."""
    if not 4 <= p <= 16:
        raise ValueError("p is from 4 to 16")
    h = hash32("id")
    return node_ids(edges).select("id", register_index(h, p).alias("reg"), rho(F.shiftright(h, p)).alias("rho")).filter("rho > 0")


def merge_step(now: DataFrame, adj: DataFrame) -> DataFrame:
    """Every node's registers after it has heard all its neighbours': the pointwise maximum."""
    heard = along(now, adj).select(F.col("dst").alias("id"), "reg", "rho")
    return now.union(heard).groupBy("id", "reg").agg(F.max("rho").alias("rho"))


WIDTH = 16  # registers of a row


def words(edges: DataFrame, p: int) -> DataFrame:
    """(id, word, r0..r15): the registers of a node, sixteen a row; rows of zeros are left out."""
    rows = registers(edges, p).withColumns({"word": F.shiftright("reg", WIDTH.bit_length() - 1), "at": F.col("reg") % WIDTH})
    own = [F.coalesce(F.max(F.when(F.col("at") == i, F.col("rho"))), F.lit(0)).cast("tinyint").alias(f"r{i}") for i in range(WIDTH)]
    return rows.groupBy("id", "word").agg(*own)


def hyperball(edges: DataFrame, p: int) -> DataFrame:
    """(iterations): the round, from zero, in which no register changed; at most the hop diameter.

    Registers travel sixteen a row, their pointwise maxima are sixteen aggregates of one pass, and
    only rows in which a register changed are sent on: a neighbour has heard the others before. With
    p = 4 a node is one row.
    """
    edges = once(edges)
    adj = adjacency(edges)
    best = Best(words(edges, p), ["id", "word"], F.max, values=tuple(f"r{i}" for i in range(WIDTH)))
    frontier, changed, rounds = best.base, best.rows, 0
    while True:
        frontier, changed = best.step_each(frontier, adj, changed)
        if not changed:
            break
        rounds += 1
    discard(adj)
    return edges.sparkSession.createDataFrame([(rounds,)], "iterations long")
