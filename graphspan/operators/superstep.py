"""Vertex-centric supersteps: messages along edges, triplets, and the loop's barrier.

What a program does at a node is given as columns, so that Catalyst compiles it; a step is one join
of the senders with their edges, one partial and one final aggregate, and one join with the states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphspan.operators.adjacency import along
from graphspan.session import bucketed, discard


def send(
    nodes: DataFrame, adj: DataFrame, *, should_send: Column, message: Column, aggregate: Callable[[Column], Column],
    update: dict[str, Column], update_no_msg: dict[str, Column] | None = None, with_default: bool = False,
) -> DataFrame:
    """One superstep over nodes (id and state columns) and adj (src, dst, w).

    message sees the sender's state and w; null messages are not sent. update sees the receiver's
    state and `msg`, the aggregate of what it got; columns it doesn't name stay. update_no_msg is
    for nodes without messages. with_default also makes nodes of receivers that nodes lacks (their
    state columns are null before update); otherwise such messages are lost.
    """
    state = [c for c in nodes.columns if c != "id"]
    mail = (
        along(nodes.filter(should_send), adj)
        .select(F.col("dst").alias("id"), message.alias("msg"))
        .filter("msg is not null")
        .groupBy("id")
        .agg(aggregate(F.col("msg")).alias("msg"))
    )
    met = nodes.join(mail, "id", "full_outer" if with_default else "left")
    idle = update_no_msg or {}
    got = F.col("msg").isNotNull()
    return met.select("id", *[F.when(got, update.get(c, F.col(c))).otherwise(idle.get(c, F.col(c))).alias(c) for c in state])


def triplets(nodes: DataFrame, edges: DataFrame, action: Column) -> DataFrame:
    """(u, v, out): action over w and both ends' states, as structs `a` (of u) and `b` (of v); nulls go.

    A hub's edges are split among tasks by Spark's adaptive skew join, as both sides of each join are
    dealt for it alone.
    """
    state = F.struct(*[c for c in nodes.columns if c != "id"])
    a = nodes.select(F.col("id").alias("u"), state.alias("a"))
    b = nodes.select(F.col("id").alias("v"), state.alias("b"))
    return edges.join(a, "u").join(b, "v").select("u", "v", action.alias("out")).filter("out is not null")


def branch_all(rows: DataFrame, condition: Column, threshold: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(stable, further, matches): all rows go on if more than threshold match, else none does."""
    matches = rows.agg(F.count(F.when(condition, 1))).first()[0]
    nothing = rows.filter(F.lit(False))
    return (nothing, rows, matches) if matches > threshold else (rows, nothing, matches)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], active: Column, name: str, max_steps: int = 1_000_000, log: list[dict] | None = None) -> tuple[DataFrame, int]:
    """Apply step until no row is active; the state is written after each, in buckets of its ids.

    Returns the last state and the number of steps. RuntimeError if rows are still active after
    max_steps. log is given a row for each step: step, active (rows that go on) and rows.
    """
    measures = {"active": F.count(F.when(active, 1)), "rows": F.count("*")}
    now, seen = bucketed(state, ["id"], name, **measures)
    steps = 0
    while seen["active"]:
        if steps >= max_steps:
            raise RuntimeError(f"{seen['active']} rows are active after {steps} steps")
        new, seen = bucketed(step(now, steps), ["id"], name, **measures)
        steps += 1
        if log is not None:
            log.append({"step": steps, **seen})
        discard(now)
        now = new
    return now, steps


def log_table(spark: SparkSession, log: list[dict]) -> DataFrame:
    """(step, active, rows) of iterate()'s log: how each superstep left the state."""
    return spark.createDataFrame([(x["step"], x["active"], x["rows"]) for x in log], "step long, active long, rows long")
