"""From a graph and an algorithm's specification to a recorded run."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphspan.operators import cluster, hyperball, results, traversal
from graphspan.operators.deadline import DeadlineExceeded, run_within
from graphspan.operators.results import Spec
from graphspan.operators.run_store import RunStore, schema
from graphspan.session import materialise
from graphspan.sources import catalog

SEED, TIMEOUT = 1234, 3600.0


@dataclass
class Outcome:
    """What a run found: a diameter or a bound on it (-1 if it was stopped), times, counters and guesses.

    counters holds (counter, outer_iter, inner_iter, count), guesses (iteration, radius, milliseconds,
    centres); final_ms is the time of a clustering's estimate alone.
    """

    diameter: int = -1
    total_ms: int = 0
    final_ms: int | None = None
    killed: bool = False
    counters: list[tuple[str, int, int, int]] = field(default_factory=list)
    guesses: list[tuple[int, int, int, int]] = field(default_factory=list)


def _found(edges: DataFrame, spec: Spec, seed: int, root: int | None, out: Outcome) -> int:
    kind, numbers = spec.algorithm, spec.numbers
    if kind == "Sequential":
        return traversal.sequential(edges).first()[0]
    if kind == "SequentialSingle":
        return traversal.single_pass(edges).first()[0]
    if kind == "Bfs":
        return traversal.eccentricity(traversal.bfs(edges, root)).first()["ecc"]
    if kind == "DeltaStepping":
        return traversal.eccentricity(traversal.delta_stepping(edges, numbers[0], root, out.counters)).first()["ecc"]
    if kind == "HyperBall":
        return hyperball.hyperball(edges, numbers[0]).first()[0]
    if kind == "RandCluster":
        found = materialise(cluster.clusters(edges, numbers[0], float(numbers[1]), seed, log=out.counters), "cluster")
    else:
        found, out.guesses = cluster.guess_clusters(edges, *numbers, seed, out.counters)
    began = time.monotonic()
    diameter = cluster.estimate(edges, found).first()["diameter"]
    out.final_ms = round(1000 * (time.monotonic() - began))
    return diameter


def measure(edges: DataFrame, spec: Spec, seed: int = SEED, root: int | None = None, deadline: float | None = TIMEOUT) -> Outcome:
    """Run an algorithm on edges, for `deadline` seconds at most; it is stopped then, and what it had counted is dropped."""
    out = Outcome()
    try:
        out.diameter, seconds = run_within(edges.sparkSession, lambda: _found(edges, spec, seed, root, out), deadline)
    except DeadlineExceeded as late:
        return Outcome(killed=True, total_ms=round(1000 * late.elapsed))
    out.total_ms = round(1000 * seconds)
    return out


def record(
    store: RunStore, spec: Spec, dataset: str, out: Outcome, seed: int = SEED, threads: int = 1, hosts: str = "", offline: bool = False,
    date: datetime.datetime | None = None,
) -> str:
    """Add a run to the store, its counters and guesses with it, and return its id."""
    spark, date = store.spark, date or datetime.datetime.now()
    sha = results.run_id(date.isoformat(), seed, threads, hosts, dataset, spec.algorithm, spec.parameters, offline)
    row = (sha, date, seed, threads, hosts, dataset, spec.algorithm, spec.parameters, out.diameter, out.total_ms, offline, out.final_ms, out.killed)
    others = {}
    if out.counters:
        others["counters"] = spark.createDataFrame([(sha, *x) for x in out.counters], schema("counters"))
    if out.guesses:
        others["rand_cluster_iterations"] = spark.createDataFrame([(sha, *x) for x in out.guesses], schema("rand_cluster_iterations"))
    store.append(spark.createDataFrame([row], schema("main")), **others)
    return sha


def run_named(
    spark: SparkSession, store: RunStore, spec: str, dataset: str, folder: str = ".", seed: int = SEED, threads: int = 1, hosts: str = "", offline: bool = False,
    deadline: float | None = TIMEOUT, again: bool = False,
) -> str:
    """Run what `spec` says on a graph of the catalog and record it; the run's id.

    If the store has a run with the same settings, that one's id is returned and nothing runs, unless
    again is set. A run that was stopped counts as run: it would be stopped again.
    """
    what = results.parse_spec(spec)
    keys = {"seed": seed, "threads": threads, "hosts": hosts, "dataset": dataset, "algorithm": what.algorithm, "parameters": what.parameters, "offline": offline}
    if not again and (had := results.already_run(store.table("main"), **keys).first()):
        return had["sha"]
    edges = materialise(catalog.resolve(spark, dataset, folder), "graph")
    return record(store, what, dataset, measure(edges, what, seed, None, deadline), seed, threads, hosts, offline)
