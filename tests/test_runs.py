"""Deadlines, the run store, recorded runs and the counters of nested loops."""

import datetime
import threading
import time

import pytest
from graphs_for_tests import MICRO, frame
from pyspark.sql import functions as F

from graphspan.operators import cluster, experiment, results, traversal
from graphspan.operators.deadline import DeadlineExceeded, run_within
from graphspan.operators.run_store import RunStore, schema
from graphspan.session import materialise, scratch, shared_dir
from graphspan.sources import graphs

WHEN = datetime.datetime(2024, 5, 1, 12)


def _slow(spark, seconds):
    """A job of eight tasks that sleep."""
    spark.range(8).repartition(8).rdd.foreach(lambda _: time.sleep(seconds))


def test_work_in_time(spark):
    value, seconds = run_within(spark, lambda: spark.range(10).count(), 60)
    assert value == 10 and 0 < seconds < 60
    assert run_within(spark, lambda: 3)[0] == 3


def test_a_deadline_of_nothing_starts_nothing(spark):
    ran = []
    with pytest.raises(DeadlineExceeded):
        run_within(spark, lambda: ran.append(1), 0)
    assert not ran


def test_jobs_are_cancelled_and_scratch_is_cleared(spark):
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file://"))

    def work():
        for _ in range(100):
            materialise(spark.range(10), "deadline-test")
            _slow(spark, 1)

    began = time.monotonic()
    with pytest.raises(DeadlineExceeded) as late:
        run_within(spark, work, 2.5)
    assert 2.5 <= late.value.elapsed <= time.monotonic() - began < 20
    assert not list(folder.glob("graphspan-deadline-test-*"))
    assert spark.range(5).count() == 5  # the session goes on, and its jobs carry no tag any more


def test_a_write_that_is_cancelled_leaves_nothing(spark):
    from pathlib import Path

    folder = Path(shared_dir(spark).removeprefix("file://"))
    sleeping = F.udf(lambda x: time.sleep(1) or x, "long")
    with pytest.raises(DeadlineExceeded):
        run_within(spark, lambda: materialise(spark.range(0, 400, 1, 8).select(sleeping("id").alias("id")), "cancelled-test"), 2)
    time.sleep(1)
    assert not list(folder.glob("graphspan-cancelled-test-*"))


def test_other_threads_go_on(spark):
    done = []
    other = threading.Thread(target=lambda: done.append(_slow(spark, 0.5)))
    other.start()
    with pytest.raises(DeadlineExceeded):
        run_within(spark, lambda: _slow(spark, 30), 1)
    other.join()
    assert done == [None]


def test_errors_of_the_work_are_its_own(spark):
    with pytest.raises(ZeroDivisionError):
        run_within(spark, lambda: 1 // 0, 60)


def _main(spark, *shas, **values):
    row = {"date": WHEN, "seed": 1, "threads": 8, "hosts": "", "dataset": "USA", "algorithm": "Bfs", "parameters": "", "diameter": 5, "total_time_ms": 10, "offline": True, "final_diameter_time_ms": 4, "killed": True} | values
    return spark.createDataFrame([(sha, *row.values()) for sha in shas], schema("main"))


def test_store_of_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.commits().count() == 0 and store.table("main").count() == 0 and store.table("counters").count() == 0


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    counters = spark.createDataFrame([("a", "Centers", 0, 0, 7), ("a", "Uncovered", 0, 1, 3)], schema("counters"))
    staged = store.stage(_main(spark, "a"), counters=counters)
    assert store.table("main").count() == 0 and store.table("counters").count() == 0
    assert store.abandoned(datetime.datetime.now() + datetime.timedelta(hours=1)) == [staged.split("-")[0]]
    assert store.abandoned(WHEN) == []
    store.publish(staged)
    assert [r["sha"] for r in store.table("main").collect()] == ["a"] and store.table("counters").count() == 2
    assert store.abandoned(datetime.datetime.now() + datetime.timedelta(hours=1)) == []
    store.append(_main(spark, "b", "c"))
    assert sorted(r["sha"] for r in store.table("main").collect()) == ["a", "b", "c"] and store.commits().count() == 2
    store.drop(staged.split("-")[0])
    assert sorted(r["sha"] for r in store.table("main").collect()) == ["b", "c"] and store.table("counters").count() == 0


def test_a_writer_that_stops_between_two_tables(spark, tmp_path):
    """The second table can't be written: nothing of the first is seen or stays, and the commit can be made again."""
    store = RunStore(spark, str(tmp_path))
    broken = spark.createDataFrame([("a", "x", 0, 0, "no number")], "sha string, counter string, outer_iter int, inner_iter int, count string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.append(_main(spark, "a"), counters=broken)
    assert store.table("main").count() == 0 and not list(tmp_path.glob("main/commit=*"))
    # one that dies without cleaning up leaves rows that no reader sees
    _main(spark, "a").write.parquet(str(tmp_path / "main" / "commit=dead"))
    (tmp_path / "commits").mkdir(exist_ok=True)
    (tmp_path / "commits" / ".dead").write_text('{"commit": "dead", "vers')
    assert store.table("main").count() == 0
    store.append(_main(spark, "a"), counters=broken.withColumn("count", F.lit(4)))
    assert store.table("main").count() == 1 and store.table("counters").first()["count"] == 4


@pytest.mark.parametrize("version, offline, final, killed", [(1, False, None, False), (2, True, None, False), (4, True, 4, False), (6, True, 4, True)])
def test_rows_of_older_versions(spark, tmp_path, version, offline, final, killed):
    store = RunStore(spark, str(tmp_path))
    store.append(_main(spark, "a"), version)
    store.append(_main(spark, "b"))
    row = store.table("main").filter("sha = 'a'").first()
    assert (row["offline"], row["final_diameter_time_ms"], row["killed"], row["version"], row["diameter"]) == (offline, final, killed, version, 5)
    guesses = spark.createDataFrame([("a", 0, 29, 100, 12)], schema("rand_cluster_iterations"))
    if version < 5:
        with pytest.raises(ValueError):
            store.append(_main(spark, "c"), version, rand_cluster_iterations=guesses)
        assert store.table("main").count() == 2
    else:
        store.append(_main(spark, "c"), version, rand_cluster_iterations=guesses)
        assert store.table("rand_cluster_iterations").first()["num_centers"] == 12


SPECS = {"sequential": 12, "sequential-single": 12, "delta-stepping(3)": 12, "hyperball(6)": None, "rand-cluster(4,2)": None}


@pytest.mark.parametrize("text", sorted(SPECS))
def test_every_algorithm_from_its_specification(spark, text):
    edges = frame(spark, MICRO["heavy_light"][0])
    out = experiment.measure(edges, results.parse_spec(text))
    assert not out.killed and out.total_ms > 0 and out.diameter == (SPECS[text] if SPECS[text] is not None else out.diameter)
    clustered = text.startswith("rand")
    assert (out.final_ms is not None) == clustered and bool(out.counters) == (clustered or text.startswith("delta"))
    if clustered:
        assert out.diameter >= 6 and out.final_ms <= out.total_ms


def test_runs_by_name_are_recorded_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    first = experiment.run_named(spark, store, "rand-cluster-guess(4, 2, 6)", "mesh-10", threads=2)
    assert experiment.run_named(spark, store, "rand-cluster-guess(4,2,6)", "mesh-10", threads=2) == first
    stopped = experiment.run_named(spark, store, "bfs", "mesh-10", deadline=0)
    assert experiment.run_named(spark, store, "bfs", "mesh-10") == stopped
    again = experiment.run_named(spark, store, "bfs", "mesh-10", again=True)
    main = {r["sha"]: r for r in store.table("main").collect()}
    assert set(main) == {first, stopped, again}
    assert (main[stopped]["diameter"], main[stopped]["killed"], main[again]["diameter"], main[again]["killed"]) == (-1, True, 18, False)
    assert main[first]["parameters"] == "4:2,6" and main[first]["final_diameter_time_ms"] is not None
    tried = store.table("rand_cluster_iterations").orderBy("iteration").collect()
    assert [r["iteration_radius"] for r in tried] == [2 * 6**i for i in range(len(tried))] and all(r["duration_ms"] > 0 and r["sha"] == first for r in tried)
    assert tried[-1]["num_centers"] <= 4 < min([r["num_centers"] for r in tried[:-1]], default=5)
    counted = store.table("counters").filter("counter = 'Uncovered'").orderBy(F.desc("outer_iter"), F.desc("inner_iter")).first()
    assert counted["count"] == 0
    with pytest.raises(KeyError):
        experiment.run_named(spark, store, "bfs", "no-such-graph")


def test_counters_of_a_clustering(spark):
    edges = graphs.mesh(spark, 7)
    log = []
    found = cluster.clusters(edges, 3, seed=5, log=log).collect()
    roots = {r["root"] for r in found}
    assert sum(n for c, _, _, n in log if c == "Centers") == len(roots)
    assert sum(n for c, _, _, n in log if c in ("Centers", "Covered")) == 49
    bare = 49
    for (counter, outer, inner, n), (other, o, i, left) in zip(log[::2], log[1::2]):
        assert other == "Uncovered" and (outer, inner) == (o, i) and (counter == "Centers") == (inner == 0)
        bare -= n
        assert left == bare
    assert bare == 0 and [x[1] for x in log] == sorted(x[1] for x in log)


@pytest.mark.parametrize("delta", [5, 1000])
def test_delta_stepping_and_its_counters(spark, delta):
    """Against the same walk told plainly."""
    import random

    rng = random.Random(delta)
    raw = {(a, b): rng.randint(0, 9) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(40)) if a < b}
    edges = [(a, b, w) for (a, b), w in raw.items()] + [(100, 101, 1)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    root = min(near)
    known, want, upto = {root: 0}, [], 0

    def relax(senders, kind):
        mail = {}
        for a in senders:
            for b, w in near[a]:
                if (w <= delta) == (kind == "Updated"):
                    mail[b] = min(mail.get(b, 10**9), known[a] + w)
        better = {b: d for b, d in mail.items() if d < known.get(b, 10**9)}
        known.update(better)
        return better

    heavy = any(w > delta for *_, w in edges)
    while left := [d for d in known.values() if d >= upto]:
        bucket = min(left) // delta
        upto, steps = delta * (bucket + 1), 0
        frontier = {a for a, d in known.items() if delta * bucket <= d < upto}
        settled = set(frontier)
        while frontier:
            steps += 1
            better = relax(frontier, "Updated")
            want.append(("Updated", bucket, steps, len(better)))
            frontier = {b for b, d in better.items() if d < upto}
            settled |= frontier
        if heavy:
            want.append(("Heavy", bucket, steps + 1, len(relax(settled, "Heavy"))))
    log = []
    got = {r["id"]: r["distance"] for r in traversal.delta_stepping(frame(spark, edges), delta, root, log).collect()}
    assert got == known and log == want
