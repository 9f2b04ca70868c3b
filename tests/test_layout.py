"""How edges and ids are laid out: hubs in parts, ranges of ids, and what a step moves."""

import random

import pytest
from graphs_for_tests import frame
from pyspark.sql import functions as F

from graphspan.operators import cluster, superstep, transforms, traversal
from graphspan.operators.adjacency import adjacency, adjacency_with, along
from graphspan.operators.fixpoint import Best
from graphspan.sources import graphs


def _sizes(table):
    return [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]


def test_a_star_of_a_million_edges_fills_no_bucket(spark):
    n = 1_000_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"), F.lit(1).cast("long").alias("w"))
    adj = adjacency(star)
    sizes = _sizes(adj)
    assert sum(sizes) == 2 * n and len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    start = spark.createDataFrame([(0, 0), (5, 0)], "id long, value long")
    assert along(start, adj).groupBy("id").count().orderBy("id").collect() == [(0, n), (5, 1)]
    assert along(start, adj).columns == ["id", "value", "src", "dst", "w"]


def _hubs(seed=1):
    """Two hubs and a random rest."""
    rng = random.Random(seed)
    edges = {(0, i): rng.randint(1, 9) for i in range(1, 120)} | {(1, i): rng.randint(1, 9) for i in range(60, 160)}
    edges |= {tuple(sorted(rng.sample(range(2, 220), 2))): rng.randint(1, 9) for _ in range(150)}
    return [(u, v, w) for (u, v), w in sorted(edges.items())]


def test_hubs_give_the_same_distances(spark, monkeypatch):
    edges = frame(spark, _hubs())
    want = sorted(map(tuple, traversal.sssp(edges).collect()))
    split = lambda e, **measures: adjacency_with(e, 10, **measures)
    monkeypatch.setattr(traversal, "adjacency", lambda e: split(e)[0])
    monkeypatch.setattr(traversal, "adjacency_with", split)
    assert len(adjacency(edges, 10)._graphspan_hubs.collect()) >= 2
    assert sorted(map(tuple, traversal.sssp(edges).collect())) == want
    assert sorted(map(tuple, traversal.delta_stepping(edges, 8).collect())) == want


def test_send_along_split_hubs(spark):
    edges = frame(spark, _hubs())
    nodes = transforms.degrees(edges)
    step = dict(should_send=F.col("degree") > 3, message=F.col("degree") * F.col("w"), aggregate=F.max, update={"degree": F.col("msg")}, update_no_msg={"degree": F.lit(0)}, with_default=True)
    plain = superstep.send(nodes, transforms.symmetric(edges), **step)
    assert sorted(superstep.send(nodes, adjacency(edges, 10), **step).collect()) == sorted(plain.collect())


def test_a_step_over_hubs_leaves_the_edges_where_they_lie(spark):
    adj = adjacency(frame(spark, _hubs()), 10)
    assert adj._graphspan_hubs is not None
    best = Best(spark.createDataFrame([(0, 0)], "id long, value long"), ["id"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mail = along(best.base, adj).select(F.col("dst").alias("id"), "w")
        plan = mail._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1  # the senders, by (id, part)


@pytest.mark.parametrize("spread", ["hashed", "close", "few"])
def test_dense_ids_of_any_ids(spark, spread):
    n = {"hashed": 200_000, "close": 50_000, "few": 3}[spread]
    ids = spark.range(n).select((F.xxhash64("id") if spread == "hashed" else F.col("id") + 7).alias("u"))
    edges = ids.select("u", (F.col("u") + (0 if spread == "hashed" else 1)).alias("v"), F.lit(1).cast("long").alias("w"))
    got = transforms.dense_ids(edges)
    nodes = n if spread == "hashed" else n + 1
    assert got.agg(F.count("*"), F.countDistinct("dense"), F.min("dense"), F.max("dense")).first() == (nodes, nodes, 0, nodes - 1)
    rows = got.orderBy("id").collect() if spread != "hashed" else got.orderBy("id").limit(1000).collect()
    assert [r["dense"] for r in rows] == list(range(len(rows)))
    if spread == "hashed":
        top = got.orderBy(F.desc("id")).limit(1000).collect()
        assert [r["dense"] for r in top] == list(range(n - 1, n - 1001, -1))
        sizes = [r["count"] for r in transforms.id_ranges(edges).groupBy("part").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * n / 8


def test_dense_ids_of_no_edges(spark):
    assert transforms.dense_ids(frame(spark, [(1, 2, 3)]).filter("false")).count() == 0


def test_a_step_of_few_senders_combines_messages_where_edges_lie(spark, monkeypatch):
    """Without broadcasts by size: of an edge's two ends the receiver's is read, so no message is shuffled."""
    from graphspan.operators import fixpoint

    plans, write = [], fixpoint.materialise_with

    def noted(df, *args, **measures):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **measures)

    monkeypatch.setattr(fixpoint, "materialise_with", noted)
    adj = adjacency(graphs.mesh(spark, 8))
    best = fixpoint.Best(spark.createDataFrame([(0, 0)], "id long, value long"), ["id"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh, seen = best.step(best.base, adj, F.col("value") + F.col("w"), most=1)
        _, more = best.step(fresh, adj, F.col("value") + F.col("w"), most=best.told + 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen["n"] == 2 and more["n"] == 3
    assert plans[0].count("Exchange hashpartitioning") == 0 and "BroadcastHashJoin" in plans[0]
    # a large frontier: senders, messages and earlier changes move, and edges are not sorted
    assert "ShuffledHashJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]


def test_large_frontiers_give_the_same_distances(spark, monkeypatch):
    from graphspan.operators import fixpoint

    edges = frame(spark, _hubs())
    centres = spark.createDataFrame([(3,), (70,), (150,)], "id long")
    each = [lambda: traversal.sssp(edges), lambda: traversal.delta_stepping(edges, 4), lambda: cluster.grow_once(edges, centres), lambda: cluster.clusters(edges, 3)]
    told = [sorted(map(tuple, f().collect())) for f in each]
    monkeypatch.setattr(fixpoint, "_TOLD", 0)
    assert [sorted(map(tuple, f().collect())) for f in each] == told


@pytest.mark.parametrize("shift, weight", [(0, 1), (-(10**6), 1), (0, 10**17)])
def test_nearest_centres_as_numbers_and_as_structs(spark, shift, weight):
    """The smallest of several nearest centres, whether distance and root fit one number or not."""
    edges = [(u + shift, v + shift, w * weight) for u, v, w in _hubs(5)]
    roots = [40 + shift, 3 + shift, 150 + shift]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    cluster_of = {r: (0, r) for r in roots}
    todo = list(roots)
    while todo:
        a = todo.pop()
        for b, w in near[a]:
            told = (cluster_of[a][0] + w, cluster_of[a][1])
            if b not in cluster_of or told < cluster_of[b]:
                cluster_of[b] = told
                todo.append(b)

    found = {r["id"]: (r["distance"], r["root"]) for r in cluster.grow_once(frame(spark, edges), spark.createDataFrame([(r,) for r in roots], "id long")).collect()}
    assert found == cluster_of


def test_a_bucket_whose_rows_were_all_improved_is_passed_over(spark):
    """Node 3 waits at 30, beyond the bucket, and is improved to 14 before its bucket comes."""
    log = []
    edges = [(0, 1, 4), (0, 3, 30), (1, 2, 5), (2, 3, 5)]
    found = traversal.delta_stepping(frame(spark, edges), 10, 0, log)
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 4), (2, 9), (3, 14)]
    assert sorted({bucket for _, bucket, _, _ in log}) == [0, 1]
