import pytest
from graphs_for_tests import MICRO, TWO_TRIANGLES, frame
from pyspark.sql import functions as F

from graphspan.functions import bits
from graphspan.operators import cluster, hyperball, superstep, transforms, traversal
from graphspan.operators.components import connected_components
from graphspan.sources import graphs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", MICRO)
def test_distances_of_micro_graphs(spark, name):
    edges, hops, weighted, sweep = MICRO[name]
    g = frame(spark, edges)
    assert traversal.eccentricity(traversal.bfs(g)).first()["ecc"] == hops
    assert traversal.eccentricity(traversal.sssp(g)).first()[0:3] == (weighted, weighted, 2 * weighted)
    assert traversal.sequential(g).first()["diameter"] == sweep


@pytest.mark.parametrize("delta", [1, 3, 1_000_000])
def test_delta_stepping_is_sssp_for_every_delta(spark, delta):
    g = frame(spark, MICRO["heavy_light"][0])
    assert rows(traversal.delta_stepping(g, delta)) == rows(traversal.sssp(g))


def test_disconnected_graphs(spark):
    g = frame(spark, TWO_TRIANGLES)
    assert rows(connected_components(g)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 3)]
    assert len(rows(traversal.bfs(g))) == 3
    assert {r[0] for r in rows(transforms.largest_component(g))} == {3, 4, 5}
    assert rows(traversal.double_sweep(g).select("component", "sweep")) == [(0, 1), (3, 6)]


def test_empty_graph(spark):
    g = frame(spark, [])
    assert rows(connected_components(g)) == []
    assert rows(traversal.sssp(g)) == []
    assert traversal.sequential(g).first()["diameter"] == 0
    assert rows(transforms.metadata(g)) == [(None, 0, None, None)]
    assert rows(transforms.largest_component(g)) == []


def test_root_without_edges_reaches_nothing(spark):
    assert rows(traversal.bfs(frame(spark, MICRO["path5"][0]), 77)) == []


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1, 500).select(F.lit(1000).cast("long").alias("u"), (F.col("id") + 1000).alias("v"))
    found = connected_components(path.union(star).union(star))
    assert {r["component"]: r["count"] for r in found.groupBy("component").count().collect()} == {0: 301, 1000: 500}


def test_mesh_closed_forms(spark):
    g = graphs.mesh(spark, 7)
    assert g.count() == 2 * 7 * 6
    assert traversal.eccentricity(traversal.bfs(g)).first()["ecc"] == 12
    assert rows(transforms.metadata(g)) == [(49, 84, 1, 1)]


def test_layers_add_to_the_hop_eccentricity(spark):
    g = transforms.layered(frame(spark, MICRO["path5"][0]), 2)
    assert g.count() == 13
    assert traversal.eccentricity(traversal.bfs(g)).first()["ecc"] == 5
    assert traversal.eccentricity(traversal.sssp(g)).first()["ecc"] == 11
    assert transforms.layered(frame(spark, MICRO["path5"][0]), 1).count() == 4


def test_canonical_keeps_least_weight_and_drops_loops(spark):
    g = frame(spark, [(2, 1, 5), (1, 2, 3), (4, 4, 1), (None, 3, 1)])
    assert rows(transforms.canonical(g)) == [(1, 2, 3)]
    assert rows(transforms.canonical(g, keep_loops=True)) == [(1, 2, 3), (4, 4, 1)]


def test_dense_ids_follow_id_order(spark):
    g = frame(spark, [(5, 1_000_000, 1), (70_000, 5, 2)])
    assert rows(transforms.dense_ids(g)) == [(5, 0), (70_000, 1), (1_000_000, 2)]
    assert rows(transforms.remap(g)) == [(0, 1, 2), (0, 2, 1)]


def test_bits(spark):
    pairs = [((0, 1), 1), ((1, 2), 6), ((2, 3), 13), ((3, 4), 26), ((0, 5), 17), ((2**31 - 1, 2**31 - 1), 2**62 - 1)]
    df = spark.createDataFrame([(*p, z) for p, z in pairs], "x long, y long, z long")
    x, y = bits.morton_decode(F.col("z"))
    for r in df.select("*", bits.morton_encode(F.col("x"), F.col("y")).alias("z2"), x.alias("x2"), y.alias("y2")).collect():
        assert (r["z2"], r["x2"], r["y2"]) == (r["z"], r["x"], r["y"])
    values = spark.createDataFrame([(1, 1, 1), (2, 3, 2), (3, 3, 1), (4, 5, 3), (100, 13, 3)], "n long, gamma long, rho long")
    for r in values.select("*", bits.gamma_bits(F.col("n")).alias("g"), bits.rho(F.col("n")).alias("r")).collect():
        assert (r["g"], r["r"]) == (r["gamma"], r["rho"])
    blocks = spark.createDataFrame([(0, 1, 0), (1, 7, 1), (4, 5, 2), (6, 8, 3)], "u long, v long, block long")
    assert all(r[0] == r[1] for r in blocks.select("block", bits.block_of(F.col("u"), F.col("v"), 5, 2)).collect())
    assert spark.range(1).select(bits.node_blocks(F.lit(6), 5, 2)).first()[0] == [1, 3, 2, 3]


def test_grid_of_codes_round_trips(spark):
    grid = spark.range(10_000).select((F.col("id") % 100).alias("x"), F.floor(F.col("id") / 100).alias("y"))
    x, y = bits.morton_decode(bits.morton_encode(F.col("x"), F.col("y")))
    assert grid.filter((x != F.col("x")) | (y != F.col("y"))).count() == 0


def test_sources_read_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n0 1\n1\t2\n1 0\n3 3\n")
    (tmp_path / "b.txt").write_text("0 1 7\n1 0 5\n")
    (tmp_path / "c.gr").write_text("c x\np sp 3 2\na 1 2 803\na 2 1 803\na 2 3 4\n")
    assert rows(graphs.read_edge_list(spark, str(tmp_path / "a.txt"))) == [(0, 1, 1), (1, 2, 1)]
    assert rows(graphs.read_edge_list(spark, str(tmp_path / "b.txt"), weighted=True)) == [(0, 1, 5)]
    assert rows(graphs.read_road_network(spark, str(tmp_path / "c.gr"))) == [(1, 2, 803), (2, 3, 4)]


def test_edge_table_round_trip(spark, tmp_path):
    g = graphs.mesh(spark, 6)
    transforms.write_edge_table(g, str(tmp_path / "t"), 4)
    assert rows(graphs.read_edge_table(spark, str(tmp_path / "t"))) == rows(g)


def test_send_defaults_and_silence(spark):
    g = frame(spark, MICRO["star6"][0])
    nodes = spark.createDataFrame([(0, 1)], "id long, x long")
    step = dict(should_send=F.col("x") > 0, message=F.col("x") + F.col("w"), aggregate=F.min, update={"x": F.col("msg")}, update_no_msg={"x": F.lit(-1).cast("long")})
    adj = transforms.symmetric(g)
    assert rows(superstep.send(nodes, adj, **step)) == [(0, -1)]
    assert rows(superstep.send(nodes, adj, **step, with_default=True)) == [(0, -1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_newest_message_wins_the_merge_and_may_then_be_rejected(spark):
    """A newer but longer message hides an older, shorter one of the node's own cluster."""
    mail = spark.createDataFrame([(-2, 9, 5), (-1, 1, 7)], "older long, distance long, root long")
    best = mail.agg(F.min(F.struct("older", "distance", "root")).alias("msg"))
    known = lambda d: F.struct(F.lit(7).alias("root"), F.lit(d).alias("distance"), F.lit(1).alias("generation"))
    taken = lambda d: best.withColumn("known", known(d)).select(cluster.accepts(1, 2)).first()[0]
    assert taken(4) is False and taken(10) is True
    assert best.withColumn("known", F.lit(None).cast("struct<root:int,distance:int,generation:int>")).select(cluster.accepts(1, 2)).first()[0] is True


def test_steps_leave_the_edges_where_they_lie(spark):
    """Without broadcasts, a step moves messages; neither the edges nor the states are shuffled."""
    from graphspan.operators.fixpoint import Best

    adj = transforms.adjacency(graphs.mesh(spark, 8))
    best = Best(spark.createDataFrame([(0, 0)], "id long, value long"), ["id"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mail = best.base.join(adj, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("value") + F.col("w")).alias("msg")).groupBy("id").agg(F.min("msg").alias("msg"))
        plan = best.lookup(mail)._jdf.queryExecution().executedPlan().toString()
        sent = superstep.send(
            best.base, adj, should_send=F.col("value") >= 0, message=F.col("value") + F.col("w"), aggregate=F.min, update={"value": F.col("msg")}
        )._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 1 and sent.count("Exchange hashpartitioning") == 1
    assert best.spread(adj, F.col("value") + F.col("w")) == 14
    assert best.known().agg(F.max("value")).first()[0] == 14


def test_loops_that_do_not_end_say_so(spark):
    state = spark.createDataFrame([(0, True)], "id long, on boolean")
    with pytest.raises(RuntimeError):
        superstep.iterate(state, lambda rows, _: rows, F.col("on"), "endless", max_steps=2)


def _clusters(edges, radius, seed):
    """The clustering told plainly, superstep by superstep."""
    import hashlib

    draw = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16) / 2**32
    adj = {}
    for u, v, w in edges:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    state, still, awake, g = {}, set(), set(), 0
    while len(still) < len(adj):
        for x in adj:
            if x not in state and (2.0**g >= len(adj) or draw(seed, g, x) < 2.0**g / len(adj)):
                state[x] = (x, 0, g)
                awake.add(x)
        can = lambda x: x in awake and x not in still and state[x][1] <= radius * (1 + g - state[x][2])
        while any(can(x) for x in awake):
            mail = {}
            for x in filter(can, awake):
                for y, w in adj[x]:
                    m = (-state[x][2], state[x][1] + w, state[x][0])
                    mail[y] = min(m, mail.get(y, m))
            took = set()
            for y, (older, d, root) in mail.items():
                if y not in state or (y not in still and d < state[y][1] and (-older > state[y][2] or root == state[y][0])):
                    state[y] = (root, d, -older)
                    took.add(y)
            awake = took
        still |= {x for x, s in state.items() if s[1] <= radius * (1 + g - s[2])}
        g += 1
    return sorted((x, s[0], s[1]) for x, s in state.items())


@pytest.mark.parametrize("radius", [1, 3, 20])
def test_clusters_match_brute_force_and_bound_the_diameter(spark, radius):
    import random

    rng = random.Random(radius)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a != b} | {(i, i + 1) for i in range(39)})
    edges = [(u, v, rng.randint(0, 9)) for u, v in edges]
    g = frame(spark, edges)
    found = cluster.materialise(cluster.clusters(g, radius, seed=9))
    assert rows(found) == _clusters(edges, radius, 9)
    far = {}
    for u in range(40):
        d, todo = {u: 0}, [u]
        while todo:
            x = todo.pop(0)
            for a, b, w in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and d[x] + w < d.get(q, 10**9):
                        d[q] = d[x] + w
                        todo.append(q)
        far[u] = max(d.values())
    exact = cluster.estimate(g, found, exact_quotient=True).first()
    assert exact["diameter"] >= max(far.values()) and exact["diameter"] >= cluster.estimate(g, found).first()["diameter"]


@pytest.mark.parametrize("fringe", [False, True])
def test_clusters_cover_every_node(spark, fringe):
    g = graphs.mesh(spark, 6)
    found = cluster.clusters(g, 2, seed=3, reactivate_fringe=fringe).cache()
    assert found.count() == 36 and found.select("id").distinct().count() == 36
    assert found.filter("root = id and distance <> 0").count() == 0
    result = cluster.estimate(g, found).first()
    assert result["max_radius"] <= result["diameter"] and 4 * result["diameter"] >= 10


def test_one_cluster_is_twice_its_radius(spark):
    g = frame(spark, MICRO["path5"][0])
    found = spark.createDataFrame([(i, 0, d) for i, d in enumerate((0, 1, 3, 6, 10))], "id long, root long, distance long")
    assert tuple(cluster.estimate(g, found).first()) == (20, 10, 1)


def test_bad_parameters(spark):
    g = frame(spark, MICRO["path5"][0])
    for call in (lambda: cluster.clusters(g, 0), lambda: cluster.rand_cluster_guess(g, 1, 1, 1), lambda: hyperball.registers(g, 3)):
        with pytest.raises(ValueError):
            call()


def test_hyperball_is_at_most_the_hop_diameter(spark):
    assert hyperball.hyperball(graphs.mesh(spark, 5), 4).first()[0] <= 8


def test_same_answer_for_any_number_of_partitions(spark):
    g = graphs.mesh(spark, 5)
    once = {n: rows(cluster.clusters(g.repartition(n), 2, seed=5)) for n in (1, 4)}
    assert once[1] == once[4]


@pytest.mark.parametrize("p", [4, 6])
def test_hyperball_counts_rounds(spark, p):
    """Rounds of registers in words against rounds of single registers, told plainly."""
    edges = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (0, 5, 1), (7, 8, 1), (8, 9, 1), (4, 11, 1), (11, 12, 1)]
    g = frame(spark, edges)
    own = {}
    for i, reg, rho in rows(hyperball.registers(g, p)):
        own[i, reg] = rho
    words = hyperball.words(g, p).collect()
    assert {(r["id"], 16 * r["word"] + i): r[f"r{i}"] for r in words for i in range(16) if r[f"r{i}"]} == own
    rounds = 0
    while True:
        new = dict(own)
        for u, v, _ in edges:
            for a, b in ((u, v), (v, u)):
                for (i, reg), rho in own.items():
                    if i == a and rho > new.get((b, reg), 0):
                        new[b, reg] = rho
        if new == own:
            break
        own, rounds = new, rounds + 1
    assert hyperball.hyperball(g, p).first()[0] == rounds


def test_rows_a_step_are_the_nodes_that_changed(spark):
    from graphspan.operators.fixpoint import Best

    g = graphs.mesh(spark, 4)
    best = Best(hyperball.words(g, 4), ["id", "word"], F.max, values=tuple(f"r{i}" for i in range(16)))
    fresh, n = best.step_each(best.base, transforms.adjacency(g))
    before = {r["id"]: tuple(r) for r in best.base.collect()}
    after = {r["id"]: tuple(r) for r in best.known().collect()}
    assert fresh.count() == n == sum(after[i] != before.get(i) for i in after) and fresh.select("id").distinct().count() == n


def test_a_guess_ends_where_more_components_than_memory_are_left(spark):
    """No radius leaves fewer centres than components; those larger than all distances give the same clusters."""
    edges = [(10 * i + a, 10 * i + b, w) for i in range(3) for a, b, w in [(0, 1, 3), (1, 2, 7)]]
    found, tried = cluster.guess_clusters(frame(spark, edges), 2, 4, 4)
    assert [t[1] for t in tried] == [4, 16] and all(t[3] >= 3 for t in tried)
    assert rows(found) == _clusters(edges, 16, 1234) == _clusters(edges, 10**6, 1234)


def test_idle_rounds_are_skipped(spark, monkeypatch):
    """A far node waits for the round that reaches it; no round before that is worked through."""
    edges, passed, frozen = [(0, i, 400 + i) for i in range(1, 7)], [], cluster.frozen
    monkeypatch.setattr(cluster, "frozen", lambda radius, round_, of="value": passed.append(round_) or frozen(radius, round_, of))
    assert rows(cluster.clusters(frame(spark, edges), 1, seed=0)) == _clusters(edges, 1, 0)
    assert len(set(passed)) < 30  # the reach is 401 after as many rounds


def test_components_of_paths_that_lie_together_take_few_rounds(spark, monkeypatch):
    from graphspan.operators import components

    made, write = [], components.materialise_with
    monkeypatch.setattr(components, "materialise_with", lambda *a, **k: made.append(a) or write(*a, **k))
    path = spark.range(0, 3000, 1, 4).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1).cast("long").alias("w"))
    assert connected_components(path).groupBy("component").count().collect() == [(0, 3001)]
    assert len(made) <= 5


def test_invariants_ask_for_the_distance_to_the_own_root(spark, monkeypatch):
    """Node 3 is 6 from its root 0, not 1, and 6 has no path to it; another root is as near as each claims to be."""
    from graphspan.plans import queries

    edges = [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 1), (5, 6, 1)]
    found = [(0, 0, 0), (1, 0, 1), (2, 0, 3), (3, 0, 1), (4, 4, 0), (5, 5, 0), (6, 0, 1)]
    monkeypatch.setattr(queries.graphs, "part_supplier", lambda *_: frame(spark, edges))
    monkeypatch.setattr(queries.cluster, "clusters", lambda *_, **__: spark.createDataFrame(found, "id long, root long, distance long"))
    assert tuple(queries.QUERIES["cluster_invariants"](spark, "").first()) == (7, 0, 2, 0, 0)


@pytest.mark.parametrize("seed", [0, 1])
def test_distances_under_the_true_ones_match_brute_force(spark, seed):
    """Right rows whose paths leave their cluster, wrong ones that rest on wrong ones, zero weights, repeats, unknown roots."""
    import random

    rng = random.Random(seed)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a != b})
    edges = [(u, v, rng.randint(0, 9)) for u, v in edges]
    far = {}
    for r in range(30):
        d, todo = {r: 0}, [r]
        while todo:
            x = todo.pop(0)
            for a, b, w in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and d[x] + w < d.get(q, 10**9):
                        d[q] = d[x] + w
                        todo.append(q)
        far[r] = d

    def found(table):
        some = cluster.too_near(frame(spark, edges), spark.createDataFrame(table, "id long, root long, distance long"))
        return sorted((tuple(r) for r in some.collect()), key=str)

    roots = rng.sample(range(30), 4)
    right = [(i, r, far[r][i] + rng.choice([0, 0, 1])) for i in range(30) for r in [rng.choice(roots)] if i in far[r]]
    assert found(right) == []
    table = right + [(i, r, d - 4) for i, r, d in right if r == roots[0]] + [(3, 99, 5), (99, 99, 0), (4, roots[1], -1), (5, roots[2], None)]
    wrong = [(i, r, d) for i, r, d in table if d is None or d < (0 if i == r else far.get(r, {}).get(i, 10**9))]
    assert found(table) == sorted(wrong, key=str)
