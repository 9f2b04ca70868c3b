"""The graph queries by name: each takes (spark, sf_dir) and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphspan.functions import bits
from graphspan.operators import analysis, cluster, experiment, hyperball, results, superstep, transforms, traversal
from graphspan.operators.components import connected_components
from graphspan.operators.run_store import RunStore, schema
from graphspan.session import discard, materialise, once, scratch, tasks_for
from graphspan.sources import catalog, graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SIDE = 10  # of the mesh queries
DELTA = 10  # light edges are no heavier
RADIUS = 5  # of the clusters
MEMORY, FIRST, GROWTH = 20, 1, 4  # of the guesses
CENTRES = 16  # a node is a fixed centre if its hash is divisible by this


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an edge, in the direction it came."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("long").alias("u"), F.col("l_partkey").cast("long").alias("v"), F.col("l_quantity").cast("long").alias("w")
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run records."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("run_id"),
        (cust % 8).cast("long").alias("seed"),
        F.when(cust % 4 == 0, "USA").when(cust % 4 == 1, "USA-x5").when(cust % 4 == 2, "USA-x10").otherwise("sk-2005-lcc-rweight").alias("dataset"),
        F.when(key % 3 == 0, "DeltaStepping").when(key % 3 == 1, "Sequential").otherwise("RandClusterGuess").alias("algorithm"),
        F.when(key % 3 == 0, "2950").when(key % 3 == 1, "").otherwise("100000:29,10").alias("parameters"),
        (bits.hash32("o_orderkey") % 1000000).alias("diameter"),
        F.floor("o_totalprice").cast("long").alias("total_time_ms"),
        F.col("o_orderdate").cast("string").alias("run_date"),
        (key % 17 == 0).alias("killed"),
    )


def _iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the radius guesses of runs, dealt by run: nearly every one is a guess of its own."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.repartition(tasks_for(lines, lines.count()), "l_orderkey").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("iteration")).agg(
        F.max((F.col("l_linenumber") * 290)).cast("long").alias("iteration_radius"),
        F.sum(F.col("l_quantity").cast("long")).alias("duration_ms"),
        F.max(F.col("l_partkey")).cast("long").alias("num_centers"),
    )


# ---- edges


@query
def edges_canonical(spark, sf_dir):
    return _raw(spark, sf_dir).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")


@query
def edges_dedup_min(spark, sf_dir):
    return transforms.canonical(_raw(spark, sf_dir))


@query
def edges_dedup(spark, sf_dir):
    return edges_canonical(spark, sf_dir).select("u", "v").distinct()


@query
def self_loop_filter(spark, sf_dir):
    return _raw(spark, sf_dir).filter("u <> v").agg(F.count("*").alias("kept"), F.sum("w").alias("weight"))


@query
def edges_symmetric(spark, sf_dir):
    return transforms.symmetric(graphs.part_supplier(spark, sf_dir))


@query
def degree(spark, sf_dir):
    return transforms.degrees(graphs.part_supplier(spark, sf_dir))


@query
def node_scan(spark, sf_dir):
    return transforms.node_ids(graphs.event_users(spark, sf_dir))


@query
def graph_metadata(spark, sf_dir):
    return transforms.metadata(graphs.part_supplier(spark, sf_dir))


@query
def event_graph(spark, sf_dir):
    return graphs.event_users(spark, sf_dir)


@query
def order_graph(spark, sf_dir):
    return graphs.customer_orders(spark, sf_dir)


@query
def dataset_listing(spark, sf_dir):
    """The graphs of the driver's tables, listed like data sets."""
    named = {"ps": graphs.part_supplier(spark, sf_dir), "ev": graphs.event_users(spark, sf_dir), "oc": graphs.customer_orders(spark, sf_dir)}
    rows = None
    for name, edges in named.items():
        one = transforms.metadata(edges).select(F.lit(name).alias("dataset"), "*")
        rows = one if rows is None else rows.union(one)
    return analysis.dataset_listing(rows)


@query
def dataset_facts(spark, sf_dir):
    return analysis.dataset_facts(spark)


@query
def dense_remap(spark, sf_dir):
    return transforms.remap(graphs.part_supplier(spark, sf_dir))


@query
def block_assign(spark, sf_dir):
    return transforms.with_blocks(transforms.remap(graphs.part_supplier(spark, sf_dir)), 4).select("u", "v", "block")


@query
def node_blocks(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    per = ids.agg(F.max("id")).first()[0] // 4 + 1
    return ids.select("id", F.explode(bits.node_blocks(F.col("id"), per, 4)).alias("block"))


@query
def morton_encode(spark, sf_dir):
    edges = graphs.part_supplier(spark, sf_dir)
    return edges.select("u", "v", bits.morton_encode(F.col("u"), F.col("v")).alias("z"))


@query
def morton_roundtrip(spark, sf_dir):
    edges = graphs.part_supplier(spark, sf_dir)
    x, y = bits.morton_decode(bits.morton_encode(F.col("u"), F.col("v")))
    return edges.select("u", "v", x.alias("x"), y.alias("y"))


@query
def delta_gaps(spark, sf_dir):
    return transforms.gaps(transforms.remap(graphs.part_supplier(spark, sf_dir)), 4)


@query
def gamma_bits(spark, sf_dir):
    """Bits that the gaps of each block take in gamma code."""
    rows = delta_gaps(spark, sf_dir)
    return rows.groupBy("block").agg(F.count("*").alias("n_edges"), F.sum(bits.gamma_bits(F.col("gap"))).alias("n_bits"))


# ---- generators


@query
def mesh(spark, sf_dir):
    return graphs.mesh(spark, SIDE)


@query
def mesh_biweight(spark, sf_dir):
    return graphs.mesh_two_weights(spark, SIDE, 0.25, 1, 1000000, 7)


@query
def mesh_rweight(spark, sf_dir):
    return graphs.mesh_random_weights(spark, SIDE, 1, 1000000, 7)


@query
def rweight(spark, sf_dir):
    return transforms.random_weights(graphs.part_supplier(spark, sf_dir), 11)


@query
def layered(spark, sf_dir):
    return transforms.layered(graphs.part_supplier(spark, sf_dir), 3)


# ---- components


@query
def components(spark, sf_dir):
    return connected_components(graphs.customer_orders(spark, sf_dir))


@query
def component_sizes(spark, sf_dir):
    return transforms.component_sizes(connected_components(graphs.customer_orders(spark, sf_dir)))


@query
def lcc_edges(spark, sf_dir):
    return transforms.largest_component(graphs.customer_orders(spark, sf_dir))


# ---- supersteps


def _known(spark, sf_dir):
    """Parts of the part-supplier graph as nodes with a distance; suppliers are not among them."""
    edges = graphs.part_supplier(spark, sf_dir)
    nodes = edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("distance"))
    return nodes, transforms.symmetric(edges)


def _mail(spark, sf_dir, with_default):
    nodes, adj = _known(spark, sf_dir)
    adj = adj.union(adj.filter("src < dst").select("src", (F.col("src") + 1).alias("dst"), "w"))
    got = F.least(F.coalesce("distance", "msg"), "msg")
    return superstep.send(
        nodes, adj, should_send=F.col("distance") >= 2, message=F.col("distance") + F.col("w"), aggregate=F.min, update={"distance": got}, with_default=with_default
    )


@query
def send_min(spark, sf_dir):
    """Only the messages: the least at each receiver."""
    nodes, adj = _known(spark, sf_dir)
    sent = superstep.send(
        nodes.withColumn("heard", F.lit(None).cast("long")), adj, should_send=F.col("distance") >= 2, message=F.col("distance") + F.col("w"),
        aggregate=F.min, update={"heard": F.col("msg")}, with_default=True,
    )
    return sent.filter("heard is not null").select("id", "heard")


@query
def send_with_default(spark, sf_dir):
    return _mail(spark, sf_dir, True)


@query
def send_no_default(spark, sf_dir):
    return _mail(spark, sf_dir, False)


@query
def triplets(spark, sf_dir):
    edges = graphs.part_supplier(spark, sf_dir)
    nodes = transforms.degrees(edges)
    action = F.when(F.col("a.degree") != F.col("b.degree"), F.col("w") + F.col("a.degree") + F.col("b.degree"))
    return superstep.triplets(nodes, edges, action)


@query
def branch_all_counts(spark, sf_dir):
    """Rows on either side of the barrier, for thresholds under and over the number of matches."""
    nodes = materialise(transforms.degrees(graphs.part_supplier(spark, sf_dir)), "degrees")
    rows = None
    for threshold in (0, 1_000_000_000):
        stable, further, matches = superstep.branch_all(nodes, F.col("degree") >= 2, threshold)
        one = stable.agg(F.count("*").alias("stable")).select(F.lit(threshold).cast("long").alias("threshold"), F.lit(matches).cast("long").alias("matches"), "stable", F.lit(further.count()).cast("long").alias("further"))
        rows = one if rows is None else rows.union(one)
    return rows


# ---- distances


@query
def bfs_levels(spark, sf_dir):
    return traversal.bfs(graphs.part_supplier(spark, sf_dir))


@query
def bfs_ecc(spark, sf_dir):
    return traversal.eccentricity(traversal.bfs(graphs.part_supplier(spark, sf_dir)))


@query
def sssp(spark, sf_dir):
    return traversal.sssp(graphs.part_supplier(spark, sf_dir))


@query
def delta_stepping(spark, sf_dir):
    return traversal.delta_stepping(graphs.part_supplier(spark, sf_dir), DELTA)


@query
def delta_stepping_ecc(spark, sf_dir):
    return traversal.eccentricity(traversal.delta_stepping(graphs.part_supplier(spark, sf_dir), 5))


@query
def ecc_bounds(spark, sf_dir):
    return traversal.eccentricity(traversal.sssp(graphs.part_supplier(spark, sf_dir)))


@query
def light_heavy_split(spark, sf_dir):
    edges = graphs.part_supplier(spark, sf_dir)
    return edges.groupBy((F.col("w") <= DELTA).alias("light")).agg(F.count("*").alias("n_edges"), F.min("w").alias("least"), F.max("w").alias("largest"))


@query
def double_sweep(spark, sf_dir):
    return traversal.double_sweep(graphs.part_supplier(spark, sf_dir))


@query
def sequential(spark, sf_dir):
    return traversal.sequential(graphs.part_supplier(spark, sf_dir))


@query
def single_pass(spark, sf_dir):
    return traversal.single_pass(graphs.part_supplier(spark, sf_dir))


# ---- registers


@query
def hll_registers(spark, sf_dir):
    return hyperball.registers(graphs.part_supplier(spark, sf_dir), 4)


@query
def hll_merge_step(spark, sf_dir):
    edges = once(graphs.part_supplier(spark, sf_dir))
    return hyperball.merge_step(hyperball.registers(edges, 4), transforms.symmetric(edges))


@query
def hyperball_rounds(spark, sf_dir):
    return hyperball.hyperball(graphs.part_supplier(spark, sf_dir), 4)


# ---- clusters


def _wave(spark, sf_dir):
    edges = once(graphs.part_supplier(spark, sf_dir))
    return edges, materialise(cluster.grow_sampled(edges, bits.hash32("id") % CENTRES == 0), "wave-clusters")


@query
def cluster_sample(spark, sf_dir):
    nodes = transforms.node_ids(graphs.part_supplier(spark, sf_dir))
    return nodes.filter(cluster.sampled(1234, 3, 0.125))


@query
def cluster_wave(spark, sf_dir):
    return _wave(spark, sf_dir)[1]


@query
def cluster_radii(spark, sf_dir):
    return cluster.radii(_wave(spark, sf_dir)[1])


@query
def radius_histogram(spark, sf_dir):
    return cluster_radii(spark, sf_dir).groupBy("radius").agg(F.count("*").alias("clusters"))


@query
def quotient_edges(spark, sf_dir):
    return cluster.quotient(*_wave(spark, sf_dir))


@query
def cluster_invariants(spark, sf_dir):
    """What must hold of any clustering, counted: nodes, repeats, roots without a node, roots elsewhere, distances under the true ones
    to the nodes' own roots."""
    edges = once(graphs.part_supplier(spark, sf_dir))
    adj = transforms.adjacency(edges)
    found = materialise(cluster.clusters(edges, RADIUS, adj=adj), "cluster")
    too_near = cluster.too_near(edges, found, adj).count()
    discard(adj)
    nodes = transforms.node_ids(edges)
    roots = found.select(F.col("root").alias("id")).distinct()
    return (
        found.agg(F.count("*").alias("nodes"), (F.count("*") - F.countDistinct("id")).alias("repeats"))
        .withColumn("too_near", F.lit(too_near).cast("long"))
        .withColumn("lost_roots", F.lit(roots.join(nodes, "id", "left_anti").count()).cast("long"))
        .withColumn("moved_roots", F.lit(roots.join(found, "id").filter("root <> id or distance <> 0").count()).cast("long"))
    )


@query
def cluster_assignment(spark, sf_dir):
    return cluster.clusters(graphs.part_supplier(spark, sf_dir), RADIUS)


@query
def cluster_messages(spark, sf_dir):
    """Which of the messages to a node is heard: newest generation, then distance, then root."""
    mail = F.struct((-(F.col("l_linenumber") % 3).cast("long")).alias("older"), F.col("l_quantity").cast("long").alias("distance"), F.col("l_suppkey").cast("long").alias("root"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").cast("long").alias("id"), mail.alias("msg"))
    return lines.groupBy("id").agg(F.min("msg").alias("msg")).select("id", (-F.col("msg.older")).alias("generation"), "msg.distance", "msg.root")


@query
def guess_tried(spark, sf_dir):
    """The radii tried until the clusters' centres fit, and how many there were."""
    return cluster.rand_cluster_guess(graphs.part_supplier(spark, sf_dir), MEMORY, FIRST, GROWTH)[1].drop("duration_ms")


@query
def rand_cluster(spark, sf_dir):
    return cluster.rand_cluster(graphs.part_supplier(spark, sf_dir), RADIUS)


@query
def rand_cluster_exact(spark, sf_dir):
    """The estimate through the exact diameter of the graph of clusters."""
    return cluster.rand_cluster(graphs.part_supplier(spark, sf_dir), RADIUS, exact_quotient=True)


@query
def rand_cluster_guess(spark, sf_dir):
    return cluster.rand_cluster_guess(graphs.part_supplier(spark, sf_dir), MEMORY, FIRST, GROWTH)[0]


# ---- files


def _written(spark, sf_dir, line):
    """The line items as lines of text, read as a file of the graph would be."""
    path = scratch(spark, "edge-text")
    _raw(spark, sf_dir).select(F.format_string(line, "u", F.col("v") + 1_000_000, "w").alias("value")).write.text(path)
    return path


@query
def read_edge_list(spark, sf_dir):
    return graphs.read_edge_list(spark, _written(spark, sf_dir, "%d\t%d"))


@query
def read_weighted_list(spark, sf_dir):
    return graphs.read_edge_list(spark, _written(spark, sf_dir, "%d %d %d"), weighted=True)


@query
def read_road_network(spark, sf_dir):
    return graphs.read_road_network(spark, _written(spark, sf_dir, "a %d %d %d"))


@query
def edge_table(spark, sf_dir):
    """The part-supplier graph from a blocked edge table."""
    path = scratch(spark, "edge-table")
    transforms.write_edge_table(transforms.remap(graphs.part_supplier(spark, sf_dir)), path, 4)
    return spark.read.parquet(path).select("u", "v", "w", F.col("block").cast("long").alias("block"))


@query
def catalog_names(spark, sf_dir):
    """How many catalog names there are of each kind."""
    rows = spark.createDataFrame([(x,) for x in catalog.names()], "name string")
    kind = F.when(F.col("name").endswith("-lcc"), "component").when(F.col("name").endswith("-rweight"), "weights").when(F.col("name").rlike("-x[0-9]+$"), "layers").otherwise("base")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def catalog_mesh(spark, sf_dir):
    """A name that stands for a component of random weights: the mesh is connected, ids stay."""
    return catalog.resolve(spark, "mesh-rw-10-lcc")


@query
def superstep_log(spark, sf_dir):
    """How many nodes each superstep of a hop search woke, and how many it had reached."""
    edges = graphs.part_supplier(spark, sf_dir)
    adj, log = transforms.adjacency(edges), []
    root = edges.agg(F.min(F.least("u", "v"))).first()[0]
    start = spark.createDataFrame([(root, 0, True)], "id long, distance long, active boolean")

    def step(nodes, _):
        return superstep.send(
            nodes, adj, should_send=F.col("active"), message=F.col("distance") + 1, aggregate=F.min,
            update={"distance": F.coalesce("distance", "msg"), "active": F.col("distance").isNull()}, update_no_msg={"active": F.lit(False)}, with_default=True,
        )

    superstep.iterate(start, step, F.col("active"), "hops", log=log)
    return superstep.log_table(spark, log)


# ---- run records


@query
def latest_run(spark, sf_dir):
    return results.latest_run(_runs(spark, sf_dir), ["seed", "dataset", "algorithm", "parameters"], "run_date", "run_id")


@query
def already_run(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("sha", results.run_id_column(F.col("run_id")))
    return results.already_run(runs, seed=3, dataset="sk-2005-lcc-rweight", algorithm="Sequential", parameters="")


@query
def run_sha(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", results.run_id_column(F.col("run_id"), F.col("dataset")).alias("sha"))


_SPECS = ["sequential", "sequential-single", "bfs", "delta-stepping(2950)", "hyperball(4)", "rand-cluster(10, 2)", "rand-cluster-guess(100000, 29,10)", "other"]


@query
def parse_algorithm(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in _SPECS], "spec string")
    name, parameters = results.spec_columns(F.col("spec"))
    return rows.select("spec", name.alias("algorithm"), parameters.alias("parameters"))


@query
def parse_params(spark, sf_dir):
    one, two, three = analysis.split_parameters(F.col("parameters"), 3)
    return _runs(spark, sf_dir).select("run_id", one.alias("p1"), two.alias("p2"), three.alias("p3"))


@query
def union_killed(spark, sf_dir):
    return analysis.with_killed(_runs(spark, sf_dir)).groupBy("algorithm", "killed").agg(F.count("*").alias("n"), F.sum("run_id").alias("ids"))


@query
def main_data(spark, sf_dir):
    return analysis.main_data(_runs(spark, sf_dir))


@query
def bounds(spark, sf_dir):
    rows = analysis.bounds(analysis.main_data(_runs(spark, sf_dir)))
    return rows.withColumn("total_time", F.round("total_time", 4))


@query
def best_per_group(spark, sf_dir):
    best = analysis.best_per_group(analysis.main_data(_runs(spark, sf_dir)), "run_id")
    return best.select("dataset", "algorithm", "run_id", "diameter", "total_time", "killed", "label")


@query
def cumulative_time(spark, sf_dir):
    rows = analysis.cumulative_time(_iterations(spark, sf_dir), 290, 2900, "run_id")
    return rows.select("run_id", "iteration", "iteration_radius_multiple", "cumulative_time")


@query
def scale_factor_mean(spark, sf_dir):
    main = analysis.main_data(_runs(spark, sf_dir)).filter(F.col("dataset").isin("USA", "USA-x5", "USA-x10") & ~F.col("killed"))
    return analysis.scale_factor_mean(main).withColumn("total_time", F.round("total_time", 4))


@query
def pivot_counters(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    counters = lines.select(results.run_id_column(F.col("l_orderkey")).alias("sha"), F.when(F.col("l_linenumber") % 2 == 0, "Centers").otherwise("Uncovered").alias("counter"), F.col("l_quantity").cast("long").alias("count"))
    return analysis.pivot_counters(counters, ["Centers", "Uncovered"])


@query
def semi_join_datasets(spark, sf_dir):
    return analysis.dataset_facts(spark).join(_runs(spark, sf_dir).select("dataset").distinct(), "dataset", "left_semi")


@query
def graph_type(spark, sf_dir):
    return analysis.dataset_facts(spark).select("dataset", analysis.graph_type(F.col("dataset")).alias("graph_type"))


@query
def center_fraction(spark, sf_dir):
    nodes = analysis.dataset_facts(spark).select("dataset", "num_nodes")
    rows = _iterations(spark, sf_dir).join(_runs(spark, sf_dir).select("run_id", "dataset"), "run_id")
    return analysis.center_fraction(rows, nodes).withColumn("fraction", F.round("fraction", 9))


def _timed(spark, sf_dir):
    """Run records with ids, hosts and the time of the last phase; the clustering runs' radius varies."""
    rows = _runs(spark, sf_dir)
    radius = F.element_at(F.array(*[F.lit(str(x)) for x in analysis.RADIUS_OF]), (F.col("run_id") % 5 + 1).cast("int"))
    clustered = F.col("algorithm") == "RandClusterGuess"
    return rows.withColumns(
        {
            "sha": results.run_id_column(F.col("run_id")), "hosts": F.concat_ws(",", F.array_repeat(F.lit("node:1"), (F.col("run_id") % 3).cast("int"))),
            "final_diameter_time_ms": F.floor(F.col("total_time_ms") / 4), "parameters": F.when(clustered, F.concat(radius, F.lit(":29,10"))).otherwise(F.col("parameters")),
        }
    )


@query
def scalability_data(spark, sf_dir):
    rows = analysis.scalability_data(_timed(spark, sf_dir), ["USA", "USA-x10"], "2950:29,10", "node")
    return rows.select("run_id", "dataset", "algorithm", "n_hosts", F.round("total_time", 4).alias("total_time"), F.round("final_diameter_time", 4).alias("final_diameter_time"))


CHOSEN = [2, 5, 8, 11, 14, 17, 20, 23, 26, 29]  # run ids of the insight table


@query
def diameter_insight(spark, sf_dir):
    rows = analysis.diameter_insight_data(_timed(spark, sf_dir), [results.run_id(x) for x in CHOSEN])
    return rows.withColumn("clustering_time", F.round("clustering_time", 4))


def _dependence(spark, sf_dir):
    timed = _timed(spark, sf_dir)
    insight = analysis.diameter_insight_data(timed, [results.run_id(x) for x in CHOSEN])
    return analysis.parameter_dependence(analysis.main_data(timed), _iterations(spark, sf_dir), insight, "run_id", "USA", "29500:29,10")


@query
def parameter_dependence(spark, sf_dir):
    """Iterations, their durations and the diameters of the runs chosen for their radius."""
    return _dependence(spark, sf_dir).select("run_id", "iteration", "iteration_radius", F.round("duration", 4).alias("duration"), "num_centers", "diameter")


@query
def parameter_dependence_frame(spark, sf_dir):
    """Duration and diameter over the radius as a multiple of the average weight."""
    rows = _dependence(spark, sf_dir).filter("iteration_radius >= 290").withColumn("iteration_radius_multiple", F.col("iteration_radius") / 2900)
    return rows.groupBy("iteration_radius_multiple").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("duration"), F.max("diameter").alias("diameter"))


def _static(spark, sf_dir):
    rows = analysis.with_killed(_runs(spark, sf_dir)).withColumn("graph_type", analysis.graph_type(F.col("dataset")))
    return analysis.static_diam_vs_time(rows)


@query
def static_diam_vs_time(spark, sf_dir):
    return _static(spark, sf_dir)[0].withColumns({"total_time": F.round("total_time", 4), "diameter": F.round("diameter", 4)})


@query
def static_bounds(spark, sf_dir):
    return _static(spark, sf_dir)[1].withColumns({x: F.round(x, 4) for x in ("diameter_lower", "diameter_upper")})


def _counters(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        results.run_id_column(F.col("l_orderkey")).alias("sha"), F.when(F.col("l_linenumber") % 2 == 0, "Centers").otherwise("Uncovered").alias("counter"),
        F.ceil(F.col("l_linenumber") / 2).cast("int").alias("outer_iter"), F.lit(0).alias("inner_iter"), F.col("l_quantity").cast("long").alias("count"),
    )


@query
def counters_report(spark, sf_dir):
    main = _timed(spark, sf_dir).withColumnRenamed("run_date", "date")
    return analysis.counters_report(_counters(spark, sf_dir), main, ["Centers", "Uncovered"])


@query
def center_progression(spark, sf_dir):
    return analysis.center_progression(_counters(spark, sf_dir), _timed(spark, sf_dir).withColumnRenamed("run_date", "date"))


@query
def runs_from_csv(spark, sf_dir):
    """Run records written as CSV and read again."""
    path = scratch(spark, "runs-csv")
    _runs(spark, sf_dir).write.csv(path, header=True)
    kinds = "run_id long, seed long, dataset string, algorithm string, parameters string, diameter long, total_time_ms long, run_date string, killed boolean"
    return results.read_csv(spark, path, kinds).select("run_id", "algorithm", "diameter", "killed")


@query
def mean_and_error(spark, sf_dir):
    rows = analysis.mean_and_error(analysis.main_data(_runs(spark, sf_dir)), ["dataset", "algorithm"], "total_time")
    return rows.select("dataset", "algorithm", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


@query
def bootstrap_interval(spark, sf_dir):
    """Mean times with 95 % intervals from 100 resamples of the runs."""
    rows = analysis.bootstrap_interval(analysis.main_data(_runs(spark, sf_dir)), ["dataset", "algorithm"], "total_time", "run_id", replicas=100, seed=7)
    return rows.select("dataset", "algorithm", *[F.round(x, 4).alias(x) for x in ("mean", "lower", "upper")])


@query
def auxiliary_size(spark, sf_dir):
    """Centres as a share of the nodes, by radius, of clustering runs whose base is 2."""
    centres = _iterations(spark, sf_dir).groupBy("run_id").agg(F.max("num_centers").alias("centers"))
    base = F.when(F.col("run_id") % 4 == 0, "10").otherwise("2")
    runs = _runs(spark, sf_dir).filter("algorithm <> 'Sequential'").withColumns({"algorithm": F.lit("RandCluster"), "parameters": F.concat_ws(":", (F.col("run_id") % 7 + 1).cast("string"), base)})
    nodes = analysis.dataset_facts(spark).select("dataset", "num_nodes")
    return analysis.auxiliary_size(runs.join(centres, "run_id"), nodes).withColumn("fraction", F.round("fraction", 9))


@query
def deadline_runs(spark, sf_dir):
    """Runs over the part-supplier graph without any time and with all the time, as their records tell."""
    edges = materialise(graphs.part_supplier(spark, sf_dir), "graph")
    store = RunStore(spark, scratch(spark, "runs"))
    for text in ("bfs", "sequential-single"):
        spec = results.parse_spec(text)
        for deadline in (0, None):
            experiment.record(store, spec, "ps", experiment.measure(edges, spec, deadline=deadline))
    return store.table("main").select("dataset", "algorithm", "killed", "diameter")


@query
def committed_runs(spark, sf_dir):
    """Orders as runs and line items as their counters and guesses, in five commits.

    Two are of older versions; one is staged and never published; one is staged by a writer that
    dies, and made again.
    """
    store = RunStore(spark, scratch(spark, "store"))
    sha = F.col("run_id").cast("string").alias("sha")
    runs = _runs(spark, sf_dir).select(
        "run_id", sha, F.to_timestamp("run_date").alias("date"), "seed", F.lit(8).alias("threads"), F.lit("").alias("hosts"), "dataset", "algorithm", "parameters", "diameter",
        "total_time_ms", (F.col("seed") % 2 == 0).alias("offline"), F.floor(F.col("total_time_ms") / 4).alias("final_diameter_time_ms"), "killed",
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("run_id", F.col("l_orderkey"))
    counters = lines.select("run_id", sha, F.when(F.col("l_linenumber") % 2 == 0, "Centers").otherwise("Uncovered").alias("counter"), F.col("l_linenumber").alias("outer_iter"), F.lit(0).alias("inner_iter"), F.col("l_quantity").alias("count"))
    guesses = _iterations(spark, sf_dir).select("run_id", sha, "iteration", "iteration_radius", "duration_ms", "num_centers")
    for part, version, published in ((0, 1, True), (1, 4, True), (2, 6, True), (3, 6, False), (4, 6, False), (4, 6, True)):
        own = F.col("run_id") % 5 == part
        others = {"rand_cluster_iterations": guesses.filter(own)} if schema("rand_cluster_iterations", version) else {}
        staged = store.stage(runs.filter(own), version, counters=counters.filter(own), **others)
        if published:
            store.publish(staged)
    counted = store.table("counters").groupBy("sha").agg(F.count("*").alias("n_counters"), F.sum("count").alias("counted"))
    tried = store.table("rand_cluster_iterations").groupBy("sha").agg(F.count("*").alias("n_guesses"), F.sum("duration_ms").alias("guess_ms"))
    main = store.table("main").select("sha", F.col("version").cast("long").alias("version"), "diameter", "offline", "final_diameter_time_ms", "killed")
    return main.join(counted, "sha", "left").join(tried, "sha", "left")


@query
def loop_counters(spark, sf_dir):
    """What each superstep of each round of a clustering covered, and what it left."""
    log = []
    cluster.clusters(graphs.part_supplier(spark, sf_dir), RADIUS, log=log)
    return spark.createDataFrame(log, "counter string, outer_iter long, inner_iter long, count long")
