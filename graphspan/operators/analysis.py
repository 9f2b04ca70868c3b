"""Relational analytics over run records: bounds, best runs, scaling, counters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphspan.functions.bits import hash01

#: fixed values: datasets left out, algorithms kept, those whose result is an eccentricity to double
LEFT_OUT = ["sk-2005", "USA-E"]
COMPARED = ["RandClusterGuess", "DeltaStepping", "Sequential"]
ONE_SIDED = ["Bfs", "DeltaStepping"]
TIMEOUT_S = 5 * 3600.0

#: fixed values: type of each graph
GRAPH_TYPES = {
    "social": ["livejournal-lcc", "orkut-lcc"],
    "web": ["uk-2014-host-lcc", "uk-2005-lcc", "sk-2005-lcc"],
    "roads": ["USA-E", "USA-W", "USA-CTR", "USA"],
    "synthetic": ["mesh-2048"],
}

#: fixed values: name, nodes, edges, least and largest weight of the known graphs
DATASETS = [
    ("twitter-lcc", 81306, 1342310, 1, 1),
    ("twitter", 81306, 1342311, 1, 1),
    ("mesh-1000", 1000000, 1998000, 1, 1),
    ("mesh-biw-1000", 1000000, 1998000, 1, 1000000),
    ("mesh-rw-1000", 1000000, 1998000, 1, 999999),
    ("cnr-2000", 325888, 2738969, 1, 1),
    ("USA-E", 3598623, 4354029, 1, 200760),
    ("USA-W", 6262104, 7559642, 1, 368855),
    ("mesh-2048", 4194304, 8384512, 1, 1),
    ("mesh-biw-2048", 4194304, 8384512, 1, 1000000),
    ("mesh-rw-2048", 4194304, 8384512, 1, 999999),
    ("uk-2014-tpd", 1766398, 15283718, 1, 1),
    ("USA-CTR", 14081816, 16933416, 1, 214013),
    ("USA", 23947347, 28854313, 1, 368855),
    ("uk-2014-host-lcc", 4524940, 38904680, 1, 1),
    ("uk-2014-host", 4769515, 40214909, 1, 1),
    ("livejournal-lcc", 4843953, 43362749, 1, 1),
    ("livejournal", 4847571, 43369638, 1, 1),
    ("orkut", 3072441, 117185083, 1, 1),
    ("orkut-lcc", 3072441, 117185083, 1, 1),
    ("uk-2005-lcc", 38823691, 761981639, 1, 1),
    ("uk-2005", 39460220, 783027125, 1, 1),
    ("twitter-2010", 41652446, 1202513046, 1, 1),
    ("sk-2005-lcc", 50048065, 1772779168, 1, 1),
    ("sk-2005", 50636543, 1810063330, 1, 1),
    ("gsh-2015", 988491121, 25690705118, 1, 1),
    ("clueweb12", 978408033, 37372179311, 1, 1),
]


def dataset_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, "dataset string, num_nodes long, num_edges long, min_weight long, max_weight long")


def dataset_listing(facts: DataFrame) -> DataFrame:
    """The facts by number of edges, then name."""
    return facts.orderBy(F.asc_nulls_first("num_edges"), "dataset")


def renamed(algorithm: str | Column = "algorithm") -> Column:
    column = F.col(algorithm) if isinstance(algorithm, str) else algorithm
    return F.when(column == "RandClusterGuess", F.lit("ClusterDiameter")).otherwise(column)


def with_killed(runs: DataFrame) -> DataFrame:
    """Finished runs and, by name, the killed ones of the baseline."""
    finished = runs.filter(~F.col("killed")).filter(F.col("algorithm").isin(COMPARED))
    return finished.unionByName(runs.filter(F.col("killed") & (F.col("algorithm") == "DeltaStepping")), allowMissingColumns=True)


def _seconds(rows: DataFrame) -> DataFrame:
    """Times in seconds instead of milliseconds, under the name without the unit."""
    for name in ("total_time", "final_diameter_time"):
        if f"{name}_ms" in rows.columns:
            rows = rows.withColumn(name, F.col(f"{name}_ms") / 1000).drop(f"{name}_ms")
    return rows


def _hosts(rows: DataFrame, host_pattern: str | None) -> DataFrame:
    return rows if host_pattern is None else rows.withColumn("n_hosts", F.regexp_count("hosts", F.lit(host_pattern)))


def main_data(runs: DataFrame, n_hosts: tuple[int, ...] | None = None, host_pattern: str | None = None) -> DataFrame:
    """The runs compared: algorithms renamed, eccentricities doubled, times in seconds.

    n_hosts keeps runs on that many hosts, counted as matches of host_pattern in `hosts`.
    """
    rows = _hosts(with_killed(runs).withColumn("algorithm", renamed()), host_pattern)
    if n_hosts is not None:
        rows = rows.filter(F.col("n_hosts").isin(list(n_hosts)))
    rows = rows.filter(~F.col("dataset").isin(LEFT_OUT))
    rows = rows.withColumn("diameter", F.when(F.col("algorithm").isin(ONE_SIDED), 2 * F.col("diameter")).otherwise(F.col("diameter")))
    return _seconds(rows).drop("hosts")


def scalability_data(runs: DataFrame, datasets: list[str], parameters: str, host_pattern: str) -> DataFrame:
    """Finished runs of the clustering estimate on some data sets with fixed parameters, and their hosts."""
    rows = runs.filter(~F.col("killed") & (F.col("algorithm") == "RandClusterGuess") & F.col("dataset").isin(datasets) & (F.col("parameters") == parameters))
    return _seconds(_hosts(rows.withColumn("algorithm", renamed()), host_pattern)).drop("hosts")


#: fixed values: radius of the chosen runs -> radius of the iteration it goes with
RADIUS_OF = {295: 290, 2950: 2900, 29500: 29000, 295000: 290000, 2950000: 2900000}


def diameter_insight_data(runs: DataFrame, shas: list[str]) -> DataFrame:
    """(sha, iteration_radius, diameter, clustering_time) of chosen runs; the radius leads the parameters."""
    rows = _seconds(runs.filter(F.col("sha").isin(shas)))
    radius, _ = split_parameters(F.col("parameters"), 2)
    of = F.lit(None).cast("long")
    for a, b in RADIUS_OF.items():
        of = F.when(radius == a, F.lit(b).cast("long")).otherwise(of)
    return rows.select("sha", of.alias("iteration_radius"), "diameter", (F.col("total_time") - F.col("final_diameter_time")).alias("clustering_time"))


def parameter_dependence(main: DataFrame, iterations: DataFrame, insight: DataFrame, key: str, dataset: str, parameters: str) -> DataFrame:
    """The iterations of the runs of one data set and one setting, each with the diameter that the
    chosen run of its radius found; durations in seconds."""
    some = main.filter((F.col("dataset") == dataset) & (F.col("algorithm") == "ClusterDiameter") & (F.col("parameters") == parameters)).drop("diameter")
    rows = some.join(iterations, key).withColumn("duration", F.col("duration_ms") / 1000).drop("duration_ms")
    return rows.join(insight.select("iteration_radius", "diameter"), "iteration_radius")


def static_diam_vs_time(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_type, dataset, algorithm, parameters) with mean time in seconds and mean diameter; and
    the bounds that the one-sided algorithms' means prove for each graph."""
    by = ["graph_type", "dataset", "algorithm", "parameters"]
    means = _seconds(runs).groupBy(*by).agg(F.avg("total_time").alias("total_time"), F.avg("diameter").alias("diameter"))
    one_sided = means.filter(F.col("algorithm").isin(ONE_SIDED))
    limits = one_sided.groupBy("graph_type", "dataset").agg(F.max(F.col("diameter") / 2).alias("diameter_lower"), F.min("diameter").alias("diameter_upper"))
    return means, limits


def counters_report(counters: DataFrame, main: DataFrame, names: list[str], last: int = 6) -> DataFrame:
    """Of the `last` run ids in order: sha, parameters and the sum of each counter."""
    sums = counters.groupBy("sha", "counter").agg(F.sum("count").alias("count"))
    rows = sums.join(main.select("sha", "parameters"), "sha").groupBy("sha", "parameters").pivot("counter", names).agg(F.sum("count"))
    return rows.orderBy(F.desc("sha"), F.desc("parameters")).limit(last)


def center_progression(counters: DataFrame, main: DataFrame) -> DataFrame:
    """The centres and uncovered nodes of the latest run, by its loops."""
    latest = main.orderBy(F.desc("date"), F.desc("sha")).limit(1).select("sha", "parameters")
    some = counters.join(F.broadcast(latest), "sha").groupBy("parameters", "outer_iter", "inner_iter")
    return some.pivot("counter", ["Centers", "Uncovered"]).agg(F.sum("count"))


def short_name(dataset: Column, keep_roads: bool = False) -> Column:
    """The graph a dataset is made from; roads by their own name if keep_roads."""
    roads = F.when(dataset.contains("USA"), dataset if keep_roads else F.lit("USA"))
    return F.when(dataset.contains("sk-2005"), "sk-2005").when(dataset.contains("twitter-2010"), "twitter-2010").otherwise(roads)


def bounds(main: DataFrame) -> DataFrame:
    """(dataset, diameter_upper, diameter_lower, total_time): what the compared runs prove.

    A killed run proves nothing (its diameter is a mark), so it counts in the mean time alone.
    """
    done = main.filter(~F.col("killed"))
    upper = done.filter("algorithm = 'DeltaStepping'").groupBy("dataset").agg(F.min("diameter").alias("diameter_upper"))
    half = F.when(F.col("algorithm") == "Sequential", F.col("diameter")).otherwise(F.floor(F.col("diameter") / 2)).cast("long")
    lower = done.filter(F.col("algorithm").isin("DeltaStepping", "Sequential")).groupBy("dataset").agg(F.max(half).alias("diameter_lower")).dropna()
    times = main.groupBy("dataset").agg(F.avg("total_time").alias("total_time"))
    return upper.join(lower, "dataset").join(times, "dataset").withColumn("dataset", short_name(F.col("dataset"))).dropna()


def best_per_group(main: DataFrame, tie: str) -> DataFrame:
    """The fastest run of each dataset and algorithm; killed runs count as the timeout."""
    timed = main.withColumn("total_time", F.when(F.col("killed"), F.lit(TIMEOUT_S)).otherwise(F.col("total_time")))
    label = F.when(F.col("killed"), F.lit("timed out > 5h")).otherwise(F.concat(F.round("total_time").cast("long").cast("string"), F.lit(" s")))
    timed = timed.withColumn("label", label).withColumn("dataset", short_name(F.col("dataset"), keep_roads=True))
    first = F.row_number().over(Window.partitionBy("dataset", "algorithm").orderBy("total_time", tie))
    return timed.withColumn("rank", first).filter("rank = 1").drop("rank")


def cumulative_time(iterations: DataFrame, least_radius: int, average_weight: int, key: str) -> DataFrame:
    """Radius guesses of each run in rising order, as multiples of the average weight, with the time so far."""
    so_far = Window.partitionBy(key).orderBy("iteration_radius").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = iterations.filter(F.col("iteration_radius") >= least_radius)
    return rows.withColumns(
        {"iteration_radius_multiple": F.col("iteration_radius") / average_weight, "cumulative_time": F.sum("duration_ms").over(so_far) / 1000}
    )


def scale_factor_mean(main: DataFrame) -> DataFrame:
    """Mean time by scale factor (digits in the dataset's name, else 1), algorithm and parameters."""
    scale = F.coalesce(F.regexp_extract("dataset", r"(\d+)", 1).try_cast("int"), F.lit(1))
    return main.withColumn("scale", scale).groupBy("scale", "algorithm", "parameters").agg(F.avg("total_time").alias("total_time"))


def pivot_counters(counters: DataFrame, names: list[str]) -> DataFrame:
    """A row for each sha, a column for each counter."""
    return counters.groupBy("sha").pivot("counter", names).agg(F.sum("count"))


def graph_type(dataset: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, names in reversed(GRAPH_TYPES.items()):
        found = F.when(dataset.isin(names), F.lit(kind)).otherwise(found)
    return found


def split_parameters(parameters: Column, pieces: int) -> list[Column]:
    """The numbers in a parameter string, in order; null beyond its last, more than `pieces` are dropped."""
    parts = F.split(parameters, "[^0-9A-Za-z]+")
    return [F.get(parts, F.lit(i)).try_cast("long") for i in range(pieces)]


def center_fraction(iterations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean share of a graph's nodes that became centres, by dataset and radius."""
    return iterations.join(nodes, "dataset").groupBy("dataset", "iteration_radius").agg(F.avg(F.col("num_centers") / F.col("num_nodes")).alias("fraction"))


def mean_and_error(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and its standard error."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def auxiliary_size(runs: DataFrame, nodes: DataFrame, base: int = 2) -> DataFrame:
    """(dataset, radius, base, fraction): mean share of a graph's nodes that were centres, by radius.

    runs has dataset, algorithm, parameters (radius and base) and centers; only clusterings of that
    base count. nodes has dataset and num_nodes.
    """
    radius, own = split_parameters(F.col("parameters"), 2)
    chosen = runs.filter(F.col("algorithm") == "RandCluster").withColumns({"radius": radius, "base": own}).filter(F.col("base") == base)
    share = chosen.join(nodes, "dataset").withColumn("fraction", F.col("centers") / F.col("num_nodes"))
    return share.groupBy("dataset", "radius", "base").agg(F.avg("fraction").alias("fraction"))


def poisson_weight(draw: Column, most: int = 14) -> Column:
    """How often a row is drawn, Poisson with mean one, for a number in [0, 1)."""
    weight, upto, share = F.lit(0), 0.0, math.exp(-1)
    for k in range(most):
        upto += share
        share /= k + 1
        weight = weight + (draw >= F.lit(upto)).cast("int")
    return weight


def bootstrap_interval(runs: DataFrame, by: list[str], value: str, row: str, replicas: int = 1000, confidence: float = 0.95, seed: int = 1234) -> DataFrame:
    """(*by, mean, lower, upper): means and the percentile intervals of their bootstrap.

    Each replica weighs every row by a Poisson number that is a function of seed, replica and the
    row's key, so that resampling needs neither the group's size nor an order. All replicas
    are summed in one partial aggregate: of a task's rows only by-group and replica sums move.
    Null values don't count. A group whose values are all null has null for all three.
    """
    drawn = hash01(F.lit(seed), F.col("__replica"), F.col(row))
    rows = runs.filter(F.col(value).isNotNull()).withColumn("__replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("__w", poisson_weight(drawn))
    sums = rows.groupBy(*by, "__replica").agg(F.sum(F.col("__w") * F.col(value)).alias("s"), F.sum("__w").alias("n")).filter("n > 0")
    tail = (1 - confidence) / 2
    spread = sums.groupBy(*by).agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    means = runs.groupBy(*by).agg(F.avg(value).alias("mean"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    return means.alias("m").join(spread.alias("s"), same, "left").select(*[f"m.{k}" for k in by], "mean", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))
