"""Edge tables (u, v, w) from files, driver tables and generators.

An edge table has `u < v`, one row a pair, and the least weight of a pair; see
operators.transforms.canonical().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphspan.functions.bits import hash01, hash32
from graphspan.operators.transforms import canonical
from graphspan.session import materialise


def _columns(lines: DataFrame, names: tuple[str, ...], first: int) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*[F.element_at(parts, first + i).cast("long").alias(n) for i, n in enumerate(names)])


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, keep_loops: bool = False) -> DataFrame:
    """White-space separated `src dst [weight]` text, plain or compressed; `#` lines are comments."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    edges = _columns(lines, ("u", "v", "w") if weighted else ("u", "v"), 1)
    return canonical(edges if weighted else edges.withColumn("w", F.lit(1).cast("long")), keep_loops)


def read_road_network(spark: SparkSession, path: str, keep_loops: bool = False) -> DataFrame:
    """Road-network text: lines `a src dst weight`; other lines are ignored."""
    return canonical(_columns(spark.read.text(path).filter(F.col("value").startswith("a ")), ("u", "v", "w"), 2), keep_loops)


def read_edge_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet edge table, such as write_edge_table() leaves, whole or one block of it."""
    return spark.read.parquet(path).select("u", "v", "w")


def mesh(spark: SparkSession, side: int) -> DataFrame:
    """A side x side grid of unit edges to the right and below: 2 side (side - 1) of them."""
    cells = spark.range(side * side).withColumnRenamed("id", "u")
    right = cells.filter((F.col("u") % side) < side - 1).select("u", (F.col("u") + 1).alias("v"))
    below = cells.filter(F.col("u") < side * (side - 1)).select("u", (F.col("u") + side).alias("v"))
    return right.union(below).withColumn("w", F.lit(1).cast("long"))


def mesh_two_weights(spark: SparkSession, side: int, p: float, w1: int, w2: int, seed: int) -> DataFrame:
    """The mesh with weight w1 in a share p of its edges and w2 in the others."""
    draw = hash01(F.lit(seed), F.col("u"), F.col("v"))
    return mesh(spark, side).withColumn("w", F.when(draw < p, F.lit(w1)).otherwise(F.lit(w2)).cast("long"))


def mesh_random_weights(spark: SparkSession, side: int, low: int, high: int, seed: int) -> DataFrame:
    """The mesh with weights drawn from low..high-1."""
    draw = hash32(F.concat_ws(":", F.lit(seed).cast("string"), F.col("u").cast("string"), F.col("v").cast("string")))
    return mesh(spark, side).withColumn("w", F.lit(low) + draw % F.lit(high - low))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of all line items; the weight is the least quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_partkey").cast("long").alias("u"), (F.col("l_suppkey") + 1_000_000).cast("long").alias("v")).agg(F.min("l_quantity").cast("long").alias("w"))


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events, in one order over all events; the weight counts how often.

    The events are dealt by ranges of that order; each range looks back within itself, and its first
    event to the last one of the range before it, of which there are as many as ranges.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(events.repartitionByRange(parts, "ts", "event_id").withColumn("part", F.spark_partition_id()), "events")
    own = Window.partitionBy("part").orderBy("ts", "event_id")
    last = rows.groupBy("part").agg(F.max(F.struct("ts", "event_id", "user_id")).alias("last")).select("part", F.col("last.user_id").alias("last"))
    last = last.select("part", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("earlier"))
    seen = rows.select("part", F.col("user_id").alias("a"), F.lag("user_id").over(own).alias("b"), F.row_number().over(own).alias("i"))
    pairs = seen.join(F.broadcast(last), "part").select("a", F.when(F.col("i") == 1, F.col("earlier")).otherwise(F.col("b")).alias("b")).filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("w"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders of each customer; the weight is the days between them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.col("o_orderdate").cast("date"))
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = orders.select(F.lag("o_orderkey").over(own).alias("a"), F.col("o_orderkey").alias("b"), F.datediff("day", F.lag("day").over(own)).cast("long").alias("w"))
    return steps.filter("a is not null").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")
