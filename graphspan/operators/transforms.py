"""Graph to graph: canonical form, components, layers, weights, ids, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphspan.functions.bits import block_of, hash32, morton_encode
from graphspan.operators.adjacency import adjacency, symmetric  # noqa: F401
from graphspan.operators.components import connected_components
from graphspan.session import materialise, once, tasks_for


def canonical(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """u < v, one row a pair with its least weight; self loops go, since they change no distance."""
    rows = edges.filter("u is not null and v is not null")
    rows = rows if keep_loops else rows.filter("u <> v")
    return rows.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))


def node_ids(edges: DataFrame) -> DataFrame:
    """(id) of nodes with at least one edge."""
    return symmetric(edges).select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def metadata(edges: DataFrame) -> DataFrame:
    """num_nodes (largest id + 1), num_edges, min_weight and max_weight in one pass."""
    return edges.agg(
        (F.max(F.greatest("u", "v")) + 1).alias("num_nodes"), F.count("*").alias("num_edges"), F.min("w").alias("min_weight"), F.max("w").alias("max_weight")
    )


def id_ranges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, part, place): ids dealt by ranges, whose bounds Spark samples, and their places in them."""
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.monotonically_increasing_id()  # the partition's number, then the place in it, in 33 bits
    rows = node_ids(edges).repartitionByRange(parts, "id").sortWithinPartitions("id").select("id", F.shiftright(mark, 33).alias("part"), mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    return materialise(rows, "ranges")


def dense_ids(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, dense): ids numbered 0..n-1 in order.

    A number is a place in a range of ids plus the sizes of the ranges before it, of which there are
    as many as tasks. So it costs one shuffle however the ids are spread, and no task has more than
    its range.
    """
    rows = id_ranges(edges, parts)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each task
    return rows.join(F.broadcast(starts), "part").select("id", (F.col("place") + F.col("start")).cast("long").alias("dense"))


def remap(edges: DataFrame) -> DataFrame:
    """The same graph over dense ids."""
    edges = once(edges)
    ids = dense_ids(edges)
    a = ids.select(F.col("id").alias("u"), F.col("dense").alias("a"))
    b = ids.select(F.col("id").alias("v"), F.col("dense").alias("b"))
    return edges.join(a, "u").join(b, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes; of several, that of the smallest id."""
    edges = once(edges)
    parts = materialise(connected_components(edges), "components")
    best = component_sizes(parts).orderBy(F.desc("nodes"), "component").limit(1)
    inside = parts.join(F.broadcast(best.select("component")), "component", "left_semi").select(F.col("id").alias("u"))
    return edges.join(inside, "u", "left_semi").select("u", "v", "w")


def layered(edges: DataFrame, layers: int) -> DataFrame:
    """layers copies of the graph; consecutive copies of a node are joined by an edge of weight 1.

    Copy i of id x is x + i * num_nodes. Ids without edges get none here.
    """
    n = metadata(edges).first()["num_nodes"] or 0
    copies = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).select(
        (F.col("u") + F.col("i") * n).alias("u"), (F.col("v") + F.col("i") * n).alias("v"), "w"
    )
    if layers < 2:
        return copies
    rungs = node_ids(edges).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(layers - 2)))).select(
        (F.col("id") + F.col("i") * n).alias("u"), (F.col("id") + (F.col("i") + 1) * n).alias("v"), F.lit(1).cast("long").alias("w")
    )
    return copies.union(rungs)


def random_weights(edges: DataFrame, seed: int, top: int | None = None) -> DataFrame:
    """New weights in 1..top (num_nodes if not given), a function of seed and edge."""
    top = top or metadata(edges).first()["num_nodes"]
    draw = hash32(F.concat_ws(":", F.lit(seed).cast("string"), F.col("u").cast("string"), F.col("v").cast("string")))
    return edges.withColumn("w", 1 + draw % F.lit(top))


def with_blocks(edges: DataFrame, side: int, side_elements: int | None = None) -> DataFrame:
    """edges with their block number and space-filling code, for a blocked layout."""
    n = side_elements or metadata(edges).first()["num_nodes"] or 1
    per = -(-n // side)
    return edges.withColumns({"block": block_of(F.col("u"), F.col("v"), per, side), "z": morton_encode(F.col("u"), F.col("v"))})


def write_edge_table(edges: DataFrame, path: str, side: int = 32) -> None:
    """Parquet with a folder for each block, sorted by the space-filling code within.

    A task has a range of blocks and codes, so that its size doesn't follow that of a block.
    """
    rows = materialise(with_blocks(once(edges), side), "blocks")
    tasks = tasks_for(rows, rows.count())
    rows.repartitionByRange(tasks, "block", "z").sortWithinPartitions("block", "z").drop("z").write.partitionBy("block").parquet(path)


def gaps(edges: DataFrame, side: int) -> DataFrame:
    """Each edge's code less the one before it in its block: what a delta coder stores."""
    coded = with_blocks(edges, side)
    before = F.lag("z").over(Window.partitionBy("block").orderBy("z"))
    return coded.withColumn("gap", F.col("z") - F.coalesce(before, F.lit(0))).select("block", "z", "gap")
