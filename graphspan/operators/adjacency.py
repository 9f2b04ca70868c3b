"""Edges laid out for supersteps: by their source, and a hub's by the parts of its neighbours.

Edges lie in buckets of their source, so that a step moves its senders and never the edges. A node
with a large share of all edges would fill a bucket alone; its edges are dealt, by a hash of their
other end, into parts of bounded size that lie in buckets of (source, part). A sender that is a hub
goes to each of its parts, and to no other bucket; all other senders go to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphspan.session import bucketed, discard, materialise, materialise_with, once

_PART, _PARTS = "__part", "__parts"
_SHARE = 16  # a hub has more than a sixteenth of a bucket's edges
_LEAST = 4096  # and more than so many
_SLOTS = 64  # slots of ids for each hub that there may be


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w): every edge from both ends."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(edges.select(F.col("v"), F.col("u"), F.col("w")))


def adjacency_with(edges: DataFrame, least: int = _LEAST, **measures: Column) -> tuple[DataFrame, dict]:
    """adjacency(), and aggregates of its rows that ride on the write. least: edges that no hub may have fewer of."""
    both = symmetric(once(edges))
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the edges of a hub are no more than those of its slot: only ids of full slots are counted one by one
    slot = F.pmod(F.xxhash64("src"), F.lit(_SLOTS * _SHARE * buckets))
    slots = materialise(both.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "slots")
    most = max(least, (slots.agg(F.sum("n")).first()[0] or 0) // (_SHARE * buckets))
    full = slots.filter(F.col("n") > most).select("slot")  # _SHARE * buckets at most
    within = both.withColumn("slot", slot).join(F.broadcast(full), "slot", "left_semi")
    hubs = None if full.isEmpty() else _hubs(within.groupBy("src").agg(F.count("*").alias("n")), most)
    discard(slots)
    if hubs is None:
        adj, told = bucketed(both, ["src"], "adjacency", **measures)
        adj._graphspan_hubs = None
        return adj, told
    parts = F.coalesce(F.pmod(F.xxhash64("dst"), _PARTS), F.lit(0)).cast("int")
    dealt = both.join(F.broadcast(hubs.withColumnRenamed("id", "src")), "src", "left").withColumn(_PART, parts).select("src", "dst", "w", _PART)
    adj, told = bucketed(dealt, ["src", _PART], "adjacency", **measures)
    adj._graphspan_hubs = hubs
    return adj, told


def _hubs(degree: DataFrame, most: int) -> DataFrame | None:
    """(id, __parts) of the nodes with more than `most` edges, or None if there are none."""
    hubs, seen = materialise_with(degree.filter(F.col("n") > most).select(F.col("src").alias("id"), F.ceil(F.col("n") / most).cast("int").alias(_PARTS)), "hubs", n=F.count("*"))
    if seen["n"]:
        return hubs
    discard(hubs)
    return None


def adjacency(edges: DataFrame, least: int = _LEAST) -> DataFrame:
    """The symmetric edges (src, dst, w), written once for all supersteps; along() joins senders with them."""
    return adjacency_with(edges, least)[0]


def only(adj: DataFrame, which: Column) -> DataFrame:
    """The edges of adj for which `which` holds, laid out as adj is."""
    out = adj.filter(which)
    out._graphspan_hubs = getattr(adj, "_graphspan_hubs", None)
    return out


def along(senders: DataFrame, adj: DataFrame, hashed: bool = False) -> DataFrame:
    """senders (id and others) with each of their edges; adj is adjacency(), or any table of src, dst and w.

    hashed: a bucket's senders fit into memory as a hash table, so that its edges need no sorting."""
    hubs = getattr(adj, "_graphspan_hubs", None)
    if hubs is None:
        senders = senders.hint("shuffle_hash") if hashed else senders
        return senders.join(adj, F.col("id") == F.col("src"))
    own = F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1)).alias("__to")
    dealt = senders.join(F.broadcast(hubs), "id", "left").select(*senders.columns, own)
    dealt = dealt.hint("shuffle_hash") if hashed else dealt
    return dealt.join(adj, (F.col("id") == F.col("src")) & (F.col("__to") == F.col(_PART))).drop("__to", _PART)
