"""Exact cosine links between vectors by dual traversal of cover trees.

On unit vectors, cosine >= c is chord distance <= sqrt(2 - 2c). The top of a label's cover tree is
shared: large labels have centres, far from each other, out of a small sample of theirs; every
vector goes to its nearest centre, and a pair of centres is dropped if it is further apart than both
covering radii plus the threshold. What a centre covers is dealt into cells of bounded size, and
every pair of cells of a pair that is left is one group of work. In it each cell becomes a cover
tree: nested levels of centres whose radii halve, every node with the largest distance from its
centre to a vector below it. Pairs of nodes descend together, and a pair is dropped as soon as the
distance of its centres exceeds both radii plus the threshold; what remains is compared.

Equal vectors are one row with a count, so a vector that a third of all rows share costs one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphspan.operators.components import connected_components
from graphspan.operators.skew import split_hot
from graphspan.session import materialise, materialise_with

_SLACK = 1e-7  # the rounding of sqrt(2 - 2 x.y) near zero is 2e-8


class CoverTree:
    """Levels of centres over unit vectors: radii 2, 1, 1/2 ... down to `finest`, then the vectors."""

    def __init__(self, x: np.ndarray, finest: float):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []  # centres, radii, children
        members = [np.arange(len(x))]
        centres, radius = np.zeros(1, np.int64), 2.0
        radii = [self._spread(0, members[0])]
        while radius / 2 >= finest:
            radius /= 2
            children, below, spread, kids = [], [], [], []
            for centre, own in zip(centres.tolist(), members, strict=True):
                begin = len(children)
                left = own
                while len(left):  # the parent's centre stays one: the levels are nested
                    c = centre if len(left) == len(own) else int(left[0])
                    near = self._distances(c, left) <= radius
                    near[left == c] = True
                    children.append(c)
                    below.append(left[near])
                    spread.append(self._spread(c, left[near]))
                    left = left[~near]
                kids.append(np.arange(begin, len(children)))
            self.levels.append((centres, np.array(radii), kids))
            centres, members, radii = np.array(children), below, spread
        self.levels.append((centres, np.array(radii), members))

    def _distances(self, c: int, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[own] @ self.x[c])))

    def _spread(self, c: int, own: np.ndarray) -> float:
        return float(self._distances(c, own).max()) if len(own) else 0.0


def dual_links(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with x_a[i] . x_b[j] >= cosine."""
    reach = math.sqrt(2 - 2 * cosine) + _SLACK
    pairs = {0: np.zeros(1, np.int64)} if len(a.x) and len(b.x) else {}
    for depth in range(len(a.levels)):
        last = depth == len(a.levels) - 1
        kids_a, kids_b = a.levels[depth][2], b.levels[depth][2]
        if last:
            break
        centre_a, radius_a, _ = a.levels[depth + 1]
        centre_b, radius_b, _ = b.levels[depth + 1]
        onward: dict[int, np.ndarray] = {}
        for node, others in pairs.items():
            own, their = kids_a[node], np.concatenate([kids_b[o] for o in others.tolist()])
            distance = np.sqrt(np.maximum(0, 2 - 2 * (a.x[centre_a[own]] @ b.x[centre_b[their]].T)))
            stay = distance <= radius_a[own][:, None] + radius_b[their][None, :] + reach
            for i, child in enumerate(own.tolist()):
                if stay[i].any():
                    onward[child] = their[stay[i]]
        pairs = onward
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for node, others in pairs.items():
        own, their = kids_a[node], np.concatenate([kids_b[o] for o in others.tolist()])
        i, j = np.nonzero(a.x[own] @ b.x[their].T >= cosine)
        rows.append(own[i])
        cols.append(their[j])
    return np.concatenate(rows), np.concatenate(cols)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n points over edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, end, low)
            np.minimum.at(label, before[end], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _work(table: pa.Table, cosine: float, finest: float) -> pa.Table:
    side = table["mine"].to_numpy()
    node, n = table["node"].to_numpy(), table["n"].to_numpy()
    flat = table["unit"].combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    both = table["both"][0].as_py()
    first = np.flatnonzero(side) if not both else np.arange(len(node))
    second = first if both else np.flatnonzero(~side)
    tree = CoverTree(x[first], finest)
    i, j = dual_links(tree, tree if both else CoverTree(x[second], finest), cosine)
    a, b = first[i], second[j]
    if both:
        a, b = a[a < b], b[a < b]
    links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
    label = _labels(len(node), a, b)
    some = np.flatnonzero(links)
    return pa.table({"node": node[some], "links": links[some].astype(np.int64), "to": node[label[some]]})


def _centres(units: DataFrame, sizes: DataFrame, cell: int, centres: int) -> DataFrame:
    """(group, centre, unit): of each group one vector a cell, `centres` at most, each the furthest
    from those before it, out of a sample by hash of about four times as many."""
    share = F.lit(4.0 * centres) / F.col("rows") * (1 << 40)
    some = units.join(sizes, "group").filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 40)) < share)

    def spread(table: pa.Table) -> pa.Table:
        x = np.array(table.sort_by("node")["unit"].to_pylist())
        chosen, near = [0], np.full(len(x), np.inf)
        while len(chosen) < min(centres, len(x), -(-table["rows"][0].as_py() // cell)):
            near = np.minimum(near, 2 - 2 * (x @ x[chosen[-1]]))
            chosen.append(int(np.argmax(near)))
        chosen = sorted(set(chosen))
        return pa.table({"group": table["group"].take(pa.array([0] * len(chosen))), "centre": np.arange(len(chosen)), "unit": pa.array(x[chosen].tolist(), pa.list_(pa.float64()))})

    kind = units.schema["group"].dataType.simpleString()
    return some.select("group", "rows", "node", "unit").groupBy("group").applyInArrow(spread, f"group {kind}, centre long, unit array<double>")


def _pairs(units: DataFrame, total: int, reach: float, cell: int, centres: int) -> DataFrame:
    """Every vector once for each pair of cells it is compared in: group, i, j, mine, both, node, n, unit."""
    large = materialise(units.groupBy("group").agg(F.count("*").alias("rows")).filter(F.col("rows") >= 4 * cell), "labels")
    top = materialise(_centres(units, large, cell, centres), "centres")
    known = top.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("centre", "unit"))), lambda c: c["unit"]).alias("centres"))
    known, seen = materialise_with(known.join(large, "group"), "known", n=F.count("*"), hot=F.count(F.when(F.col("rows") >= total / 100, 1)))
    hot = F.broadcast(known.filter(F.col("rows") >= total / 100).select("group", "centres"))  # a hundred labels at most
    rest = units.join(F.broadcast(hot.select("group")), "group", "left_anti")
    rest = rest.join(known.filter(F.col("rows") < total / 100).select("group", "centres"), "group", "left") if seen["n"] > seen["hot"] else rest.withColumn("centres", F.lit(None).cast("array<array<double>>"))
    labelled = units.join(hot, "group").unionByName(rest)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    chord = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b)))
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(chord(F.col("unit"), c).alias("far"), i.cast("long").alias("centre"))))
    placed = labelled.withColumn("near", F.coalesce(near, F.struct(F.lit(0.0).alias("far"), F.lit(-1).cast("long").alias("centre"))))
    placed = materialise(placed.select("group", "node", "n", "unit", F.struct("group", "near.centre").alias("ball"), F.col("near.far").alias("far")), "placed")
    balls = materialise(placed.groupBy("ball").agg(F.count("*").alias("rows"), F.max("far").alias("radius")), "balls")
    balls = balls.select("ball", "ball.group", "ball.centre", "radius", "rows", F.ceil(F.col("rows") / cell).cast("int").alias("cells"))
    balls = balls.join(top.withColumnRenamed("unit", "at"), ["group", "centre"], "left")
    other = balls.select("group", *[F.col(x).alias(f"o_{x}") for x in ("centre", "radius", "cells", "at")])
    close = F.col("at").isNull() | (chord(F.col("at"), F.col("o_at")) <= F.col("radius") + F.col("o_radius") + reach)
    met = balls.join(other, "group").filter(close).groupBy("ball", "rows", "cells").agg(F.collect_list(F.struct(F.col("o_centre").alias("centre"), F.col("o_cells").alias("cells"))).alias("met"))
    hot, cold = split_hot(placed, materialise(met, "meetings"), "ball", "rows", total)
    cols = ["group", "ball", "node", "n", "unit", "cells", "met"]
    rows = hot.select(*cols).union(cold.select(*cols))
    number = lambda centre, part: F.shiftleft(centre + 1, 40) + part
    rows = rows.withColumn("own", number(F.col("ball.centre"), F.pmod(F.xxhash64("node", "unit"), F.col("cells"))))
    rows = rows.withColumn("them", F.explode("met")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("them.cells") - 1).cast("long"))))
    rows = rows.withColumn("other", number(F.col("them.centre"), F.col("part")))
    return rows.select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("mine"),
        (F.col("own") == F.col("other")).alias("both"), "node", "n", "unit",
    )


def cosine_links(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cell: int = 2000,
    centres: int = 64,
) -> DataFrame:
    """(id, n_links, component_id, kept): exact links of vectors with equal labels and cosine >= `cosine`.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null
    label, link with nothing; so do vectors of unequal length. Ids are integers; repeated ids are
    rows of their own that link like any others. A null id is kept without links. Other columns
    are not returned. cell bounds the vectors of a cell, centres those at the top of a large label,
    one of at least 4 cells; those of a hundredth of all rows or more, a hundred at most, have their
    centres broadcast, the others are joined with theirs. What links are vectors: an id on unlike
    vectors has the links and the component of each in its rows.
    """
    value = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.array_max(F.transform(value, F.abs)) > 0),
        F.lit(False),
    )
    rows = rows.withColumn("ok", sound)
    peak = F.array_max(F.transform(value, F.abs))  # scaled first, lest squares run over or under
    scaled = rows.filter("ok").withColumn("p", peak).withColumn("v", F.transform(value, lambda x: x / F.col("p"))).drop("p")
    distinct = scaled.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialise(distinct, "distinct-vectors")  # written, so that numbers stay
    units = distinct.withColumn("norm", norm).select("label", F.size("v").alias("dim"), "node", "n", F.transform(value, lambda x: x / F.col("norm")).alias("unit"))
    units = units.withColumn("group", F.struct("label", "dim")).drop("label", "dim")
    total = distinct.count()
    pairs = _pairs(units, total, math.sqrt(2 - 2 * cosine) + _SLACK, cell, centres)
    finest = math.sqrt(2 - 2 * cosine) / 2
    found = materialise(
        pairs.groupBy("group", "i", "j").applyInArrow(lambda t: _work(t, cosine, finest), "node long, links long, to long"), "vector-links"
    )
    parts = materialise(connected_components(found.filter("node <> to"), "node", "to"), "parts").withColumnRenamed("id", "node")
    smallest = parts.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.join(degree, "node", "left").join(parts.join(smallest, "component"), "node", "left").select(
        F.struct("label", "v").alias("same"), "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("smallest", "least").alias("component_id")
    )
    hot, cold = split_hot(scaled.withColumn("same", F.struct("label", "v")), materialise(known, "vector-classes"), "same", "n", rows.count())
    shape = ["id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"]
    lone = rows.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = hot.select(*shape).union(cold.select(*shape)).union(lone)
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    return cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
