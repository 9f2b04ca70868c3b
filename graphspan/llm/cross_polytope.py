"""Nearest neighbours by cross-polytope hashing with several probes a table, ranked exactly.

A vector's direction is turned by pseudo-random rotations (three rounds of random signs and a fast
Hadamard transform) and goes to the nearest signed axis; a few such digits make a bucket, and each
table has rotations of its own. Norms go by octaves, which are part of the bucket. Every row lies in
one bucket of each table; a query visits, in each, the buckets whose axes cost it least. Rows and
queries meet bucket by bucket, and only each bucket's nearest leave it.

How many buckets a query visits is measured: for a bounded sample of queries all rows are searched,
and the number is the one that reaches all but a small share of their true neighbours. Where even
many visits don't, buckets are made larger. Queries that meet fewer rows than they ask for are
searched against all rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from graphspan.operators.skew import split_hot
from graphspan.session import materialise, materialise_with

_SAMPLE = 128  # queries that are searched in full to find how many buckets to visit
_VISITS = 512  # buckets that a query visits in one table and octave, at most
_BLOCK = 4096  # queries of a search of all rows
_CHUNK = 1 << 22  # distances held at once
_KEYS = ["tab", "dim", "octave", "bucket"]


def sound(value: Column) -> Column:
    """Whether a vector is not null, empty or zero, and has finite entries alone."""
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _hadamard(y: np.ndarray) -> np.ndarray:
    n, width, h = len(y), y.shape[1], 1
    while h < width:
        pairs = y.reshape(n, -1, 2, h)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return y / math.sqrt(width)


class Polytopes:
    """The buckets of one table for vectors of one length: digits of so many axes each."""

    def __init__(self, dim: int, table: int, buckets: float):
        self.width = 1 << (dim - 1).bit_length()
        self.axes: list[int] = []
        while buckets > 1 or not self.axes:
            self.axes.append(max(1, min(self.width, 1 << (math.ceil(buckets / 2) - 1).bit_length())))
            buckets /= 2 * self.axes[-1]
        signs = np.random.default_rng([table, dim, 97])
        self.signs = signs.integers(0, 2, (len(self.axes), 3, self.width)) * 2.0 - 1

    def turned(self, x: np.ndarray) -> list[np.ndarray]:
        """For each digit the directions of x in its rotation, its axes' coordinates only."""
        peak = np.abs(x).max(axis=1, keepdims=True)  # scaled first, lest squares run over or under
        unit = np.zeros((len(x), self.width))
        unit[:, : x.shape[1]] = x / peak
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        out = []
        for axes, signs in zip(self.axes, self.signs, strict=True):
            y = unit
            for s in signs:
                y = _hadamard(y * s)
            out.append(y[:, :axes])
        return out

    def bucket(self, x: np.ndarray) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for y in self.turned(x):
            axis = np.abs(y).argmax(axis=1)
            code = code * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return code

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` buckets nearest to each of x, nearest first (fewer if there are no more).

        A digit costs the square of what its coordinate lacks of the largest; costs add up, so the
        best prefixes are enough to find the best buckets.
        """
        parts = []
        step = max(1, _CHUNK // (most * 2 * max(self.axes)))
        for i in range(0, len(x), step):
            code = cost = None
            for y in self.turned(x[i : i + step]):
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                own = (np.abs(y).max(axis=1, keepdims=True) - both) ** 2
                if cost is None:
                    cost, code = own, np.broadcast_to(np.arange(own.shape[1]), own.shape)
                else:
                    cost = (cost[:, :, None] + own[:, None, :]).reshape(len(y), -1)
                    code = (code[:, :, None] * own.shape[1] + np.arange(own.shape[1])).reshape(len(y), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :most]
                cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            parts.append(code)
        return np.concatenate(parts)


def octave(x: np.ndarray) -> np.ndarray:
    """The norm's logarithm to base two, rounded."""
    peak = np.abs(x).max(axis=1)
    return np.floor(np.log2(peak) + np.log2(np.sqrt(((x / peak[:, None]) ** 2).sum(axis=1))) + 0.5).astype(np.int32)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.Table]]:
    """The batch's rows by the length of their vectors."""
    table = pa.Table.from_batches([batch])
    size = pc.list_value_length(table[name]).to_numpy()
    for dim in np.unique(size).tolist():
        yield dim, table.filter(pa.array(size == dim)) if (size != dim).any() else table


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, from their differences; scaled where squares would run over."""
    d = np.abs(q - x)
    peak = d.max(axis=1, initial=0.0)
    scale = np.where((peak > 1e150) | (peak < 1e-150), np.where(peak > 0, peak, 1.0), 1.0)
    d = d / scale[:, None]
    return scale * np.sqrt((d * d).sum(axis=1))


def _nearest(qids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int, vectors: bool = False) -> pa.Table:
    """For each of q the k nearest rows of x, whose ids come as sorted lists; smaller ids first in ties.

    A product of matrices leaves what may be among the k nearest, given its rounding; their
    distances are then taken from the differences.
    """
    norm_q, norm_x = (q * q).sum(axis=1), (x * x).sum(axis=1)
    out_q, out_x = [], []
    step = max(1, _CHUNK // max(1, len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(q), step):
            about = norm_q[i : i + step, None] + norm_x - 2 * (q[i : i + step] @ x.T)
            slack = 1e-12 * (norm_q[i : i + step, None] + norm_x.max(initial=0))
            limit = (np.partition(about, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.full((len(about), 1), np.inf)) + slack
            a, b = np.nonzero(~(about > limit))  # NaN stays
            out_q.append(a + i)
            out_x.append(b)
    a, b = np.concatenate(out_q), np.concatenate(out_x)
    step = max(1, _CHUNK // q.shape[1])
    score = np.concatenate([_distances(q[a[i : i + step]], x[b[i : i + step]]) for i in range(0, len(a), step)] or [np.zeros(0)])
    lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    n = lengths[b]
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    each = np.repeat(starts[b], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a, b, score, found = np.repeat(a, n), np.repeat(b, n), np.repeat(score, n), flat[each]
    order = np.lexsort((found, score, a))
    a, b, score, found = a[order], b[order], score[order], found[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    out = {"qid": qids[a[keep]], "id": found[keep], "score": score[keep]}
    if vectors:
        out["v"] = pa.array(list(x[b[keep]]), pa.list_(pa.float64()))
    return pa.table(out)


def _all_rows(index: DataFrame, block: list, k: int, vectors: bool = False) -> DataFrame:
    """(qid, id, score[, v]): each task's nearest rows of every query of the block (rows with qid, v)."""
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in block}:
        own = [r for r in block if len(r["v"]) == dim]
        queries[dim] = np.array([r["qid"] for r in own]), np.array([r["v"] for r in own], dtype=np.float64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, table in _by_dim(batch, "v"):
                if dim in queries:
                    yield from _nearest(*queries[dim], _matrix(table["v"], dim), table["ids"].combine_chunks(), k, vectors).to_batches()

    rows = index.select("v", "ids").mapInArrow(found, "qid long, id long, score double" + ", v array<double>" * vectors)
    return _first(rows, k)


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of each query with the smallest scores, then ids; what a task has is cut before it is sent."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def plan_visits(index: DataFrame, queries: DataFrame, total: int, k: int, tables: int, aim: int, recall: float) -> tuple[float, int, int]:
    """(buckets a table, visits, octaves): how fine buckets are and how many of them a query visits.

    _SAMPLE queries, by hash, are searched against all rows. octaves is how far apart a query's
    octave and a neighbour's may be among them; visits is the least number with which the share
    `recall` of their neighbours lies in a visited bucket of some table. Buckets hold `aim` rows on
    average; if _VISITS visits do not reach the share, they get four times as large, and so on.
    """
    sample = queries.orderBy(F.xxhash64("v"), "qid").limit(_SAMPLE).select("qid", "v").collect()
    pairs = _all_rows(index, sample, k + 1, vectors=True).collect()
    asked = {r["qid"]: np.array([r["v"]], dtype=np.float64) for r in sample}
    met = [(asked[p["qid"]], np.array([p["v"]])) for p in pairs if p["score"] > 0]  # copies share every bucket
    buckets = max(1.0, total / aim)
    if not met:
        return buckets, 1, 0
    octaves = max(abs(int(octave(a)[0]) - int(octave(b)[0])) for a, b in met)
    while True:
        places = np.full(len(met), _VISITS)
        for t in range(tables):
            made: dict[int, Polytopes] = {}
            for i, (a, b) in enumerate(met):
                own = made.setdefault(a.shape[1], Polytopes(a.shape[1], t, buckets))
                at = np.flatnonzero(own.visits(a, _VISITS)[0] == own.bucket(b)[0])
                if len(at):
                    places[i] = min(places[i], at[0])
        needed = int(np.sort(places)[math.ceil(recall * len(places)) - 1]) + 1
        if needed <= _VISITS or buckets <= 2:
            return buckets, min(needed, _VISITS), octaves
        buckets = max(1.0, buckets / 4)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2, aim: int = 256, recall: float = 0.96,
    part: int = 1024,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows nearest to each query among those found, by Euclidean distance.

    rows and queries have integer ids and vectors (arrays of numbers). Those with a null id, and
    vectors that are null, empty, zero or hold null or non-finite entries, take no part; vectors of
    different lengths don't meet. Rows equal in id and vector count once, queries too; a query's own
    row, of equal id and vector, is no answer to it. Rows of one id and several vectors are rows of
    their own, and so are such queries, whose answers stand under one query_id. Ties go to smaller
    ids. Every query gets k rows, or all others of its length if those are fewer. Other columns are
    not looked at.

    recall is the share of true neighbours that the number of visits is chosen for, on a sample of
    queries (plan_visits()). tables, and `aim` rows a bucket, shift work between moving rows and
    comparing. Copies of a vector are one entry with their k + 1 smallest ids; a bucket of more than
    `part` rows is split, by hash, into parts that each meet its queries (above a billion rows in
    all `part` grows with them, so that crowded buckets are a million at most).
    """
    spark = rows.sparkSession
    value = F.col("v")
    kind = rows.schema[vector_col].dataType
    array = kind if kind.elementType == T.FloatType() else T.ArrayType(T.DoubleType())
    taken = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(array).alias("v")).filter(F.col("id").isNotNull() & sound(value)).distinct()
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = taken(rows).withColumn("copy", copy).filter(F.col("copy") <= k + 1)
    index, seen = materialise_with(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "index", n=F.count("*"))
    asked = materialise(taken(queries), "queries")
    several = asked.groupBy("v").agg(F.count("*").alias("asking")).withColumn("qid", F.monotonically_increasing_id())
    several = materialise(several, "query-vectors")  # written, so that numbers stay
    total = seen["n"]
    buckets, visits, octaves = plan_visits(index, several, total, k, tables, aim, recall)
    name = "tab int, dim int, octave int, bucket long"

    def keyed(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], Polytopes] = {}
        for batch in batches:
            for dim, table in _by_dim(batch, "v"):
                x = _matrix(table["v"], dim)
                ring = octave(x)
                for t in range(tables):
                    if (dim, t) not in made:
                        made[dim, t] = Polytopes(dim, t, buckets)
                    codes = made[dim, t].visits(x, visits) if asking else made[dim, t].bucket(x)[:, None]
                    for shift in range(-octaves, octaves + 1) if asking else (0,):
                        n = codes.shape[1]
                        step = max(1, (1 << 14) // n)
                        for i in range(0, len(x), step):
                            at = np.repeat(np.arange(i, min(len(x), i + step)), n)
                            put = {"tab": pa.array(np.full(len(at), t, np.int32)), "dim": pa.array(np.full(len(at), dim, np.int32)), "octave": pa.array(ring[at] + np.int32(shift)), "bucket": pa.array(codes[i : i + step].ravel())}
                            rest = table.take(pa.array(at))
                            yield from pa.table(put | {c: rest[c] for c in rest.column_names}).combine_chunks().to_batches()

    vector = array.simpleString()
    lying = index.mapInArrow(lambda b: keyed(b, False), f"{name}, v {vector}, ids array<long>")
    visiting = several.select("v", "qid").mapInArrow(lambda b: keyed(b, True), f"{name}, v {vector}, qid long")
    many = max(part, math.ceil(total * tables / 1_000_000))
    crowded = lying.groupBy(*_KEYS).agg(F.count("*").alias("n")).filter(F.col("n") > many).select(*_KEYS, F.ceil(F.col("n") / many).cast("int").alias("parts"))
    crowded = F.broadcast(materialise(crowded, "crowded"))  # a million keys at most
    parts = F.coalesce("parts", F.lit(1))
    nothing, none = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    lying = lying.join(crowded, _KEYS, "left").select(*_KEYS, F.pmod(F.hash("v", F.lit(7)), parts).alias("part"), "v", "ids", nothing.alias("qid"))
    visiting = visiting.join(crowded, _KEYS, "left").select(*_KEYS, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "v", none.alias("ids"), "qid")

    def meet(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        asks = table["qid"].is_valid()
        q, x = table.filter(asks), table.filter(pc.invert(asks))
        if not len(q) or not len(x):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = x["ids"].combine_chunks()
        return _nearest(q["qid"].to_numpy(), _matrix(q["v"], dim), _matrix(x["v"], dim), ids, k + 1)

    found = lying.union(visiting).groupBy(*_KEYS, "part").applyInArrow(meet, "qid long, id long, score double")
    found = materialise(_first(found.distinct(), k + 1), "met")
    # which queries need all rows: fewer answers than asked for, and than their length has
    sizes = index.groupBy(F.size("v").alias("dim")).agg(F.sum(F.size("ids")).alias("there"))
    short = several.join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").withColumn("dim", F.size("v"))
    short, missing = materialise_with(short.filter(F.coalesce("n", F.lit(0)) <= k).join(sizes, "dim").filter(F.coalesce("n", F.lit(0)) < F.least("there", F.lit(k + 1))).select("qid", "v"), "short", n=F.count("*"))
    if missing["n"]:
        blocks = math.ceil(missing["n"] / _BLOCK)
        dealt = short.withColumn("block", F.pmod(F.hash("qid"), F.lit(blocks)))
        extra = [materialise(_all_rows(index, dealt.filter(F.col("block") == i).collect(), k + 1), "searched") for i in range(blocks)]
        found = found.join(short.select("qid"), "qid", "left_anti")
        for more in extra:
            found = found.union(more)
    best = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("best"))
    answers = materialise(several.join(best, "qid").select("v", "asking", "best"), "answers")
    hot, cold = split_hot(asked, answers, "v", "asking", seen["n"])
    cols = ["id", "best"]
    own = lambda b: ~((b["score"] == 0) & (b["id"] == F.col("id")))
    each = hot.select(*cols).union(cold.select(*cols)).select(F.col("id").alias("query_id"), F.slice(F.filter("best", own), 1, k).alias("best"))
    out = each.select("query_id", F.posexplode("best").alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))


def op13(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0)).withColumnRenamed("id", "vec_id")
