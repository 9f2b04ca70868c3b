"""Whitening of embeddings: exact sums, a centred scatter summed over tasks, cyclic Jacobi on the driver.

Entries become integers, so that sums and deviations are exact. What reaches the driver are sums of
as many numbers as a vector has entries, and their products: bounded by the dimension, whatever the
number of vectors. The driver applies symmetric rotations, pair by pair in cycles, until no entry off
the diagonal counts beside its two diagonal ones, which gives small eigenvalues to high relative
accuracy, and sends the matrix of the leading components back to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from graphspan.session import materialise

_TINY = np.finfo(float).eps
_LARGEST = 2.0**38  # larger entries have no exact integer here
_ROWS = 8192  # rows whose integers are summed in 64 bits


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix.

    A cycle visits every pair once, in rounds of disjoint pairs that are rotated together.
    """
    d = len(matrix)
    a, vectors = np.array(matrix, dtype=np.float64), np.eye(d)
    n = d + d % 2
    seats = np.arange(n)
    least = np.abs(a).max(initial=0.0) * _TINY * _TINY
    for _ in range(sweeps):
        still = True
        for _ in range(n - 1):
            p, q = seats[: n // 2], seats[n // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            off = a[p, q]
            turn = np.abs(off) > np.maximum(_TINY * np.sqrt(np.abs(a[p, p] * a[q, q])), least)
            if turn.any():
                still = False
                p, q, off = p[turn], q[turn], off[turn]
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                new_p, new_q = a[p, p] - t * off, a[q, q] + t * off
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                for m in (a, vectors):
                    cols_p, cols_q = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = new_p, new_q
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if still:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def integers(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vectors have dim finite entries, and those entries as integers, floor(1024 c) + 100000."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # a null entry is NaN here
    long = np.maximum(size, 0)
    fit = np.flatnonzero(size == dim)
    x = flat.reshape(-1, dim) if len(fit) == len(size) else flat[(np.cumsum(long) - long)[fit][:, None] + np.arange(dim)]
    sound = (np.abs(x) < _LARGEST).all(axis=1)  # not so for NaN
    return fit[sound], np.floor(1024 * x[sound]).astype(np.int64) + 100_000


def _sums(vectors: DataFrame) -> DataFrame:
    """(dim, pos, n, s) for each length of vectors: their number and the exact sum of each entry."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            for dim in np.unique(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist():
                if not dim:
                    continue
                _, x = integers(column, dim)
                had = seen.setdefault(dim, [0, [0] * dim])
                for i in range(0, len(x), _ROWS):
                    part = x[i : i + _ROWS]
                    had[0] += len(part)
                    had[1] = [a + b for a, b in zip(had[1], part.sum(axis=0).tolist(), strict=True)]
        for dim, (n, sums) in seen.items():
            if n:
                yield pa.record_batch([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["dim", "pos", "n", "s"])

    return vectors.mapInArrow(found, "dim int, pos int, n long, s decimal(38,0)").groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _scatter(rows: DataFrame, centred: Callable[[pa.RecordBatch], np.ndarray], d: int) -> np.ndarray:
    """The sum of c c' over all rows, c being centred(batch)'s rows; a task sends its own sum."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            c = centred(batch)
            total += c.T @ c
        for i in range(d):
            yield pa.record_batch([pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array(total[i, i:])], ["i", "j", "v"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(found, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sum over entries of (n y - rest)^2, exactly, as decimals; null beyond 38 digits."""
    most = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if most * most * max(1, len(rest)) < 1 << 62:
        z = n * y - rest
        return pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
    z = n * y.astype(object) - rest.astype(object)
    return pa.array([Decimal(x) if x < 10**38 else None for x in (z * z).sum(axis=1).tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries (or such of 2^38 or more, which
    have no exact integer here) are dropped, and so are vectors of another length than the commonest
    (of several, the longest). Every other entry c counts as x = floor(1024 c) + 100000, and all those
    vectors are the fit list: n of them with sums S. Components are eigenvectors of their covariance
    (divisor n), by falling eigenvalue e, at most `components` and no more than the covariance has
    eigenvalues beyond rounding (none for a single vector, or equal ones: no rows then). whitened is
    (x - S/n) on the component over sqrt(e), explained is e over the trace, deviation the sum of
    (n x - S)^2 as decimal(38,0) (null beyond its 38 digits), identity_error the largest entry of whitened's covariance less the
    identity. Ids are not looked at: null and repeated ids are rows of their own. Other columns of
    vectors are not returned.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    shape = f"id {kind.simpleString()}, deviation decimal(38,0), w array<double>"
    out = f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sums = materialise(_sums(rows.select("v")), "sums")
    common = sums.filter("pos = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], out)
    n, d = common["n"], common["dim"]
    told = {r["pos"]: int(r["s"]) for r in sums.filter(F.col("dim") == d).collect()}
    middle = np.array([told[j] // n for j in range(d)])
    rest = np.array([told[j] % n for j in range(d)])  # S = n middle + rest
    mean = rest / n

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return integers(batch.column(0), d)[1] - middle - mean

    covariance = _scatter(rows.select("v"), centred, d) / n
    values, basis = jacobi(covariance)
    doubt = d * _TINY * (np.abs(basis) * np.sqrt(np.diag(covariance))[:, None]).sum(axis=0) ** 2  # what rounding may amount to
    chosen = np.flatnonzero(values > doubt)[:components]
    if not len(chosen):
        return spark.createDataFrame([], out)
    matrix = basis[:, chosen] / np.sqrt(values[chosen])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), d)
            y = x - middle
            w = (y - mean) @ matrix
            offsets = pa.array(np.arange(len(at) + 1) * len(chosen), pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(at)), _deviations(y, n, rest), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["id", "deviation", "w"])

    white = materialise(rows.mapInArrow(projected, shape), "whitened")
    k = len(chosen)
    means = np.array(white.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first())

    def about_mean(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - means

    error = float(np.abs(_scatter(white.select("w"), about_mean, k) / n - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e / np.trace(covariance))) for e in values[chosen]])
    each = white.select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select(
        "id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    """deviation is a long here, and null where it has no room in one."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).withColumnRenamed("id", "vec_id")
