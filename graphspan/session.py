"""Session defaults and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphspan")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the cluster names it.

    Only where it is unset (tests, local runs) a temporary folder is made for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphspan.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphspan-")
        spark.conf.set("spark.graphspan.scratch", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/graphspan-{name}-{uuid.uuid4().hex}"


_open: list[list[DataFrame]] = []


@contextmanager
def clearing() -> Iterator[list[DataFrame]]:
    """Tables that are materialised inside are deleted at the end, but for those that kept() names."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for df in _open.pop():
            discard(df)


def kept(df: DataFrame) -> DataFrame:
    """df, which outlives the clearing() it was made in (and falls to the one around it)."""
    for depth, tables in enumerate(_open):
        if any(x is df for x in tables):
            tables[:] = [x for x in tables if x is not df]
            if depth:
                _open[depth - 1].append(df)
    return df


def _noted(df: DataFrame) -> DataFrame:
    if _open:
        _open[-1].append(df)
    return df


def materialise(df: DataFrame, name: str = "table", compression: str = "snappy", level: int = 3) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again; level is that of zstd.

    Cuts the lineage: a lost executor costs a read of the file, not the work before it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _whole(spark, path):
        df.write.option("parquet.compression.codec.zstd.level", str(level)).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphspan_path = path
    return _noted(out)


def once(df: DataFrame, name: str = "edges") -> DataFrame:
    """df itself if it is a written table, else written: for what is read more than once."""
    return df if getattr(df, "_graphspan_path", None) else materialise(df, name)


def tasks_for(df: DataFrame, rows: int) -> int:
    """As many tasks as a shuffle has, or more, so that none has over a million or so of the rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))


def materialise_with(df: DataFrame, name: str, columns: list[str] | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """materialise(), and aggregates of the rows that ride on the write instead of a job of their own.

    Only `columns` are written, if given; measures see all of df's.
    """
    seen = Observation()
    rows = df.observe(seen, *[m.alias(k) for k, m in measures.items()])
    out = materialise(rows.select(*columns) if columns else rows, name)
    return out, _told(seen, df, measures)


def _told(seen: Observation, rows: DataFrame, measures: dict[str, Column]) -> dict:
    try:
        return seen.get
    except Py4JJavaError:  # a plan found empty while it ran is replaced whole, and with it what observes it
        nothing = rows.sparkSession.createDataFrame([], rows.schema)
        return nothing.agg(*[m.alias(k) for k, m in measures.items()]).first().asDict()


def bucketed(df: DataFrame, keys: list[str], name: str = "table", compression: str = "snappy", **measures: Column) -> tuple[DataFrame, dict]:
    """materialise_with(), laid out by a hash of keys in as many buckets as a shuffle has partitions.

    A join or a grouping by these keys then reads the table where it lies: only the other side moves.
    """
    spark = df.sparkSession
    path, table, buckets = scratch(spark, name), f"graphspan_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation() if measures else None
    rows = df.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else df
    with _whole(spark, path, table):
        rows.repartition(buckets, *keys).write.format("parquet").option("path", path).option("compression", compression).bucketBy(buckets, *keys).saveAsTable(table)
    out = spark.table(table)
    out._graphspan_path, out._graphspan_table = path, table
    _noted(out)
    return out, _told(seen, df, measures) if measures else {}


@contextmanager
def _whole(spark: SparkSession, path: str, table: str | None = None) -> Iterator[None]:
    """Of a write that fails or is cancelled nothing stays."""
    try:
        yield
    except BaseException:
        _delete(spark, path, table)
        raise


def _delete(spark: SparkSession, path: str | None, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    _delete(df.sparkSession, getattr(df, "_graphspan_path", None), getattr(df, "_graphspan_table", None))
