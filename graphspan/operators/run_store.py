"""A store of run records in which several tables change as one.

A commit writes its rows of every table into folders of its own, and then a marker that names it.
Readers join the rows with the markers, so that a commit whose writer died is never seen, in whole
or in part, and one that is published is seen in all tables at once. Writers share nothing: each
commit has an id of its own, and none waits for another.

Every commit says in which version of the schema it was written. Rows of older versions lack the
columns that came later; they are read with those columns' defaults.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: fixed values: of each table the columns, their types, the version they came in and their defaults
TABLES: dict[str, list[tuple[str, str, int, object]]] = {
    "main": [
        ("sha", "string", 1, None), ("date", "timestamp", 1, None), ("seed", "long", 1, None), ("threads", "int", 1, None), ("hosts", "string", 1, None),
        ("dataset", "string", 1, None), ("algorithm", "string", 1, None), ("parameters", "string", 1, None), ("diameter", "long", 1, None),
        ("total_time_ms", "long", 1, None), ("offline", "boolean", 2, False), ("final_diameter_time_ms", "long", 4, None), ("killed", "boolean", 6, False),
    ],
    "counters": [("sha", "string", 1, None), ("counter", "string", 1, None), ("outer_iter", "int", 1, None), ("inner_iter", "int", 1, None), ("count", "long", 1, None)],
    "rand_cluster_iterations": [
        ("sha", "string", 5, None), ("iteration", "int", 5, None), ("iteration_radius", "long", 5, None), ("duration_ms", "long", 5, None), ("num_centers", "long", 5, None),
    ],
}
VERSION = 6


def schema(table: str, version: int = VERSION) -> str:
    """The columns a table had in a version; none if it didn't exist."""
    return ", ".join(f"`{name}` {kind}" for name, kind, since, _ in TABLES[table] if since <= version)


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        """path is a folder that driver and executors share; it need not exist."""
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        target, files = self._file(path)
        return files.exists(target)

    def stage(self, main: DataFrame, version: int = VERSION, **others: DataFrame) -> str:
        """Write a commit's rows, of main and of the other TABLES, and return its id; nothing is visible yet.

        Only the columns that the version has are written. A table that the version lacks is an
        error, and so are columns that a frame lacks. If a write fails, what was written is deleted.
        """
        commit = uuid.uuid4().hex
        try:
            for table, rows in {"main": main, **others}.items():
                columns = [(name, kind) for name, kind, since, _ in TABLES[table] if since <= version]
                if not columns:
                    raise ValueError(f"version {version} has no table {table}")
                rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns]).write.parquet(f"{self.path}/{table}/commit={commit}")
        except BaseException:
            self.drop(commit)
            raise
        return self._pending(commit, version)

    def _pending(self, commit: str, version: int) -> str:
        return f"{commit}-{version}"

    def publish(self, staged: str) -> None:
        """Make a staged commit visible. The marker appears under its name when it is complete."""
        commit, version = staged.split("-")
        told = {"commit": commit, "version": int(version), "at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        hidden, files = self._file(f"{self.path}/commits/.{commit}")
        stream = files.create(hidden, True)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        if not files.rename(hidden, self._file(f"{self.path}/commits/{commit}.json")[0]):
            raise OSError(f"commit {commit} can't be published")

    def append(self, main: DataFrame, version: int = VERSION, **others: DataFrame) -> str:
        """stage() and publish(); the commit's id."""
        staged = self.stage(main, version, **others)
        self.publish(staged)
        return staged.split("-")[0]

    def commits(self) -> DataFrame:
        """(commit, version, at) of what is published."""
        kinds = "commit string, version int, at timestamp"
        if not self._there(f"{self.path}/commits"):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).json(f"{self.path}/commits")

    def table(self, name: str) -> DataFrame:
        """A table's visible rows in the newest schema, with the version they were written in."""
        path, kinds = f"{self.path}/{name}", schema(name)
        if not self._there(path):
            return self.spark.createDataFrame([], f"{kinds}, version int")
        rows = self.spark.read.schema(f"{kinds}, commit string").parquet(path).join(self.commits().select("commit", "version"), "commit")
        value = lambda column, default: F.col(column) if default is None else F.coalesce(column, F.lit(default))
        return rows.select(*[value(column, default).alias(column) for column, _, _, default in TABLES[name]], "version")

    def drop(self, commit: str) -> None:
        """Delete a commit: its marker first, so that no reader sees a part of it."""
        for path in (f"commits/{commit}.json", *(f"{table}/commit={commit}" for table in TABLES)):
            target, files = self._file(f"{self.path}/{path}")
            files.delete(target, True)

    def abandoned(self, before: datetime.datetime) -> list[str]:
        """Commits that were staged before a time and have no marker: their writers died."""
        published = {r["commit"] for r in self.commits().select("commit").collect()}
        found = set()
        for table in TABLES:
            target, files = self._file(f"{self.path}/{table}")
            for status in files.listStatus(target) if files.exists(target) else ():
                name = status.getPath().getName()
                if name.startswith("commit=") and status.getModificationTime() < before.timestamp() * 1000:
                    found.add(name.removeprefix("commit="))
        return sorted(found - published)
