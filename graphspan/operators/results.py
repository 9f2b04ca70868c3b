"""Run records: specifications, identifiers, the store and what was run before."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: fixed values: name stored for each algorithm, and the pattern of its specification, in the order tried
SPECS = [
    ("SequentialSingle", r"sequential-single"),
    ("Sequential", r"sequential"),
    ("DeltaStepping", r"delta-stepping\((\d+)\)"),
    ("HyperBall", r"hyperball\((\d+)\)"),
    ("RandCluster", r"rand-cluster\((\d+), *(\d+)\)"),
    ("RandClusterGuess", r"rand-cluster-guess\((\d+), *(\d+), *(\d+)\)"),
    ("Bfs", r"bfs"),
]
#: how the stored parameters of an algorithm join its numbers
_JOINS = {"RandCluster": "{}:{}", "RandClusterGuess": "{}:{},{}", "DeltaStepping": "{}", "HyperBall": "{}"}

MAIN = (
    "sha string, date timestamp, seed long, threads int, hosts string, dataset string, algorithm string, parameters string, "
    "diameter long, total_time_ms long, offline boolean, final_diameter_time_ms long, killed boolean"
)
KEYS = ["seed", "threads", "hosts", "dataset", "algorithm", "parameters", "offline"]


@dataclass(frozen=True)
class Spec:
    algorithm: str
    numbers: tuple[int, ...]

    @property
    def parameters(self) -> str:
        return _JOINS.get(self.algorithm, "").format(*self.numbers)


def parse_spec(text: str) -> Spec:
    """The first pattern found anywhere in the text; ValueError if none is, or a number is out of range."""
    for name, pattern in SPECS:
        if found := re.search(pattern, text):
            numbers = tuple(map(int, found.groups()))
            if name == "HyperBall" and not 4 <= numbers[0] <= 16:
                raise ValueError("hyperball's parameter is from 4 to 16")
            return Spec(name, numbers)
    raise ValueError(f"no such algorithm: {text}")


def spec_columns(spec: Column) -> tuple[Column, Column]:
    """parse_spec() over a column: (algorithm, parameters), null where nothing matches."""
    name, parameters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for algorithm, pattern in reversed(SPECS):
        hit = spec.rlike(pattern)
        pieces = re.split(r"\{\}", _JOINS.get(algorithm, ""))
        joined = F.lit(pieces[0])
        for i, piece in enumerate(pieces[1:], 1):
            joined = F.concat(joined, F.regexp_extract(spec, pattern, i), F.lit(piece))
        name, parameters = F.when(hit, F.lit(algorithm)).otherwise(name), F.when(hit, joined).otherwise(parameters)
    return name, parameters


def run_id(*parts: object) -> str:
    """Six hex digits of a digest over what makes a run."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:6]


def run_id_column(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 6)


COUNTERS = "sha string, counter string, outer_iter int, inner_iter int, count long"


def read_csv(spark: SparkSession, path: str, schema: str = MAIN) -> DataFrame:
    """Runs or counters (schema COUNTERS) kept as CSV with a header line."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def append_run(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Add runs (in the order of MAIN) to the store; a killed run has diameter -1."""
    spark.createDataFrame(rows, MAIN).write.mode("append").parquet(path)


def already_run(store: DataFrame, **keys: object) -> DataFrame:
    """(sha) of one run with these keys, or nothing."""
    rows = store
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows.select(F.min("sha").alias("sha")).filter("sha is not null")


def latest_run(runs: DataFrame, keys: list[str], date: str, tie: str) -> DataFrame:
    """Of each combination of keys the run with the largest date, then the largest tie."""
    rest = [c for c in runs.columns if c not in keys]
    order = [date, tie, *[c for c in rest if c not in (date, tie)]]
    return runs.groupBy(*keys).agg(F.max(F.struct(*order)).alias("x")).select(*keys, *[f"x.{c}" for c in rest])
