import datetime

import pytest
from pyspark.sql import functions as F

from graphspan.operators import analysis, results


@pytest.mark.parametrize(
    "text, name, parameters",
    [
        ("sequential", "Sequential", ""),
        ("sequential-single", "SequentialSingle", ""),
        ("bfs", "Bfs", ""),
        ("delta-stepping(2950)", "DeltaStepping", "2950"),
        ("hyperball(16)", "HyperBall", "16"),
        ("rand-cluster(3,2)", "RandCluster", "3:2"),
        ("rand-cluster-guess(10, 29, 10)", "RandClusterGuess", "10:29,10"),
    ],
)
def test_specs(text, name, parameters):
    spec = results.parse_spec(text)
    assert (spec.algorithm, spec.parameters) == (name, parameters)


@pytest.mark.parametrize("text", ["nothing", "hyperball(3)", "delta-stepping()"])
def test_bad_specs(text):
    with pytest.raises(ValueError):
        results.parse_spec(text)


def test_store_and_lookup(spark, tmp_path):
    run = ("abc123", datetime.datetime(2024, 1, 1), 1, 8, "", "USA", "Bfs", "", 5, 10, False, None, False)
    killed = ("def456", datetime.datetime(2024, 1, 2), 1, 8, "", "USA", "DeltaStepping", "3", -1, 10, False, None, True)
    results.append_run(spark, str(tmp_path / "main"), [run])
    results.append_run(spark, str(tmp_path / "main"), [killed])
    store = spark.read.parquet(str(tmp_path / "main"))
    assert store.count() == 2
    assert results.already_run(store, seed=1, algorithm="Bfs").first()["sha"] == "abc123"
    assert results.already_run(store, seed=2).count() == 0
    assert len(results.run_id("a", 1)) == 6


def test_host_filter_counts_names(spark):
    runs = spark.createDataFrame(
        [("USA", "Sequential", 4, 1000, False, ""), ("USA", "DeltaStepping", 4, 2000, False, "node1__node2"), ("USA-E", "Sequential", 4, 1, False, "")],
        "dataset string, algorithm string, diameter long, total_time_ms long, killed boolean, hosts string",
    )
    got = {(r["algorithm"], r["diameter"], r["total_time"]) for r in analysis.main_data(runs, (0, 2), "node").collect()}
    assert got == {("Sequential", 4, 1.0), ("DeltaStepping", 8, 2.0)}


def test_split_parameters_drops_extra_and_fills_missing(spark):
    df = spark.createDataFrame([("1:2,3",), ("",), ("x:7",)], "p string")
    a, b = analysis.split_parameters(F.col("p"), 2)
    assert [tuple(r) for r in df.select(a, b).collect()] == [(1, 2), (None, None), (None, 7)]
