import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as driver
from graphspan.plans import oracles, queries

DATA = Path("/root/testdata/sf0.001")

def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.QUERIES[name](spark, str(DATA))
    told = con.execute(oracles.ORACLES[name])
    columns = [x[0] for x in told.description]
    assert _sorted(found.columns, found.collect()) == _sorted(columns, told.fetchall())
