import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    from fixtures import SCHEMA, corpus

    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from fixtures import SCHEMA

    return spark.createDataFrame([], SCHEMA)
