import random

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A function that makes a table from rows, spread over some partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture
def rng():
    return random.Random(7)
