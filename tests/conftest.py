import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docweave.session import local_session

    s = local_session("4", shuffle_partitions=8, app="docweave-tests")
    yield s


def one(spark, col, value, schema="t string"):
    """Evaluate a Column function on a single value."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]
