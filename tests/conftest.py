import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from murmur.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="murmur-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield s


def one(spark, expr, value, schema="v string"):
    """Evaluate a column expression on a single inline row."""
    return spark.createDataFrame([(value,)], schema).select(expr.alias("out")).first()["out"]
