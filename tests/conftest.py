import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from quadlake.quads import QUAD_SCHEMA, as_term  # noqa: E402
from quadlake.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.maxMetadataStringLength", "10000").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture(scope="session")
def make(spark):
    """Quads from (g, s, p, o) tuples; bare strings are IRIs, '_:x' a blank node."""
    def one(x):
        from quadlake.quads import bnode
        return bnode(x[2:]) if isinstance(x, str) and x.startswith("_:") else as_term(x)

    def build(*rows):
        data = []
        for g, s, p, o in rows:
            s, o = one(s), one(o)
            data.append((g, s.value, s.kind, p, o.value, o.kind, o.dt, o.lang))
        return spark.createDataFrame(data, QUAD_SCHEMA)

    return build


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
