import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.verify import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(cpus=8, parts=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """DataFrame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def values(spark):
    """Evaluate column expressions over literal texts: one result per text."""
    from pyspark.sql import functions as F

    def run(texts, *exprs):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
        out = df.select("i", *[e(F.col("v")).alias(f"x{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
        return [r["x0"] if len(exprs) == 1 else tuple(r)[1:] for r in out]

    return run
