import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passagework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a column function to a list of values."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}") \
            .select("i", function(F.col("x")).alias("y")).collect()
        return [y for _, y in sorted((r.i, r.y) for r in rows)] if rows and not isinstance(
            rows[0].y, (list, dict)) else [r.y for r in sorted(rows, key=lambda r: r.i)]

    return run


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)
