import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from affect_engine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a text function on a list of strings."""
    from pyspark.sql import functions as F

    def run(function, texts):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
        return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
