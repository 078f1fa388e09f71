import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4")
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_sources(spark):
    """Sources from {id: "space-separated tokens"}."""

    def make(texts, batch_index=0):
        rows = [(batch_index, i, s, t.split(" ") if t else [], None, None, None) for i, (s, t) in enumerate(texts.items())]
        return spark.createDataFrame(rows, "batch_index long, source_index long, source_id string, tokens array<string>, text string, timestamp_unix_ms long, metadata string")

    return make
