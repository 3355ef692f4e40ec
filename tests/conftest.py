from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("quern-tests")
        .config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"file://{base}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from quern.engine.session import Engine

    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture
def db(engine):
    with engine.connect() as session:
        yield session
