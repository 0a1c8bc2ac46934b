import logging
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lanewise-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lanewise-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


LINE = "array<struct<x:double,y:double>>"


@pytest.fixture(scope="session")
def make_lines(spark):
    """Roads from (id, name, points) with one class and study."""

    def build(rows, functional_class="Local Road", study_id=1):
        data = [(study_id, i, name, functional_class, [(float(x), float(y)) for x, y in pts]) for i, name, pts in rows]
        schema = f"study_id int, road_id bigint, road_name string, functional_class string, geom {LINE}"
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture(scope="session")
def make_polygons(spark):
    def build(rows, key="geoid", study_id=1):
        data = [(study_id, k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in rows]
        return spark.createDataFrame(data, f"study_id int, {key} string, rings array<{LINE}>")

    return build
