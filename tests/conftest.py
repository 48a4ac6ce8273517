import json
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("geocairn-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Id, grade, latitude, longitude, count.
OBSERVATIONS = [
    (1, "research", 36.5400, -82.5500, 3), (2, "research", 36.5450, -82.5400, 5),
    (3, "casual", 36.5500, -82.5300, 2), (4, "research", 36.5350, -82.5600, 1),
    (5, "research", 36.5480, -82.5450, 8), (6, "casual", 36.5600, -82.5200, 4),
    (7, "research", 36.5250, -82.5700, 1), (8, "needs_id", 36.5700, -82.5100, 1),
    (9, "research", 36.5300, -82.5550, 2), (10, "research", 36.5150, -82.5800, 1),
    (11, "research", 36.5420, -82.5420, 4), (12, "research", 36.5380, -82.5480, 2),
    (13, "casual", 36.5520, -82.5350, 6), (14, "research", 36.5100, -82.5900, 1),
    (15, "research", 36.5460, -82.5380, 7), (16, "needs_id", 36.5200, -82.5750, 1),
    (17, "research", 36.5550, -82.5250, 2), (18, "casual", 36.5650, -82.5150, 3),
    (19, "research", 36.5320, -82.5520, 2), (20, "casual", 36.5580, -82.5280, 1),
]
# The fixture's two polygons.
BIG_PARK = [[(-82.60, 36.50), (-82.50, 36.50), (-82.50, 36.58), (-82.60, 36.58), (-82.60, 36.50)]]
SMALL_PARK = [[(-82.57, 36.52), (-82.54, 36.52), (-82.54, 36.55), (-82.57, 36.55),
               (-82.57, 36.52)]]


@pytest.fixture(scope="session")
def observations_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("obs") / "observations.csv"
    lines = ["id,quality_grade,latitude,longitude,count"]
    lines += [f"{i},{g},{y:.4f},{x:.4f},{n}" for i, g, y, x, n in OBSERVATIONS]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="session")
def parks_geojson(tmp_path_factory):
    path = tmp_path_factory.mktemp("parks") / "parks.geojson"
    features = [{"type": "Feature", "properties": {"name": name},
                 "geometry": {"type": "Polygon", "coordinates": rings}}
                for name, rings in (("big", BIG_PARK), ("small", SMALL_PARK))]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    return str(path)


@pytest.fixture(scope="session")
def obs(spark, observations_csv):
    import geocairn

    return geocairn.load_csv(spark, observations_csv)


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="session")
def events(spark):
    df = spark.read.parquet(f"{SF_DIR}/events.parquet")
    return df.select(
        "event_id", "event_type", "user_id", "ts", "value",
        ((345000 + F.col("event_id") * 7919 % 25001) / F.lit(10000.0)).alias("latitude"),
        ((-845000 + F.col("event_id") * 104729 % 35001) / F.lit(10000.0)).alias("longitude"),
    )
