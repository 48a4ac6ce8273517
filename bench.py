"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_POINTS (rows of the
generated tables that stand for the published single-node numbers, 0 to skip).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import geocairn as gc
from catalogue.spark_queries import QUERIES
from catalogue.tables import nation_zones

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
POINTS = [int(n) for n in os.environ.get("BENCH_POINTS", "1000000,10000000").split(",") if int(n)]

HEADLINE = (
    "bbox", "radius", "nearest", "within", "within_long_boundary", "where", "grouped_aggregates",
    "dataset_profile", "within_join", "within_join_shuffled", "zonal_stats", "radius_join",
    "radius_join_shuffled", "knn_join", "buffer_join", "geodesic_distance", "track_lengths",
    "customer_areas", "centroids", "bounds", "buffer_points", "dissolve", "dissolve_extent",
    "simplify_by_distance", "simplify_by_area", "geojson_round_trip", "csv_round_trip",
    "row_numbers", "clustered_layout",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clock(fn, runs: int = 2) -> float:
    """Best wall time of building the plan and running it; the first run warms the JVM."""
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        fn()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def clustered_points(spark, n: int):
    """70 % of rows around ten hot spots, the rest spread evenly over the same region."""
    spot = F.col("id") % 10
    hot = F.rand(1) < 0.7
    lat = F.when(hot, 34.8 + 0.22 * spot + 0.05 * F.randn(2)).otherwise(34.5 + 2.5 * F.rand(3))
    lon = F.when(hot, -84.3 + 0.32 * ((spot * 7) % 10) + 0.05 * F.randn(4)).otherwise(
        -84.5 + 3.5 * F.rand(5))
    return spark.range(n).select(
        "id", F.concat(F.lit("species_"), F.col("id") % 31).alias("species"),
        lat.alias("latitude"), lon.alias("longitude"), (F.col("id") % 20 + 1).alias("count"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' code paths once
    run(QUERIES["within_join"](spark, SF_DIR))
    run(QUERIES["geodesic_distance"](spark, SF_DIR))

    times = {}
    for name in HEADLINE:
        times[name] = clock(lambda: run(QUERIES[name](spark, SF_DIR)))

    rates = {}
    for points in POINTS:
        base = tempfile.mkdtemp(prefix="bench-points-")
        clustered_points(spark, points).write.parquet(f"{base}/raw")
        raw = gc.load_points(spark, f"{base}/raw", format="parquet")
        runs = 2 if points <= 1_000_000 else 1
        label = f"{points // 1_000_000}m" if points >= 1_000_000 else str(points)
        times[f"layout_{label}"] = clock(lambda: gc.write_layout(
            raw.df, f"{base}/layout", lat="latitude", lon="longitude", partitions=16,
            mode="overwrite"), runs)
        data = gc.load_points(spark, f"{base}/layout", format="parquet")
        square = [[[(-83.6, 35.5), (-83.4, 35.5), (-83.4, 35.7), (-83.6, 35.7), (-83.6, 35.5)]]]
        one = {
            "nearest10": lambda: data.nearest(lat=35.6, lon=-83.5, k=10, tie="id"),
            "nearest10_grown": lambda: data.nearest(lat=35.6, lon=-83.5, k=10, tie="id",
                                                    start_radius_m=2000.0),
            "radius5km": lambda: data.radius(lat=35.6, lon=-83.5, radius="5km").df,
            "radius10km": lambda: data.radius(lat=35.6, lon=-83.5, radius="10km").df,
            "bbox02": lambda: data.bbox(35.5, -83.6, 35.7, -83.4).df,
            "within_small": lambda: data.within(square).df,
            "group_count": lambda: data.aggregate(by="species", aggs="count"),
            "profile": lambda: data.profile(),
            "hull_per_species": lambda: data.dissolve("species"),
        }
        for name, make in one.items():
            times[f"{name}_{label}"] = clock(lambda: run(make()), runs)
        for name in ("radius5km", "group_count", "hull_per_species"):
            rates[f"{name}_{label}_rows_per_sec"] = round(points / times[f"{name}_{label}"])
        zones = nation_zones(spark, SF_DIR)
        times[f"zonal_stats_{label}"] = clock(lambda: run(gc.zonal_stats(
            data.df, zones, lat="latitude", lon="longitude", aggs=["count", "sum:count"])), runs)
        rates[f"zonal_stats_{label}_rows_per_sec"] = round(points / times[f"zonal_stats_{label}"])
    customers = spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
    rates["knn_join_queries_per_sec"] = round(customers / times["knn_join"])
    rates["simplify_by_distance_vertices_per_sec"] = round(40 * customers / times["simplify_by_distance"])

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "rates": rates, "sf": os.path.basename(SF_DIR.rstrip("/")).lstrip("sf"),
                      "cpus": int(CPUS), "generated_points": POINTS, "timing": "best of 2 runs, one run at 10m"}))
    spark.stop()


if __name__ == "__main__":
    main()
