"""Sources, sinks, row numbers, layout, refresh and streaming."""

import datetime as dt
import decimal
import json
import os

import pytest
from conftest import BIG_PARK, plan_of
from pyspark.sql import functions as F

import geocairn as gc
from geocairn.streaming import versions
from geocairn.functions.geometry import parts_literal


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name)) as f:
                out += f.read().splitlines()
    return out


def test_format_dispatch(spark, observations_csv, tmp_path):
    assert gc.load_points(spark, observations_csv).df.count() == 20
    with pytest.raises(ValueError, match="format"):
        gc.load_points(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        gc.load_points(spark, observations_csv, format="orc")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        gc.load_points(spark, str(tmp_path / "missing.csv"))
    upper = tmp_path / "UPPER.CSV"
    upper.write_text("LAT,LON\n1,2\n")
    assert gc.load_points(spark, str(upper)).lat_col == "LAT"


def test_csv_with_schema_skips_inference(spark, observations_csv):
    data = gc.load_csv(spark, observations_csv, schema="id int, quality_grade string, "
                       "latitude double, longitude double, count int")
    assert dict(data.raw.dtypes)["id"] == "int" and data.df.count() == 20


def test_catalog_table(spark, obs):
    obs.raw.write.mode("overwrite").saveAsTable("geocairn_obs")
    assert gc.load_points(spark, table="geocairn_obs").df.count() == 20
    with pytest.raises(ValueError, match="invalid name"):
        gc.load_points(spark, table="a; drop table b")
    spark.sql("DROP TABLE geocairn_obs")


def test_geojson_polygons_and_points(spark, parks_geojson, tmp_path):
    zones = gc.read_features(spark, parks_geojson)
    assert [tuple(r) for r in zones.select("name", "geometry.geom_type").orderBy("name").collect()] == [
        ("big", "Polygon"), ("small", "Polygon")]
    mixed = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": 1},
         "geometry": {"type": "Point", "coordinates": [-82.5, 36.5, 120.0]}},
        {"type": "Feature", "properties": {"n": 2},
         "geometry": {"type": "Polygon", "coordinates": BIG_PARK}},
        {"type": "Feature", "properties": {"n": 3}, "geometry": None},
        {"type": "Feature", "properties": {"n": 4},
         "geometry": {"type": "GeometryCollection", "geometries": []}}]}
    path = tmp_path / "mixed.json"
    path.write_text(json.dumps(mixed))
    data = gc.load_points(spark, str(path))
    assert [tuple(r) for r in data.df.select("n", "latitude", "longitude").collect()] == [
        (1, 36.5, -82.5)]
    assert data.profile().collect()[0].row_count == 4
    split = tmp_path / "split.geojson"
    split.write_text("\n".join(json.dumps(f) for f in mixed["features"]))
    assert gc.load_points(spark, str(split), lines=True).df.count() == 1


def test_geojson_property_coordinates_win(spark, tmp_path):
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"lat": 1.0, "lon": 2.0},
         "geometry": {"type": "Point", "coordinates": [9, 9]}}]}))
    row = gc.load_points(spark, str(path)).df.collect()[0]
    assert (row.lat, row.lon) == (1.0, 2.0) and row.geometry.geom_type == "Point"


def test_parks_join(spark, obs, parks_geojson):
    zones = gc.read_features(spark, parks_geojson).select(
        F.col("name").alias("zone_id"), F.col("geometry.parts").alias("polygons"))
    out = gc.zonal_stats(obs.df, zones, lat="latitude", lon="longitude", aggs=["count"])
    assert {tuple(r) for r in out.collect()} == {("big", 20), ("small", 7)}


def test_row_numbers_over_many_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).repartition(
        7).write.parquet(path)
    data = gc.load_parquet(spark, path, with_rowid=True)
    first = {r.id: r.rowid for r in data.raw.select("id", "rowid").collect()}
    assert sorted(first.values()) == list(range(1, 1001))
    # the same numbers when the scan is split otherwise, and under a filter
    again = data.raw.repartition(3).filter("id % 7 = 0").select("id", "rowid").collect()
    assert all(first[r.id] == r.rowid for r in again)


def test_row_numbers_follow_the_file(spark, observations_csv):
    rows = gc.load_csv(spark, observations_csv, with_rowid=True).raw.collect()
    assert all(r.rowid == r.id for r in rows) and rows[0].asDict().keys() >= {"rowid", "latitude"}


@pytest.fixture(scope="module")
def odd_rows(spark):
    schema = ("id int, latitude double, longitude double, x double, f float, d date, "
              "t timestamp, wide decimal(20,0), price decimal(9,2), tags array<string>, s string")
    rows = [
        (1, 1.5, 2.5, float("nan"), 1.0, dt.date(2024, 3, 5), dt.datetime(2024, 3, 5, 1, 2, 3),
         decimal.Decimal(2**64 - 1), decimal.Decimal("1.50"), ["a", "b"], "q,\"z\""),
        (2, None, 2.5, float("inf"), float("-inf"), None, None, None, None, None, None),
        (3, float("nan"), 1.0, 0.1, 0.5, None, None, None, None, [], "é"),
    ]
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_json_sink(odd_rows, tmp_path):
    gc.write_json(odd_rows, str(tmp_path / "j"))
    rows = [json.loads(x) for x in lines(tmp_path / "j")]
    assert rows[0]["x"] is None and rows[0]["d"] == "2024-03-05" and rows[0]["tags"] == ["a", "b"]
    assert rows[0]["wide"] == "18446744073709551615" and rows[0]["price"] == 1.5
    assert rows[1]["x"] is None and rows[1]["f"] is None and "s" in rows[1]  # NULLs are kept


def test_csv_sink(odd_rows, tmp_path, spark):
    gc.write_csv(odd_rows, str(tmp_path / "c"))
    text = lines(tmp_path / "c")
    assert text[0].startswith("id,latitude,longitude,x") and len(text) == 4
    assert text[2] == "2,,2.5,,,,,,,,"
    gc.write_csv(odd_rows.filter("id > 5"), str(tmp_path / "empty"))
    assert lines(tmp_path / "empty")[:1] == [text[0]]
    back = gc.load_csv(spark, str(tmp_path / "c"))
    assert back.raw.filter("id = 1").select("s").collect()[0][0] == "q,\"z\""


def test_geojson_sink(odd_rows, tmp_path):
    gc.write_geojson(odd_rows, str(tmp_path / "g"), lat="latitude", lon="longitude")
    (only,) = [json.loads(x) for x in lines(tmp_path / "g")]  # rows without a position are left out
    assert only["geometry"] == {"type": "Point", "coordinates": [2.5, 1.5]}
    assert "latitude" not in only["properties"] and only["properties"]["x"] is None
    with pytest.raises(ValueError):
        gc.feature_lines(odd_rows.select("id"))


def test_write_dispatch(obs, tmp_path):
    for kind in ("json", "csv", "geojson"):
        obs.write(str(tmp_path / kind), format=kind)
        assert len(lines(tmp_path / kind)) == (21 if kind == "csv" else 20)
    with pytest.raises(ValueError, match="unknown output format"):
        obs.write(str(tmp_path / "x"), format="xml")


def test_geojson_geometry_sink(spark, obs):
    hull = json.loads(gc.feature_lines(obs.convex_hull(), geometry="geometry").collect()[0][0])
    assert hull["type"] == "Feature" and hull["geometry"]["type"] == "Polygon"
    assert hull["geometry"]["coordinates"][0][0] == hull["geometry"]["coordinates"][0][-1]
    assert hull["properties"]["point_count"] == 20


def test_geojson_text_columns(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    multi = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}'
    point = '{"type":"Point","coordinates":[3,4]}'
    texts = [
        square, f'{{"type":"Feature","properties":null,"geometry":{multi}}}',
        f'{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{square}}},'
        f'{{"type":"Feature","geometry":{multi}}}]}}',
        point, "nonsense", '{"type":"FeatureCollection","features":[]}',
        '{"type":"Polygon","coordinates":[[["a",0]]]}', None,
        '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    polys = {r.i: r for r in gc.polygons_from_geojson(df, "t").collect()}
    assert [len(polys[i].polygons or []) for i in range(9)] == [1, 2, 3, 0, 0, 0, 0, 0, 0]
    assert all((polys[i]["_error"] is None) == (i < 3) for i in range(9))
    pts = gc.points_from_geojson(df, "t").collect()
    assert sorted((r.i, r.lon, r.lat) for r in pts if r["_error"] is None) == [
        (3, 3.0, 4.0), (8, 1.0, 2.0), (8, 3.0, 4.0)]
    assert {r.i for r in pts} == set(range(9))
    one = {r.i: r for r in gc.geometries_from_geojson(df, "t").collect()}
    assert one[1].geometry.geom_type == "MultiPolygon" and one[2].geometry is None
    assert one[2]["_error"] is not None


def test_layout_clusters_and_spreads_copies(spark, tmp_path):
    rng = spark.range(40000).select(
        "id", (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    copies = spark.range(20000).select((F.col("id") + 40000).alias("id"), F.lit(10.0).alias("lat"),
                                       F.lit(20.0).alias("lon"))
    path = str(tmp_path / "z")
    gc.write_layout(rng.repartition(8).unionByName(copies.repartition(8)), path, lat="lat",
                    lon="lon", partitions=12)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.count("*").alias("n"), (F.max("lon") - F.min("lon")).alias("w"),
        (F.max("lat") - F.min("lat")).alias("h")).collect()
    assert sum(r.n for r in sizes) == 60000
    assert max(r.n for r in sizes) < 15000  # one position fills a third of the table
    assert sum(r.w * r.h for r in sizes) < 2.5 * 360 * 180  # files cover compact areas
    near = gc.load_parquet(spark, path).bbox(0, 0, 5, 5).df
    assert "PushedFilters" in plan_of(near)


def save(spark, rows, path):
    spark.createDataFrame(rows, "id long, latitude double, longitude double").write.parquet(path)
    return path


def test_refresh_keeps_the_old_data_on_failure(spark, tmp_path):
    two = save(spark, [(1, 1.0, 1.0), (2, 2.0, 2.0)], str(tmp_path / "a.parquet"))
    four = save(spark, [(i, 1.0 * i, 1.0) for i in range(4)], str(tmp_path / "b.parquet"))
    nowhere = save(spark, [(1, None, None)], str(tmp_path / "n.parquet"))
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b,c\n1,2,3\n")
    versions = str(tmp_path / "versions")
    gc.refresh(spark, "live_points", two, versions_dir=versions)
    assert gc.published(spark, "live_points").df.count() == 2
    for broken in (str(bad), str(tmp_path / "gone.csv"), nowhere):
        with pytest.raises(gc.RefreshFailed):
            gc.refresh(spark, "live_points", broken, versions_dir=versions)
        assert gc.published(spark, "live_points").df.count() == 2
    gc.refresh(spark, "live_points", four, versions_dir=versions, layout=True)
    assert gc.published(spark, "live_points").df.count() == 4
    assert len(os.listdir(versions)) >= 2


def test_other_sessions_read_the_newest_version(spark, tmp_path):
    versions = str(tmp_path / "shared")
    sources = [save(spark, [(j, 1.0 * j, 1.0) for j in range(i + 1)], str(tmp_path / f"s{i}.parquet")) for i in range(5)]
    with pytest.raises(LookupError):
        gc.published(spark.newSession(), "shared_points", versions_dir=versions)
    gc.refresh(spark, "shared_points", sources[0], versions_dir=versions)
    other = spark.newSession()
    pinned = gc.published(other, "shared_points", versions_dir=versions)
    assert pinned.df.count() == 1
    gc.refresh(other, "shared_points", sources[1], versions_dir=versions)  # any session may publish
    with pytest.raises(gc.RefreshFailed):
        gc.refresh(other, "shared_points", str(tmp_path / "gone.parquet"), versions_dir=versions)
    assert gc.published(spark.newSession(), "shared_points", versions_dir=versions).df.count() == 2
    assert pinned.df.count() == 1  # a reader stays with its version
    for source in sources[2:]:
        gc.refresh(spark, "shared_points", source, versions_dir=versions, keep=2)
    live = gc.published(spark.newSession(), "shared_points", versions_dir=versions)
    assert live.df.count() == 5 and (live.lat_col, live.lon_col) == ("latitude", "longitude")
    assert len([n for n in os.listdir(versions) if n.startswith("shared_points-")]) == 2
    assert sorted(n for n in os.listdir(versions + "/shared_points.pointers") if not n.startswith(".")) == ["4", "5"]
    with pytest.raises(ValueError):
        gc.refresh(spark, "shared_points", sources[0], versions_dir=versions, keep=0)


@pytest.mark.parametrize("moment", ["before the swap", "after the swap"])
def test_a_stream_that_stops_anywhere_publishes_each_row_once(spark, events, tmp_path, monkeypatch, moment):
    source, log, folder = (str(tmp_path / n) for n in ("in", "log", "versions"))
    events.limit(900).repartition(3).write.parquet(source)
    run = lambda: gc.publish_stream(
        gc.stream_points(spark, source, schema=events.schema, max_files_per_trigger=1), "live_stream",
        versions_dir=folder, checkpoint=log, availableNow=True).awaitTermination()
    real, calls = versions.swap, []

    def failing(*args, **kwargs):
        calls.append(1)
        if moment == "after the swap":
            real(*args, **kwargs)
        if len(calls) == 2:
            raise RuntimeError("stopped here")
        if moment == "before the swap":
            real(*args, **kwargs)

    monkeypatch.setattr(versions, "swap", failing)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(versions, "swap", real)
    rows = lambda: gc.published(spark.newSession(), "live_stream", versions_dir=folder).df.count()
    assert rows() == (300 if moment == "before the swap" else 600)
    run()
    live = gc.published(spark, "live_stream", versions_dir=folder)
    assert rows() == 900 and live.raw.columns == events.columns and live.df.select("event_id").distinct().count() == 900
    run()  # nothing new
    events.where("event_id >= 0").limit(950).subtract(live.raw).write.mode("append").parquet(source)
    run()
    assert rows() > 900 and live.df.count() == 900


def test_stream_equals_batch(spark, events, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(6).write.parquet(source)
    zone = spark.range(1).select(F.lit(5).alias("zone_id"), parts_literal(
        [[[(-84, 35), (-82, 35.2), (-81.5, 36.6), (-83, 35.9), (-84, 36.5)]]]).alias("polygons"))
    options = {"lat": "latitude", "lon": "longitude"}
    stream = gc.stream_points(spark, source, schema=events.schema, max_files_per_trigger=2)
    near = gc.within_join(stream.where({"event_type": "click"}).df, zone, **options)
    query = (near.select("event_id", "zone_id").writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "log"))
             .trigger(availableNow=True).start(sink))
    query.awaitTermination()
    want = gc.within_join(events.filter("event_type = 'click'"), zone, **options)
    got = spark.read.parquet(sink)
    assert got.count() > 0
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(
        r[0] for r in want.select("event_id").collect())


def test_windowed_zone_counts(spark, tmp_path):
    """In time: as on a batch, over restarts. Too late: dropped, and counted in the progress."""
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    zones = spark.createDataFrame([(1, 0.0), (2, 5.0)], "zone_id int, w double").select("zone_id", F.expr(
        "array(array(array(named_struct('lon', w, 'lat', 0D), named_struct('lon', w + 5, 'lat', 0D), "
        "named_struct('lon', w + 5, 'lat', 9D), named_struct('lon', w, 'lat', 9D))))").alias("polygons"))

    def rows(*values):  # (minute, lon)
        return spark.createDataFrame([(m, 1.0, x) for m, x in values], "m int, lat double, lon double").select(
            F.timestamp_seconds(F.col("m") * 60).alias("at"), "lat", "lon")

    def run(part):
        part.coalesce(1).write.mode("append").parquet(source)
        counts = gc.zone_counts(gc.stream_points(spark, source, schema=part.schema), zones, time="at",
                                window="10 minutes", delay="5 minutes")
        query = (counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", log)
                 .trigger(availableNow=True).start(sink))
        query.awaitTermination()
        return (sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]),
                {(int(r.window_start.timestamp()) // 60, r.zone_id, r["count"]) for r in
                 spark.read.schema(counts.schema).parquet(sink).collect()})

    first = rows((0, 1.0), (3, 1.0), (4, 7.0), (11, 1.0), (14, 20.0), (None, 1.0))
    assert run(first) == (0, set())
    second = rows((9, 1.0), (16, 7.0), (17, 1.0))  # minute 9 is out of order, but its window is open
    assert run(second) == (0, {(0, 1, 3), (0, 2, 1)})
    late, closed = run(rows((8, 1.0), (19, 7.0), (31, 1.0)))
    assert late == 1 and closed == {(0, 1, 3), (0, 2, 1), (10, 1, 2), (10, 2, 2)}
    batch = gc.PointDataset(first.union(second), "lat", "lon")
    got = gc.zone_counts(batch, zones, time="at", window="10 minutes", delay="5 minutes").collect()
    assert {(int(r.window_start.timestamp()) // 60, r.zone_id, r["count"]) for r in got} == {
        (0, 1, 3), (0, 2, 1), (10, 1, 2), (10, 2, 1)}


def test_refresh_keeps_coordinate_columns_and_all_rows(spark, tmp_path):
    rows = [(1, 1.0, 2.0, 50.0, 60.0), (2, 3.0, 4.0, 51.0, 61.0), (3, None, None, None, 7.0)]
    path = str(tmp_path / "both.parquet")
    spark.createDataFrame(rows, "id long, lat double, lon double, north double, east double").write.parquet(path)
    gc.refresh(spark, "live_both", path, lat="north", lon="east", versions_dir=str(tmp_path / "v"))
    live = gc.published(spark, "live_both")
    assert (live.lat_col, live.lon_col) == ("north", "east")
    assert live.raw.count() == 3 and live.profile().first().row_count == 3 and live.df.count() == 2


def test_csv_follows_rfc_4180(spark, tmp_path):
    path = str(tmp_path / "quoted.csv")
    with open(path, "w", newline="") as f:
        f.write('id,latitude,longitude,note\n1,1.5,2.5,"say ""hi"", ok"\n2,1.0,2.0,"two\nlines"\n3,1.0,2.0,plain\n')
    back = gc.load_csv(spark, path, multi_line=True).df.orderBy("id").collect()
    assert [r.note for r in back] == ['say "hi", ok', "two\nlines", "plain"] and back[0].id == 1
    with pytest.raises(Exception):
        gc.load_csv(spark, path, schema="id long, latitude double, longitude double, note string").df.collect()
    out = str(tmp_path / "out")
    texts = ['a "b" c', " padded ", "x,y", "line\nend", "\\", 'back\\"slash']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, note string")
    gc.write_csv(rows, out)
    again = gc.sources.readers.read_csv(spark, out, rows.schema, multi_line=True).orderBy("id").collect()
    assert [r.note for r in again] == texts


def test_bad_features_raise_or_are_reported(spark, tmp_path):
    path = str(tmp_path / "mixed.geojson")
    with open(path, "w") as f:
        f.write('{"type":"Feature","properties":{"k":1},"geometry":{"type":"Point","coordinates":[1,2]}}\n'
                '{"type":"Feature","prop\n'
                '{"type":"Feature","properties":{"k":3},"geometry":{"type":"Circle","coordinates":[1,2]}}\n'
                '{"type":"Feature","properties":{"k":4},"geometry":null}\n')
    with pytest.raises(Exception):
        gc.read_features(spark, path, properties="k long").collect()
    got = gc.read_features(spark, path, properties="k long", errors="column").collect()
    assert len(got) == 4 and sum(r._error is not None for r in got) == 2
    assert [r.k for r in got if r._error is None] == [1, 4]


def test_the_first_line_tells_documents_from_lines(spark, tmp_path):
    feature = '{"type":"Feature","properties":{"k":%d},"geometry":{"type":"Point","coordinates":[1,2]}}'
    lines, document = str(tmp_path / "lines.geojson"), str(tmp_path / "document.geojson")
    with open(lines, "w") as f:
        f.write("\n".join(feature % i for i in range(5)))
    with open(document, "w") as f:
        f.write('{"type":"FeatureCollection",\n"features":[' + ",\n".join(feature % i for i in range(5)) + "]}")
    for path in (lines, document):
        assert sorted(r.k for r in gc.read_features(spark, path).collect()) == list(range(5))
