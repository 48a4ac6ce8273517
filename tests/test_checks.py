import pytest

from geocairn.functions import checks


@pytest.mark.parametrize("names, expected", [
    (["station", "LATITUDE", "elevation", "longitude"], ("LATITUDE", "longitude")),
    (["t", "Y", "X"], ("Y", "X")),
    (["lng", "lat", "longitude", "when", "latitude"], ("latitude", "longitude")),
    (["GEO_LNG", "Geo_Lat"], ("Geo_Lat", "GEO_LNG")),
])
def test_detect_coordinates(names, expected):
    assert checks.detect_coordinates(names) == expected


def test_detect_coordinates_given_and_missing():
    assert checks.detect_coordinates(["A", "b"], lat="a", lon="b") == ("A", "b")
    with pytest.raises(checks.ColumnNotFound, match="depth, salinity"):
        checks.detect_coordinates(["depth", "salinity"])
    with pytest.raises(checks.ColumnNotFound):
        checks.detect_coordinates(["lat", "lon"], lat="nope")


def test_parse_bbox():
    assert checks.parse_bbox("-12.25, 170.5, 3, 179.75") == (-12.25, 170.5, 3.0, 179.75)
    for bad in ("7,8", "91,0,92,1", "0,181,1,182", "5,0,4,1", "0,9,1,8", "north,0,1,1", "0,inf,1,1", ""):
        with pytest.raises(ValueError):
            checks.parse_bbox(bad)


@pytest.mark.parametrize("text, metres", [
    ("3.25km", 3250.0), ("740m", 740.0), ("2mi", 3218.688), ("61", 61.0), (" 2 ft ", 0.6096),
    (250, 250.0), ("1e3", 1000.0),
])
def test_parse_radius(text, metres):
    assert checks.parse_radius(text) == pytest.approx(metres, abs=1e-9)


@pytest.mark.parametrize("bad", ["wide", "-0.5km", "3 leagues", "", "nan", "km"])
def test_parse_radius_rejects(bad):
    with pytest.raises(ValueError):
        checks.parse_radius(bad)


def test_radius_column(spark):
    from pyspark.sql import functions as F

    texts = ["12km", "2 mi", "3ft", "7", "x", None, "-2m"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(checks.radius_metres(F.col("t"))).collect()]
    assert got[:4] == pytest.approx([12000.0, 3218.688, 0.9144, 7.0])
    assert got[4:] == [None, None, None]


def test_identifier():
    assert checks.check_identifier("cat.db.points_1") == "cat.db.points_1"
    assert checks.check_identifier("größe") == "größe"
    for bad in ("", "a b", "a;drop", 'a"b', "a..b"):
        with pytest.raises(ValueError):
            checks.check_identifier(bad)


def test_parse_where():
    assert checks.parse_where("a:1,b:x:y") == [("a", "1"), ("b", "x:y")]
    for bad in ("a", "a:1,b", ":1"):
        with pytest.raises(ValueError):
            checks.parse_where(bad)
