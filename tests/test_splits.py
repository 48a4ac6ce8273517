"""Files read by many tasks although their records span lines: equal to the readers of whole files."""

import contextlib
import csv
import json
import random

import pytest
from pyspark.sql import functions as F

import geocairn as gc
from geocairn.sources import splits
from geocairn.sources.readers import read_csv

SCHEMA = "id long, note string, more string"
BITS = ['"', '""', ",", "\n", "\r\n", "\n\n", "a", "é", "𝄞", " ", "{", "}", "\\", "long words here", ""]


@contextlib.contextmanager
def splits_of(spark, size):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    yield
    spark.conf.set(name, before)


def tasks(spark, path, separator="\n"):
    return splits._pieces(spark, path, separator).select(F.spark_partition_id()).distinct().count()


def texts(seed, n, longest=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(1, longest))) for _ in range(n)]


def write_rows(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL)
        out.writerow(["id", "a\nquoted \"name\"", "more"])
        out.writerows(rows)


@pytest.mark.parametrize("size, end", [(31, "\n"), (250, "\r\n"), (1 << 20, "\r\n")])
def test_csv_cut_anywhere(spark, tmp_path, size, end):
    folder = tmp_path / "f"
    folder.mkdir()
    notes = [t for t in texts(size, 30) if t]
    rows = [(i, t, notes[-i - 1]) for i, t in enumerate(notes)]
    write_rows(folder / "a.csv", rows[:15], end)
    write_rows(folder / "b.csv", rows[15:], end)
    with splits_of(spark, size):
        got = read_csv(spark, str(folder), SCHEMA, split=True).collect()
        assert (tasks(spark, str(folder / "a.csv")) > 1) == (size < 1000)
        # the same records where the states of the splits are too many to broadcast
        dealt = splits.csv_records(spark, str(folder), limit=-1).collect()
        held = splits.csv_records(spark, str(folder)).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, read_csv(spark, str(folder), SCHEMA, multi_line=True).collect()))
    assert sorted(map(tuple, dealt)) == sorted(map(tuple, held)) and len(held) == len(rows) + 2
    assert sum(r._head for r in held) == 2


def test_csv_record_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "long.csv")
    rows = [(1, "x", "y"), (2, "\n".join(f'line "{i}"' for i in range(150)), "end"), (3, "z", "\n")]
    write_rows(path, rows)
    with splits_of(spark, 200):
        assert tasks(spark, path) > 8
        assert sorted(map(tuple, read_csv(spark, path, SCHEMA, split=True).collect())) == rows


def test_csv_odd_files(spark, tmp_path):
    empty, headed, broken = (str(tmp_path / n) for n in ("empty.csv", "headed.csv", "broken.csv"))
    open(empty, "w").close()
    write_rows(headed, [])
    write_rows(broken, [(i, "a\nb", "c") for i in range(20)])
    with open(broken, "a") as f:
        f.write('21,"never closed,1\n22,a,b\n')
    with splits_of(spark, 50):
        assert read_csv(spark, empty, SCHEMA, split=True).collect() == []
        assert read_csv(spark, headed, SCHEMA, split=True).collect() == []
        with pytest.raises(Exception):
            read_csv(spark, broken, SCHEMA, split=True).collect()
    with pytest.raises(ValueError, match="schema"):
        read_csv(spark, headed, split=True)
    with pytest.raises(ValueError, match="cannot be set"):
        read_csv(spark, headed, SCHEMA, split=True, lineSep=";")


def test_csv_points(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w", newline="") as f:
        f.write('id,latitude,longitude,note\n1,1.5,2.5,"say ""hi"", ok"\n\n2,1.0,2.0,"two\nlines"\n3,,2.0,\n')
    data = gc.load_csv(spark, path, schema="id int, latitude double, longitude double, note string", split=True)
    assert sorted((r.id, r.note) for r in data.df.collect()) == [(1, 'say "hi", ok'), (2, "two\nlines")]
    assert data.profile().first().row_count == 3


def document(features, indent=None, **members):
    return json.dumps({"type": "FeatureCollection", "name": "has {braces} and \"quotes\"", "crs": {
        "type": "name", "properties": {"name": "urn:{x}"}}, **members, "features": features}, indent=indent)


def feature(i, text):
    kinds = [{"type": "Point", "coordinates": [i, 1.5]},
             {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, i]}]},
             {"type": "Polygon", "coordinates": [[[0, 0], [i + 1, 0], [0, 1], [0, 0]]]}, None]
    return {"type": "Feature", "properties": {"k": i, "t": text, "deep": {"er": {"x": "}{"}}}, "geometry": kinds[i % 4]}


PROPERTIES = "k long, t string, deep struct<er: struct<x: string>>"


@pytest.mark.parametrize("size, indent, tail", [(120, None, ""), (400, 1, " \n\n"), (1 << 20, 2, "")])
def test_geojson_cut_anywhere(spark, tmp_path, size, indent, tail):
    folder = tmp_path / "g"
    folder.mkdir()
    made = [feature(i, t) for i, t in enumerate(texts(size, 12))]
    (folder / "a.json").write_text(document(made[:7], indent) + tail, encoding="utf-8")
    (folder / "b.json").write_text(document(made[7:], indent, bbox=[1, 2], other={"features": {"a": []}}) + tail, encoding="utf-8")
    (folder / "c.json").write_text(document([], indent) + tail, encoding="utf-8")
    (folder / "d.json").write_text('{"features": [%s], "last": {"type": "x", "more": {}}}' % json.dumps(made[0]) + tail)
    read = dict(properties=PROPERTIES)
    with splits_of(spark, size):
        got = gc.read_features(spark, str(folder), split=True, **read).collect()
        assert (tasks(spark, str(folder / "a.json"), "}") > 1) == (size < 1000)
        held = splits.feature_texts(spark, str(folder)).collect()
        dealt = splits.feature_texts(spark, str(folder), limit=-1).collect()
    whole = gc.read_features(spark, str(folder), lines=False, **read).collect()
    assert len(got) == 13 and sorted(map(repr, got)) == sorted(map(repr, whole))
    assert sorted(held) == sorted(dealt)
    assert sorted((json.loads(r.value) for r in held), key=str) == sorted([*made, made[0]], key=str)


def test_geojson_that_is_cut_off_raises(spark, tmp_path):
    text = document([feature(i, 'a "b" {') for i in range(6)])
    for cut in (1, 2, 40, len(text) // 2):
        path = tmp_path / f"cut{cut}.json"
        path.write_text(text[:-cut])
        with splits_of(spark, 300), pytest.raises(ValueError, match="closed"):
            gc.read_features(spark, str(path), split=True, properties=PROPERTIES)


def test_geojson_of_another_type_raises(spark, tmp_path):
    path = tmp_path / "one.json"
    for text in (json.dumps(feature(0, "a")), '{"type": "Point", "coordinates": [1, 2]}'):
        path.write_text(text)
        with pytest.raises(Exception, match="FeatureCollection"):
            gc.read_features(spark, str(path), split=True, properties=PROPERTIES).collect()
    with pytest.raises(ValueError, match="properties"):
        gc.read_features(spark, str(path), split=True)


def test_objects_that_are_no_features(spark, tmp_path):
    path = tmp_path / "odd.json"
    path.write_text(document([feature(0, "a"), {"type": "Blob"}, feature(2, "b"), feature(4, 7)]))
    with pytest.raises(Exception, match="not a Feature"):
        gc.read_features(spark, str(path), split=True, properties=PROPERTIES).collect()
    got = gc.read_features(spark, str(path), split=True, properties=PROPERTIES, errors="column").collect()
    assert sorted(r.k for r in got if r._error is None) == [0, 2, 4]
    assert [json.loads(r._error) for r in got if r._error] == [{"type": "Blob"}]
