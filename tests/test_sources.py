"""Sources: directories of archives, elements, rasters, masks."""

import json

import pytest

from wayloom.sources import archive, elements, rasters


def test_directory_round_trip_and_limits():
    entries = [(0, 1, 10, 0), (5, 3, 20, 10), (300, 0, 7, 500), (301, 2, 9, 507)]
    assert archive.directory(archive.pack_directory(entries)) == entries
    contiguous = bytes([2, 1, 1, 1, 1, 4, 4, 1, 0])
    assert archive.directory(contiguous) == [(1, 1, 4, 0), (2, 1, 4, 4)]
    with pytest.raises(ValueError):
        archive.directory(bytes([255]))


def test_read_directories(spark, tmp_path):
    (tmp_path / "a.dir").write_bytes(archive.pack_directory([(3, 2, 5, 0)]))
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.dir"))
    assert [tuple(r)[1:] for r in archive.read_directories(files).collect()] == [(3, 2, 5, 0)]


def test_elements_of_json_and_of_a_missing_file(spark, tmp_path):
    doc = {"elements": [{"type": "way", "id": 1, "tags": {"highway": "path"}, "nodes": [1, 2]}, {"type": "way", "id": 2, "tags": {}}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    rows = elements.read(spark, f"file://{tmp_path}/e.json").withColumn("layer", elements.layer()).collect()
    assert [(r.id, r.layer) for r in rows] == [(1, "road"), (2, None)]
    assert elements.read(spark, f"file://{tmp_path}/none.json").count() == 0


def test_split_at_shared_nodes(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9, 3, 8])], "way long, nodes array<long>")
    assert sorted((r.way, r.part, r.nodes) for r in elements.split_at_junctions(ways).collect()) == [(1, 0, [1, 2, 3]), (1, 1, [3, 4]), (2, 0, [9, 3]), (2, 1, [3, 8])]


def test_raster_edges_and_masks(spark):
    cells = spark.createDataFrame([(0, 0, 10.0), (0, 1, 20.0), (1, 0, -9999.0), (1, 1, None)], "row long, col long, h double")
    points = spark.createDataFrame([(1, 100.0, 50.0), (2, 100.0, 100.0), (3, 900.0, 900.0)], "pid long, px double, py double")
    assert {r.pid: r.z for r in rasters.sample(points, cells, 100.0).collect()} == {1: 15.0, 2: 15.0, 3: None}
    lines = spark.createDataFrame([(1, [(50.0, 50.0)]), (2, [(950.0, 50.0)])], "id long, points array<struct<x:double,y:double>>")
    assert [r.id for r in rasters.within(lines, cells.select("row", "col"), 100.0).collect()] == [1]
