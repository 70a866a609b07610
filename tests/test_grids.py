"""Binary and text grids, and map files, on small files."""

import numpy as np
from pyspark.sql import functions as F

from tessera.sources import grids, osm


def hgt(folder, name, rows):
    (folder / name).write_bytes(np.array(rows, ">i2").tobytes())


def test_binary_grids(spark, tmp_path):
    hgt(tmp_path, "N34W072.hgt", [[7, 8, 9], [4, -32768, 6], [1, 2, 300]])  # north row first
    hgt(tmp_path, "N34W071.hgt", [[9, 1, 1], [6, 1, 1], [300, 1, -5]])
    hgt(tmp_path, "S01E000.hgt", [[1, 2], [3, 4]])
    hgt(tmp_path, "N35W072.hgt", [[0, 0, 0], [0, 0, 0], [7, 8, 9]])
    (tmp_path / "notes.txt").write_bytes(b"no grid")
    (tmp_path / "N00E001.hgt").write_bytes(b"")
    cells = grids.read_hgt(spark, str(tmp_path))
    got = {(r.tile_x, r.tile_y, r.x, r.y): r.value for r in cells.collect()}
    assert len(got) == 31 and got[-72, 34, 0, 0] == 1 and got[-72, 34, 2, 0] == 300 and got[-72, 34, 1, 1] is None and got[-72, 34, 0, 2] == 7 and got[-71, 34, 2, 0] == -5 and got[0, -1, 1, 1] == 2
    once = grids.without_shared_edges(cells.filter("tile_y > 0"))
    places = [((r.tile_x * 2 + r.x), (r.tile_y * 2 + r.y)) for r in once.collect()]
    assert len(places) == len(set(places)) == 27 - 3 - 3
    back = grids.hgt_cells(grids.hgt_contents(cells.filter("not (tile_x = -72 and tile_y = 34 and x = 1 and y = 2)")))
    assert {(r.tile_x, r.tile_y, r.x, r.y): r.value for r in back.collect()} == got | {(-72, 34, 1, 2): None}
    void = cells.withColumn("value", F.lit(None).cast("int"))
    assert grids.hgt_contents(void).count() == 0


def test_text_grids(spark):
    text = "ncols 3\nnrows 2\nxllcorner -0.25\nyllcorner 9.75\ncellsize 0.5\nNODATA_value -1\n1 2 -1\n4 x 6 7"
    plain = "NCOLS 1\nNROWS 1\nXLLCORNER 0\nYLLCORNER 0\nCELLSIZE 1\n-9999"
    frame = spark.createDataFrame([("a", text), ("b", plain), ("c", "rows 1"), ("d", None), ("e", "")], "file string, value string")
    got = {(r.file, r.x, r.y): r.value for r in grids.arc_cells(frame).collect()}
    assert got == {("a", 0, 1): 1.0, ("a", 1, 1): 2.0, ("a", 2, 1): None, ("a", 0, 0): 4.0, ("a", 1, 0): None, ("a", 2, 0): 6.0, ("b", 0, 0): None}
    edges = {tuple(r) for r in grids.arc_cells(frame).filter("file = 'a'").select("west", "south", "east", "north").collect()}
    assert edges == {(0.0, 10.0, 1.0, 10.5)}


def test_map_files(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        """<?xml version="1.0"?>
<osm>
 <node id="1" lat="2.5" lon="-3.5"/>
 <node id="2" lat="1" lon="1"><tag k="name" v="A &amp; B"/></node>
 <way id="7"><nd ref="2"/><nd ref="1"/><nd ref="2"/><tag k="natural" v="water"/></way>
 <way id="8"/>
 <relation id="9"><member type="way" ref="7" role="outer"/><member type="node" ref="1" role=""/><tag k="type" v="multipolygon"/></relation>
</osm>"""
    )
    read = osm.read_osm(spark, str(tmp_path))
    assert {(r.node_id, r.lon, r.lat, r.tags.get("name")) for r in read["nodes"].collect()} == {(1, -3.5, 2.5, None), (2, 1.0, 1.0, "A & B")}
    assert sorted(tuple(r) for r in read["refs"].collect()) == [(7, 0, 2), (7, 1, 1), (7, 2, 2)]
    assert {r.way_id: r.tags for r in read["ways"].collect()} == {7: {"natural": "water"}, 8: {}}
    assert [(r.rel_id, r.rel_type) for r in read["relations"].collect()] == [(9, "multipolygon")]
    assert [(r.pos, r.kind, r.ref, r.role or "") for r in read["members"].orderBy("pos").collect()] == [(0, "way", 7, "outer"), (1, "node", 1, "")]
    osm.write_osm(read, str(tmp_path / "again"))
    again = osm.read_osm(spark, str(tmp_path / "again"))
    for name in read:
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, read[name].collect())), name
