"""Rings of relations against a plain reading of the order in which ways go, and small cases of tags and boxes."""

import random

from pyspark.sql import functions as F

from tessera.operators import osm
from tessera.sources import osm as maps


def plain_linked(ways):
    """One way at a time: count ends, drop the first open way with an end that is not shared by two, put the last one in its place."""
    ways = list(ways)
    for role in (False, True):
        while True:
            ends = [n for _, inner, a, b in ways if inner == role and a != b for n in (a, b)]
            loose = [i for i, (_, inner, a, b) in enumerate(ways) if inner == role and a != b and (ends.count(a) != 2 or ends.count(b) != 2)]
            if not loose:
                break
            ways[loose[0]] = ways[-1]
            ways.pop()
    return ways


def test_loose_ways_go_in_the_stated_order():
    for seed in range(400):
        draw = random.Random(seed)
        ways = [(i, draw.random() < 0.3, draw.randrange(6), draw.randrange(6)) for i in range(draw.randrange(14))]
        assert osm.linked(ways) == plain_linked(ways), seed
        chained = osm.chained(osm.linked(ways))
        kept = {w: (a, b) for w, _, a, b in ways}
        for ring in {r for r, *_ in chained}:
            ends = [kept[w][::-1] if back else kept[w] for r, _, _, w, back in chained if r == ring]
            assert all(x[1] == y[0] for x, y in zip(ends, ends[1:] + ends[:1]))


def test_repeated_ways_keep_the_first():
    assert osm.without_repeats([(1,), (2,), (1,), (3,), (2,), (4,)]) == [(1,), (2,), (4,), (3,)]
    assert osm.without_repeats([]) == []


def tables(spark):
    nodes = [(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 4.0), (4, 0.0, 4.0), (5, 1.0, 1.0), (6, 2.0, 1.0), (7, 2.0, 2.0)]
    refs = {10: [1, 2, 3], 11: [1, 4, 99, 3], 12: [5, 6, 7, 5], 13: [3, 7], 14: [99], 15: [2, 6]}
    members = [(1, 0, 10, "outer"), (1, 1, 12, "inner"), (1, 2, 11, None), (1, 3, 10, "outer"), (1, 4, 13, "outer"), (1, 5, 14, ""), (1, 6, 777, ""), (2, 0, 12, "inner"), (2, 1, 13, "outer"), (3, 0, 12, "outer")]
    return (
        spark.createDataFrame(members, "rel_id long, pos long, way_id long, role string"),
        spark.createDataFrame([(w, i, n) for w, ns in refs.items() for i, n in enumerate(ns)], "way_id long, pos long, node_id long"),
        spark.createDataFrame(nodes, "node_id long, lon double, lat double"),
    )


def test_rings_of_relations(spark):
    got = {(r.rel_id, r.inner): [(p.x, p.y) for p in r.points] for r in osm.assemble_multipolygons(*tables(spark)).collect()}
    # A loose third way at node 3: the first way with three ends there goes first, and all the others with it.
    assert set(got) == {(3, False)} and got[3, False] == [(2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    members, refs, nodes = tables(spark)
    got = {(r.rel_id, r.inner): [(p.x, p.y) for p in r.points] for r in osm.assemble_multipolygons(members.filter("way_id <> 13"), refs, nodes).collect()}
    assert got[1, False] == [(0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    assert got[1, True] == [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)] and (2, True) not in got
    assert osm.assemble_multipolygons(members.limit(0), refs, nodes).count() == 0


def test_relations_share_a_call_and_may_span_batches(spark):
    parts = [(rel, pos, rel * 100 + pos, "") for rel in range(40) for pos in range(7)]
    refs = [(way, end, way // 100 * 100 + (way % 100 + end) % 7) for _, _, way, _ in parts for end in (0, 1)]
    members, refs = spark.createDataFrame(parts, "rel_id long, pos long, way_id long, role string"), spark.createDataFrame(refs, "way_id long, pos long, node_id long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 5)
    try:
        steps = osm.ring_steps(members, refs)
        got = sorted(tuple(r) for r in steps.collect())
    finally:
        spark.conf.set(name, before)
    assert got == [(rel, 0, False, pos, rel * 100 + pos, False) for rel in range(40) for pos in range(7)]
    assert "FlatMapGroups" not in steps._jdf.queryExecution().executedPlan().toString()


def test_tags_move_to_relations_without_any(spark):
    members, refs, _ = tables(spark)
    members = members.filter("way_id <> 13")
    steps = osm.ring_steps(members, refs)
    relations = spark.createDataFrame([(1, {"type": "multipolygon"}), (3, {"type": "multipolygon", "name": "own"}), (9, {"type": "route"})], "rel_id long, tags map<string,string>")
    ways = spark.createDataFrame([(10, {"natural": "water", "a": "1"}), (11, {"natural": "wood", "b": "2"}), (12, {"hole": "yes"})], "way_id long, tags map<string,string>")
    got = {r.rel_id: r.tags for r in osm.migrated_tags(relations, members, ways, steps).collect()}
    assert got == {1: {"natural": "water", "a": "1", "b": "2"}, 3: {"name": "own"}, 9: {}}


def test_boxes_of_relations(spark):
    nodes = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.5, 0.5), (3, 9.5, 7.5)], "node_id long, lon double, lat double")
    refs = spark.createDataFrame([(5, 0, 1), (5, 1, 2)], "way_id long, pos long, node_id long")
    relations = spark.createDataFrame([(1, "boundary"), (2, "route"), (3, "boundary")], "rel_id long, rel_type string")
    members = spark.createDataFrame([(1, "way", 5), (1, "node", 3), (1, "relation", 2), (2, "node", 3), (3, "node", 404)], "rel_id long, kind string, ref long")
    boxes = osm.relation_boxes(relations, members, nodes, refs, types=("boundary",))
    assert [tuple(r) for r in boxes.collect()] == [(1, 0, 9, 0, 7)]
    ways, points = osm.widened_by_relations(nodes, refs, members, boxes)
    assert [tuple(r) for r in ways.collect()] == [(5, 0, 9, 0, 7)]
    assert {tuple(r) for r in points.collect()} == {(i, 0, 9, 0, 7) for i in (1, 2, 3)}


def test_written_files_are_bounded(spark, tmp_path):
    tags = F.create_map().cast("map<string,string>")
    ways = spark.range(0, 500, 1, 1).select(F.col("id").alias("way_id"), tags.alias("tags"))
    tables = {
        "nodes": spark.range(0, 1000, 1, 1).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("lon"), F.lit(1.0).alias("lat"), tags.alias("tags")),
        "ways": ways,
        "refs": ways.select("way_id", F.lit(0).cast("long").alias("pos"), F.col("way_id").alias("node_id")),
        "relations": ways.select(F.col("way_id").alias("rel_id"), "tags"),
        "members": ways.select(F.col("way_id").alias("rel_id"), F.lit(0).cast("long").alias("pos"), F.lit("way").alias("kind"), F.col("way_id").alias("ref"), F.lit("").alias("role")),
    }
    maps.write_osm(tables, str(tmp_path), {"node": 100, "way": 50, "relation": 50})
    held = {kind: [path.read_text().count(f"<{kind} ") for path in (tmp_path / f"{kind}s").glob("part-*")] for kind in ("node", "way", "relation")}
    assert {kind: (max(n), sum(n)) for kind, n in held.items()} == {"node": (100, 1000), "way": (50, 500), "relation": (50, 500)}
    read = maps.read_osm(spark, str(tmp_path))
    assert [read[t].count() for t in ("nodes", "ways", "refs", "relations", "members")] == [1000, 500, 500, 500, 500]
