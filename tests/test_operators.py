"""Operators on small hand-made cases that the tables do not have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.jobs.registry import ORACLES, QUERIES
from tessera.operators import airports, greedy, network, points, raster, rules, segments, terrain, vectors


def cells(spark, rows):
    return spark.createDataFrame(rows, "x long, y long, value double")


def joined_rows(df):
    """Rows that the joins of a collected table gave."""

    def found(plan):
        below = [plan.plan()] if "QueryStage" in plan.getClass().getSimpleName() else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return own + sum(map(found, below))

    plan = df._jdf.queryExecution().executedPlan()
    return found(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)


def test_scanline_gaps_at_both_ends_and_between(spark):
    got = raster.fill_scanline_gaps(cells(spark, [(0, 0, None), (1, 0, 2.0), (2, 0, None), (3, 0, None), (4, 0, 8.0), (5, 0, None), (0, 1, None)]))
    assert {(r.x, r.y): r.value for r in got.collect()} == {(0, 0): 2.0, (1, 0): 2.0, (2, 0): 4.0, (3, 0): 6.0, (4, 0): 8.0, (5, 0): 8.0, (0, 1): None}


def test_empty_raster(spark):
    nothing = cells(spark, [])
    for out in (raster.fill_scanline_gaps(nothing), raster.erode(nothing, 2), raster.trimmed_mean(nothing), raster.slope_aspect(nothing, 30.0), raster.gaussian_blur(nothing, 1.0)):
        assert out.count() == 0


def test_two_steps_of_erosion(spark):
    square = [(x, y, None if (x, y) == (0, 0) else 1.0) for x in range(5) for y in range(5)]
    left = {(r.x, r.y) for r in raster.erode(cells(spark, square), 2).collect() if r.value is not None}
    assert left == {(x, y) for x in range(5) for y in range(5) if max(x, y) > 2}


def test_flat_raster_has_no_slope(spark):
    got = raster.slope_aspect(cells(spark, [(x, y, 7.0) for x in range(3) for y in range(3)]), 30.0).collect()
    assert all(r.slope == 0 and r.aspect == 0 for r in got)


def test_bilinear_ignores_void_corners(spark):
    grid = cells(spark, [(0, 0, 10.0), (1, 0, None), (0, 1, 20.0), (1, 1, None)])
    spots = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "id long, px double, py double")
    assert {r.id: r.value for r in raster.sample_bilinear(spots, grid, "id").collect()} == {1: 15.0, 2: None}


def test_first_rule_wins_and_equal_bounds_mean_any(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "kind long, t double")
    table = [rules.Rule("cold", {}, {"t": (0.0, 10.0)}), rules.Rule("two", {"kind": 2}, {"t": (1.0, 1.0)}), rules.Rule("rest", {"kind": 1})]
    assert [r[0] for r in df.select(rules.first_match(table, "-1")).collect()] == ["cold", "two", "-1"]


def test_attribute_patterns(spark):
    df = spark.createDataFrame([({"a": "x"},), ({"a": ""},), ({},)], "tags map<string,string>")
    table = [({"a": "*"}, "full"), ({"a": "!-"}, "empty"), ({"a": "-"}, "missing")]
    assert [r[0] for r in df.select(rules.first_attribute_match("tags", table)).collect()] == ["full", "empty", "missing"]


def test_components_of_a_long_chain_a_loop_and_parallel_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)]
    found = {r.node: r.component for r in network.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(41)} == {0} and found[100] == 100 and found[201] == 200


def test_dead_ends_go_in_rounds(spark):
    edges = spark.createDataFrame([(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 5, 6)], "edge_id long, src long, dst long")
    wet = spark.createDataFrame([(1,), (2,)], "edge_id long")
    assert {r.edge_id for r in network.prune_dead_ends(edges, wet).collect()} == {3, 4}


def test_duplicate_roads_tie_keeps_the_twin(spark):
    segments = spark.createDataFrame([(1, 1, 2, 5), (2, 2, 1, 5), (3, 1, 2, 7), (4, 8, 9, 1), (5, 9, 8, 2)], "edge_id long, src long, dst long, feat_type long")
    assert {(r.src, r.dst, r.feat_type) for r in network.drop_duplicate_roads(segments).collect()} == {(2, 1, 5), (8, 9, 1)}


def test_node_on_a_grid_line_belongs_to_both_tiles(spark):
    nodes = spark.createDataFrame([(1, -120.0, 34.5)], "node_id long, lon double, lat double")
    assert {(r.tile_x, r.tile_y) for r in vectors.per_tile(vectors.node_boxes(nodes), "node_id").collect()} == {(-121, 34), (-120, 34)}


def test_ways_keep_order_and_skip_missing_nodes(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "node_id long, lon double, lat double")
    refs = spark.createDataFrame([(7, 1, 2), (7, 2, 9), (7, 3, 1), (8, 1, 9)], "way_id long, pos long, node_id long")
    got = vectors.assemble_ways(nodes, refs).collect()
    assert [(r.way_id, [p.lon for p in r.points]) for r in got] == [(7, [1.0, 0.0])]


def test_near_pairs_meet_once_across_squares(spark):
    spots = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.00001, 50.0), (3, 10.0, 50.00001), (4, 11.0, 50.0)], "id long, lon double, lat double")
    assert {(r.a, r.b) for r in points.near_pairs(spots, 3.0, "id").collect()} == {(1, 2), (1, 3), (2, 3)}


def test_points_of_one_place_are_tested_as_one(spark):
    spots = [(i, 10.0 + 0.00001 * (i % 3), 50.0) for i in range(300)] + [(i, 10.0, 50.0) for i in (7, 9)] + [(None, 10.0, 50.0), (400, None, 50.0)]
    got = points.near_pairs(spark.createDataFrame(spots, "id long, lon double, lat double"), 1.0, "id")
    want = sorted((a[0], b[0]) for a in spots[:-2] for b in spots[:-2] if a[0] < b[0] and abs(a[1] - b[1]) < 0.000011)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    assert joined_rows(got) <= 15


def test_metres_are_rounded_once_for_two_places(spark):
    """Rounding comes before the listing of ids, not after: there it costs more than all the rest."""
    from tessera.jobs.registry import QUERIES
    from tests.conftest import DATA

    plan = QUERIES["j18_points_near_pairs"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(ids2" in plan and plan.rindex("explode(ids2") < plan.index("round(")
    spots = spark.createDataFrame([(i, 10.0 + 0.00001 * (i % 2), 50.0) for i in range(6)], "id long, lon double, lat double")
    exact = {(r.a, r.b): r.metres for r in points.near_pairs(spots, 3.0, "id").collect()}
    assert len(exact) == 15 and {(r.a, r.b): r.metres for r in points.near_pairs(spots, 3.0, "id", digits=2).collect()} == {k: round(v, 2) for k, v in exact.items()}


def test_equal_segments_are_tested_as_one(spark):
    kinds = [(0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.2), (5.0, 5.0, 5.0, 5.0)]
    lines = [(i, *kinds[i % 4]) for i in range(200)] + [(5, *kinds[0]), (None, *kinds[0]), (300, None, 0.0, 1.0, 1.0)]
    got = segments.crossings(spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), 0.5)
    cross = {(kinds[i], kinds[j]) for i, j in ((0, 1), (1, 0), (1, 2), (2, 1))}
    want = sorted((a[0], b[0]) for a in lines[:-2] for b in lines[:-2] if a[0] < b[0] and (a[1:], b[1:]) in cross)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    assert joined_rows(got) <= 200


def test_overlay_with_a_soft_edge_needs_no_sort(spark):
    places = [(x, y) for x in range(9) for y in range(9)]
    base, over = cells(spark, [(x, y, 10.0) for x, y in places]), cells(spark, [(x, y, None if (x, y) == (4, 4) else 1.0) for x, y in places])
    merged = terrain.raster_merge(base, over, 2)
    got = {(r.x, r.y): r.value for r in merged.collect()}
    assert (got[4, 4], got[4, 3], got[0, 0]) == (10.0, 5.5, 1.0) and len(got) == 81
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()


def test_bands_of_frequency_share_a_shuffle(spark):
    split = terrain.frequency_split(cells(spark, [(0, 0, 1.0), (1, 0, 3.0), (2, 0, 8.0), (3, 3, None), (-1, 0, 5.0)]), 2)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count(" Sort ")) == (1, 1)
    got = {(r.band, r.x, r.y): r.value for r in split.collect()}
    assert [got[b, 0, 0] for b in range(3)] == [-1.0, -2.0, 4.0] and [got[b, 2, 0] for b in range(3)] == [0.0, 4.0, 4.0] and got[2, -1, 0] == 5.0
    assert len(got) == 15 and {got[b, 3, 3] for b in range(3)} == {None}
    assert {r.value for r in terrain.frequency_split(cells(spark, [(0, 0, 1.0)]), 0).collect()} == {1.0}


def shuffled_rows(df):
    """Rows that the exchanges of a collected table wrote."""

    def found(plan):
        below = [plan.plan()] if "QueryStage" in plan.getClass().getSimpleName() else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        return own + sum(map(found, below))

    return found(df._jdf.queryExecution().executedPlan().executedPlan())


def odd_raster():
    """Missing, void and repeated cells on both sides of the borders of squares, in two layers."""
    made = []
    for layer, x, y in ((n, x, y) for n in (1, 2) for x in range(-70, 70) for y in range(-30, 10)):
        k = (x * 7919 + y * 104729 + layer * 31) % 997
        made += [] if k % 4 == 0 else [(layer, x, y, None if k % 7 < 2 else float((k + i) % 11)) for i in range(3 if k % 50 == 1 else 1)]
    return made


def by_place(rows):
    found = {}
    for layer, x, y, value in rows:
        found.setdefault((layer, x, y), []).append(value)
    return found


def test_trimmed_means_across_squares_shuffle_each_cell_about_once(spark):
    rows = odd_raster()
    places = by_place(rows)
    want = {}
    for n, x, y in places:
        near = sorted(v for dx, dy in raster.box(2) for v in places.get((n, x + dx, y + dy), []) if v is not None)
        kept = near[len(near) // 8 : len(near) - len(near) // 3]
        want[n, x, y] = sum(kept) / len(kept) if kept else None
    out = raster.trimmed_mean(spark.createDataFrame(rows, "layer long, x long, y long, value double").repartition(4), 2, ["layer"])
    got = out.collect()
    assert {(r.layer, r.x, r.y): r.value for r in got} == want and len(got) == len(want)
    # One row a cell for the test's own repartition, and little more than one for the windows.
    assert shuffled_rows(out) <= 2.3 * len(rows)


def test_disagreements_across_squares_shuffle_each_cell_about_once(spark):
    rows = odd_raster()
    places = by_place(rows)
    want = {}
    for (n, x, y), held in places.items():
        own = max((v for v in held if v is not None), default=None)
        near = [v for dx, dy in raster.box(2) if (dx, dy) != (0, 0) for v in places.get((n, x + dx, y + dy), [])]
        want[n, x, y] = (len(near) if own is None else 24) - near.count(own)
    out = raster.neighbour_disagreement(spark.createDataFrame(rows, "layer long, x long, y long, value double").repartition(4), 2, ["layer"])
    got = out.collect()
    assert {(r.layer, r.x, r.y): r.value for r in got} == want and len(got) == len(want)
    assert shuffled_rows(out) <= 2.3 * len(rows)


def test_windows_of_a_place_with_many_cells_go_in_steps(spark):
    """More neighbours in a square than a task looks at in one step."""
    rows = [(x, y, float((x + y + i) % 5)) for x in range(40) for y in range(40) for i in range(30)]
    assert len(rows) * 25 > raster.STEP
    got = {(r.x, r.y): r.value for r in raster.trimmed_mean(cells(spark, rows)).collect()}
    # Each place has 0 … 4 six times: of 750 values 93 go at the low end and 250 at the high, 57 zeros, 150 ones, 150 twos, 50 threes stay.
    assert len(got) == 1600 and got[20, 20] == (57 * 0 + 150 + 300 + 150) / 407
    assert got[0, 0] == pytest.approx(sum(sorted([0, 1, 2, 3, 4] * 54)[33:180]) / 147)


def test_trimmed_means_of_lone_voids_are_left_out_as_in_the_sql(spark, tmp_path):
    orders = str(tmp_path / "orders.parquet")
    spark.createDataFrame([(13,), (500,), (501,), (520,), (7800,)], "o_orderkey long").write.parquet(orders)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{orders}/*.parquet')")
    got = QUERIES["w6_trimmed_mean_surface"](spark, str(tmp_path))
    want = con.sql(ORACLES["w6_trimmed_mean_surface"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and got.count() == 2


def test_ring_measures(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0))])
    row = spark.range(1).select(geo.ring_area(ring).alias("a"), geo.ring_centroid(ring).alias("c"), geo.point_in_ring(F.lit(1.0), F.lit(1.0), ring).alias("i"), geo.point_in_ring(F.lit(5.0), F.lit(1.0), ring).alias("o")).first()
    assert (row.a, row.c.x, row.c.y, row.i, row.o) == (8.0, 2.0, 1.0, True, False)


def test_tile_path_floors_below_zero(spark):
    assert spark.range(1).select(geo.tile_path(F.lit(-0.5), F.lit(-0.5))).first()[0] == "-10-010/-01-001"


def test_flows_that_later_winds_cannot_reach(spark):
    flows = spark.createDataFrame([(1, 1, 1, 0, 359, 20.0), (2, 1, 2, 10, 20, 15.0), (3, 1, 3, 350, 370, 30.0)], "flow long, apt long, place long, from_deg long, to_deg long, knots double")
    assert [r.flow for r in airports.unreachable_flows(flows).collect()] == [2]


@pytest.mark.parametrize("heading", [0.0, 45.0, 270.0])
def test_runway_ends_are_a_length_apart(spark, heading):
    ends = geo.runway_ends(F.lit(10.0), F.lit(50.0), F.lit(heading), F.lit(3000.0))
    row = spark.range(1).select(ends.alias("e")).select(geo.dist_m(*map(F.col, ("e.lon1", "e.lat1", "e.lon2", "e.lat2")))).first()
    assert abs(row[0] - 3000) < 1


def test_simplified_line_keeps_ends_and_corners(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.01), (1, 2, 2.0, 0.0), (1, 3, 2.0, 5.0), (2, 0, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 0.0, 0.0), (3, 2, 0.0, 0.0)], "way long, pos long, lon double, lat double")
    got = greedy.simplify_lines(line, "way", 0.1).collect()
    assert sorted((r.way, r.pos) for r in got) == [(1, 0), (1, 2), (1, 3), (2, 0), (3, 0), (3, 2)]


def test_many_lines_are_simplified_together(spark):
    import random

    draw = random.Random(5)
    lines = {i: [(draw.random(), draw.randrange(4) / 4) for _ in range(draw.choice((1, 2, 3, 7, 40)))] for i in range(60)}

    def kept(line, tolerance=0.3):
        stay, spans = {0, len(line) - 1}, [(0, len(line) - 1)]
        while spans:
            a, b = spans.pop()
            (x, y), (u, v) = line[a], line[b]
            far = [abs((u - x) * (q - y) - (v - y) * (p - x)) / ((u - x) ** 2 + (v - y) ** 2) ** 0.5 for p, q in line[a + 1 : b]]
            if far and max(far) > tolerance:
                k = a + 1 + far.index(max(far))
                stay.add(k)
                spans += [(a, k), (k, b)]
        return stay

    frame = spark.createDataFrame([(i, n, *p) for i, line in lines.items() for n, p in enumerate(line)], "way long, pos long, lon double, lat double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # lines go on over batches
    try:
        out = greedy.simplify_lines(frame, "way", 0.3)
        assert sorted((r.way, r.pos) for r in out.collect()) == sorted((i, n) for i, line in lines.items() for n in kept(line))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # no call for each line


def test_near_duplicates_go_greedily_by_rank(spark):
    import math
    import random

    draw = random.Random(3)
    rows = [(i, i % 3, float(draw.randrange(5)), 10 + draw.random() * 0.002, 50 + draw.random() * 0.001) for i in range(120)]
    stay = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        near = lambda s: math.hypot((s[3] - r[3]) * math.cos(math.radians((s[4] + r[4]) / 2)), s[4] - r[4]) * geo.DEG_TO_MTR_LAT <= 10  # noqa: E731, B023
        if not any(s[1] == r[1] and near(s) for s in stay):
            stay.append(r)
    got = greedy.remove_near_duplicates(spark.createDataFrame(rows, "id long, face_id long, rank double, lon double, lat double"), 10.0).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in stay)


def test_near_duplicates_at_one_place_make_no_pairs(spark, monkeypatch):
    kept, held = network.checkpointed, []

    def counted(df):
        out = kept(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(network, "checkpointed", counted)
    monkeypatch.setattr(greedy, "checkpointed", counted, raising=False)
    rows = [(i, i % 2, float(i % 7), 10.0, 50.0 + i % 3) for i in range(300)] + [(900, None, 9.0, 10.0, 50.0), (901, 0, None, 10.0, None), (902, 5, None, 10.0, 50.0)]
    got = greedy.remove_near_duplicates(spark.createDataFrame(rows, "id long, face_id long, rank double, lon double, lat double"), 10.0).collect()
    best = {min((-r[2], r[0]) for r in rows[:300] if r[1] == f and r[4] == 50.0 + k)[1] for f in (0, 1) for k in range(3)}
    assert {r.id for r in got} == best | {900, 901, 902} and len(got) == 9
    assert sum(held) < len(rows)


def test_regions_join_around_corners(spark):
    picture = ["aab", "bab", "aaa", "bbb"]
    rows = [(x, y, float(ord(c))) for y, line in enumerate(picture) for x, c in enumerate(line)]
    got = {(r.x, r.y): r.region for r in terrain.regions(cells(spark, rows), 3).collect()}
    assert {got[p] for p in ((0, 0), (1, 0), (1, 1), (0, 2), (1, 2), (2, 2))} == {0} and got[2, 0] == got[2, 1] == 2 and got[0, 1] == 3 and {got[x, 3] for x in range(3)} == {9}
    small = terrain.eliminate_small_regions(cells(spark, rows), float(ord("b")), 2, 3).collect()
    assert [(r.x, r.y) for r in small if r.value is None] == [(0, 1)]


def test_mode_flood_fills_from_the_border(spark):
    rows = [(x, y, 1.0 if x == 0 else 2.0 if x == 4 else None) for x in range(5) for y in range(3)]
    got = {(r.x, r.y): r.value for r in terrain.fill_mode_flood(cells(spark, rows)).collect()}
    assert [got[x, 1] for x in range(5)] == [1.0, 1.0, 1.0, 2.0, 2.0]
