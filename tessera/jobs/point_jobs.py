"""Obstacle queries: tiles, heights, scalar geometry, pairs, faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.jobs.registry import query
from tessera.operators.points import face_of, near_pairs, with_tile
from tessera.sources.fixtures import derived

RAD = "pi()/180"


@query("SELECT floor(lon)::BIGINT AS tile_x, floor(lat)::BIGINT AS tile_y, kind, min(agl) AS low, max(agl) AS high, count(*) AS n FROM obstacles GROUP BY ALL", "obstacles")
def a1_height_range_by_tile(spark, sf_dir):
    tiled = with_tile(derived(spark, sf_dir, "obstacles"))
    return tiled.groupBy("tile_x", "tile_y", "kind").agg(F.min("agl").alias("low"), F.max("agl").alias("high"), F.count("*").alias("n"))


@query("SELECT kind, min(agl) AS low, max(agl) AS high, (SELECT count(*) FROM obstacles) AS all_obstacles FROM obstacles GROUP BY kind", "obstacles")
def a1_height_range_by_kind(spark, sf_dir):
    found = derived(spark, sf_dir, "obstacles").groupBy("kind").agg(F.min("agl").alias("low"), F.max("agl").alias("high"), F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(found.agg(F.sum("n").alias("all_obstacles")))).drop("n")


@query("SELECT obs_id, floor(lon)::BIGINT AS tile_x, floor(lat)::BIGINT AS tile_y FROM obstacles", "obstacles")
def j1_assign_tile(spark, sf_dir):
    return with_tile(derived(spark, sf_dir, "obstacles")).select("obs_id", "tile_x", "tile_y")


@query("SELECT kind, count(*) AS n, round(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM obstacles GROUP BY kind", "obstacles")
def a2_object_usage_histogram(spark, sf_dir):
    counts = derived(spark, sf_dir, "obstacles").groupBy("kind").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"SELECT obs_id, round(sqrt(power((lon+120)*cos((lat+35)/2*{RAD}), 2)+power(lat-35, 2))*6371008.0*{RAD}, 3) AS metres FROM obstacles", "obstacles")
def p1_dist_m(spark, sf_dir):
    return derived(spark, sf_dir, "obstacles").select("obs_id", F.round(geo.dist_m(F.col("lon"), F.col("lat"), F.lit(-120.0), F.lit(35.0)), 3).alias("metres"))


@query(
    f"""WITH k AS (SELECT obs_id, lat*{RAD} AS r, (1/298.257223563)*(2-1/298.257223563) AS e2 FROM obstacles)
 SELECT obs_id, round({RAD}*6378137.0/sqrt(1-e2*sin(r)*sin(r))*cos(r), 4) AS lon_m, round({RAD}*6378137.0*(1-e2)/power(1-e2*sin(r)*sin(r), 1.5), 4) AS lat_m FROM k""",
    "obstacles",
)
def p2_deg2mtr(spark, sf_dir):
    m = geo.deg2mtr(F.col("lat"))
    return derived(spark, sf_dir, "obstacles").select("obs_id", F.round(m["lon_m"], 4).alias("lon_m"), F.round(m["lat_m"], 4).alias("lat_m"))


@query(
    f"""WITH h AS (SELECT obs_id, atan2((lon+120)*cos(lat*{RAD}), lat-35)/({RAD})-(lon+120)*sin(lat*{RAD}) AS a FROM obstacles)
 SELECT obs_id, round(a-360*floor(a/360), 6) AS heading FROM h""",
    "obstacles",
)
def p3_heading_from_vector(spark, sf_dir):
    heading = geo.heading_from_vector(F.col("lon"), F.col("lat"), F.col("lon") + 120, F.col("lat") - 35)
    return derived(spark, sf_dir, "obstacles").select("obs_id", F.round(heading, 6).alias("heading"))


@query(
    f"""SELECT rwy_id, round(a.lon-dx, 9) AS lon1, round(a.lat-dy, 9) AS lat1, round(a.lon+dx, 9) AS lon2, round(a.lat+dy, 9) AS lat2 FROM (SELECT rwy_id, apt_id, length_m/2*sin(num_lo*10*{RAD}) AS ex, length_m/2*cos(num_lo*10*{RAD}) AS ny FROM runways) r
 JOIN airports a USING (apt_id), LATERAL (SELECT ex/(6371008.0*{RAD}*cos(a.lat*{RAD})) AS dx, ny/(6371008.0*{RAD}) AS dy)""",
    "runways",
    "airports",
)
def p4_runway_ends(spark, sf_dir):
    placed = derived(spark, sf_dir, "runways").join(derived(spark, sf_dir, "airports").select("apt_id", "lon", "lat"), "apt_id")
    ends = placed.select("rwy_id", geo.runway_ends(F.col("lon"), F.col("lat"), F.col("num_lo") * 10, F.col("length_m")).alias("e"))
    return ends.select("rwy_id", *[F.round(f"e.{c}", 9).alias(c) for c in ("lon1", "lat1", "lon2", "lat2")])


@query(f"SELECT obs_id, round((lon+120)*6371008.0*{RAD}*cos(35*{RAD}), 4) AS x, round((lat-35)*6371008.0*{RAD}, 4) AS y FROM obstacles", "obstacles")
def p5_ll_to_m(spark, sf_dir):
    m = geo.ll_to_m(F.lit(-120.0), F.lit(35.0), F.col("lon"), F.col("lat"))
    return derived(spark, sf_dir, "obstacles").select("obs_id", F.round(m["x"], 4).alias("x"), F.round(m["y"], 4).alias("y"))


@query("SELECT face_id FROM faces WHERE west <= -119 AND west+0.2 >= -121 AND south <= 35 AND south+0.2 >= 33", "faces")
def p6_bbox_overlap(spark, sf_dir):
    face = (F.col("west"), F.col("south"), F.col("west") + 0.2, F.col("south") + 0.2)
    return derived(spark, sf_dir, "faces").filter(geo.bbox_overlap(face, tuple(map(F.lit, (-121.0, 33.0, -119.0, 35.0))))).select("face_id")


@query("SELECT face_id, round(CAST(0.04 AS DOUBLE), 9) AS area, round(west+0.1, 6) AS x, round(south+0.1, 6) AS y FROM faces", "faces")
def p7_polygon_area_centroid(spark, sf_dir):
    w, s = F.col("west"), F.col("south")
    corner = lambda dx, dy: F.struct((w + dx).alias("x"), (s + dy).alias("y"))
    rings = derived(spark, sf_dir, "faces").select("face_id", F.array(corner(0.0, 0.0), corner(0.2, 0.0), corner(0.2, 0.2), corner(0.0, 0.2)).alias("ring"))
    middle = geo.ring_centroid(F.col("ring"))
    return rings.select("face_id", F.round(geo.ring_area(F.col("ring")), 9).alias("area"), F.round(middle["x"], 6).alias("x"), F.round(middle["y"], 6).alias("y"))


@query(
    """WITH e(x1, y1, x2, y2) AS (VALUES (-122.0, 33.0, -119.0, 33.5), (-119.0, 33.5, -120.5, 36.5), (-120.5, 36.5, -122.0, 33.0))
 SELECT obs_id FROM obstacles, e WHERE ((x1 < lon AND lon <= x2) OR (x2 < lon AND lon <= x1)) AND lat > y1+(y2-y1)*(lon-x1)/(x2-x1) GROUP BY obs_id HAVING count(*)%2=1""",
    "obstacles",
)
def p8_point_in_polygon(spark, sf_dir):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(corner(-122.0, 33.0), corner(-119.0, 33.5), corner(-120.5, 36.5))
    return derived(spark, sf_dir, "obstacles").filter(geo.point_in_ring(F.col("lon"), F.col("lat"), ring)).select("obs_id")


@query(
    """SELECT obs_id, round(power(lon-(-122+3*t), 2)+power(lat-(33+4*t), 2), 6) AS d2 FROM (SELECT obs_id, lon, lat, greatest(0.0, least(1.0, ((lon+122)*3+(lat-33)*4)/25.0)) AS t FROM obstacles)""",
    "obstacles",
)
def p9_segment_distance(spark, sf_dir):
    d2 = geo.segment_distance2(F.col("lon"), F.col("lat"), *map(F.lit, (-122.0, 33.0, -119.0, 37.0)))
    return derived(spark, sf_dir, "obstacles").select("obs_id", F.round(d2, 6).alias("d2"))


@query("SELECT node_id FROM osm_nodes WHERE lon BETWEEN -121.5 AND -119.25 AND lat BETWEEN 33.1 AND 35.7", "osm_nodes")
def p11_crop_points(spark, sf_dir):
    return derived(spark, sf_dir, "osm_nodes").filter(F.col("lon").between(-121.5, -119.25) & F.col("lat").between(33.1, 35.7)).select("node_id")


@query("SELECT obs_id, round(floor(lon*3600+0.5)/3600, 9) AS lon, round(floor(lat*3600+0.5)/3600, 9) AS lat FROM obstacles", "obstacles")
def p13_round_by_parts(spark, sf_dir):
    return derived(spark, sf_dir, "obstacles").select("obs_id", *[F.round(geo.round_by_parts(F.col(c), 3600), 9).alias(c) for c in ("lon", "lat")])


@query(
    """SELECT obs_id, i, round(lon*power(1-i/4.0, 3)+3*(lon+0.1)*power(1-i/4.0, 2)*(i/4.0)+3*(lon+0.2)*(1-i/4.0)*power(i/4.0, 2)+(lon+0.1)*power(i/4.0, 3), 6) AS x FROM obstacles, (VALUES (0), (1), (2), (3), (4)) s(i)""",
    "obstacles",
)
def p20_bezier_sample(spark, sf_dir):
    stepped = derived(spark, sf_dir, "obstacles").select("obs_id", "lon", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    x = geo.bezier_point(F.col("lon"), F.col("lon") + 0.1, F.col("lon") + 0.2, F.col("lon") + 0.1, F.col("i") / 4)
    return stepped.select("obs_id", "i", F.round(x, 6).alias("x"))


@query(
    """SELECT obs_id, concat(format('{:+03d}', (floor(lat/10)*10)::INT), format('{:+04d}', (floor(lon/10)*10)::INT), '/', format('{:+03d}', floor(lat)::INT), format('{:+04d}', floor(lon)::INT)) AS path FROM obstacles""",
    "obstacles",
)
def s13_tile_path(spark, sf_dir):
    return derived(spark, sf_dir, "obstacles").select("obs_id", geo.tile_path(F.col("lon"), F.col("lat")).alias("path"))


_METRES = f"sqrt(power((b.lon-a.lon)*cos((a.lat+b.lat)/2*{RAD}), 2)+power(b.lat-a.lat, 2))*6371008.0*{RAD}"


@query(f"SELECT a.obs_id AS a, b.obs_id AS b, round({_METRES}, 3) AS metres FROM obstacles a JOIN obstacles b ON a.obs_id < b.obs_id AND b.lat BETWEEN a.lat-0.06 AND a.lat+0.06 AND {_METRES} <= 5000", "obstacles")
def j18_points_near_pairs(spark, sf_dir):
    return near_pairs(derived(spark, sf_dir, "obstacles"), 5000.0, "obs_id", 45.0, digits=3)


@query("SELECT obs_id, kind, agl, face_id FROM obstacles JOIN faces ON lon >= west AND lon < west+0.2 AND lat >= south AND lat < south+0.2 WHERE kind IS NOT NULL", "obstacles", "faces")
def j6_feature_to_face(spark, sf_dir):
    return face_of(derived(spark, sf_dir, "obstacles").filter("kind is not null"), derived(spark, sf_dir, "faces"), "obs_id", 0.2).select("obs_id", "kind", "agl", "face_id")


@query("SELECT face_id, count(obs_id) AS n, min(msl) AS low, max(msl) AS high, round(avg(msl), 6) AS mean FROM faces LEFT JOIN obstacles ON lon >= west AND lon < west+0.2 AND lat >= south AND lat < south+0.2 GROUP BY face_id", "faces", "obstacles")
def j9_zonal_stats(spark, sf_dir):
    faces = derived(spark, sf_dir, "faces")
    met = face_of(derived(spark, sf_dir, "obstacles"), faces, "obs_id", 0.2).select("face_id", "obs_id", "msl")
    stats = met.groupBy("face_id").agg(F.count("obs_id").alias("n"), F.min("msl").alias("low"), F.max("msl").alias("high"), F.round(F.avg("msl"), 6).alias("mean"))
    return faces.select("face_id").join(stats, "face_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT face_id, kind, count(*) AS n FROM faces JOIN obstacles ON lon >= west AND lon < west+0.2 AND lat >= south AND lat < south+0.2 GROUP BY ALL", "faces", "obstacles")
def j10_zonal_histogram(spark, sf_dir):
    return face_of(derived(spark, sf_dir, "obstacles"), derived(spark, sf_dir, "faces"), "obs_id", 0.2).groupBy("face_id", "kind").agg(F.count("*").alias("n"))
