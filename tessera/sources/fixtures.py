"""Spatial inputs derived from the given tables by integer arithmetic that any SQL engine computes alike."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

#: Name → SQL over the given tables, whose names stand in braces.
DERIVED = {
    "obstacles": """SELECT event_id AS obs_id, 1+event_id%7 AS kind,
 CAST(-1240000+(event_id*7919)%80000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(event_id*6007)%60000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat,
 CASE WHEN event_id%11=0 THEN NULL ELSE CAST((event_id*37)%300 AS DOUBLE) END AS agl,
 CASE WHEN event_id%11=0 THEN NULL ELSE CAST((event_id*37)%300+(event_id*53)%2000 AS DOUBLE) END AS msl FROM {events}""",
    "cells": """SELECT CAST(floor(o_orderkey/CAST(120 AS DOUBLE)/CAST(25 AS DOUBLE)) AS BIGINT) AS tile_y,
 CAST(floor((o_orderkey%120)/CAST(40 AS DOUBLE)) AS BIGINT) AS tile_x,
 o_orderkey%120 AS x, CAST(floor(o_orderkey/CAST(120 AS DOUBLE)) AS BIGINT) AS y,
 CASE WHEN (o_orderkey*31)%13=0 THEN NULL ELSE CAST((o_orderkey*7919)%1000 AS DOUBLE) END AS elev,
 1+(CAST(floor((o_orderkey%120)/CAST(5 AS DOUBLE)) AS BIGINT)*7+CAST(floor(o_orderkey/CAST(600 AS DOUBLE)) AS BIGINT)*3)%6 AS landuse,
 CAST((o_orderkey*613)%400 AS DOUBLE)/CAST(10 AS DOUBLE) AS temp,
 CAST((o_orderkey*389)%2000 AS DOUBLE) AS rain FROM {orders}""",
    "road_edges": """SELECT o_orderkey AS edge_id, CAST(floor(o_orderkey/CAST(200 AS DOUBLE)) AS BIGINT) AS net_id, o_orderkey AS src, o_orderkey+1 AS dst,
 1+o_orderkey%3 AS feat_type, o_orderkey%5-1 AS src_h, (o_orderkey+1)%5-1 AS dst_h FROM {orders}
 WHERE o_orderkey%10<>9 AND o_orderkey%23<>0""",
    "airports": """SELECT s_suppkey AS apt_id, concat('K', lpad(CAST(s_suppkey AS VARCHAR(10)),4,'0')) AS icao, s_name AS name,
 CAST(-1240000+(s_suppkey*7919)%80000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(s_suppkey*6007)%60000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat,
 CAST(s_nationkey AS BIGINT) AS region FROM {supplier}""",
    "runways": """SELECT p_partkey AS rwy_id, p_partkey%100 AS apt_id, 1+(p_partkey*7)%36 AS num_lo,
 1+((p_partkey*7)%36+CASE WHEN p_partkey%9=0 THEN 17 ELSE 18 END)%36 AS num_hi,
 CAST(3+p_size AS DOUBLE) AS width_m, CAST((p_partkey*97)%4000 AS DOUBLE) AS length_m FROM {part}""",
    "atc_freqs": """SELECT event_id AS freq_id, event_id%100 AS apt_id, event_id%7 AS atc_type, 117000+(event_id*5)%21000 AS khz FROM {events}""",
    "osm_nodes": """SELECT event_id AS node_id, CAST(-1240000+(event_id*7919)%80000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(event_id*6007)%60000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM {events}""",
    "osm_way_refs": """SELECT l_orderkey AS way_id, CAST(l_linenumber AS BIGINT) AS pos, min(l_partkey*5+l_linenumber) AS node_id FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "faces": """SELECT c_custkey AS face_id, CAST(-124 AS DOUBLE)+CAST(c_custkey%40 AS DOUBLE)/CAST(5 AS DOUBLE)+CAST(8 AS DOUBLE)*floor(c_custkey/CAST(1200 AS DOUBLE)) AS west,
 CAST(32 AS DOUBLE)+CAST(floor((c_custkey%1200)/CAST(40 AS DOUBLE)) AS DOUBLE)/CAST(5 AS DOUBLE) AS south,
 CASE WHEN c_custkey%5=0 THEN 'water' ELSE 'land' END AS terrain FROM {customer}""",
    "runway_uses": """SELECT event_id AS use_id, event_id%100 AS apt_id, event_id%4 AS operations, event_id%5 AS equipment,
 117000+((event_id+(event_id%3)*50)*5)%21000 AS khz FROM {events}""",
    "apt_metadata": """SELECT s_suppkey AS apt_id, k.meta_key, CASE k.meta_key WHEN 'faa' THEN CASE (s_suppkey*7+k.no)%5 WHEN 0 THEN 'ABC' WHEN 1 THEN 'AB' WHEN 2 THEN '' WHEN 3 THEN 'A1CDE' ELSE 'A-C' END
 WHEN 'iata' THEN CASE (s_suppkey*7+k.no)%4 WHEN 0 THEN 'ABC' WHEN 1 THEN 'A1C' WHEN 2 THEN 'ABCD' ELSE '' END
 WHEN 'icao' THEN CASE (s_suppkey*7+k.no)%4 WHEN 0 THEN 'KABC' WHEN 1 THEN 'xABC' WHEN 2 THEN 'K1BC' ELSE 'KABCD' END
 WHEN 'local' THEN CASE (s_suppkey*7+k.no)%3 WHEN 0 THEN 'AB12' WHEN 1 THEN 'A' ELSE 'ABCD5678' END
 WHEN 'transition_alt' THEN CASE (s_suppkey*7+k.no)%6 WHEN 0 THEN '18000' WHEN 1 THEN '180' WHEN 2 THEN '90' WHEN 3 THEN '12.5' WHEN 4 THEN '31000' ELSE '' END
 WHEN 'circuits' THEN CASE (s_suppkey*7+k.no)%3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2' END
 WHEN 'tower_caps' THEN CASE (s_suppkey*7+k.no)%3 WHEN 0 THEN 'atc' WHEN 1 THEN 'fiso' ELSE 'none' END
 WHEN 'gui_label' THEN CASE (s_suppkey*7+k.no)%3 WHEN 0 THEN '2D' WHEN 1 THEN '3D' ELSE '4D' END
 ELSE CASE (s_suppkey*7+k.no)%2 WHEN 0 THEN 'Springfield' ELSE 'see https://x.org' END END AS meta_value
 FROM {supplier} CROSS JOIN (VALUES (0, 'faa'), (1, 'iata'), (2, 'icao'), (3, 'local'), (4, 'transition_alt'), (5, 'circuits'), (6, 'tower_caps'), (7, 'gui_label'), (8, 'city')) AS k(no, meta_key)""",
    "apt_parts": """SELECT p_partkey AS part_id, p_partkey%100 AS apt_id,
 CASE WHEN p_partkey%53=0 THEN 'helipad' WHEN p_partkey%59=0 THEN 'sealane' WHEN p_partkey%61=0 THEN 'boundary' WHEN p_partkey%67=0 THEN 'truck parking' WHEN p_partkey%71=0 THEN 'truck route' WHEN p_partkey%13=0 THEN 'runway' ELSE 'taxiway' END AS part_kind,
 CAST(-1240000+((p_partkey%100)*7919)%80000 AS DOUBLE)/CAST(10000 AS DOUBLE)+CAST((p_partkey*37)%600-300 AS DOUBLE)/CASE WHEN p_partkey%5=0 THEN CAST(2000 AS DOUBLE) ELSE CAST(10000 AS DOUBLE) END AS lon,
 CAST(320000+((p_partkey%100)*6007)%60000 AS DOUBLE)/CAST(10000 AS DOUBLE)+CAST((p_partkey*53)%600-300 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM {part}""",
    "taxi_edges": """SELECT o_orderkey AS edge_id, o_orderkey%100 AS apt_id, o_orderkey%7 AS width_class, CAST((o_orderkey*37)%400 AS DOUBLE)/CAST(10 AS DOUBLE) AS dx,
 CAST((o_orderkey*53)%300 AS DOUBLE)/CAST(10 AS DOUBLE) AS dy, CASE o_orderkey%6 WHEN 0 THEN 'A' WHEN 1 THEN 'B1' WHEN 2 THEN '1A' WHEN 3 THEN 'AB3' WHEN 4 THEN 'Alpha' ELSE '' END AS taxi_name FROM {orders}""",
    "apt_surfaces": """SELECT p_partkey AS part_id, p_partkey%100 AS apt_id, CASE p_partkey%3 WHEN 0 THEN 'taxiway' WHEN 1 THEN 'boundary' ELSE 'pavement' END AS kind FROM {part}
 WHERE CASE p_partkey%3 WHEN 0 THEN p_partkey%2 WHEN 1 THEN CAST(floor((p_partkey%100)/CAST(2 AS DOUBLE)) AS BIGINT)%2 ELSE CAST(floor((p_partkey%100)/CAST(4 AS DOUBLE)) AS BIGINT)%2 END = 1""",
    "ring_nodes": """SELECT c_custkey*100+k.node AS node_id, CAST(-1240000+(c_custkey*7919)%80000+k.dx*(1+c_custkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(c_custkey*6007)%60000+k.dy*(1+c_custkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM {customer} CROSS JOIN (VALUES (0, 100, 0), (1, 70, 70), (2, 0, 100), (3, -70, 70), (4, -100, 0), (5, -70, -70), (6, 0, -100), (7, 70, -70), (20, 40, 0), (21, 28, 28), (22, 0, 40), (23, -28, 28), (24, -40, 0), (25, -28, -28), (26, 0, -40), (27, 28, -28)) AS k(node, dx, dy)""",
    "ring_refs": """SELECT c_custkey*10+k.way AS way_id, k.pos, c_custkey*100+k.node AS node_id FROM {customer} JOIN (VALUES (0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 0, 3, 3), (0, 0, 4, 4), (0, 0, 5, 5), (0, 0, 6, 6), (0, 0, 7, 7), (0, 0, 8, 0), (1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 0, 4, 4), (1, 1, 0, 4), (1, 1, 1, 5), (1, 1, 2, 6), (1, 1, 3, 7), (1, 1, 4, 0), (2, 0, 0, 0), (2, 0, 1, 1), (2, 0, 2, 2), (2, 0, 3, 3), (2, 1, 0, 6), (2, 1, 1, 5), (2, 1, 2, 4), (2, 1, 3, 3), (2, 2, 0, 6), (2, 2, 1, 7), (2, 2, 2, 0), (3, 0, 0, 0), (3, 0, 1, 1), (3, 0, 2, 2), (3, 0, 3, 3), (3, 0, 4, 4), (3, 1, 0, 4), (3, 1, 1, 5), (3, 1, 2, 6), (3, 1, 3, 7), (10, 4, 0, 20), (10, 4, 1, 21), (10, 4, 2, 22), (10, 4, 3, 23), (10, 4, 4, 24), (10, 4, 5, 25), (10, 4, 6, 26), (10, 4, 7, 27), (10, 4, 8, 20), (11, 4, 0, 20), (11, 4, 1, 21), (11, 4, 2, 22), (11, 4, 3, 23), (11, 4, 4, 24), (11, 4, 5, 25)) AS k(sel, way, pos, node) ON k.sel=c_custkey%4 OR k.sel=10+c_custkey%3""",
    "rel_members": """SELECT c_custkey AS rel_id, CASE WHEN c_custkey%2=0 THEN k.way ELSE 9-k.way END AS pos, c_custkey*10+k.way AS way_id, CASE WHEN k.way=4 THEN 'inner' WHEN k.way=1 THEN 'outer' ELSE '' END AS role FROM {customer}
 JOIN (VALUES (0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (10, 4), (11, 4)) AS k(sel, way) ON k.sel=c_custkey%4 OR k.sel=10+c_custkey%3
 UNION ALL SELECT c_custkey, 20, c_custkey*10, '' FROM {customer} WHERE c_custkey%5=0""",
    "osm_relations": """SELECT s_suppkey AS rel_id, CASE s_suppkey%3 WHEN 0 THEN 'multipolygon' WHEN 1 THEN 'boundary' ELSE 'route' END AS rel_type FROM {supplier}""",
    "osm_members": """SELECT s_suppkey AS rel_id, CASE k.i%3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind, s_suppkey*17+k.i*29 AS ref FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS k(i)""",
    "map_edges": """SELECT c_custkey*4+k.i AS edge_id, c_custkey AS left_face, CASE WHEN c_custkey%4=1 THEN NULL WHEN c_custkey%3=2 AND k.i=0 THEN NULL WHEN c_custkey%3=1 AND k.i=3 THEN c_custkey+2 ELSE c_custkey+1 END AS right_face
 FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(i)""",
    "mesh_points": """SELECT p_partkey AS tri_id, k.pos, CAST((CAST(floor(p_partkey/CAST(2 AS DOUBLE)) AS BIGINT)%12+k.dx)*10 AS DOUBLE) AS px, CAST((CAST(floor(p_partkey/CAST(24 AS DOUBLE)) AS BIGINT)+k.dy)*10 AS DOUBLE) AS py,
 CAST((((CAST(floor(p_partkey/CAST(2 AS DOUBLE)) AS BIGINT)%12+k.dx)*7+(CAST(floor(p_partkey/CAST(24 AS DOUBLE)) AS BIGINT)+k.dy)*13)*31)%1000 AS DOUBLE) AS height
 FROM {part} JOIN (VALUES (0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (1, 0, 0, 0), (1, 1, 1, 1), (1, 2, 0, 1)) AS k(half, pos, dx, dy) ON p_partkey%2=k.half""",
    "taxi_net": """SELECT o_orderkey AS edge_id, o_orderkey%100 AS apt_id, o_orderkey%7 AS width_class, o_orderkey*2 AS src, o_orderkey*2+1 AS dst, CAST((o_orderkey*79)%499 AS DOUBLE) AS x1, CAST((o_orderkey*131)%491 AS DOUBLE) AS y1,
 CAST((o_orderkey*79)%499+(o_orderkey*37)%60-30 AS DOUBLE) AS x2, CAST((o_orderkey*131)%491+(o_orderkey*53)%60-30 AS DOUBLE) AS y2 FROM {orders}
 UNION ALL SELECT o_orderkey+10000000, o_orderkey%100, o_orderkey%7, o_orderkey*2+1, 100000000+o_orderkey, CAST((o_orderkey*79)%499+(o_orderkey*37)%60-30 AS DOUBLE), CAST((o_orderkey*131)%491+(o_orderkey*53)%60-30 AS DOUBLE),
 CAST((o_orderkey*79)%499+(o_orderkey*37)%60-10 AS DOUBLE), CAST((o_orderkey*131)%491+(o_orderkey*53)%60-5 AS DOUBLE) FROM {orders} WHERE o_orderkey%5=0""",
    "placed_runways": """SELECT p_partkey AS rwy_id, p_partkey%100 AS apt_id, CAST((p_partkey*97)%900 AS DOUBLE) AS cx, CAST((p_partkey*61)%900 AS DOUBLE) AS cy, k.ux/CAST(5 AS DOUBLE) AS ux, k.uy/CAST(5 AS DOUBLE) AS uy,
 CAST(300+(p_partkey*97)%1500 AS DOUBLE) AS length_m, CAST(20+(p_partkey%3)*10 AS DOUBLE) AS width_m FROM {part} JOIN (VALUES (0, 3, 4), (1, 5, 0), (2, 0, 5), (3, -4, 3)) AS k(way, ux, uy) ON p_partkey%4=k.way""",
    "runway_routes": """SELECT p_partkey*10+r.i AS route_id, p_partkey AS rwy_id, r.i AS src, r.i+1 AS dst,
 CAST((p_partkey*97)%900 AS DOUBLE)+k.ux/CAST(5 AS DOUBLE)*CAST(300+(p_partkey*97)%1500 AS DOUBLE)*r.a/CAST(1000 AS DOUBLE)-k.uy/CAST(5 AS DOUBLE)*r.c AS x1, CAST((p_partkey*61)%900 AS DOUBLE)+k.uy/CAST(5 AS DOUBLE)*CAST(300+(p_partkey*97)%1500 AS DOUBLE)*r.a/CAST(1000 AS DOUBLE)+k.ux/CAST(5 AS DOUBLE)*r.c AS y1,
 CAST((p_partkey*97)%900 AS DOUBLE)+k.ux/CAST(5 AS DOUBLE)*CAST(300+(p_partkey*97)%1500 AS DOUBLE)*r.b/CAST(1000 AS DOUBLE)-k.uy/CAST(5 AS DOUBLE)*r.d AS x2, CAST((p_partkey*61)%900 AS DOUBLE)+k.uy/CAST(5 AS DOUBLE)*CAST(300+(p_partkey*97)%1500 AS DOUBLE)*r.b/CAST(1000 AS DOUBLE)+k.ux/CAST(5 AS DOUBLE)*r.d AS y2
 FROM {part} JOIN (VALUES (0, 3, 4), (1, 5, 0), (2, 0, 5), (3, -4, 3)) AS k(way, ux, uy) ON p_partkey%4=k.way
 JOIN (VALUES (0, 0, -450, -100, 0, 1), (0, 1, -100, 200, 1, 0), (0, 2, 200, 450, 0, 0), (1, 0, -450, 450, 7, 7), (2, 0, -20, 20, -3, 3), (3, 0, -100, 200, 0, 0), (4, 0, -450, 520, 0, 0), (5, 0, -400, 100, 0, 0), (5, 1, 100, -150, 0, 0), (5, 2, -150, 300, 0, 0), (6, 0, -450, 450, 1, 1), (6, 2, -450, 450, 1, 1)) AS r(s, i, a, b, c, d) ON p_partkey%7=r.s""",
    "hot_zones": """SELECT p_partkey AS route_id, p_partkey%100 AS apt_id, p_partkey%5 AS src, (p_partkey*3)%7 AS dst, CASE p_partkey%4 WHEN 0 THEN '09/27' WHEN 1 THEN '09/27,04' WHEN 2 THEN '' ELSE '18' END AS hot,
 CASE p_partkey%6 WHEN 0 THEN '09/27' WHEN 1 THEN '04' ELSE '' END AS runway FROM {part}""",
    "ramps": """SELECT p_partkey AS ramp_id, p_partkey%100 AS apt_id, p_partkey%6 AS equipment, CASE p_partkey%4 WHEN 0 THEN 'gate' WHEN 1 THEN 'tie-down' WHEN 2 THEN 'misc' ELSE 'hangar' END AS ramp_type, p_partkey%3 AS op_type, p_partkey%7-1 AS width_class,
 CASE p_partkey%11 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'ABC def' WHEN 3 THEN 'ab' WHEN 4 THEN 'abcd efg' WHEN 5 THEN 'abcxdef' WHEN 6 THEN 'a1c def' WHEN 7 THEN 'a c def' WHEN 8 THEN repeat('abc ', 26) WHEN 9 THEN ' abc ' ELSE 'ab cdef1gh' END AS airlines FROM {part}""",
    "flows": """SELECT s_suppkey*4+k.i AS flow_id, s_suppkey AS apt_id, CASE WHEN (s_suppkey*3+k.i)%7=0 THEN '' WHEN s_suppkey%5=0 AND k.i > 1 THEN 'same' ELSE concat('flow ', CAST(k.i AS VARCHAR(3))) END AS name,
 CASE WHEN (s_suppkey+k.i)%6=0 THEN '' ELSE 'KABC' END AS icao, CAST((s_suppkey*7+k.i*5)%27-2 AS DOUBLE) AS visibility, ((s_suppkey*13+k.i*3)%14-1)*1000 AS ceiling, 1+(s_suppkey*5+k.i*7)%36 AS pattern FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(i)""",
    "wind_rules": """SELECT s_suppkey*8+k.j AS rule_id, s_suppkey*4+k.i AS flow_id, CASE WHEN (s_suppkey+k.j)%9=0 THEN '' ELSE 'KABC' END AS icao, (s_suppkey*31+k.j*67)%380-10 AS from_deg, (s_suppkey*31+k.j*(67+s_suppkey%3))%380-10 AS to_deg, (s_suppkey*11+k.j*5)%40-2 AS knots
 FROM {supplier} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)) AS k(i, j)""",
    "time_rules": """SELECT s_suppkey*4+k.i AS rule_id, s_suppkey*4+k.i AS flow_id, (s_suppkey*137+k.i*50)%2500-20 AS start, (s_suppkey*137+k.i*110)%2500-20 AS stop FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(i)""",
    "flow_uses": """SELECT s_suppkey*8+k.j AS use_id, s_suppkey*4+k.i AS flow_id, CASE WHEN s_suppkey%3=0 AND k.j%2=1 THEN (s_suppkey*5+k.i*7)%36+1 ELSE (s_suppkey*5+k.i*7+18)%36+1 END AS number, CASE WHEN k.i%2=0 THEN '' WHEN k.j%2=0 THEN 'L' WHEN s_suppkey%2=0 THEN 'R' ELSE 'L' END AS side,
 (s_suppkey+k.j)%4<>0 AS arrivals, (s_suppkey+k.i)%3<>0 AS departures FROM {supplier} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)) AS k(i, j)""",
    "map_faces": """SELECT c_custkey AS face_id, CASE WHEN c_custkey%5=0 THEN 'water' ELSE 'land' END AS terrain, c_custkey%9 AS code FROM {customer}""",
    "face_points": """SELECT c_custkey AS face_id, k.ring, k.pos, CAST(-1240000+(c_custkey*7919)%77000+k.dx*(1+c_custkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(c_custkey*6007)%57000+k.dy*(1+c_custkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM {customer} JOIN (VALUES (0, 0, 0, 0, 0), (0, 0, 1, 1800, 300), (0, 0, 2, 700, 1700),
 (1, 0, 0, 0, 0), (1, 0, 1, 2000, 0), (1, 0, 2, 2000, 2000), (1, 0, 3, 0, 2000), (1, 1, 0, 500, 400), (1, 1, 1, 400, 1500), (1, 1, 2, 1500, 1600), (1, 1, 3, 1600, 500),
 (2, 0, 0, 0, 0), (2, 0, 1, 0, 2000), (2, 0, 2, 600, 2100), (2, 0, 3, 700, 600), (2, 0, 4, 2000, 500), (2, 0, 5, 1900, 0), (3, 0, 0, 0, 0), (3, 0, 1, 40, 10), (3, 0, 2, 10, 50))
 AS k(shape, ring, pos, dx, dy) ON c_custkey%4=k.shape""",
    "apt_boundary_points": """SELECT s_suppkey AS apt_id, k.boundary, k.ring, k.pos, CAST(-1240000+(s_suppkey*7919)%80000+k.dx*(1+s_suppkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
 CAST(320000+(s_suppkey*6007)%60000+k.dy*(1+s_suppkey%3) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM {supplier} JOIN (VALUES (0, 0, 0, 0, -170, -170), (0, 0, 0, 1, 180, -160), (0, 0, 0, 2, 40, 20), (0, 0, 0, 3, 190, 170), (0, 0, 0, 4, -160, 180), (0, 0, 1, 0, -50, -50), (0, 0, 1, 1, 50, -50), (0, 0, 1, 2, 0, 50),
 (1, 0, 0, 0, -150, -90), (1, 0, 0, 1, 0, -100), (1, 0, 0, 2, -20, 110), (1, 0, 0, 3, -140, 90), (1, 1, 0, 0, -10, -120), (1, 1, 0, 1, 160, -110), (1, 1, 0, 2, 150, 120), (1, 1, 0, 3, 10, 100)) AS k(shape, boundary, ring, pos, dx, dy) ON s_suppkey%3=k.shape""",
    "apt_corners": """SELECT p_partkey%100 AS apt_id, CASE p_partkey%3 WHEN 0 THEN 'runway' WHEN 1 THEN 'taxiway' ELSE 'ramp' END AS kind, p_partkey AS part_id, k.pos,
 CAST(-1240000+((p_partkey%100)*7919)%80000+((p_partkey*37)%500-250)+k.dx*(p_partkey%7) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon, CAST(320000+((p_partkey%100)*6007)%60000+((p_partkey*53)%500-250)+k.dy*(p_partkey%5) AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat
 FROM {part} JOIN (VALUES (0, 0, -20, -3), (0, 1, -20, 3), (0, 2, 20, 3), (0, 3, 20, -3), (1, 0, -11, -7), (1, 1, 13, -9), (1, 2, 15, 12), (1, 3, 3, 17), (1, 4, -12, 9), (2, 0, 0, 0)) AS k(shape, pos, dx, dy) ON p_partkey%3=k.shape""",
}


def _tables(text: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(text) if name]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs."""
    text = DERIVED[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(text)})


def with_inputs(sql: str, *names: str) -> str:
    """SQL for the given tables, with derived inputs in front of it."""
    parts = [f"{n} AS ({DERIVED[n].format(**{t: t for t in _tables(DERIVED[n])})})" for n in names]
    more = sql.lstrip()
    if more.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {more[15:]}"
    if more.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {more[5:]}"
    return f"WITH {', '.join(parts)} {more}"
