"""Queries of several passes over the derived ``cells``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.jobs.raster_jobs import _cells, _rounded
from tessera.jobs.registry import query
from tessera.operators import terrain
from tessera.sources.fixtures import DERIVED, derived

CELLS = DERIVED["cells"].format(orders="orders")

_HALF = "SELECT x//2 AS x, y//2 AS y, coalesce(max(v) FILTER (x%2=1 AND y%2=0), max(v) FILTER (x%2=0 AND y%2=1), max(v) FILTER (x%2=1 AND y%2=1), max(v) FILTER (x%2=0 AND y%2=0)) AS v FROM {} GROUP BY ALL"


@query(
    f"""WITH l0 AS (SELECT x, y, elev AS v FROM cells), l1 AS ({_HALF.format('l0')}), l2 AS ({_HALF.format('l1')})
 SELECT l0.x, l0.y, coalesce(l0.v, l1.v, l2.v) AS value FROM l0 JOIN l1 ON l1.x=l0.x//2 AND l1.y=l0.y//2 JOIN l2 ON l2.x=l0.x//4 AND l2.y=l0.y//4""",
    "cells",
)
def w12_spread_nearest(spark, sf_dir):
    return terrain.spread_nearest(_cells(spark, sf_dir), 2)


@query(
    """WITH a AS (SELECT x, y, elev, CASE WHEN elev IS NOT NULL THEN avg(elev) OVER (PARTITION BY x//2, y//2) END AS m1 FROM cells), b AS (SELECT *, CASE WHEN m1 IS NOT NULL THEN avg(m1) OVER (PARTITION BY x//4, y//4) END AS m2 FROM a)
 SELECT 0 AS band, x, y, round(elev-m1, 6)+0.0 AS value FROM b UNION ALL SELECT 1, x, y, round(m1-m2, 6)+0.0 FROM b UNION ALL SELECT 2, x, y, round(m2, 6)+0.0 FROM b""",
    "cells",
)
def w13_frequency_split(spark, sf_dir):
    return terrain.frequency_split(_cells(spark, sf_dir), 2).withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT x, y, elev AS value FROM cells", "cells")
def w13_frequency_recombine(spark, sf_dir):
    return terrain.frequency_split(_cells(spark, sf_dir), 3).groupBy("x", "y").agg(F.round(F.sum("value"), 6).alias("value"))


@query(
    """WITH s AS (SELECT edge_id, src%120 AS x1, src//120 AS y1, dst%120 AS x2, dst//120 AS y2 FROM road_edges), p AS (SELECT edge_id, x1, y1, x2, y2, x1+i/4.0*(x2-x1) AS px, y1+i/4.0*(y2-y1) AS py FROM s, range(0, 5) r(i))
 SELECT edge_id, round(avg(rain)*sqrt((max(x2)-max(x1))*(max(x2)-max(x1))+(max(y2)-max(y1))*(max(y2)-max(y1))), 4) AS value FROM p LEFT JOIN cells c ON c.x=ceil(px-0.5) AND c.y=ceil(py-0.5) GROUP BY edge_id""",
    "road_edges",
    "cells",
)
def w15_line_integral(spark, sf_dir):
    place = lambda c: [(F.col(c) % 120).alias(f"x{1 if c == 'src' else 2}"), F.expr(f"{c} div 120").alias(f"y{1 if c == 'src' else 2}")]
    lines = derived(spark, sf_dir, "road_edges").select("edge_id", *place("src"), *place("dst"))
    return terrain.line_integral(lines, _cells(spark, sf_dir, "rain"), "edge_id", 4).withColumn("value", F.round("value", 4))


#: The land use of the derived cells lies in blocks of 5 by 5, so SQL can find regions among blocks.
@query(
    f"""WITH RECURSIVE cells AS ({CELLS}), b AS (SELECT DISTINCT x//5 AS bx, y//5 AS ay, landuse FROM cells), r(bx, ay, landuse, region) AS (SELECT bx, ay, landuse, ay*1000+bx FROM b UNION
 SELECT n.bx, n.ay, n.landuse, r.region FROM r JOIN b n ON n.landuse=r.landuse AND abs(n.bx-r.bx)+abs(n.ay-r.ay)=1)
 SELECT landuse, n, count(*) AS regions FROM (SELECT m.landuse, m.region, count(*) AS n FROM (SELECT bx, ay, landuse, min(region) AS region FROM r GROUP BY ALL) m JOIN cells c ON c.x//5=bx AND c.y//5=ay AND c.landuse=m.landuse GROUP BY m.landuse, m.region) GROUP BY landuse, n"""
)
def g2_raster_components(spark, sf_dir):
    found = terrain.regions(_cells(spark, sf_dir, "landuse"), 120).groupBy("value", "region").agg(F.count("*").alias("n"))
    return found.groupBy(F.col("value").alias("landuse"), "n").agg(F.count("*").alias("regions"))


@query(
    """WITH d(k, dx, dy) AS (VALUES (0,0,1), (1,1,1), (2,1,0), (3,1,-1), (4,0,-1), (5,-1,-1), (6,-1,0), (7,-1,1)), n AS (SELECT c.x, c.y, k, row_number() OVER (PARTITION BY c.x, c.y ORDER BY e.elev, k) AS i FROM cells c JOIN d ON TRUE JOIN cells e ON e.x=c.x+dx AND e.y=c.y+dy WHERE e.elev < c.elev)
 SELECT c.x, c.y, n.k AS direction FROM cells c LEFT JOIN n ON n.x=c.x AND n.y=c.y AND i=1""",
    "cells",
)
def g7_flow_direction(spark, sf_dir):
    return terrain.flow_direction(_cells(spark, sf_dir))


@query(
    """WITH w AS (SELECT a.x, a.y, a.rain, a.elev, coalesce(max(CASE WHEN b.elev IS NULL THEN 1-sqrt(power(b.x-a.x, 2)+power(b.y-a.y, 2))/3 END), 0) AS w FROM cells a JOIN cells b ON b.x BETWEEN a.x-2 AND a.x+2 AND b.y BETWEEN a.y-2 AND a.y+2 AND power(b.x-a.x, 2)+power(b.y-a.y, 2) < 9 GROUP BY ALL)
 SELECT x, y, round(CASE WHEN elev IS NULL THEN rain ELSE rain*w+elev*(1-w) END, 6) AS value FROM w""",
    "cells",
)
def d4_raster_merge(spark, sf_dir):
    return _rounded(terrain.raster_merge(_cells(spark, sf_dir, "rain"), _cells(spark, sf_dir), 3), "value")


@query(
    """WITH b AS (SELECT x//8 AS x, y//8 AS y, avg(CASE landuse WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.2 ELSE 0 END) AS v FROM cells GROUP BY ALL)
 SELECT a.x, a.y, round(greatest(0, least(1, avg(n.v))), 6) AS value FROM b a JOIN b n ON abs(n.x-a.x) <= 1 AND abs(n.y-a.y) <= 1 GROUP BY a.x, a.y""",
    "cells",
)
def a15_urban_density(spark, sf_dir):
    return _rounded(terrain.urban_density(_cells(spark, sf_dir, "landuse"), {1: 1.0, 2: 0.6, 3: 0.2}), "value")


@query(
    """WITH d(dx, dy, slot) AS (VALUES (-1,-1,0), (0,-1,1), (1,-1,2), (-1,0,3), (1,0,4), (-1,1,5), (0,1,6), (1,1,7)), n AS (SELECT c.x, c.y, e.landuse AS v, slot FROM cells c JOIN d ON TRUE JOIN cells e ON e.x=c.x+dx AND e.y=c.y+dy WHERE c.elev IS NULL AND e.elev IS NOT NULL),
 k AS (SELECT x, y, v, count(*) AS n, max(slot) AS reached FROM n GROUP BY ALL), m AS (SELECT x, y, v FROM k QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC, reached)=1)
 SELECT c.x, c.y, CAST(coalesce(m.v, c.landuse) AS DOUBLE) AS value FROM cells c LEFT JOIN m USING (x, y)""",
    "cells",
)
def w16_fill_mode_flood(spark, sf_dir):
    """Land use where the elevation is valid, filled elsewhere: no two such cells are neighbours, so one round decides."""
    cells = derived(spark, sf_dir, "cells").select("x", "y", F.when(F.col("elev").isNotNull(), F.col("landuse")).cast("double").alias("value"))
    return terrain.fill_mode_flood(cells)
