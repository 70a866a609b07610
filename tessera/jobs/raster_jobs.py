"""Raster queries on the derived ``cells``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import raster
from tessera.sources.fixtures import derived


def _cells(spark: SparkSession, sf_dir: str, value: str = "elev", *more: str) -> DataFrame:
    return derived(spark, sf_dir, "cells").select(*more, "x", "y", F.col(value).alias("value"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


#: Cells with their eight neighbours, for the SQL of neighbourhood operators.
PAIRS = "SELECT a.x, a.y, a.elev AS own, b.elev AS near, b.x-a.x AS dx, b.y-a.y AS dy FROM cells a JOIN cells b ON b.x BETWEEN a.x-{r} AND a.x+{r} AND b.y BETWEEN a.y-{r} AND a.y+{r}"


@query(
    """SELECT x, y, round(CASE WHEN elev IS NOT NULL THEN elev WHEN av IS NULL THEN bv WHEN bv IS NULL THEN av
 ELSE av + (x-ax)*(bv-av)/CAST(bx-ax AS DOUBLE) END, 6) AS value FROM (SELECT x, y, elev,
 last_value(CASE WHEN elev IS NOT NULL THEN x END IGNORE NULLS) OVER p AS ax, last_value(elev IGNORE NULLS) OVER p AS av,
 first_value(CASE WHEN elev IS NOT NULL THEN x END IGNORE NULLS) OVER n AS bx, first_value(elev IGNORE NULLS) OVER n AS bv FROM cells
 WINDOW p AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "cells",
)
def w1_fill_scanline_gaps(spark, sf_dir):
    return _rounded(raster.fill_scanline_gaps(_cells(spark, sf_dir)), "value")


_NORMAL = """WITH valid AS (SELECT x, y, elev FROM cells WHERE elev IS NOT NULL),
 h AS (SELECT *, lag(x) OVER w AS lx, lag(elev) OVER w AS lv, lead(x) OVER w AS rx, lead(elev) OVER w AS rv FROM valid WINDOW w AS (PARTITION BY y ORDER BY x)),
 v AS (SELECT *, lag(y) OVER w AS dy0, lag(elev) OVER w AS dv, lead(y) OVER w AS uy, lead(elev) OVER w AS uv FROM h WINDOW w AS (PARTITION BY x ORDER BY y)),
 g AS (SELECT x, y, coalesce(CASE WHEN rx IS NULL OR (lx IS NOT NULL AND x-lx < rx-x) THEN (lv-elev)/((lx-x)*30.0) ELSE (rv-elev)/((rx-x)*30.0) END, 0) AS gx,
 coalesce(CASE WHEN uy IS NULL OR (dy0 IS NOT NULL AND y-dy0 < uy-y) THEN (dv-elev)/((dy0-y)*30.0) ELSE (uv-elev)/((uy-y)*30.0) END, 0) AS gy FROM v)"""


@query(
    _NORMAL + " SELECT c.x, c.y, round(1-1/sqrt(gx*gx+gy*gy+1), 6) AS slope, round(CASE WHEN gx IS NULL THEN NULL WHEN gx=0 AND gy=0 THEN 0 ELSE -gy/sqrt(gx*gx+gy*gy) END, 6) AS aspect FROM cells c LEFT JOIN g USING (x, y)",
    "cells",
)
def w2_slope_aspect(spark, sf_dir):
    out = raster.slope_aspect(_cells(spark, sf_dir), 30.0).drop("value")
    return _rounded(out, "slope", "aspect").withColumn("aspect", F.col("aspect") + 0.0)


@query(_NORMAL + " SELECT c.x, c.y, round(-gx/sqrt(gx*gx+gy*gy+1), 6)+0.0 AS nx, round(-gy/sqrt(gx*gx+gy*gy+1), 6)+0.0 AS ny, round(1/sqrt(gx*gx+gy*gy+1), 6) AS nz FROM cells c LEFT JOIN g USING (x, y)", "cells")
def w18_surface_normals(spark, sf_dir):
    out = raster.surface_normals(_cells(spark, sf_dir), 30.0).drop("value")
    return _rounded(out, "nx", "ny", "nz").withColumns({c: F.col(c) + 0.0 for c in ("nx", "ny")})


@query(
    """SELECT x, y, elev AS value, high-low AS range, round(CASE WHEN elev IS NULL THEN NULL WHEN high=low THEN 0 ELSE (elev-low)/(high-low) END, 6) AS relative
 FROM (SELECT *, min(elev) OVER b AS low, max(elev) OVER b AS high FROM cells WINDOW b AS (PARTITION BY x//8, y//8))""",
    "cells",
)
def w3_relative_elevation(spark, sf_dir):
    return _rounded(raster.relative_elevation(_cells(spark, sf_dir)), "relative")


#: A ramp that falls from the middle of a 5 × 5 kernel.
RAMP = {(dx, dy): float(5 - abs(dx) - abs(dy)) for dx in range(-2, 3) for dy in range(-2, 3)}


@query(f"SELECT x, y, round(coalesce(sum(near*(5-abs(dx)-abs(dy))), 0), 6) AS value FROM ({PAIRS.format(r=2)}) GROUP BY x, y", "cells")
def w4_convolve(spark, sf_dir):
    return _rounded(raster.convolve(_cells(spark, sf_dir), RAMP, False), "value")


@query(f"SELECT x, y, round(sum(near*(5-abs(dx)-abs(dy)))/sum(CASE WHEN near IS NOT NULL THEN 5-abs(dx)-abs(dy) END), 6) AS value FROM ({PAIRS.format(r=2)}) GROUP BY x, y", "cells")
def w4_convolve_normalised(spark, sf_dir):
    return _rounded(raster.convolve(_cells(spark, sf_dir), RAMP, True), "value")


@query(
    """WITH v AS (SELECT a.x, a.y, sum(b.elev*exp(-power(b.y-a.y, 2)/2.0))/sum(CASE WHEN b.elev IS NOT NULL THEN exp(-power(b.y-a.y, 2)/2.0) END) AS e
 FROM cells a JOIN cells b ON a.x=b.x AND b.y BETWEEN a.y-3 AND a.y+3 GROUP BY a.x, a.y)
 SELECT a.x, a.y, round(sum(b.e*exp(-power(b.x-a.x, 2)/2.0))/sum(CASE WHEN b.e IS NOT NULL THEN exp(-power(b.x-a.x, 2)/2.0) END), 5) AS value
 FROM v a JOIN v b ON a.y=b.y AND b.x BETWEEN a.x-3 AND a.x+3 GROUP BY a.x, a.y""",
    "cells",
)
def w5_gaussian_blur(spark, sf_dir):
    return raster.gaussian_blur(_cells(spark, sf_dir), 1.0).withColumn("value", F.round("value", 5))


@query(
    f"""SELECT x, y, round(avg(near), 6) AS value FROM (SELECT x, y, near, row_number() OVER (PARTITION BY x, y ORDER BY near) AS k, count(*) OVER (PARTITION BY x, y) AS n
 FROM ({PAIRS.format(r=2)}) WHERE near IS NOT NULL) WHERE k > n//8 AND k <= n - n//3 GROUP BY x, y""",
    "cells",
)
def w6_trimmed_mean_surface(spark, sf_dir):
    return _rounded(raster.trimmed_mean(_cells(spark, sf_dir)), "value").filter("value is not null")


@query(f"SELECT x, y, coalesce(max(abs(own-near)), 0) AS value FROM ({PAIRS.format(r=1)}) WHERE dx<>0 OR dy<>0 GROUP BY x, y", "cells")
def w7_max_neighbour_difference(spark, sf_dir):
    return raster.max_neighbour_difference(_cells(spark, sf_dir))


@query(
    f"""SELECT x, y, CAST(24 - CASE WHEN max(own) IS NULL THEN 24 - count(*) + count(*) FILTER (near IS NULL) ELSE count(*) FILTER (near = own) END AS BIGINT) AS value
 FROM ({PAIRS.format(r=2)}) WHERE dx<>0 OR dy<>0 GROUP BY x, y""",
    "cells",
)
def w8_neighbour_disagreement(spark, sf_dir):
    return raster.neighbour_disagreement(_cells(spark, sf_dir), 2)


@query(f"SELECT DISTINCT x, y, own AS value FROM ({PAIRS.format(r=1)}) WHERE abs(dx)+abs(dy)=1 AND own IS NOT NULL AND near IS NULL", "cells")
def w9_border_cells(spark, sf_dir):
    return raster.border_cells(_cells(spark, sf_dir))


@query(
    """WITH voids AS (SELECT x, y FROM cells WHERE elev IS NULL)
 SELECT c.x, c.y, CASE WHEN EXISTS (SELECT 1 FROM voids v WHERE v.x BETWEEN c.x-1 AND c.x+1 AND v.y BETWEEN c.y-1 AND c.y+1) THEN NULL ELSE elev END AS value FROM cells c""",
    "cells",
)
def w10_erode(spark, sf_dir):
    return raster.erode(_cells(spark, sf_dir), 1)


@query("SELECT x*2+i AS x, y*2+j AS y, elev AS value FROM cells, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)", "cells")
def w11_upsample(spark, sf_dir):
    return raster.upsample(_cells(spark, sf_dir), 2)


@query(
    """SELECT x, y, coalesce(elev, arg_min(near, slot)) AS value FROM (SELECT a.x, a.y, a.elev, b.elev AS near, n*8+k AS slot FROM cells a CROSS JOIN (VALUES (1), (2), (3)) d(n)
 CROSS JOIN (VALUES (0,-1,0), (1,1,0), (2,0,-1), (3,0,1), (4,1,-1), (5,1,1), (6,-1,-1), (7,-1,1)) o(k, ox, oy) LEFT JOIN cells b ON b.x=a.x+ox*n AND b.y=a.y+oy*n AND b.elev IS NOT NULL)
 GROUP BY x, y, elev""",
    "cells",
)
def w17_spread_directional(spark, sf_dir):
    return raster.spread_directional(_cells(spark, sf_dir), 3)


@query(
    """SELECT x//7 AS bx, y//7 AS by, CASE WHEN min(elev)=min(elev) FILTER (x%7 BETWEEN 1 AND 5 AND y%7 BETWEEN 1 AND 5) AND max(elev)=max(elev) FILTER (x%7 BETWEEN 1 AND 5 AND y%7 BETWEEN 1 AND 5)
 THEN max(elev)-min(elev) END AS value FROM cells GROUP BY ALL""",
    "cells",
)
def w19_local_rise(spark, sf_dir):
    return raster.local_rise(_cells(spark, sf_dir), 7)


@query("SELECT tile_x, tile_y, elev AS value, count(*) AS n FROM cells WHERE elev IS NOT NULL GROUP BY ALL", "cells")
def a5_raster_histogram(spark, sf_dir):
    cells = _cells(spark, sf_dir, "elev", "tile_x", "tile_y").filter("value is not null")
    return cells.groupBy("tile_x", "tile_y", "value").agg(F.count("*").alias("n"))


@query("SELECT quantile_disc(elev, 0.9) AS value FROM cells", "cells")
def a5_percentile_from_histogram(spark, sf_dir):
    return raster.percentile_from_histogram(raster.histogram(_cells(spark, sf_dir)), 0.9)


@query("SELECT x//4 AS x, y//4 AS y, round(avg(elev), 6) AS value FROM cells GROUP BY ALL", "cells")
def a6_downsample_mean(spark, sf_dir):
    return _rounded(raster.downsample_mean(_cells(spark, sf_dir), 4), "value")


@query(
    """SELECT x//2 AS x, y//2 AS y, coalesce(max(elev) FILTER (x%2=1 AND y%2=0), max(elev) FILTER (x%2=0 AND y%2=1), max(elev) FILTER (x%2=1 AND y%2=1), max(elev) FILTER (x%2=0 AND y%2=0)) AS value
 FROM cells GROUP BY ALL""",
    "cells",
)
def a7_downsample_nearest(spark, sf_dir):
    return raster.downsample_nearest(_cells(spark, sf_dir))


@query("SELECT x//8 AS x, y//8 AS y, min(elev) AS low, max(elev) AS high FROM cells GROUP BY ALL", "cells")
def a8_block_min_max(spark, sf_dir):
    return raster.block_min_max(_cells(spark, sf_dir), 8)


@query("SELECT x, y, CASE WHEN x%3=0 THEN coalesce(rain, elev) ELSE elev END AS value FROM cells", "cells")
def d1_overlay(spark, sf_dir):
    return raster.overlay(_cells(spark, sf_dir), _cells(spark, sf_dir, "rain").filter("x % 3 = 0"))


@query("SELECT x, y, round(CASE WHEN x%256=0 THEN elev WHEN x%256=255 THEN rain ELSE elev*(1-(x%256)/255.0)+rain*((x%256)/255.0) END, 6) AS value FROM cells", "cells")
def d2_mask_overlay(spark, sf_dir):
    mask = _cells(spark, sf_dir).withColumn("value", F.col("x") % 256)
    return _rounded(raster.mask_overlay(_cells(spark, sf_dir), _cells(spark, sf_dir, "rain"), mask), "value")


@query("SELECT x, y, coalesce(rain-elev, 0) AS value FROM cells", "cells")
def d3_raster_difference(spark, sf_dir):
    return raster.difference(_cells(spark, sf_dir, "rain"), _cells(spark, sf_dir))


@query("SELECT x, y, CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 5 AND 15 THEN 0 ELSE elev END AS value FROM cells", "cells")
def d6_raster_clear(spark, sf_dir):
    inside = F.col("x").between(10, 20) & F.col("y").between(5, 15)
    return _cells(spark, sf_dir).withColumn("value", F.when(inside, 0.0).otherwise(F.col("value")))


@query("SELECT x, y, coalesce(n, landuse) AS kept, n AS imported FROM cells LEFT JOIN (VALUES (1, 10), (3, 30), (5, 50)) m(o, n) ON o=landuse", "cells")
def p14_recode(spark, sf_dir):
    table = spark.createDataFrame([(1, 10), (3, 30), (5, 50)], "landuse long, n int")
    out = derived(spark, sf_dir, "cells").join(F.broadcast(table), "landuse", "left")
    return out.select("x", "y", F.coalesce("n", "landuse").alias("kept"), F.col("n").alias("imported"))


@query("SELECT tile_x, tile_y, sum(CASE WHEN landuse=2 THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS n FROM cells GROUP BY ALL", "cells")
def p15_binary_mask(spark, sf_dir):
    mask = F.when(F.col("landuse") == 2, 1).otherwise(0)
    return derived(spark, sf_dir, "cells").groupBy("tile_x", "tile_y").agg(F.sum(mask).alias("hits"), F.count("*").alias("n"))


_POINTS = "SELECT obs_id, (lon+124)*15 AS px, (lat-32)*20 AS py FROM obstacles"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "obstacles").select("obs_id", ((F.col("lon") + 124) * 15).alias("px"), ((F.col("lat") - 32) * 20).alias("py"))


@query(
    f"""WITH p AS ({_POINTS}), c AS (SELECT obs_id, c.elev, greatest(0, 1-abs(px-c.x))*greatest(0, 1-abs(py-c.y)) AS w FROM p LEFT JOIN cells c ON c.x IN (floor(px), floor(px)+1) AND c.y IN (floor(py), floor(py)+1))
 SELECT obs_id, round(sum(elev*w)/nullif(sum(CASE WHEN elev IS NOT NULL THEN w END), 0), 4) AS value FROM c GROUP BY obs_id""",
    "obstacles",
    "cells",
)
def j7_sample_bilinear(spark, sf_dir):
    return raster.sample_bilinear(_points(spark, sf_dir), _cells(spark, sf_dir), "obs_id").withColumn("value", F.round("value", 4))


@query(f"WITH p AS ({_POINTS}) SELECT obs_id, elev AS value FROM p LEFT JOIN cells c ON c.x=ceil(px-0.5) AND c.y=ceil(py-0.5)", "obstacles", "cells")
def j8_sample_nearest(spark, sf_dir):
    return raster.sample_nearest(_points(spark, sf_dir), _cells(spark, sf_dir), "obs_id")
