"""Rule classifications and category shares of cells and roads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators.rules import Rule, first_attribute_match, first_match
from tessera.sources.fixtures import derived

# The rule tables of the registered queries, in order.
TERRAIN_RULES = [
    Rule("snow", {}, {"temp": (0.0, 2.0)}),
    Rule("desert", {}, {"temp": (30.0, 40.0), "rain": (0.0, 200.0)}),
    Rule("wet_farm", {"landuse": 1}, {"rain": (1000.0, 2000.0)}),
    Rule("farm", {"landuse": 1}, {"rain": (5.0, 5.0)}),
    Rule("steppe", {"landuse": 2}, {"temp": (5.0, 25.0), "rain": (100.0, 900.0)}),
    Rule("wood", {"landuse": 3}, {"temp": (0.0, 30.0)}),
]
FOREST_RULES = [
    Rule("palm", {}, {"temp": (25.0, 40.0), "rain": (800.0, 2000.0)}),
    Rule("pine", {"landuse": 3}, {"temp": (0.0, 12.0)}),
    Rule("oak", {"landuse": 3}, {"temp": (12.0, 25.0), "rain": (300.0, 2000.0)}),
    Rule("shrub", {}, {"rain": (50.0, 300.0)}),
]
ROAD_RULES = [
    Rule("motorway_city", {"feat_type": 1}, {"rain": (0.0, 999.0), "temp": (0.0, 20.0)}),
    Rule("motorway", {"feat_type": 1}, {}),
    Rule("street_warm", {"feat_type": 2}, {"temp": (20.0, 40.0)}),
    Rule("street", {"feat_type": 2}, {"rain": (0.0, 1500.0)}),
]

TERRAIN_SQL = """CASE WHEN temp BETWEEN 0 AND 2 THEN 'snow' WHEN temp BETWEEN 30 AND 40 AND rain BETWEEN 0 AND 200 THEN 'desert' WHEN landuse=1 AND rain BETWEEN 1000 AND 2000 THEN 'wet_farm'
 WHEN landuse=1 THEN 'farm' WHEN landuse=2 AND temp BETWEEN 5 AND 25 AND rain BETWEEN 100 AND 900 THEN 'steppe' WHEN landuse=3 AND temp BETWEEN 0 AND 30 THEN 'wood' ELSE '-1' END"""


@query(f"SELECT x, y, {TERRAIN_SQL} AS terrain FROM cells", "cells")
def r1_natural_terrain(spark, sf_dir):
    return derived(spark, sf_dir, "cells").select("x", "y", first_match(TERRAIN_RULES, "-1").alias("terrain"))


@query(
    """WITH rules(rule_no, landuse, t0, t1, r0, r1, forest) AS (VALUES (1, NULL, 25, 40, 800, 2000, 'palm'), (2, 3, 0, 12, 0, 0, 'pine'), (3, 3, 12, 25, 300, 2000, 'oak'), (4, NULL, 0, 0, 50, 300, 'shrub'))
 SELECT c.x, c.y, arg_min(forest, rule_no) AS forest FROM cells c LEFT JOIN rules r ON (r.landuse IS NULL OR r.landuse=c.landuse) AND (t0=t1 OR c.temp BETWEEN t0 AND t1) AND (r0=r1 OR c.rain BETWEEN r0 AND r1) GROUP BY c.x, c.y""",
    "cells",
)
def r3_forest_type(spark, sf_dir):
    return derived(spark, sf_dir, "cells").select("x", "y", first_match(FOREST_RULES).alias("forest"))


@query(
    """SELECT edge_id, CASE WHEN feat_type=1 AND rain BETWEEN 0 AND 999 AND temp BETWEEN 0 AND 20 THEN 'motorway_city' WHEN feat_type=1 THEN 'motorway'
 WHEN feat_type=2 AND temp BETWEEN 20 AND 40 THEN 'street_warm' WHEN feat_type=2 AND rain BETWEEN 0 AND 1500 THEN 'street' END AS rep FROM road_edges JOIN cells ON src = y*120+x""",
    "road_edges",
    "cells",
)
def r4_road_type(spark, sf_dir):
    cells = derived(spark, sf_dir, "cells").select((F.col("y") * 120 + F.col("x")).alias("src"), "temp", "rain")
    return derived(spark, sf_dir, "road_edges").join(cells, "src").select("edge_id", first_match(ROAD_RULES).alias("rep"))


@query(
    """SELECT p_partkey AS shape_id, CASE WHEN p_brand='Brand#11' THEN NULL WHEN p_name<>'' AND p_type LIKE 'PROMO%' THEN 'promoted' WHEN p_type='STANDARD' THEN 'standard' WHEN p_brand IS NOT NULL THEN 'branded' END AS feature FROM part"""
)
def r6_shape_feature_rules(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    promo = F.when(F.col("p_type").startswith("PROMO"), F.lit("yes"))
    tagged = part.select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("promo"), promo).alias("tags"))
    rules = [({"brand": "Brand#11"}, None), ({"name": "*", "promo": "!-"}, "promoted"), ({"type": "STANDARD"}, "standard"), ({"brand": "!-"}, "branded")]
    return tagged.select(F.col("p_partkey").alias("shape_id"), first_attribute_match("tags", rules).alias("feature"))


@query(
    """WITH n AS (SELECT tile_x, tile_y, landuse, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT *, n/CAST(sum(n) OVER w AS DOUBLE) AS share, row_number() OVER (w ORDER BY n DESC, landuse) AS place FROM n WINDOW w AS (PARTITION BY tile_x, tile_y))
 SELECT tile_x, tile_y, place, landuse, round(share, 6) AS share FROM s WHERE place <= 3""",
    "cells",
)
def a16_dominant_category_top3(spark, sf_dir):
    counts = derived(spark, sf_dir, "cells").groupBy("tile_x", "tile_y", "landuse").agg(F.count("*").alias("n"))
    tile = Window.partitionBy("tile_x", "tile_y")
    ranked = counts.withColumn("place", F.row_number().over(tile.orderBy(F.desc("n"), "landuse")).cast("long")).withColumn("share", F.round(F.col("n") / F.sum("n").over(tile), 6))
    return ranked.filter("place <= 3").select("tile_x", "tile_y", "place", "landuse", "share")


@query(
    """WITH t AS (SELECT tile_x, tile_y, 100.0*count(*) FILTER (landuse=4)/count(*) AS lu, 100.0*count(*) FILTER (elev IS NULL)/count(*) AS wet FROM cells GROUP BY ALL)
 SELECT g.x AS tile_x, g.y AS tile_y, coalesce(CAST(floor(lu) AS BIGINT), 255) AS lu_percent, coalesce(CAST(floor(wet) AS BIGINT), 255) AS wet_percent
 FROM (SELECT a.x, b.y FROM range(0, 360) a(x), range(0, 180) b(y)) g LEFT JOIN t ON t.tile_x=g.x AND t.tile_y=g.y""",
    "cells",
)
def a9_tile_coverage(spark, sf_dir):
    cells = derived(spark, sf_dir, "cells")
    percent = lambda test: F.floor(100 * F.sum(F.when(test, 1).otherwise(0)) / F.count("*"))
    tiles = cells.groupBy("tile_x", "tile_y").agg(percent(F.col("landuse") == 4).alias("lu"), percent(F.col("elev").isNull()).alias("wet"))
    grid = spark.range(360 * 180).select((F.col("id") % 360).alias("tile_x"), F.expr("id div 360").alias("tile_y"))
    return grid.join(tiles, ["tile_x", "tile_y"], "left").select("tile_x", "tile_y", F.coalesce("lu", F.lit(255)).alias("lu_percent"), F.coalesce("wet", F.lit(255)).alias("wet_percent"))


@query(
    """WITH a AS (SELECT tile_x, tile_y, count(*) FILTER (elev IS NULL)/CAST(count(*) AS DOUBLE) AS w FROM cells GROUP BY ALL), b AS (SELECT tile_x, tile_y, count(*) FILTER (landuse=5)/CAST(count(*) AS DOUBLE) AS w FROM cells GROUP BY ALL)
 SELECT tile_x, tile_y, round(coalesce(a.w, 0)-coalesce(b.w, 0), 6) AS absolute, round((coalesce(a.w, 0)-coalesce(b.w, 0))/nullif(greatest(coalesce(a.w, 0), coalesce(b.w, 0)), 0), 6) AS relative FROM a FULL JOIN b USING (tile_x, tile_y)""",
    "cells",
)
def a10_compare_water(spark, sf_dir):
    cells = derived(spark, sf_dir, "cells")
    share = lambda test, name: cells.groupBy("tile_x", "tile_y").agg((F.sum(F.when(test, 1).otherwise(0)) / F.count("*")).alias(name))
    both = share(F.col("elev").isNull(), "a").join(share(F.col("landuse") == 5, "b"), ["tile_x", "tile_y"], "full").na.fill(0.0, ["a", "b"])
    gap = F.col("a") - F.col("b")
    return both.select("tile_x", "tile_y", F.round(gap, 6).alias("absolute"), F.round(gap / F.nullif(F.greatest("a", "b"), F.lit(0.0)), 6).alias("relative"))


@query("SELECT DISTINCT tile_x, tile_y FROM cells WHERE landuse=2 EXCEPT SELECT DISTINCT tile_x, tile_y FROM cells WHERE elev=991", "cells")
def d5_coverage_difference(spark, sf_dir):
    cells = derived(spark, sf_dir, "cells")
    tiles = lambda test: cells.filter(test).select("tile_x", "tile_y").distinct()
    return tiles(F.col("landuse") == 2).join(tiles(F.col("elev") == 991), ["tile_x", "tile_y"], "left_anti")
