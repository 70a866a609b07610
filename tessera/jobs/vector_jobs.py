"""Map queries: ways, tile boxes, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.jobs.registry import query
from tessera.operators import osm, vectors
from tessera.sources.fixtures import derived

_BOXES = """b AS (SELECT node_id, CAST(ceil(lon)-1 AS BIGINT) AS x0, CAST(floor(lon) AS BIGINT) AS x1, CAST(ceil(lat)-1 AS BIGINT) AS y0, CAST(floor(lat) AS BIGINT) AS y1 FROM osm_nodes),
 w AS (SELECT way_id, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM osm_way_refs JOIN b USING (node_id) GROUP BY way_id)"""


@query("SELECT way_id, count(*) AS n, round(sum(lon*pos), 4) AS lon_by_place, round(sum(lat*pos), 4) AS lat_by_place FROM osm_way_refs JOIN osm_nodes USING (node_id) GROUP BY way_id", "osm_way_refs", "osm_nodes")
def j4_assemble_ways(spark, sf_dir):
    ways = vectors.assemble_ways(derived(spark, sf_dir, "osm_nodes"), derived(spark, sf_dir, "osm_way_refs"))
    total = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c] * p["pos"]), 4)
    return ways.select("way_id", F.size("points").cast("long").alias("n"), total("lon").alias("lon_by_place"), total("lat").alias("lat_by_place"))


@query(f"WITH {_BOXES} SELECT * FROM w", "osm_nodes", "osm_way_refs")
def j3_way_boxes(spark, sf_dir):
    return vectors.way_boxes(derived(spark, sf_dir, "osm_nodes"), derived(spark, sf_dir, "osm_way_refs"))


@query(f"WITH {_BOXES} SELECT way_id, x AS tile_x, y AS tile_y FROM w, LATERAL (SELECT unnest(range(x0, x1+1)) AS x), LATERAL (SELECT unnest(range(y0, y1+1)) AS y)", "osm_nodes", "osm_way_refs")
def j3_tile_ways(spark, sf_dir):
    return vectors.per_tile(vectors.way_boxes(derived(spark, sf_dir, "osm_nodes"), derived(spark, sf_dir, "osm_way_refs")), "way_id")


@query(
    f"WITH {_BOXES} SELECT node_id, least(b.x0, min(w.x0)) AS x0, greatest(b.x1, max(w.x1)) AS x1, least(b.y0, min(w.y0)) AS y0, greatest(b.y1, max(w.y1)) AS y1 FROM b LEFT JOIN osm_way_refs USING (node_id) LEFT JOIN w USING (way_id) GROUP BY node_id, b.x0, b.x1, b.y0, b.y1",
    "osm_nodes",
    "osm_way_refs",
)
def j3_widened_nodes(spark, sf_dir):
    nodes, refs = derived(spark, sf_dir, "osm_nodes"), derived(spark, sf_dir, "osm_way_refs")
    return vectors.widened_nodes(nodes, refs, vectors.way_boxes(nodes, refs))


@query("SELECT p_partkey AS entity_id, CASE WHEN p_size%2=0 THEN p_brand END AS brand FROM part WHERE p_size%2=0 AND p_brand IS NOT NULL")
def p12_tag_filter(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = F.create_map(F.when(F.col("p_size") % 2 == 0, "brand").otherwise("label"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    kept = part.select(F.col("p_partkey").alias("entity_id"), F.map_filter(tags, lambda k, v: (k == "brand") & v.isNotNull()).alias("tags")).filter(F.size("tags") > 0)
    return kept.select("entity_id", F.col("tags")["brand"].alias("brand"))


@query(
    """WITH n AS (SELECT way_id, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b FROM ring_refs GROUP BY way_id), m AS (SELECT DISTINCT rel_id, role='inner' AS inner_ring, way_id, a, b FROM rel_members JOIN n USING (way_id)),
 bad AS (SELECT DISTINCT rel_id, inner_ring FROM (SELECT rel_id, inner_ring, unnest([a, b]) AS node FROM m WHERE a<>b) GROUP BY rel_id, inner_ring, node HAVING count(*)<>2),
 good AS (SELECT DISTINCT rel_id, inner_ring FROM m WHERE (rel_id, inner_ring) NOT IN (SELECT rel_id, inner_ring FROM bad)),
 p AS (SELECT DISTINCT rel_id, inner_ring, node_id, lon, lat FROM good JOIN m USING (rel_id, inner_ring) JOIN ring_refs USING (way_id) JOIN ring_nodes USING (node_id)),
 e AS (SELECT rel_id, inner_ring, lon*coalesce(lead(lat) OVER w, first_value(lat) OVER w)-lat*coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS twice FROM p WINDOW w AS (PARTITION BY rel_id, inner_ring ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT rel_id, inner_ring, count(*) AS points, round((CASE WHEN inner_ring THEN 1 ELSE -1 END)*abs(sum(twice))/2, 7) AS area FROM e WHERE rel_id IN (SELECT rel_id FROM good WHERE NOT inner_ring) GROUP BY rel_id, inner_ring""",
    "ring_nodes",
    "ring_refs",
    "rel_members",
)
def j5_assemble_multipolygons(spark, sf_dir):
    rings = osm.assemble_multipolygons(*(derived(spark, sf_dir, t) for t in ("rel_members", "ring_refs", "ring_nodes")))
    return rings.select("rel_id", F.col("inner").alias("inner_ring"), F.size("points").cast("long").alias("points"), F.round(geo.ring_area(F.col("points")), 7).alias("area"))


_RELATIONS = f"""{_BOXES}, r AS (SELECT rel_id, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM (SELECT rel_id, x0, x1, y0, y1 FROM osm_members JOIN b ON kind='node' AND ref=node_id UNION ALL SELECT rel_id, x0, x1, y0, y1 FROM osm_members JOIN w ON kind='way' AND ref=way_id)
 JOIN osm_relations USING (rel_id) WHERE rel_type IN ('multipolygon', 'boundary') GROUP BY rel_id),
 v AS (SELECT way_id, least(w.x0, min(r.x0)) AS x0, greatest(w.x1, max(r.x1)) AS x1, least(w.y0, min(r.y0)) AS y0, greatest(w.y1, max(r.y1)) AS y1 FROM w LEFT JOIN osm_members ON kind='way' AND ref=way_id LEFT JOIN r USING (rel_id) GROUP BY way_id, w.x0, w.x1, w.y0, w.y1)"""
_MAP = ("osm_nodes", "osm_way_refs", "osm_members", "osm_relations")


def _boxes(spark, sf_dir):
    nodes, refs, members, relations = (derived(spark, sf_dir, t) for t in _MAP)
    return nodes, refs, members, osm.relation_boxes(relations, members, nodes, refs, types=("multipolygon", "boundary"))


@query(f"WITH {_RELATIONS} SELECT * FROM r", *_MAP)
def j3_relation_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir)[-1]


@query(f"WITH {_RELATIONS} SELECT * FROM v", *_MAP)
def j3_ways_widened_by_relations(spark, sf_dir):
    return osm.widened_by_relations(*_boxes(spark, sf_dir))[0]


@query(
    f"""WITH {_RELATIONS}, m AS (SELECT node_id, x0, x1, y0, y1 FROM b UNION ALL SELECT node_id, x0, x1, y0, y1 FROM osm_way_refs JOIN v USING (way_id) WHERE node_id IN (SELECT node_id FROM b)
 UNION ALL SELECT ref, x0, x1, y0, y1 FROM osm_members JOIN r USING (rel_id) WHERE kind='node' AND ref IN (SELECT node_id FROM b))
 SELECT node_id, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM m GROUP BY node_id""",
    *_MAP,
)
def j3_nodes_widened_by_relations(spark, sf_dir):
    return osm.widened_by_relations(*_boxes(spark, sf_dir))[1]
