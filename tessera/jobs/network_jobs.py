"""Road network queries on the derived ``road_edges``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import network
from tessera.sources.fixtures import derived

#: Chains of the derived edges are runs of consecutive numbers, so SQL finds components as islands.
ISLANDS = """n AS (SELECT DISTINCT net_id, node FROM (SELECT net_id, src AS node FROM road_edges UNION ALL SELECT net_id, dst FROM road_edges)),
 j AS (SELECT n.net_id, n.node, EXISTS (SELECT 1 FROM road_edges e WHERE e.net_id=n.net_id AND e.dst=n.node) AS joined FROM n),
 c AS (SELECT net_id, node, max(CASE WHEN NOT joined THEN node END) OVER (PARTITION BY net_id ORDER BY node) AS component FROM j)"""


@query(f"WITH {ISLANDS} SELECT net_id, node, component FROM c", "road_edges")
def g1_components(spark, sf_dir):
    return network.components(derived(spark, sf_dir, "road_edges"), ["net_id"])


@query(f"WITH {ISLANDS}, s AS (SELECT net_id, component, count(*) AS size FROM c GROUP BY ALL) SELECT net_id, component, size FROM s QUALIFY row_number() OVER (PARTITION BY net_id ORDER BY size DESC, component) > 1", "road_edges")
def g1_not_in_largest(spark, sf_dir):
    return network.not_in_largest(network.components(derived(spark, sf_dir, "road_edges"), ["net_id"]), ["net_id"])


@query(
    """WITH j AS (SELECT e.edge_id, NOT EXISTS (SELECT 1 FROM road_edges p WHERE p.dst=e.src) AS begins FROM road_edges e)
 SELECT edge_id, max(CASE WHEN begins THEN edge_id END) OVER (ORDER BY edge_id) AS chain FROM j""",
    "road_edges",
)
def g3_contiguous_chains(spark, sf_dir):
    return network.contiguous_chains(derived(spark, sf_dir, "road_edges"))


@query(
    """WITH v AS (SELECT net_id, node, count(*) AS v FROM (SELECT net_id, src AS node FROM road_edges UNION ALL SELECT net_id, dst FROM road_edges) GROUP BY ALL)
 SELECT net_id, count(*) FILTER (v=1) AS ends, count(*) FILTER (v>=3) AS splits, count(*) FILTER (v=1)=0 AS loop FROM v GROUP BY net_id""",
    "road_edges",
)
def g4_node_valence(spark, sf_dir):
    edges = derived(spark, sf_dir, "road_edges")
    ends = edges.select("net_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("net_id", "node").agg(F.count("*").alias("v"))
    number = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return ends.groupBy("net_id").agg(number(F.col("v") == 1).alias("ends"), number(F.col("v") >= 3).alias("splits")).withColumn("loop", F.col("ends") == 0)


@query("SELECT edge_id, 'unknown node' AS problem FROM road_edges WHERE dst NOT IN (SELECT node_id FROM osm_nodes) OR src NOT IN (SELECT node_id FROM osm_nodes)", "road_edges", "osm_nodes")
def g5_route_network_integrity(spark, sf_dir):
    ends = derived(spark, sf_dir, "road_edges").select("edge_id", F.explode(F.array("src", "dst")).alias("node_id"))
    missing = ends.join(derived(spark, sf_dir, "osm_nodes"), "node_id", "left_anti")
    return missing.select("edge_id").distinct().withColumn("problem", F.lit("unknown node"))


_SEGMENTS = """s AS (SELECT edge_id%977 AS src, (edge_id*7)%977 AS dst, feat_type, edge_id FROM road_edges WHERE edge_id%977 <> (edge_id*7)%977)"""


@query(
    f"""WITH {_SEGMENTS}, d AS (SELECT src, dst, min(feat_type) AS feat_type FROM s GROUP BY ALL)
 SELECT src, dst, feat_type FROM d QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY feat_type, src>dst DESC)=1""",
    "road_edges",
)
def k1_drop_duplicate_roads(spark, sf_dir):
    e = F.col("edge_id")
    segments = derived(spark, sf_dir, "road_edges").select((e % 977).alias("src"), (e * 7 % 977).alias("dst"), "feat_type", "edge_id").filter("src <> dst")
    return network.drop_duplicate_roads(segments).select("src", "dst", "feat_type")


@query(
    """WITH r AS (SELECT edge_id, src, dst, edge_id%3=0 AS wet, NOT EXISTS (SELECT 1 FROM road_edges p WHERE p.dst=e.src) AS first, NOT EXISTS (SELECT 1 FROM road_edges p WHERE p.src=e.dst) AS last FROM road_edges e)
 SELECT edge_id FROM r WHERE NOT (wet AND (first OR last))""",
    "road_edges",
)
def d9_remove_wet_antennas(spark, sf_dir):
    # No two neighbouring edges are marked here, so one round decides and the last confirms.
    edges = derived(spark, sf_dir, "road_edges")
    return network.prune_dead_ends(edges, edges.filter("edge_id % 3 = 0")).select("edge_id")


@query("SELECT edge_id FROM road_edges WHERE NOT (src_h < 0 OR dst_h < 0)", "road_edges")
def d10_remove_tunnels(spark, sf_dir):
    return derived(spark, sf_dir, "road_edges").filter("src_h >= 0 and dst_h >= 0").select("edge_id")


@query(
    """WITH e AS (SELECT src AS node, src_h AS level, feat_type FROM road_edges UNION ALL SELECT dst, dst_h, feat_type FROM road_edges), m AS (SELECT node, level, list_sort(list(feat_type)) AS t FROM e GROUP BY ALL)
 SELECT least(len(t), 5)::INT AS degree, array_to_string(t, ',') AS types, count(*) AS n FROM m WHERE NOT (len(t)=2 AND t[1]=t[2]) GROUP BY ALL""",
    "road_edges",
)
def a19_junction_histogram(spark, sf_dir):
    return network.junction_histogram(derived(spark, sf_dir, "road_edges"))


@query(
    """SELECT edge_id, CASE WHEN src=dst THEN 'self-loop' WHEN src_h NOT BETWEEN 0 AND 5 OR dst_h NOT BETWEEN 0 AND 5 THEN 'layer' END AS problem FROM road_edges WHERE src=dst OR src_h NOT BETWEEN 0 AND 5 OR dst_h NOT BETWEEN 0 AND 5""",
    "road_edges",
)
def v17_road_rules(spark, sf_dir):
    bad = ~F.col("src_h").between(0, 5) | ~F.col("dst_h").between(0, 5)
    problem = F.when(F.col("src") == F.col("dst"), "self-loop").when(bad, "layer")
    return derived(spark, sf_dir, "road_edges").select("edge_id", problem.alias("problem")).filter("problem is not null")


@query(
    """WITH e AS (SELECT *, (edge_id//4)%2 AS kind FROM road_edges), j AS (SELECT e.edge_id, NOT EXISTS (SELECT 1 FROM e p WHERE p.dst=e.src AND p.kind=e.kind) AS begins FROM e)
 SELECT edge_id, max(CASE WHEN begins THEN edge_id END) OVER (ORDER BY edge_id) AS chain FROM j""",
    "road_edges",
)
def k5_merge_linear_chains(spark, sf_dir):
    edges = derived(spark, sf_dir, "road_edges").withColumn("kind", F.expr("edge_id div 4") % 2)
    return network.merged_chains(edges, "kind")
