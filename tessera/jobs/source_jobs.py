"""Queries that write derived inputs in a file's format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.shipping import shared_folder
from tessera.jobs.registry import query
from tessera.sources import grids, osm
from tessera.sources.fixtures import derived


@query("SELECT x, y, CAST(elev AS INT) AS value FROM cells WHERE elev IS NOT NULL", "cells")
def s10_read_hgt(spark, sf_dir):
    """Tiles of 25 × 25 posts that share their edges, in binary and back, every sample once."""
    cells = derived(spark, sf_dir, "cells").select("x", "y", F.col("elev").alias("value"))
    shared = lambda c: F.explode(F.when((F.col(c) % 24 == 0) & (F.col(c) > 0), F.array(F.expr(f"{c} div 24 - 1"), F.expr(f"{c} div 24"))).otherwise(F.array(F.expr(f"{c} div 24"))))
    tiled = cells.withColumn("tile_x", shared("x")).withColumn("tile_y", shared("y"))
    posts = tiled.select("tile_x", "tile_y", F.lit(25).alias("dim"), (F.col("x") - 24 * F.col("tile_x")).alias("x"), (F.col("y") - 24 * F.col("tile_y")).alias("y"), "value")
    read = grids.without_shared_edges(grids.hgt_cells(grids.hgt_contents(posts))).filter("value is not null")
    return read.select((24 * F.col("tile_x") + F.col("x")).cast("long").alias("x"), (24 * F.col("tile_y") + F.col("y")).cast("long").alias("y"), "value")


@query("SELECT tile_x, tile_y, count(*) AS samples, count(elev) AS valid FROM (SELECT x//24 AS tile_x, y//24 AS tile_y, elev FROM cells WHERE x%24<>0 AND y%24<>0) GROUP BY ALL", "cells")
def s11_write_hgt_tiles(spark, sf_dir):
    """One grid of 23 × 23 inner posts for each tile: how many samples are written and valid."""
    cells = derived(spark, sf_dir, "cells").filter("x % 24 <> 0 and y % 24 <> 0")
    posts = cells.select(F.expr("x div 24").alias("tile_x"), F.expr("y div 24").alias("tile_y"), F.lit(23).alias("dim"), (F.col("x") % 24 - 1).alias("x"), (F.col("y") % 24 - 1).alias("y"), F.col("elev").alias("value"))
    read = grids.hgt_cells(grids.hgt_contents(posts))
    own = posts.groupBy("tile_x", "tile_y").agg(F.count("*").alias("samples"))
    return read.groupBy(F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y")).agg(F.count("value").alias("valid")).join(own, ["tile_x", "tile_y"]).select("tile_x", "tile_y", "samples", "valid")


@query(
    "SELECT x, y, value, west, east FROM (SELECT x, y, elev AS value, CAST(tile_x AS DOUBLE) AS west, CAST(tile_x+1 AS DOUBLE) AS east, count(*) OVER (PARTITION BY tile_x, y) AS n FROM cells) WHERE n=40 AND value IS NOT NULL",
    "cells",
)
def s12_read_arc_ascii(spark, sf_dir):
    """Tiles of 40 posts a degree as text grids and back, of rows that are whole."""
    cells = derived(spark, sf_dir, "cells").select("tile_x", "tile_y", (F.col("x") - 40 * F.col("tile_x")).alias("x"), (F.col("y") - 25 * F.col("tile_y")).alias("y"), F.coalesce("elev", F.lit(-1.0)).alias("value"))
    rows = cells.groupBy("tile_x", "tile_y", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.col("value").cast("long").alias("v")))), lambda s: s["v"].cast("string")), " ").alias("line"), F.count("*").alias("n")).filter("n = 40")
    head = F.format_string("ncols 40\nnrows %d\nxllcorner %.15f\nyllcorner %.15f\ncellsize %.15f\nNODATA_value -1\n", F.size("lines"), F.col("tile_x") - 0.5 / 39, F.col("tile_y") - 0.5 / 39, F.lit(1 / 39))
    text = rows.groupBy("tile_x", "tile_y").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("k"), "line"))).alias("lines"))
    text = text.select(F.format_string("%d %d", "tile_x", "tile_y").alias("file"), F.concat(head, F.array_join(F.transform("lines", lambda s: s["line"]), "\n")).alias("value"))
    tile = lambda i: F.split("file", " ")[i].cast("long")
    read = grids.arc_cells(text).filter("value is not null")
    return read.select((tile(0) * 40 + F.col("x")).alias("x"), (tile(1) * 25 + F.col("y")).alias("y"), "value", F.round("west", 6).alias("west"), F.round("east", 6).alias("east"))


@query(
    """SELECT 'node' AS kind, node_id AS id, round(lon*lat, 6) AS digest FROM ring_nodes UNION ALL SELECT 'way', way_id, round(sum(node_id*(pos+1)), 6) FROM ring_refs GROUP BY way_id
 UNION ALL SELECT 'relation', rel_id, round(sum(way_id)+count(*) FILTER (role='inner')*0.5, 6) FROM rel_members GROUP BY rel_id""",
    "ring_nodes",
    "ring_refs",
    "rel_members",
)
def s8_read_osm(spark, sf_dir):
    nodes, refs, members = (derived(spark, sf_dir, t) for t in ("ring_nodes", "ring_refs", "rel_members"))
    tags = lambda *pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    relations = members.select("rel_id").distinct().withColumn("tags", tags(("type", "multipolygon"), ("name", 'a "b" & <c>')))
    members = members.select("rel_id", "pos", F.lit("way").alias("kind"), F.col("way_id").alias("ref"), "role")
    path = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    osm.write_osm({"nodes": nodes.withColumn("tags", tags()), "ways": refs.select("way_id").distinct().withColumn("tags", tags(("natural", "water"))), "refs": refs, "relations": relations, "members": members}, path)
    read = osm.read_osm(spark, path)
    told = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "digest")
    node = told(read["nodes"].withColumn("digest", F.round(F.col("lon") * F.col("lat"), 6)), "node", "node_id")
    way = told(read["refs"].groupBy("way_id").agg(F.sum(F.col("node_id") * (F.col("pos") + 1)).cast("double").alias("digest")), "way", "way_id")
    known = read["relations"].filter((F.col("rel_type") == "multipolygon") & (F.col("tags")["name"] == 'a "b" & <c>'))
    inner = F.count(F.when(F.col("role") == "inner", 1)) * 0.5
    relation = read["members"].join(known, "rel_id").groupBy("rel_id").agg((F.sum("ref") + inner).cast("double").alias("digest"))
    return node.union(way).union(told(relation, "relation", "rel_id"))
