"""Map nodes, ways and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_ways(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(way_id, points): the ordered coordinates of each way; missing nodes drop out, and ways without any."""
    met = refs.join(nodes, "node_id")
    return met.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("points"))


def node_boxes(nodes: DataFrame, grid: int = 1) -> DataFrame:
    """Tile box of each node; a node on a grid line belongs to the tiles on both sides."""
    low = lambda c: F.ceil(F.col(c) / grid) - 1
    high = lambda c: F.floor(F.col(c) / grid)
    return nodes.select("node_id", low("lon").alias("x0"), high("lon").alias("x1"), low("lat").alias("y0"), high("lat").alias("y1"))


def way_boxes(nodes: DataFrame, refs: DataFrame, grid: int = 1) -> DataFrame:
    """Union of the boxes of a way's nodes; refs without a node are skipped."""
    return _union(refs.join(node_boxes(nodes, grid), "node_id").groupBy("way_id"))


def _union(grouped) -> DataFrame:
    return grouped.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def widened_nodes(nodes: DataFrame, refs: DataFrame, ways: DataFrame, grid: int = 1) -> DataFrame:
    """Node boxes widened by the boxes of the ways that use them, so that every tile of a way has all of its nodes."""
    own = node_boxes(nodes, grid)
    through = refs.join(ways, "way_id").select("node_id", "x0", "x1", "y0", "y1").join(own.select("node_id"), "node_id", "left_semi")
    return _union(own.union(through).groupBy("node_id"))


def per_tile(boxes: DataFrame, id_column: str) -> DataFrame:
    """(id, tile_x, tile_y): one row for each tile of a box."""
    across = boxes.select(id_column, "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("tile_x"))
    return across.select(id_column, "tile_x", F.explode(F.sequence("y0", "y1")).alias("tile_y"))
