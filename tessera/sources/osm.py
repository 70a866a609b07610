"""Map files in XML: nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id long, _lon double, _lat double, {_TAGS}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAGS}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAGS}",
}


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", kind).option("recursiveFileLookup", "true").schema(_SCHEMAS[kind]).load(path).filter("_id is not null")
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    return rows.withColumn("tags", tags)


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of map files: ``nodes`` (node_id, lon, lat, tags), ``ways`` (way_id, tags), ``refs`` (way_id, pos, node_id),
    ``relations`` (rel_id, rel_type, tags) and ``members`` (rel_id, pos, kind, ref, role). A map has many files; each is read once
    for its nodes, once for its ways and once for its relations, in folders of any depth, and whole by one task, for it cannot be split.
    Elements without an id are left out; nodes may lack a place.
    """
    nodes, ways, relations = (_read(spark, path, kind) for kind in ("node", "way", "relation"))
    refs = ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "n")).select("way_id", F.col("pos").cast("long").alias("pos"), F.col("n._ref").alias("node_id"))
    members = relations.select(F.col("_id").alias("rel_id"), F.posexplode("member").alias("pos", "m"))
    members = members.select("rel_id", F.col("pos").cast("long").alias("pos"), F.col("m._type").alias("kind"), F.col("m._ref").alias("ref"), F.col("m._role").alias("role"))
    return {
        "nodes": nodes.select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), "tags"),
        "ways": ways.select(F.col("_id").alias("way_id"), "tags"),
        "refs": refs,
        "relations": relations.select(F.col("_id").alias("rel_id"), F.try_element_at("tags", F.lit("type")).alias("rel_type"), "tags"),
        "members": members,
    }


#: Elements in a file at most: one task reads a file whole.
FILE_ELEMENTS = {"node": 100_000, "way": 10_000, "relation": 10_000}


def write_osm(tables: dict[str, DataFrame], path: str, file_elements: dict[str, int] = FILE_ELEMENTS) -> None:
    """XML files of the tables that ``read_osm`` has, in a folder for each kind of element; refs and members in order.

    ``file_elements`` bounds the files, so that reading spreads over tasks at any size.
    """
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.struct(t["key"].alias("_k"), t["value"].alias("_v"))).alias("tag")

    def listed(rows: DataFrame, key: str, **columns: str) -> DataFrame:
        inner = F.struct("pos", *[F.col(c).alias(f"_{name}") for name, c in columns.items()])
        grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(inner)).alias("all"))
        return grouped.select(key, F.transform("all", lambda r: F.struct(*[r[f"_{name}"].alias(f"_{name}") for name in columns])).alias("inner"))

    refs, members = listed(tables["refs"], "way_id", ref="node_id"), listed(tables["members"], "rel_id", type="kind", ref="ref", role="role")
    elements = {
        "node": tables["nodes"].select(F.col("node_id").alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), tags),
        "way": tables["ways"].join(refs, "way_id", "left").select(F.col("way_id").alias("_id"), F.col("inner").alias("nd"), tags),
        "relation": tables["relations"].join(members, "rel_id", "left").select(F.col("rel_id").alias("_id"), F.col("inner").alias("member"), tags),
    }
    for kind, rows in elements.items():
        rows.write.format("xml").option("rootTag", "osm").option("rowTag", kind).option("maxRecordsPerFile", file_elements[kind]).save(f"{path}/{kind}s")
