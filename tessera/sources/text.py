"""Readers and writers of line-based scenery text. Each reader has a form that takes lines, so that any source can feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geo import FOOT

# Names in the obstacle file and the features that they stand for, if any; any other name is a radio tower.
OBSTACLE_FEATURES = {
    "AM_RADIO_TOWER": "radio tower",
    "POLE": "pole",
    "TOWERS": "radio tower",
    "TOWER": "radio tower",
    "CRANE": "crane",
    "CATENARY": None,
    "BLDG": "building",
    "CTRL TWR": None,
    "T-L TWR": None,
    "ELEVATOR": "elevator",
    "WINDMILL": "windmill",
    "RIG": None,
    "STACK": "smokestack",
    "REFINERY": "refinery",
    "TANK": "tank",
    "BLDG-TWR": "building",
    "TRAMWAY": "tramway",
    "STACKS": "smokestacks",
    "SPIRE": "spire",
    "CRANE T": "crane",
    "PLANT": "plant",
    "DOME": "dome",
    "SIGN": "sign",
    "BRIDGE": None,
    "ARCH": "arch",
    "COOL TWR": "cooling tower",
    "MONUMENT": "monument",
    "BALLOON": None,
    "DAM": "dam",
}
#: Kinds are numbers of features, from 0 for a radio tower.
FEATURES = list(dict.fromkeys(x for x in OBSTACLE_FEATURES.values() if x))
# Navigation row codes and the beacons they stand for.
BEACON_KINDS = {2: "ndb", 3: "vor", 4: "ils", 5: "loc", 6: "glideslope", 7: "outer marker", 8: "middle marker", 9: "inner marker"}
# Row codes of airport headers.
AIRPORT_HEADERS = {"1": "airport", "16": "seaport", "17": "heliport"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files. A file is read whole, since the meaning of its lines depends on their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _cut(line: str, first: int, last: int) -> Column:
    """Characters first to last, counted from 0, without blanks around them."""
    return F.trim(F.substring(line, first + 1, last - first + 1))


def _degrees(line: str, at: int, wide: int) -> Column:
    """Degrees of ``wide`` digits, minutes and seconds with a hemisphere letter behind them."""
    number = lambda a, n: F.substring(line, a + 1, n).try_cast("double")
    value = number(at, wide) + number(at + wide + 1, 2) / 60 + number(at + wide + 4, 5) / 3600
    return F.when(F.substring(line, at + wide + 10, 1).isin("S", "W"), -value).otherwise(value)


def parse_obstacles(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, freq, lon, lat, agl, msl) of fixed-column obstacle lines behind the first line that starts with a dash.

    ``kind`` is the number of a feature in ``FEATURES``, null for names that stand for none. A frequency makes a radio tower
    (kind 0), as an unknown name does; heights are metres. Lines without a position are dropped.
    """
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.max(F.col("line").startswith("-")).over(order), F.lit(False))
    body = lines.withColumn("_on", behind).filter("_on").drop("_on")
    name, freq = _cut("line", 58, 66), F.nullif(_cut("line", 68, 72), F.lit(""))
    known = F.create_map(*[F.lit(x) for name, feature in OBSTACLE_FEATURES.items() if feature for x in (name, FEATURES.index(feature))])
    none = name.isin([x for x, feature in OBSTACLE_FEATURES.items() if not feature])
    kind = F.when(freq.isNotNull(), 0).when(~none, F.coalesce(F.try_element_at(known, name), F.lit(0)))
    feet = lambda a, b: _cut("line", a, b).try_cast("double") * FOOT
    out = body.select("file", "line_no", kind.alias("kind"), freq.alias("freq"), _degrees("line", 43, 3).alias("lon"), _degrees("line", 29, 2).alias("lat"), feet(73, 77).alias("agl"), feet(78, 83).alias("msl"))
    return out.filter("lon is not null and lat is not null")


def parse_radar(lines: DataFrame, approach: bool) -> DataFrame:
    """(file, line_no, kind, lon, lat, agl, msl) of fixed-column radar lines behind the second line that starts with an underscore.

    Approach radars have their height above ground, to which the ground's is added; en-route radars only the height above sea. Heights
    stay in the file's unit. Lines with a blank in column 59, and lines without a position, are dropped.
    """
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.col("line").startswith("_").cast("int")).over(order), F.lit(0)) >= 2
    body = lines.withColumn("_on", behind).filter("_on").filter(F.substring("line", 60, 1) != " ")

    def degrees(at: int, wide: int, negative: Column) -> Column:
        number = lambda a, n: F.substring("line", a + 1, n).try_cast("double")
        value = number(at, wide) + number(at + wide + 1, 2) / 60 + number(at + wide + 4, 4) / 3600
        return F.when(negative, -value).otherwise(value)

    lat, lon = (46, 59) if approach else (59, 71)
    north, east = F.substring("line", lat + 11, 1), F.substring("line", lon + 12, 1)
    number = lambda a, b: F.coalesce(_cut("line", a, b).try_cast("long"), F.lit(0))
    agl = number(20, 23) if approach else F.lit(None).cast("long")
    msl = number(20, 23) + number(71, 76) if approach else number(85, 90)
    out = body.select("file", "line_no", F.lit("approach radar" if approach else "route radar").alias("kind"), degrees(lon, 3, east != "E").alias("lon"), degrees(lat, 2, north == "S").alias("lat"), agl.alias("agl"), msl.alias("msl"))
    return out.filter("lon is not null and lat is not null")


def parse_nav_points(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, lon, lat) of navigation rows ``code lat lon [type …]``.

    Codes 2 to 9 are beacons, 18 is a light beacon if its type is 1 or 4, 19 a windsock.
    """
    part = F.split(F.trim("line"), r"\s+")
    field = lambda i: F.get(part, i)
    code = field(0).try_cast("int")
    beacons = F.create_map(*[F.lit(x) for kind in BEACON_KINDS.items() for x in kind])
    kind = F.when(code == 18, F.when(field(3).isin("1", "4"), F.lit("light beacon"))).when(code == 19, F.lit("windsock")).otherwise(F.try_element_at(beacons, code))
    out = lines.select("file", "line_no", kind.alias("kind"), field(2).try_cast("double").alias("lon"), field(1).try_cast("double").alias("lat"))
    return out.filter("kind is not null and lon is not null and lat is not null")


def write_degree_obstacles(obstacles: DataFrame, path: str) -> None:
    """Text ``lon lat msl agl kind`` in one folder for each degree tile; rows without a kind are left out."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("lon", "lat", "msl", "agl", "kind")])
    kept = obstacles.filter("kind is not null").select(text.alias("value"), F.floor("lon").alias("tile_x"), F.floor("lat").alias("tile_y"))
    kept.repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").text(path)


def read_degree_obstacles(spark: SparkSession, path: str) -> DataFrame:
    """The inverse of ``write_degree_obstacles``."""
    part = F.split("value", " ")
    number = lambda i: F.nanvl(F.get(part, i).try_cast("double"), F.lit(None).cast("double"))
    rows = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return rows.select(number(0).alias("lon"), number(1).alias("lat"), number(2).alias("msl"), number(3).alias("agl"), F.get(part, 4).try_cast("int").alias("kind"))


def attach_to_airports(lines: DataFrame) -> DataFrame:
    """(file, line_no, code, fields, header_no, icao) of airport lines: each belongs to the last header (1, 16, 17) before it.

    Row 99 ends a file; what stands before the first header (origin and version lines) belongs to nothing.
    """
    fields = F.split(F.trim("line"), r"\s+")
    coded = lines.withColumn("fields", fields).withColumn("code", F.get("fields", F.lit(0)))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("code").isin(*AIRPORT_HEADERS) & (F.col("line_no") > 1), F.struct(F.col("line_no").alias("no"), F.get("fields", F.lit(4)).alias("icao")))
    ended = F.coalesce(F.max(F.col("code") == "99").over(order), F.lit(False))
    placed = coded.withColumn("_h", F.last(header, True).over(order)).withColumn("_end", ended).filter("_h is not null and not _end and code <> ''")
    return placed.select("file", "line_no", "code", "fields", F.col("_h.no").alias("header_no"), F.col("_h.icao").alias("icao"))


def airports_of(rows: DataFrame) -> DataFrame:
    """(file, header_no, icao, kind, elevation_m, name) from attached lines."""
    kinds = F.create_map(*[F.lit(x) for kind in AIRPORT_HEADERS.items() for x in kind])
    heads = rows.filter(F.col("line_no") == F.col("header_no"))
    name = F.array_join(F.slice("fields", F.lit(6), F.greatest(F.size("fields") - 5, F.lit(0))), " ")
    return heads.select("file", "header_no", "icao", kinds[F.col("code")].alias("kind"), (F.get("fields", F.lit(1)).try_cast("double") * FOOT).alias("elevation_m"), name.alias("name"))


def frequencies_of(rows: DataFrame) -> DataFrame:
    """(icao, code, khz, name): rows 50–56 give tens of kHz, rows 1050–1056 kHz."""
    code = F.col("code").try_cast("int")
    number = F.get("fields", F.lit(1)).try_cast("long")
    name = F.array_join(F.slice("fields", F.lit(3), F.greatest(F.size("fields") - 2, F.lit(0))), " ")
    both = rows.withColumn("_n", code)
    return both.filter(F.col("_n").between(50, 56) | F.col("_n").between(1050, 1056)).select("icao", (F.col("_n") % 1000).alias("code"), F.when(F.col("_n") < 1000, number * 10).otherwise(number).alias("khz"), name.alias("name"))


def airport_text(rows: DataFrame) -> DataFrame:
    """(icao, text): the lines of each airport in order, the inverse of ``attach_to_airports``."""
    line = F.array_join("fields", " ")
    grouped = rows.withColumn("_line", line).groupBy("file", "header_no", "icao").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("_line").alias("line")))).alias("lines"))
    return grouped.select("icao", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def scenery_commands(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables of scenery tile text: ``properties``, ``defs`` (with the index of each kind), ``objects``.

    Unknown commands are ignored. An object with a height has longitude, latitude, height, rotation in this order.
    """
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.select("file", "line_no", F.get(part, F.lit(0)).alias("word"), part.alias("part"))
    field = lambda i: F.get("part", F.lit(i))
    rest = lambda i: F.array_join(F.slice("part", F.lit(i + 1), F.greatest(F.size("part") - i, F.lit(0))), " ")
    properties = rows.filter("word = 'PROPERTY'").select("file", field(1).alias("name"), rest(2).alias("value"))
    kind = F.regexp_extract("word", r"^(OBJECT|POLYGON|NETWORK|TERRAIN|RASTER)_DEF$", 1)
    defs = rows.withColumn("kind", kind).filter("kind <> ''")
    index = F.row_number().over(Window.partitionBy("file", "kind").orderBy("line_no")) - 1
    defs = defs.select("file", "kind", index.alias("index"), rest(1).alias("path"))
    objects = rows.filter("word in ('OBJECT', 'OBJECT_MSL', 'OBJECT_AGL')")
    number = lambda i: field(i).try_cast("double")
    tall = F.col("word") != "OBJECT"
    objects = objects.select("file", "line_no", field(1).try_cast("int").alias("index"), number(2).alias("lon"), number(3).alias("lat"), F.when(tall, number(4)).alias("height"), F.when(tall, number(5)).otherwise(number(4)).alias("rotation"), F.lower(F.regexp_extract("word", "_(.*)$", 1)).alias("above"))
    return {"properties": properties, "defs": defs, "objects": objects}


def library_entries(lines: DataFrame, today: str) -> DataFrame:
    """(file, line_no, status, backup, virtual, real) of EXPORT lines, with the status that the last status line before them set.

    PUBLIC with a date after ``today`` (yyyymmdd) means new.
    """
    part = F.split(F.trim("line"), r"\s+")
    word, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    public = F.when(second.rlike(r"^\d{8}$") & (second > F.lit(today)), "new").otherwise("public")
    status = F.when(word == "PUBLIC", public).when(word.isin("PRIVATE", "DEPRECATED", "SEMI_DEPRECATED"), F.lower(word))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("status", F.coalesce(F.last(status, True).over(order), F.lit("public"))).withColumn("_p", part).filter(word.startswith("EXPORT"))
    at = F.when(F.get("_p", F.lit(0)).isin("EXPORT_RATIO", "EXPORT_SEASON", "EXPORT_REGION"), 2).otherwise(1)
    real = F.array_join(F.slice("_p", at + 2, F.greatest(F.size("_p") - at - 1, F.lit(0))), " ")
    return marked.select("file", "line_no", "status", (F.get("_p", F.lit(0)) == "EXPORT_BACKUP").alias("backup"), F.get("_p", at).alias("virtual"), real.alias("real"))


def resolve_library(entries: DataFrame) -> DataFrame:
    """(virtual, status, reals): backups count only where nothing else has the path; the public status beats the others."""
    rank = F.create_map(*[F.lit(x) for kind in {"private": 0, "deprecated": 1, "semi_deprecated": 2, "new": 3, "public": 4}.items() for x in kind])
    firm = entries.groupBy("virtual").agg(F.min("backup").alias("_all_backup"))
    kept = entries.join(firm, "virtual").filter(~F.col("backup") | F.col("_all_backup"))
    grouped = kept.groupBy("virtual").agg(F.max_by("status", rank[F.col("status")]).alias("status"), F.array_sort(F.collect_list(F.struct("file", "line_no", "real"))).alias("all"))
    return grouped.select("virtual", "status", F.array_distinct(F.transform("all", lambda x: x["real"])).alias("reals"))
