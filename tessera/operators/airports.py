"""Airport joins and validation rules; rules return one row for each problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def airports_near(boxes: DataFrame, airports: DataFrame, box_id: str) -> DataFrame:
    """(box id, apt_id): airports whose degree cell lies in the cell range of the box, met by an equi-join on cells."""
    span = lambda low, high: F.sequence(F.floor(low), F.ceil(high))
    across = boxes.select(box_id, "south", "north", F.explode(span("west", "east")).alias("cx"))
    cells = across.select(box_id, "cx", F.explode(span("south", "north")).alias("cy"))
    there = airports.select("apt_id", F.floor("lon").alias("cx"), F.floor("lat").alias("cy"))
    return cells.join(there, ["cx", "cy"]).select(box_id, "apt_id")


def duplicate_names(parts: DataFrame) -> DataFrame:
    """(apt_id, name, offenders) of names that several objects of an airport have."""
    grouped = parts.groupBy("apt_id", "name").agg(F.sort_array(F.collect_list("object")).alias("offenders"))
    return grouped.filter(F.size("offenders") > 1)


def frequency_problems(frequencies: DataFrame) -> DataFrame:
    """(freq_id, problem): band (from 108 MHz for weather service 0, else 118, to 137), guard band, channel raster."""
    low = F.when(F.col("atc_type") == 0, 108000).otherwise(118000)
    khz = F.col("khz")
    band, guard, channel = (khz < low) | (khz > 137000), khz.between(121475, 121525), ~(khz % 25).isin(0, 5, 10, 15)
    problem = F.when((khz < 118000) | (khz > 137000), "band").when(guard, "guard").when(channel, "raster")
    return frequencies.filter(band | guard | channel).select("freq_id", problem.alias("problem"))


def runway_problems(runways: DataFrame) -> DataFrame:
    """(rwy_id, problem): the high number must be the low one turned round; at least 5 by 100 metres."""
    tests = F.array(
        F.when(1 + (F.col("num_lo") + 17) % 36 != F.col("num_hi"), F.lit("reciprocal")),
        F.when(F.col("width_m") < 5, F.lit("width")),
        F.when(F.col("length_m") < 100, F.lit("length")),
    )
    return runways.select("rwy_id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("problem"))


def heading_problems(runways: DataFrame) -> DataFrame:
    """(rwy_id, off, problem): degrees between the heading and ten times the number, over 25 or over 135."""
    off = F.abs((F.col("num_lo") * 10 - F.col("heading") + 540) % 360 - 180)
    out = runways.select("rwy_id", off.alias("off")).filter("off > 25")
    return out.withColumn("problem", F.when(F.col("off") > 135, "reversed").otherwise("misaligned"))


def unreachable_flows(flows: DataFrame, most_knots: float = 35.0) -> DataFrame:
    """Flows of which no wind degree exceeds what earlier flows of the airport cover (from_deg ≤ to_deg, wrapping at 360)."""
    degrees = flows.select("flow", "apt", "place", F.least("knots", F.lit(most_knots)).alias("knots"), F.explode(F.sequence("from_deg", "to_deg")).alias("d"))
    degrees = degrees.withColumn("deg", F.col("d") % 360)
    earlier = Window.partitionBy("apt", "deg").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("knots").over(earlier), F.lit(-1.0))
    return degrees.withColumn("open", F.col("knots") > before).groupBy("flow").agg(F.max("open").alias("open")).filter(~F.col("open")).select("flow")


def name_problem(name: Column) -> Column:
    return (
        F.when(name.isNull() | (name == ""), "missing").when(F.length(name) > 30, "long").when(F.upper(name) == name, "capitals").when(F.lower(name).contains("airport"), "airport").otherwise("fine")
    )


def text_filter(airports: DataFrame, needles: str, *columns: str) -> DataFrame:
    """Rows in which any of the blank-separated needles occurs in any column, whatever the case, in order of the first."""
    test = F.lit(False)
    for needle in needles.upper().split():
        for c in columns:
            test = test | F.upper(c).contains(needle)
    return airports.filter(test).orderBy(F.upper(columns[0]))


def country_codes(countries: DataFrame, parts: DataFrame) -> DataFrame:
    """(nation, iso) where exactly one partial name occurs in the country's name; the table of names is a fixed list."""
    met = countries.join(F.broadcast(parts), F.upper("country").contains(F.col("part")))
    return met.groupBy("nation").agg(F.count("*").alias("n"), F.max("code").alias("iso")).filter("n = 1").select("nation", "iso")


def later_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace all rows of ``old`` with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def _code(low: int, high: int, digits: bool) -> str:
    """Pattern of an organisation's code."""
    return f"^[A-Za-z{'0-9' if digits else ''}]{{{low},{high}}}$"


def metadata_problems(metadata: DataFrame) -> DataFrame:
    """(apt_id, meta_key, problem) of metadata rows (apt_id, meta_key, meta_value): codes, levels, flags, links; empty values pass.

    A transition altitude under 1,000 is a flight level, which must lie between 100 and 300; else it may be 30,000 ft at most.
    """
    key, value = F.col("meta_key"), F.col("meta_value")
    number = value.try_cast("int")
    level = F.when(~value.rlike("^[0-9]+$"), "number").when((number < 1000) & ~number.between(100, 300), "flight level").when(number > 30000, "altitude")
    among = lambda *allowed: F.when(~value.isin(*allowed), "value")
    problem = (
        F.when(value == "", None)
        .when(key == "faa", F.when(~value.rlike(_code(3, 5, True)), "code"))
        .when(key == "iata", F.when(~value.rlike(_code(3, 3, False)), "code"))
        .when(key == "icao", F.when(~value.rlike(_code(4, 4, False)) | (F.lower(F.left(value, F.lit(1))) == "x"), "code"))
        .when(key == "local", F.when(~value.rlike(_code(3, 7, True)), "code"))
        .when(key == "transition_alt", level)
        .when(key == "circuits", among("0", "1"))
        .when(key == "tower_caps", among("atc", "fiso"))
        .when(key == "gui_label", among("2D", "3D"))
        .otherwise(F.when(value.contains("http"), "link"))
    )
    return metadata.select("apt_id", "meta_key", problem.alias("problem")).filter("problem is not null")


def oversized(parts: DataFrame, airports: DataFrame, most_nm: float = 7.0) -> DataFrame:
    """Airports (apt_id, icao) whose parts (apt_id, lon, lat) span more than ``most_nm``; two known ones may span three times that."""
    box = parts.groupBy("apt_id").agg((F.max("lon") - F.min("lon")).alias("wide"), (F.max("lat") - F.min("lat")).alias("tall"), ((F.max("lat") + F.min("lat")) / 2).alias("middle"))
    limit = most_nm / 60 * F.when(F.col("icao").isin("KEDW", "KSEA"), 3.0).otherwise(1.0)
    return box.join(airports.select("apt_id", "icao"), "apt_id").filter((F.col("wide") > limit / F.cos(F.radians("middle"))) | (F.col("tall") > limit)).select("apt_id", "icao")


def lacking_parts(airports: DataFrame, parts: DataFrame) -> DataFrame:
    """(apt_id, problem): no runway, helipad or sealane by the airport's kind (0 land, 1 heli, 2 sea); trucks without routes and the reverse; no boundary."""
    has = lambda kind: F.max(F.col("part_kind") == kind)
    names = ("runway", "helipad", "sealane", "boundary", "truck parking", "truck route")
    own = parts.groupBy("apt_id").agg(*[has(k).alias(k) for k in names])
    every = airports.join(own, "apt_id", "left").select("apt_id", "apt_kind", *[F.coalesce(F.col(f"`{k}`"), F.lit(False)).alias(k.replace(" ", "_")) for k in names])
    found = F.array(
        F.when((F.col("apt_kind") == 0) & ~F.col("runway"), "no runway").when((F.col("apt_kind") == 1) & ~F.col("helipad"), "no helipad").when((F.col("apt_kind") == 2) & ~F.col("sealane"), "no sealane"),
        F.when(F.col("truck_parking") & ~F.col("truck_route"), "parking without routes"),
        F.when(F.col("truck_route") & ~F.col("truck_parking"), "routes without parking"),
        F.when(F.col("runway") & ~F.col("boundary"), "no boundary"),
    )
    return every.select("apt_id", F.explode(F.array_compact(found)).alias("problem"))


def taxi_edge_problems(edges: DataFrame) -> DataFrame:
    """(edge_id, problem): edges shorter than their width class allows (0–1: 7 m, 2: 10, 3–5: 20, 6 for trucks: 5), and odd names.

    A name has up to three characters: a letter, then a letter or digit, then a digit. Truck routes may have any.
    """
    width = F.col("width_class")
    least = F.when(width <= 1, 7.0).when(width == 2, 10.0).when(width == 6, 5.0).otherwise(20.0)
    short = F.when(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") < least * least, "short")
    name = F.col("taxi_name")
    odd = F.when((width == 6) | (name == ""), None).when(F.length(name) > 3, "long name").when(~name.rlike("^[A-Za-z]([A-Za-z0-9]([0-9])?)?$"), "odd name")
    return edges.select("edge_id", F.explode(F.array_compact(F.array(short, odd))).alias("problem"))


def runway_use_problems(uses: DataFrame, frequencies: DataFrame, tower: int = 4, departure: int = 6) -> DataFrame:
    """(use_id, problem): faults of runway uses (use_id, apt_id, operations, equipment, khz).

    A use needs an operation, and else an equipment. Apart from that, at an airport with a frequency of type ``tower`` its
    frequency has to be one of the airport's of type ``departure``; so a use may have two problems, in rows of their own.
    """
    towers = frequencies.filter(F.col("atc_type") == tower).select("apt_id", F.lit(True).alias("manned")).distinct()
    known = frequencies.filter(F.col("atc_type") == departure).select("apt_id", "khz", F.lit(True).alias("known")).distinct()
    told = uses.join(towers, "apt_id", "left").join(known, ["apt_id", "khz"], "left")
    does = F.when(F.col("operations") == 0, "operation").when(F.col("equipment") == 0, "equipment")
    heard = F.when(F.col("manned") & F.col("known").isNull(), "frequency")
    return told.select("use_id", F.explode(F.array_compact(F.array(does, heard))).alias("problem"))


def airport_classes(airports: DataFrame, parts: DataFrame) -> DataFrame:
    """(apt_id, taxiways, boundaries, pavements, class): classes by which of the parts (apt_id, kind) an airport has any.

    Without a boundary: nothing (null class) unless it has taxiways; these with pavements of the old kind are a mix, else new.
    With a boundary: old if it has pavements, else new with taxiways, and only a boundary without.
    """
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    held = parts.groupBy("apt_id").agg(count("taxiway").alias("taxiways"), count("boundary").alias("boundaries"), count("pavement").alias("pavements"))
    all_of = airports.select("apt_id").join(held, "apt_id", "left").na.fill(0)
    taxi, bounded, paved = (F.col(c) > 0 for c in ("taxiways", "boundaries", "pavements"))
    kind = F.when(~bounded & taxi, F.when(paved, "new-old mix").otherwise("new without boundary"))
    kind = F.when(bounded & paved, "old with boundary").when(bounded & taxi, "new with boundary").when(bounded, "boundary only").otherwise(kind)
    return all_of.withColumn("class", kind)


def airports_of_version(classes: DataFrame, version: int, bounded: bool) -> DataFrame:
    """The airports of ``airport_classes`` of a version (810 without taxiways, else 850), with or without a boundary."""
    own = F.when(F.col("taxiways") == 0, 810).otherwise(850)
    return classes.filter((own == version) & ((F.col("boundaries") > 0) == bounded))


def ramp_problems(ramps: DataFrame, runways: DataFrame) -> DataFrame:
    """(ramp_id, problem): faults of ramp starts (ramp_id, apt_id, equipment, ramp_type, op_type, width_class, airlines).

    Types are misc, gate, tie-down and hangar. A start needs equipment; misc and hangars have neither airlines nor an operation
    type (0 is none); a gate or tie-down of class 4 or 5 needs a paved runway (apt_id, length_m, width_m, paved) of 6,000 by 100
    feet at its airport, one of class 2 or 3 one of 3,000 by 70, a smaller one any runway. Airlines, in lower case and without
    blanks around them, are groups of three letters with single spaces, 99 characters at most; they are read from the end, and
    what breaks the grid of groups ends the reading.
    """
    feet = lambda big, mid: F.when(F.col("width_class") >= 4, big).when(F.col("width_class") >= 2, mid).otherwise(0.0) * 0.3048
    real = F.col("ramp_type").isin("gate", "tie-down")
    sizes = runways.groupBy("apt_id", "paved").agg(F.collect_set(F.struct("length_m", "width_m")).alias("sizes"))
    sizes = sizes.groupBy("apt_id").agg(F.max(F.when(F.col("paved"), F.col("sizes"))).alias("paved"), F.max(F.lit(True)).alias("any"))
    long_, wide = feet(6000.0, 3000.0), feet(100.0, 70.0)
    serves = F.when(F.col("width_class") < 2, F.col("any")).otherwise(F.exists("paved", lambda r: (r["length_m"] >= long_) & (r["width_m"] >= wide)))
    listed = F.concat(F.lit(" "), F.lower(F.btrim("airlines")))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.length(listed) / 4).cast("int") - 1), lambda k: F.substr(listed, 4 * k + 1, F.lit(4)))
    odd = lambda g: F.regexp_extract(F.substr(g, F.lit(2), F.lit(3)), "[^a-z]", 0)
    judged = F.reverse(F.transform(groups, lambda g: F.when(~g.startswith(" "), "no space").when(odd(g) == " ", "not in threes").when(odd(g) != "", "not letters").otherwise("")))
    stop = F.array_position(F.transform(judged, lambda x: x.isin("no space", "not in threes")), True).cast("int")
    read = F.array_distinct(F.filter(F.slice(judged, F.lit(1), F.when(stop > 0, stop).otherwise(F.size(judged))), lambda x: x != ""))
    n = F.length(listed)
    lines = F.when(F.coalesce(n, F.lit(1)) == 1, F.array().cast("array<string>")).when(n < 4, F.array(F.lit("no airline"))).when(n % 4 != 0, F.array(F.lit("not in threes"))).when(n > 100, F.array(F.lit("too long"))).otherwise(read)
    first = F.array_compact(
        F.array(
            F.when(F.col("equipment") == 0, "equipment"),
            F.when(~real & ((F.coalesce("airlines", F.lit("")) != "") | (F.col("op_type") != 0)), "airlines or operation"),
            F.when(real & ~F.coalesce(serves, F.lit(False)), "too large"),
        )
    )
    told = ramps.join(sizes, "apt_id", "left").select("ramp_id", first.alias("first"), lines.alias("lines"))
    return told.select("ramp_id", F.explode(F.concat("first", "lines")).alias("problem"))


def flow_problems(flows: DataFrame, winds: DataFrame, times: DataFrame, uses: DataFrame, runways: DataFrame) -> DataFrame:
    """(apt_id, object, id, problem): faults of the flows of airports, their wind and time rules and their runways.

    ``flows`` (flow_id, apt_id, name, icao, visibility, ceiling, pattern), ``winds`` (rule_id, flow_id, icao, from_deg, to_deg,
    knots), ``times`` (rule_id, flow_id, start, stop) as hhmm, ``uses`` (use_id, flow_id, number, side, arrivals, departures) with
    runway numbers 1 to 36 and sides L, C, R or none, and the directions that an airport's ``runways`` (apt_id, number) have.
    Where two flows of an airport share a name, that is its only fault: 'same name', of each of them.
    """
    twice = flows.filter("name <> ''").groupBy("apt_id", "name").agg(F.count("*").alias("n")).filter("n > 1").select("apt_id", "name")
    told = lambda rows, kind, key: rows.select("apt_id", F.lit(kind).alias("object"), F.col(key).alias("id"), F.explode(F.array_compact("found")).alias("problem"))
    same = flows.join(twice, ["apt_id", "name"], "left_semi").select("apt_id", F.lit("flow").alias("object"), F.col("flow_id").alias("id"), F.lit("same name").alias("problem"))
    sound = flows.join(twice.select("apt_id").distinct(), "apt_id", "left_anti")
    owner = sound.select("flow_id", "apt_id")
    legal = runways.select("apt_id", F.col("number").alias("pattern"), F.lit(True).alias("legal")).distinct()

    out = lambda c, low, high: (F.col(c) < low) | (F.col(c) > high)
    own = F.array(
        F.when(F.col("icao") == "", "no station"),
        F.when((F.col("visibility") < 0) | (F.col("ceiling") < 0), "negative"),
        F.when(F.col("visibility") > 20, "high visibility"),
        F.when(F.col("ceiling") > 10_000, "high ceiling"),
        F.when(F.col("name") == "", "no name"),
        F.when(F.col("legal").isNull(), "unknown pattern"),
    )
    of_flows = told(sound.join(legal, ["apt_id", "pattern"], "left").withColumn("found", own), "flow", "flow_id")
    wind = F.array(
        F.when(F.col("icao") == "", "no station"),
        F.when(out("from_deg", 0, 359) | out("to_deg", 0, 360) | (F.col("from_deg") == F.col("to_deg")), "directions"),
        F.when(out("knots", 1, 999), "speed"),
    )
    of_winds = told(winds.join(owner, "flow_id").withColumn("found", wind), "wind rule", "rule_id")
    end = F.when(F.col("start") < F.col("stop"), F.col("stop")).otherwise(F.col("stop") + 2400)
    time = F.array(
        F.when(out("start", 0, 2359) | out("stop", 0, 2400) | (F.col("start") == F.col("stop")) | (F.col("start") % 100 > 59) | (F.col("stop") % 100 > 59), "times"),
        F.when(end - F.col("start") < 100, "short"),
    )
    of_times = told(times.join(owner, "flow_id").withColumn("found", time), "time rule", "rule_id")
    # A use meets those of its flow that go the other way on the same strip.
    other = F.when(F.col("side") == "L", "R").when(F.col("side") == "R", "L").otherwise(F.col("side"))
    used = uses.join(owner, "flow_id")
    back = used.select("flow_id", ((F.col("number") + 17) % 36 + 1).alias("number"), other.alias("side"), F.col("arrivals").alias("a"), F.col("departures").alias("d"))
    against = used.join(back, ["flow_id", "number", "side"]).groupBy("flow_id").agg(F.max(F.col("arrivals") & F.col("a")).alias("a"), F.max(F.col("departures") & F.col("d")).alias("d"))
    some = used.groupBy("flow_id").agg(F.max("arrivals").alias("lands"), F.max("departures").alias("leaves"))
    ways = F.array(
        F.when(F.col("a"), "opposite arrivals"),
        F.when(F.col("d"), "opposite departures"),
        F.when(~F.coalesce(F.col("lands") & F.col("leaves"), F.lit(False)), "no arrival or departure"),
    )
    of_uses = told(owner.join(against, "flow_id", "left").join(some, "flow_id", "left").withColumn("found", ways), "runways", "flow_id")
    return same.union(of_flows).union(of_winds).union(of_times).union(of_uses)
