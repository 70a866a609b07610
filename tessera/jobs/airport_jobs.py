"""Airport queries: validation rules, joins, text filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.jobs.registry import query
from tessera.operators import airports as ops
from tessera.sources.fixtures import derived


@query("SELECT a.apt_id AS a, count(*) AS near FROM airports a JOIN airports b ON floor(b.lon) BETWEEN floor(a.lon-0.5) AND ceil(a.lon+0.5) AND floor(b.lat) BETWEEN floor(a.lat-0.5) AND ceil(a.lat+0.5) GROUP BY a.apt_id", "airports")
def j2_airports_near(spark, sf_dir):
    airports = derived(spark, sf_dir, "airports")
    boxes = airports.select(F.col("apt_id").alias("a"), (F.col("lon") - 0.5).alias("west"), (F.col("lon") + 0.5).alias("east"), (F.col("lat") - 0.5).alias("south"), (F.col("lat") + 0.5).alias("north"))
    return ops.airports_near(boxes, airports, "a").groupBy("a").agg(F.count("*").alias("near"))


@query("SELECT apt_id, floor(length_m/1000) AS name, list_sort(list(rwy_id))::VARCHAR AS offenders FROM runways GROUP BY ALL HAVING count(*) > 1", "runways")
def v1_duplicate_names(spark, sf_dir):
    found = ops.duplicate_names(derived(spark, sf_dir, "runways").select("apt_id", F.floor(F.col("length_m") / 1000).cast("double").alias("name"), F.col("rwy_id").alias("object")))
    return found.select("apt_id", "name", F.concat(F.lit("["), F.array_join("offenders", ", "), F.lit("]")).alias("offenders"))


@query(
    """SELECT freq_id, CASE WHEN khz < 118000 OR khz > 137000 THEN 'band' WHEN khz BETWEEN 121475 AND 121525 THEN 'guard' WHEN khz%25 NOT IN (0, 5, 10, 15) THEN 'raster' END AS problem
 FROM atc_freqs WHERE khz < CASE WHEN atc_type=0 THEN 108000 ELSE 118000 END OR khz > 137000 OR khz BETWEEN 121475 AND 121525 OR khz%25 NOT IN (0, 5, 10, 15)""",
    "atc_freqs",
)
def v2_atc_frequency_rules(spark, sf_dir):
    return ops.frequency_problems(derived(spark, sf_dir, "atc_freqs"))


@query("SELECT apt_id, khz, count(DISTINCT (freq_id//100)%5) AS services FROM atc_freqs GROUP BY ALL HAVING count(DISTINCT (freq_id//100)%5) > 1", "atc_freqs")
def v2_shared_frequencies(spark, sf_dir):
    served = derived(spark, sf_dir, "atc_freqs").withColumn("service", F.floor(F.col("freq_id") / 100) % 5)
    return served.groupBy("apt_id", "khz").agg(F.countDistinct("service").alias("services")).filter("services > 1")


@query("WITH s AS (SELECT apt_id, (apt_id*7+(freq_id//100)%2)%5 AS service FROM atc_freqs) SELECT apt_id FROM s GROUP BY apt_id HAVING count(*) FILTER (service IN (1, 2)) > 0 AND count(*) FILTER (service=3) = 0", "atc_freqs")
def v2_ground_without_tower(spark, sf_dir):
    number = lambda test: F.sum(F.when(test, 1).otherwise(0))
    served = derived(spark, sf_dir, "atc_freqs").withColumn("service", (F.col("apt_id") * 7 + F.floor(F.col("freq_id") / 100) % 2) % 5)
    counts = served.groupBy("apt_id").agg(number(F.col("service").isin(1, 2)).alias("ground"), number(F.col("service") == 3).alias("tower"))
    return counts.filter("ground > 0 and tower = 0").select("apt_id")


@query(
    """SELECT rwy_id, 'reciprocal' AS problem FROM runways WHERE 1+(num_lo+17)%36 <> num_hi UNION ALL SELECT rwy_id, 'width' FROM runways WHERE width_m < 5 UNION ALL SELECT rwy_id, 'length' FROM runways WHERE length_m < 100""",
    "runways",
)
def v3_runway_name_rules(spark, sf_dir):
    return ops.runway_problems(derived(spark, sf_dir, "runways"))


@query(
    """WITH h AS (SELECT rwy_id, abs((num_lo*10-(rwy_id*53)%360+540)%360-180) AS off FROM runways) SELECT rwy_id, off, CASE WHEN off > 135 THEN 'reversed' ELSE 'misaligned' END AS problem FROM h WHERE off > 25""",
    "runways",
)
def v4_runway_heading_vs_name(spark, sf_dir):
    return ops.heading_problems(derived(spark, sf_dir, "runways").withColumn("heading", F.col("rwy_id") * 53 % 360))


@query(
    """WITH f AS (SELECT event_id AS flow, event_id//20 AS apt, event_id AS place, (event_id*37)%360 AS d0, (event_id*37)%360+(event_id*11)%120 AS d1, CAST((event_id*7)%40 AS DOUBLE) AS knots FROM events),
 s AS (SELECT flow, apt, place, d%360 AS deg, least(knots, 35) AS knots FROM f, LATERAL (SELECT unnest(range(d0, d1+1)) AS d)),
 c AS (SELECT a.flow, a.deg, a.knots, max(b.knots) AS before FROM s a LEFT JOIN s b ON a.apt=b.apt AND a.deg=b.deg AND b.place < a.place GROUP BY ALL)
 SELECT flow FROM c GROUP BY flow HAVING NOT bool_or(knots > coalesce(before, -1))"""
)
def v6_unreachable_flows(spark, sf_dir):
    e = F.col("event_id")
    flows = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = e * 37 % 360
    flows = flows.select(e.alias("flow"), F.floor(e / 20).alias("apt"), e.alias("place"), start.alias("from_deg"), (start + e * 11 % 120).alias("to_deg"), (e * 7 % 40).cast("double").alias("knots"))
    return ops.unreachable_flows(flows)


@query("SELECT f.freq_id FROM atc_freqs f WHERE f.apt_id NOT IN (SELECT apt_id FROM airports WHERE apt_id%9<>0)", "atc_freqs", "airports")
def v7_unknown_airport(spark, sf_dir):
    return derived(spark, sf_dir, "atc_freqs").join(derived(spark, sf_dir, "airports").filter("apt_id % 9 <> 0"), "apt_id", "left_anti").select("freq_id")


@query(
    """SELECT use_id, CASE WHEN operations=0 THEN 'operation' ELSE 'equipment' END AS problem FROM runway_uses WHERE operations=0 OR equipment=0
 UNION ALL SELECT use_id, 'frequency' FROM runway_uses u WHERE EXISTS (SELECT 1 FROM atc_freqs f WHERE f.apt_id=u.apt_id AND f.atc_type=4) AND NOT EXISTS (SELECT 1 FROM atc_freqs f WHERE f.apt_id=u.apt_id AND f.atc_type=6 AND f.khz=u.khz)""",
    "runway_uses",
    "atc_freqs",
)
def v7_runway_use_rules(spark, sf_dir):
    return ops.runway_use_problems(derived(spark, sf_dir, "runway_uses"), derived(spark, sf_dir, "atc_freqs"))


@query(
    """WITH p AS (SELECT apt_id, meta_key, meta_value AS v, CASE WHEN meta_value='' THEN NULL
 WHEN meta_key IN ('faa', 'iata', 'icao', 'local') THEN CASE WHEN (meta_key='faa' AND NOT regexp_full_match(meta_value, '[[:alnum:]]{3,5}')) OR (meta_key='iata' AND NOT regexp_full_match(meta_value, '[[:alpha:]]{3}'))
 OR (meta_key='icao' AND NOT regexp_full_match(meta_value, '[A-WYZa-wyz][[:alpha:]]{3}')) OR (meta_key='local' AND NOT regexp_full_match(meta_value, '[[:alnum:]]{3,7}')) THEN 'code' END
 WHEN meta_key='transition_alt' THEN CASE WHEN TRY_CAST(meta_value AS INTEGER) IS NULL OR contains(meta_value, '.') THEN 'number' WHEN CAST(meta_value AS INTEGER) < 100 OR CAST(meta_value AS INTEGER) BETWEEN 301 AND 999 THEN 'flight level' WHEN CAST(meta_value AS INTEGER) > 30000 THEN 'altitude' END
 WHEN meta_key='circuits' THEN CASE WHEN meta_value NOT IN ('0', '1') THEN 'value' END WHEN meta_key='tower_caps' THEN CASE WHEN meta_value NOT IN ('atc', 'fiso') THEN 'value' END
 WHEN meta_key='gui_label' THEN CASE WHEN meta_value NOT IN ('2D', '3D') THEN 'value' END WHEN contains(meta_value, 'http') THEN 'link' END AS problem FROM apt_metadata)
 SELECT apt_id, meta_key, problem FROM p WHERE problem IS NOT NULL""",
    "apt_metadata",
)
def v9_metadata_rules(spark, sf_dir):
    return ops.metadata_problems(derived(spark, sf_dir, "apt_metadata"))


@query("SELECT apt_id, CASE WHEN name IS NULL OR name='' THEN 'missing' WHEN length(name) > 30 THEN 'long' WHEN upper(name)=name THEN 'capitals' WHEN contains(lower(name), 'airport') THEN 'airport' ELSE 'fine' END AS problem FROM airports", "airports")
def v10_airport_name_rules(spark, sf_dir):
    return derived(spark, sf_dir, "airports").select("apt_id", ops.name_problem(F.col("name")).alias("problem"))


@query(
    """WITH b AS (SELECT apt_id, max(lon)-min(lon) AS w, max(lat)-min(lat) AS h, (max(lat)+min(lat))/2 AS mid FROM apt_parts GROUP BY apt_id)
 SELECT b.apt_id, icao FROM b JOIN airports USING (apt_id) WHERE w > 7.0/60/cos(radians(mid)) OR h > 7.0/60""",
    "apt_parts",
    "airports",
)
def v11_airport_size_limit(spark, sf_dir):
    return ops.oversized(derived(spark, sf_dir, "apt_parts"), derived(spark, sf_dir, "airports"))


@query(
    """WITH h AS (SELECT a.apt_id, a.apt_id%3 AS kind, count(*) FILTER (part_kind='runway') AS r, count(*) FILTER (part_kind='helipad') AS p, count(*) FILTER (part_kind='sealane') AS s, count(*) FILTER (part_kind='boundary') AS b,
 count(*) FILTER (part_kind='truck parking') AS tp, count(*) FILTER (part_kind='truck route') AS tr FROM airports a LEFT JOIN apt_parts USING (apt_id) GROUP BY ALL)
 SELECT apt_id, 'no runway' AS problem FROM h WHERE kind=0 AND r=0 UNION ALL SELECT apt_id, 'no helipad' FROM h WHERE kind=1 AND p=0 UNION ALL SELECT apt_id, 'no sealane' FROM h WHERE kind=2 AND s=0
 UNION ALL SELECT apt_id, 'parking without routes' FROM h WHERE tp>0 AND tr=0 UNION ALL SELECT apt_id, 'routes without parking' FROM h WHERE tr>0 AND tp=0 UNION ALL SELECT apt_id, 'no boundary' FROM h WHERE r>0 AND b=0""",
    "airports",
    "apt_parts",
)
def v12_required_parts(spark, sf_dir):
    return ops.lacking_parts(derived(spark, sf_dir, "airports").withColumn("apt_kind", F.col("apt_id") % 3), derived(spark, sf_dir, "apt_parts"))


_LAYERS = """WITH h AS (SELECT a.apt_id, count(*) FILTER (kind='taxiway') AS t, count(*) FILTER (kind='boundary') AS b, count(*) FILTER (kind='pavement') AS p FROM airports a LEFT JOIN apt_surfaces USING (apt_id) GROUP BY 1)"""


@query(
    f"""{_LAYERS} SELECT apt_id, CASE WHEN b=0 AND t=0 THEN NULL WHEN b=0 AND p=0 THEN 'new without boundary' WHEN b=0 THEN 'new-old mix' WHEN p>0 THEN 'old with boundary' WHEN t=0 THEN 'boundary only' ELSE 'new with boundary' END AS class FROM h""",
    "airports",
    "apt_surfaces",
)
def a12_airport_class_lists(spark, sf_dir):
    return ops.airport_classes(derived(spark, sf_dir, "airports"), derived(spark, sf_dir, "apt_surfaces")).select("apt_id", "class")


@query(
    f"""{_LAYERS} SELECT apt_id, CASE WHEN t=0 THEN 810 ELSE 850 END AS version, b>0 AS bounded FROM h WHERE (t=0)=(b>0)""",
    "airports",
    "apt_surfaces",
)
def a13_airport_filter(spark, sf_dir):
    """Two of the four filters: version 810 with a boundary, and 850 without."""
    classes = ops.airport_classes(derived(spark, sf_dir, "airports"), derived(spark, sf_dir, "apt_surfaces"))
    found = lambda version, bounded: ops.airports_of_version(classes, version, bounded).select("apt_id", F.lit(version).alias("version"), F.lit(bounded).alias("bounded"))
    return found(810, True).union(found(850, False))


@query(
    """WITH p AS (SELECT apt_id, lon, lat FROM airports UNION ALL SELECT freq_id%100, lon, lat FROM atc_freqs JOIN obstacles ON obs_id=freq_id)
 SELECT apt_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM p GROUP BY apt_id""",
    "airports",
    "atc_freqs",
    "obstacles",
)
def a14_airport_bounds(spark, sf_dir):
    parts = derived(spark, sf_dir, "atc_freqs").select("apt_id", F.col("freq_id").alias("obs_id")).join(derived(spark, sf_dir, "obstacles"), "obs_id").select("apt_id", "lon", "lat")
    points = derived(spark, sf_dir, "airports").select("apt_id", "lon", "lat").union(parts)
    return points.groupBy("apt_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query(
    """SELECT o_custkey AS apt_id, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS scenery_id FROM orders GROUP BY 1""",
)
def k4_recommended_version(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))
    return orders.withColumn("n", F.row_number().over(best)).filter("n = 1").select(F.col("o_custkey").alias("apt_id"), F.col("o_orderkey").alias("scenery_id"))


@query("SELECT icao, name FROM airports WHERE contains(upper(icao), 'K00') OR contains(upper(name), '7') OR contains(upper(icao), '7')", "airports")
def p17_airport_text_filter(spark, sf_dir):
    return ops.text_filter(derived(spark, sf_dir, "airports"), "k00 7", "icao", "name").select("icao", "name")


@query("SELECT apt_id, CASE WHEN lon < -120 THEN CASE WHEN lat < 34 THEN 'SW' ELSE 'NW' END ELSE CASE WHEN lat < 34 THEN 'SE' ELSE 'NE' END END AS part, abs(lon+120) < 0.1 OR abs(lat-34) < 0.1 AS near_border FROM airports", "airports")
def p18_hemisphere_split(spark, sf_dir):
    part = F.concat(F.when(F.col("lat") < 34, "S").otherwise("N"), F.when(F.col("lon") < -120, "W").otherwise("E"))
    near = (F.abs(F.col("lon") + 120) < 0.1) | (F.abs(F.col("lat") - 34) < 0.1)
    return derived(spark, sf_dir, "airports").select("apt_id", part.alias("part"), near.alias("near_border"))


@query(
    """WITH m AS (SELECT n.n_nationkey, k.code, count(*) OVER (PARTITION BY n.n_nationkey) AS c FROM nation n JOIN (VALUES ('ION_3', 'THR'), ('_20', 'TWE'), ('N_2', 'TWO'), ('_1', 'ONE'), ('ION_11', 'ELE')) k(part, code) ON contains(upper(n.n_name), k.part))
 SELECT n_nationkey AS nation, max(code) AS iso FROM m WHERE c=1 GROUP BY 1"""
)
def p19_country_to_iso3(spark, sf_dir):
    table = [("ION_3", "THR"), ("_20", "TWE"), ("N_2", "TWO"), ("_1", "ONE"), ("ION_11", "ELE")]
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"))
    return ops.country_codes(nation, spark.createDataFrame(table, "part string, code string"))


@query("SELECT apt_id, coalesce(nullif(CASE WHEN apt_id%3=0 THEN '' ELSE name END, ''), n_name) AS name FROM airports LEFT JOIN nation ON n_nationkey=region", "airports")
def j13_metadata_fill_defaults(spark, sf_dir):
    airports = derived(spark, sf_dir, "airports").withColumn("name", F.when(F.col("apt_id") % 3 == 0, "").otherwise(F.col("name")))
    defaults = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("fallback"))
    return airports.join(defaults, "region", "left").select("apt_id", F.coalesce(F.nullif("name", F.lit("")), "fallback").alias("name"))


@query(
    """WITH need AS (SELECT apt_id, num_lo FROM runways WHERE rwy_id%2=0), have AS (SELECT apt_id, num_lo FROM runways WHERE rwy_id%3=0) SELECT DISTINCT apt_id, num_lo FROM need EXCEPT SELECT apt_id, num_lo FROM have""",
    "runways",
)
def j14_missing_runways(spark, sf_dir):
    runways = derived(spark, sf_dir, "runways")
    need = runways.filter("rwy_id % 2 = 0").select("apt_id", "num_lo").distinct()
    return need.join(runways.filter("rwy_id % 3 = 0"), ["apt_id", "num_lo"], "left_anti")


@query("SELECT apt_id, name FROM airports WHERE apt_id%4 <> 0 UNION ALL SELECT apt_id, 'renewed' FROM airports WHERE apt_id%4=0", "airports")
def j15_dedupe_airports_by_id(spark, sf_dir):
    old = derived(spark, sf_dir, "airports").select("apt_id", "name")
    return ops.later_wins(old, old.filter("apt_id % 4 = 0").withColumn("name", F.lit("renewed")), "apt_id")


@query(
    """WITH p AS (SELECT edge_id, width_class AS w, taxi_name AS n, sqrt(dx*dx+dy*dy) AS len FROM taxi_edges)
 SELECT edge_id, 'short' AS problem FROM p WHERE len < CASE WHEN w IN (0, 1) THEN 7 WHEN w=2 THEN 10 WHEN w=6 THEN 5 ELSE 20 END
 UNION ALL SELECT edge_id, CASE WHEN length(n) > 3 THEN 'long name' ELSE 'odd name' END FROM p WHERE w<>6 AND n<>'' AND (length(n) > 3 OR NOT regexp_full_match(n, '[[:alpha:]]|[[:alpha:]][[:alnum:]]|[[:alpha:]][[:alnum:]][[:digit:]]'))""",
    "taxi_edges",
)
def v14_taxi_edge_rules(spark, sf_dir):
    return ops.taxi_edge_problems(derived(spark, sf_dir, "taxi_edges"))


@query(
    """WITH r AS (SELECT *, CASE WHEN width_class >= 4 THEN 6000*0.3048 WHEN width_class >= 2 THEN 3000*0.3048 ELSE 0 END AS l, CASE WHEN width_class >= 4 THEN 100*0.3048 WHEN width_class >= 2 THEN 70*0.3048 ELSE 0 END AS w, ' ' || lower(trim(airlines)) AS p FROM ramps),
 g AS (SELECT ramp_id, k, substr(p, 4*k+1, 4) AS g FROM r, LATERAL (SELECT unnest(range(length(p)//4)) AS k) WHERE length(p)%4=0 AND length(p) <= 100),
 c AS (SELECT ramp_id, k, CASE WHEN g[1]<>' ' THEN 'no space' WHEN regexp_extract(g[2:4], '[^a-z]')=' ' THEN 'not in threes' WHEN regexp_extract(g[2:4], '[^a-z]')<>'' THEN 'not letters' END AS problem FROM g),
 s AS (SELECT ramp_id, max(k) FILTER (problem IN ('no space', 'not in threes')) AS stop FROM c GROUP BY 1)
 SELECT ramp_id, 'equipment' AS problem FROM r WHERE equipment=0 UNION ALL SELECT ramp_id, 'airlines or operation' FROM r WHERE ramp_type IN ('misc', 'hangar') AND (airlines<>'' OR op_type<>0)
 UNION ALL SELECT ramp_id, 'too large' FROM r WHERE ramp_type IN ('gate', 'tie-down') AND NOT EXISTS (SELECT 1 FROM placed_runways q WHERE q.apt_id=r.apt_id AND (width_class < 2 OR rwy_id%3<>0) AND length_m >= l AND width_m >= w)
 UNION ALL SELECT ramp_id, CASE WHEN length(p) < 4 THEN 'no airline' WHEN length(p)%4<>0 THEN 'not in threes' ELSE 'too long' END FROM r WHERE p<>' ' AND (length(p) < 4 OR length(p)%4<>0 OR length(p) > 100)
 UNION ALL SELECT DISTINCT ramp_id, problem FROM c JOIN s USING (ramp_id) WHERE problem IS NOT NULL AND k >= coalesce(stop, 0)""",
    "ramps",
    "placed_runways",
)
def v8_ramp_rules(spark, sf_dir):
    runways = derived(spark, sf_dir, "placed_runways").withColumn("paved", F.col("rwy_id") % 3 != 0)
    return ops.ramp_problems(derived(spark, sf_dir, "ramps"), runways)


_FLOWS = ("flows", "wind_rules", "time_rules", "flow_uses")


@query(
    """WITH t AS (SELECT apt_id, name FROM flows WHERE name<>'' GROUP BY ALL HAVING count(*) > 1), f AS (SELECT * FROM flows WHERE apt_id NOT IN (SELECT apt_id FROM t)),
 g AS (SELECT DISTINCT apt_id, unnest([num_lo, num_hi]) AS number FROM runways),
 o AS (SELECT DISTINCT a.flow_id, a.arrivals AND b.arrivals AS lands, a.departures AND b.departures AS leaves FROM flow_uses a JOIN flow_uses b ON a.flow_id=b.flow_id AND a.number=(CASE WHEN b.number > 18 THEN b.number-18 ELSE b.number+18 END) AND a.side=translate(b.side, 'LR', 'RL'))
 SELECT apt_id, 'flow' AS object, flow_id AS id, 'same name' AS problem FROM flows JOIN t USING (apt_id, name)
 UNION ALL SELECT apt_id, 'flow', flow_id, 'no station' FROM f WHERE icao='' UNION ALL SELECT apt_id, 'flow', flow_id, 'negative' FROM f WHERE visibility < 0 OR ceiling < 0 UNION ALL SELECT apt_id, 'flow', flow_id, 'high visibility' FROM f WHERE visibility > 20
 UNION ALL SELECT apt_id, 'flow', flow_id, 'high ceiling' FROM f WHERE ceiling > 10000 UNION ALL SELECT apt_id, 'flow', flow_id, 'no name' FROM f WHERE name='' UNION ALL SELECT apt_id, 'flow', flow_id, 'unknown pattern' FROM f WHERE (apt_id, pattern) NOT IN (SELECT apt_id, number FROM g)
 UNION ALL SELECT apt_id, 'wind rule', rule_id, 'no station' FROM wind_rules w JOIN f USING (flow_id) WHERE w.icao='' UNION ALL SELECT apt_id, 'wind rule', rule_id, 'directions' FROM wind_rules JOIN f USING (flow_id) WHERE from_deg NOT BETWEEN 0 AND 359 OR to_deg NOT BETWEEN 0 AND 360 OR from_deg=to_deg
 UNION ALL SELECT apt_id, 'wind rule', rule_id, 'speed' FROM wind_rules JOIN f USING (flow_id) WHERE knots NOT BETWEEN 1 AND 999
 UNION ALL SELECT apt_id, 'time rule', rule_id, 'times' FROM time_rules JOIN f USING (flow_id) WHERE start NOT BETWEEN 0 AND 2359 OR stop NOT BETWEEN 0 AND 2400 OR start=stop OR start%100 > 59 OR stop%100 > 59
 UNION ALL SELECT apt_id, 'time rule', rule_id, 'short' FROM time_rules JOIN f USING (flow_id) WHERE CASE WHEN start < stop THEN stop ELSE stop+2400 END-start < 100
 UNION ALL SELECT apt_id, 'runways', flow_id, 'opposite arrivals' FROM f WHERE flow_id IN (SELECT flow_id FROM o WHERE lands) UNION ALL SELECT apt_id, 'runways', flow_id, 'opposite departures' FROM f WHERE flow_id IN (SELECT flow_id FROM o WHERE leaves)
 UNION ALL SELECT apt_id, 'runways', flow_id, 'no arrival or departure' FROM f WHERE flow_id NOT IN (SELECT flow_id FROM flow_uses WHERE arrivals) OR flow_id NOT IN (SELECT flow_id FROM flow_uses WHERE departures)""",
    *_FLOWS,
    "runways",
)
def v5_flow_rules(spark, sf_dir):
    both = derived(spark, sf_dir, "runways").select("apt_id", F.explode(F.array("num_lo", "num_hi")).alias("number"))
    return ops.flow_problems(*(derived(spark, sf_dir, t) for t in _FLOWS), both)
