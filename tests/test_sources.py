"""Readers on short literal texts."""

import json

from tessera.sources import gateway, text


def lines(spark, body, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(body.split("\n"))], "file string, line_no int, line string")


def obstacle(name, freq, agl, msl):
    row = [" "] * 84
    for at, what in ((29, "34 30 00.00N"), (43, "118 15 36.00W"), (58, name), (68, freq), (73, agl), (78, msl)):
        row[at : at + len(what)] = what
    return "".join(row)


def test_obstacles(spark):
    body = "\n".join(["head", obstacle("TOWER", "", "1", "2"), "-----", obstacle("STACK", "", "00100", "001000"), obstacle("TOWER", "101.1", "00010", ""), obstacle("WHATEVER", "", "", ""), obstacle("RIG", "", "", ""), obstacle("CRANE T", "", "", ""), "short"])
    got = text.parse_obstacles(lines(spark, body)).orderBy("line_no").collect()
    assert [r.kind for r in got] == [text.FEATURES.index("smokestack"), 0, 0, None, text.FEATURES.index("crane")]
    assert abs(got[0].lon + 118.26) < 1e-9 and abs(got[0].lat - 34.5) < 1e-9 and abs(got[0].agl - 30.48) < 1e-9 and abs(got[0].msl - 304.8) < 1e-9
    assert got[1].freq == "101.1" and got[1].msl is None and got[2].agl is None


def test_radar(spark):
    def row(*parts):
        line = [" "] * 96
        for at, what in parts:
            line[at : at + len(what)] = what
        return "".join(line)

    near = row((20, "0050"), (46, "34 30 36.5N"), (59, "118 15 36.0W"), (71, "001200"))
    far = row((59, "34-30-36.5S"), (71, "118-15-36.0E"), (85, "004000"))
    heads = "title\n____\nnames\n____\n"
    got = text.parse_radar(lines(spark, heads + near + "\n" + row((20, "9"))), True).collect()
    assert [(r.kind, round(r.lon, 6), round(r.lat, 6), r.agl, r.msl) for r in got] == [("approach radar", -118.26, round(34.5 + 36.5 / 3600, 6), 50, 1250)]
    got = text.parse_radar(lines(spark, heads + far + "\nshort"), False).collect()
    assert [(r.kind, round(r.lon, 6), round(r.lat, 6), r.agl, r.msl) for r in got] == [("route radar", 118.26, round(-34.5 - 36.5 / 3600, 6), None, 4000)]
    assert text.parse_radar(lines(spark, near), True).count() == 0


def test_nav_points(spark):
    body = "2 50.5 8.25 rest\n18 51.0 9.0 2\n18 51.0 9.0 4\n19 52.0 10.0 1\n77 1 1\n\nI"
    assert [(r.kind, r.lon, r.lat) for r in text.parse_nav_points(lines(spark, body)).orderBy("line_no").collect()] == [("ndb", 8.25, 50.5), ("light beacon", 9.0, 51.0), ("windsock", 10.0, 52.0)]


def test_degree_obstacles_round_trip(spark, tmp_path):
    rows = [(8.5, 50.25, 100.0, None, 3), (-0.5, -0.5, None, 7.0, 1)]
    df = spark.createDataFrame([*rows, (1.0, 1.0, 1.0, 1.0, None)], "lon double, lat double, msl double, agl double, kind int")
    text.write_degree_obstacles(df, str(tmp_path / "o"))
    got = text.read_degree_obstacles(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, got.select("lon", "lat", "msl", "agl", "kind").collect())) == sorted(rows)


def test_airport_lines_belong_to_the_last_header(spark):
    body = "I\n1000 Version\n\n1 328 0 0 KAAA First Field\n50 12345 ATIS here\n1053 118100 TOWER\n16 0 0 0 WBBB\n99\n1 1 0 0 KZZZ Behind the end"
    rows = text.attach_to_airports(lines(spark, body))
    heads = {r.icao: r for r in text.airports_of(rows).collect()}
    assert set(heads) == {"KAAA", "WBBB"} and heads["KAAA"].name == "First Field" and heads["WBBB"].kind == "seaport" and abs(heads["KAAA"].elevation_m - 99.9744) < 1e-9
    assert sorted((r.icao, r.code, r.khz, r.name) for r in text.frequencies_of(rows).collect()) == [("KAAA", 50, 123450, "ATIS here"), ("KAAA", 53, 118100, "TOWER")]
    assert {r.icao: r.text for r in text.airport_text(rows).collect()}["KAAA"].split("\n")[2] == "1053 118100 TOWER"


def test_scenery_text(spark):
    body = "I\n800\nhead\n\nPROPERTY sim/west 12\nOBJECT_DEF a b.obj\nPOLYGON_DEF p.pol\nOBJECT_DEF c.obj\nFILTER 0\nOBJECT_MSL 1 12.5 47.5 432.0 0.0\nOBJECT 0 12.1 47.1 90\nNONSENSE 1"
    found = text.scenery_commands(lines(spark, body))
    assert [tuple(r) for r in found["properties"].collect()] == [("f", "sim/west", "12")]
    assert sorted((r.kind, r["index"], r.path) for r in found["defs"].collect()) == [("OBJECT", 0, "a b.obj"), ("OBJECT", 1, "c.obj"), ("POLYGON", 0, "p.pol")]
    assert [(r["index"], r.height, r.rotation, r.above) for r in found["objects"].orderBy("line_no").collect()] == [(1, 432.0, 0.0, "msl"), (0, None, 90.0, "")]


def test_library(spark):
    body = "A\nEXPORT lib/a.obj x/a one.obj\nPUBLIC 20300101\nEXPORT lib/b.obj b.obj\nDEPRECATED\nEXPORT_BACKUP lib/a.obj back.obj\nEXPORT_RATIO 0.5 lib/b.obj b2.obj\nEXPORT_BACKUP lib/c.obj c.obj"
    got = {r.virtual: r for r in text.resolve_library(text.library_entries(lines(spark, body), "20260101")).collect()}
    assert got["lib/a.obj"].reals == ["x/a one.obj"] and got["lib/a.obj"].status == "public"
    assert got["lib/b.obj"].reals == ["b.obj", "b2.obj"] and got["lib/b.obj"].status == "new" and got["lib/c.obj"].reals == ["c.obj"]


def test_gateway(spark):
    airports = {"airports": [{"AirportCode": "KAAA", "AirportName": "A", "AcceptedSceneryCount": 1, "metadata": {"icao_code": "KAAA", "faa_code": "AAB"}}, {"AirportCode": "KBBB", "AcceptedSceneryCount": -1}]}
    got = gateway.gateway_airports(spark.createDataFrame([(json.dumps(airports),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("KAAA", "A", "KAAA AAB")]
    zero = gateway.ZERO_DATE
    versions = {"airport": {"icao": "KAAA", "recommendedSceneryId": 2, "scenery": [{"sceneryId": 1, "dateAccepted": zero, "dateApproved": zero}, {"sceneryId": 2, "dateAccepted": "2020", "dateApproved": zero}, {"sceneryId": 3, "userName": "u", "dateApproved": "2021"}]}}
    got = gateway.gateway_versions(spark.createDataFrame([(json.dumps(versions),)], "value string")).orderBy("scenery_id").collect()
    assert [(r.scenery_id, r.user, r.accepted, r.approved, r.recommended) for r in got] == [(2, "", "2020", None, True), (3, "u", None, "2021", False)]


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('icao,city,state\nKAAA,"New, York",NY\nKBBB,X\n')
    assert sorted(map(tuple, gateway.read_metadata_csv(spark, str(tmp_path / "m.csv")).collect())) == [("KAAA", "New, York", "NY"), ("KBBB", "X", "")]
