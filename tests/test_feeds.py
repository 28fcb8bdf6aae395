"""Archives, lists and geometry files made by the tests."""

import json
import sqlite3
import struct
import zipfile

import pytest

from viaduct.sources import feeds

STOPS = """stop_id , stop_name,stop_lat,stop_lon,location_type,parent_station
S1,Lyon Part Dieu,45.76,4.86,1,
P1,Quai 1,45.76,4.86,0,S1
P1b, Quai 2,45.761,4.861,0, S1
S2,Lyon Perrache,45.75,4.83,1,
S3,Dijon,47.32,5.03,1,
S4,Bus 12,47.0,5.0,1,
S5,Autun,46.95,4.3,1,
S3,Dijon again,1,1,1,
"""
ROUTES = "route_id,route_type\nr1,2\nr2,3\nr3,101\n"
TRIPS = "route_id,trip_id,service_id,trip_headsign,shape_id\nr1,t1,s,x,sh1\nr2,t2,s,x,\nr3,t3,s,x,\nr1,t4,s,x,\nr1,t1,s,y, \n"
TIMES = """trip_id,arrival_time,departure_time,stop_id,stop_sequence
t1,23:50:00,23:55:00,P1,1
t1,25:30:10,25:31:00,S3,2
t1,25:40:00,25:40:00,S4,3
t2,08:00:00,08:00:00,S3,1
t2,08:10:00,08:10:00,S5,2
t3,10:00:00,10:00:00,S3,5
t3,09:00:00,09:00:00,S2,3
t3,11:20:00,11:20:00,P1b,6
t4,08:00:00,08:00:00,S5,1
t4,08:05:00,08:05:00,StopPoint:OCECar-1,2
t4,08:30:00,08:30:00,S3,3
"""


def archive(path, root=""):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in (("stops.txt", "﻿" + STOPS), ("routes.txt", ROUTES), ("trips.txt", TRIPS), ("stop_times.txt", TIMES)):
            z.writestr(root + name, body)
    return str(path)


@pytest.mark.parametrize("root", ["", "feed/2024/"])
def test_a_build_from_an_archive(spark, tmp_path, root):
    path = archive(tmp_path / "gtfs.zip", root)
    all_, stop_of = feeds.stations(spark, path)
    assert {r.k: r.name for r in all_.collect()} == {"S1": "Lyon Part Dieu", "S2": "Lyon Perrache", "S3": "Dijon", "S5": "Autun"}
    assert {r.stop_id: r.k for r in stop_of.collect()} == {"S1": "S1", "P1": "S1", "P1b": "S1", "S2": "S2", "S3": "S3", "S4": "S4", "S5": "S5"}
    assert {r.trip_id: r.shape_id for r in feeds.trips(spark, path, "sncf-fr-gtfs").collect()} == {"t1": None, "t3": None}
    made = feeds.city_edges(spark, path, "sncf-fr-gtfs", "FR")
    assert {r.city: (r.display_name, r.stations) for r in made["cities"].collect()} == {"gtfs-basic-fr-lyon-0": ("Lyon", 2), "gtfs-basic-fr-dijon-0": ("Dijon", 1)}
    # past midnight, and a stop out of order is skipped but still the next one's predecessor
    assert {(r.from_city, r.to_city): r.duration_min for r in made["edges"].collect()} == {("gtfs-basic-fr-lyon-0", "gtfs-basic-fr-dijon-0"): 96}


def test_a_missing_member(spark, tmp_path):
    path = archive(tmp_path / "gtfs.zip")
    assert feeds.read_member(spark, path, "shapes.txt", ["shape_id"], optional=True).count() == 0
    with pytest.raises(Exception, match="no shapes.txt"):
        feeds.read_member(spark, path, "shapes.txt", ["shape_id"]).collect()


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_members_are_read_in_ranges(spark, tmp_path, split):
    body = 'id , note,x\r\n1,"two\nlines ""and"" quotes",a\n2,plain,b\n\n3,"é, ü\n\n",c\n4,"last"'
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("deep/down/t.txt", "\ufeff" + body)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("t.txt", "x,id\nq,9\n")
    got = feeds.read_member(spark, str(tmp_path), "t.txt", ["id", "note", "x", "none"], split=split)
    rows = sorted((r.archive[-5:], r.pos, r.id, r.note, r.x, r.none) for r in got.collect())
    want = [("a.zip", 0, "1", 'two\nlines "and" quotes', "a", None), ("a.zip", 1, "2", "plain", "b", None), ("a.zip", 3, "3", "é, ü", "c", None), ("a.zip", 4, "4", "last", None, None), ("b.zip", 0, "9", None, "q", None)]
    assert rows == want and (split > 64 or got.rdd.getNumPartitions() > 2)


def test_station_list(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('﻿NOM, Position_Geographique ,CodeINSEE,codes_uic,id\nParis,"48.8, 2.3",75112,"0087686006;87686006;12",7\n,"1,2",1,1,8\nLost,nowhere,1,1,9\nShort,"1.5,2"\n', encoding="utf-8")
    got = {r.name: r for r in feeds.station_list(spark, str(path)).collect()}
    assert set(got) == {"Paris", "Short"} and got["Paris"].codes == ["0087686006", "87686006"] and (got["Paris"].lat, got["Paris"].lon) == (48.8, 2.3)
    (paris,) = feeds.station_list(spark, str(path), least=1, normalise=True).where("id = '7'").collect()
    assert paris.codes == ["0087686006", "87686006", "12"] and paris.insee == "75056"
    path.write_text("nom,id\na,1\n")
    with pytest.raises(ValueError, match="position_geographique"):
        feeds.station_list(spark, str(path))


def wkb(lines, order):
    one = lambda p: struct.pack(f"{order}bII", int(order == "<"), 2, len(p)) + b"".join(struct.pack(f"{order}dd", x, y) for y, x in p)
    return one(lines[0]) if len(lines) == 1 else struct.pack(f"{order}bII", int(order == "<"), 5, len(lines)) + b"".join(map(one, lines))


LINES = [[(48.0, 2.0), (48.1, 2.1)], [(49.0, 3.0), (49.5, 3.5), (49.6, 3.6)]]


@pytest.mark.parametrize("order", ["<", ">"])
def test_wkb(order):
    assert feeds.wkb_lines(wkb(LINES, order)) == LINES and feeds.wkb_lines(wkb(LINES[:1], order)) == LINES[:1]
    for bad in (b"\x02" + wkb(LINES, "<")[1:], struct.pack("<bII", 1, 3, 0)):
        with pytest.raises(ValueError):
            feeds.wkb_lines(bad)


def test_geopackage_and_geojson(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "rail.gpkg")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
    db.executemany("INSERT INTO gpkg_contents VALUES (?)", [("gis_osm_railways_free_2",), ("gis_osm_railways_free",), ("roads",)])
    db.execute("CREATE TABLE gis_osm_railways_free (geom BLOB, fclass TEXT)")
    head = lambda code: b"GP\x00" + bytes([code << 1]) + b"\0" * (4 + {0: 0, 1: 32, 2: 48}[code])
    db.executemany("INSERT INTO gis_osm_railways_free VALUES (?, ?)", [(head(0) + wkb(LINES, "<"), "rail"), (head(1) + wkb(LINES[:1], ">"), "narrow_gauge"), (head(2) + wkb(LINES, "<"), "tram")])
    db.commit()
    db.close()
    assert feeds.geopackage_lines(spark, str(tmp_path / "rail.gpkg"), split=1).collect() == feeds.geopackage_lines(spark, str(tmp_path / "rail.gpkg")).collect()
    rows = feeds.geopackage_lines(spark, str(tmp_path / "rail.gpkg")).collect()
    assert sorted((r.i, r.lat, r.lon) for r in rows) == sorted([(i, *p) for line in LINES for i, p in enumerate(line)] + [(i, *p) for i, p in enumerate(LINES[0])])
    shape = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    flip = [[[x, y] for y, x in line] for line in LINES]
    (tmp_path / "rfn.geojson").write_text(json.dumps({"features": [shape("LineString", flip[0], mnemo="EXPLOITE"), shape("MultiLineString", flip), shape("LineString", flip[1], mnemo="FERME"), shape("Point", [1, 2])]}))
    rows = feeds.geojson_lines(spark, str(tmp_path / "rfn.geojson")).collect()
    assert len({r.line for r in rows}) == 3 and sorted((r.lat, r.lon) for r in rows) == sorted([p for line in LINES for p in line] + LINES[0])


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "k long, v string")
    feeds.write_document(df, str(tmp_path / "doc"))
    assert sorted(map(tuple, feeds.read_document(spark, str(tmp_path / "doc"), "k long, v string").collect())) == [(1, None), (2, "é")]
    with pytest.raises(Exception, match="MALFORMED|parse"):
        feeds.read_document(spark, str(tmp_path / "doc"), "k struct<x:int>").collect()


def test_payloads_agree_with_their_manifest(spark, tmp_path):
    from viaduct.sources import runtime

    rows = spark.createDataFrame([(str(i), "rail", [str(i)], i, f"c{i % 2}") for i in range(7)], "id string, mode string, stops array<string>, tripCount long, part string")
    runtime.write_payloads(rows, "service_patterns", str(tmp_path / "p"), "part", 2)
    got = runtime.load_payloads(spark, "service_patterns", str(tmp_path / "p"))
    assert sorted((r.chunk, r.id, r.tripCount) for r in got.collect()) == sorted((f"c{i % 2}", str(i), i) for i in range(7))
    one = spark.createDataFrame([("c1",)], "chunk string")
    assert runtime.load_payloads(spark, "service_patterns", str(tmp_path / "p"), one).count() == 3
    spark.createDataFrame([("c1", '{"patterns": [{"id": "9"}]}')], "chunk string, payload string").write.mode("append").json(str(tmp_path / "p" / "chunks"))
    with pytest.raises(ValueError, match="disagree"):
        runtime.load_payloads(spark, "service_patterns", str(tmp_path / "p"))
    spark.createDataFrame([("c1", '{"places": []}')], "chunk string, payload string").write.mode("append").json(str(tmp_path / "p" / "chunks"))
    with pytest.raises(Exception, match="no records"):
        runtime.load_payloads(spark, "service_patterns", str(tmp_path / "p"), one).collect()
