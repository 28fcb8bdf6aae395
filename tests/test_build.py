"""The national build over a micro-archive, against results worked out by hand."""

import zipfile

from pyspark.sql import functions as F

from viaduct.operators import build

STOPS = """stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station
S-87000001,Alpha Gare,48.0,2.0,1,
S-b,Beta,48.0,2.02,1,
S-c,Gamma,48.0,2.04,1,
S-d,Delta,48.0,2.15,1,
S-e,Far,48.5,2.9,1,
S-f,Never served,48.5,2.9,1,
"""
TRIPS = "route_id,trip_id,service_id,trip_headsign,shape_id\nr,t1,s,x,sh\nr,t2,s,x,\nr,t3,s,x,\nr,t4,s,x,sh\n"
TIMES = """trip_id,arrival_time,departure_time,stop_id,stop_sequence
t1,08:00:00,08:00:00,S-87000001,1
t1,08:20:00,08:21:00,S-b,2
t1,08:40:00,08:41:00,S-c,3
t2,09:00:00,09:00:00,S-c,1
t2,09:01:00,09:01:00,S-e,2
t3,10:00:00,10:00:00,S-c,1
t3,10:30:00,10:30:00,S-d,2
t4,11:00:00,11:00:00,S-87000001,1
t4,11:18:30,11:18:30,S-b,2
t4,11:40:00,11:40:00,S-c,3
"""
SHAPES = "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n" + "".join(f"sh,{48 + (0.002 if i % 2 else 0)},{2 + i / 100},{i}\n" for i in range(7))
REFERENCES = """nom,position_geographique,codeinsee,codes_uic,id,segment_drg
Alphaville,"48.0, 2.001",11111,87000001,R1,A
Beta,"48.001, 2.02",75112,,R2,B
Beta,"49.0, 2.02",22222,,R3,A
"""


def made(spark, tmp_path, **kw):
    with zipfile.ZipFile(tmp_path / "gtfs.zip", "w") as z:
        for name, body in (("stops.txt", STOPS), ("routes.txt", "route_id,route_type\nr,2\n"), ("trips.txt", TRIPS), ("stop_times.txt", TIMES), ("shapes.txt", SHAPES)):
            z.writestr(f"feed/{name}", body)
    (tmp_path / "stations.csv").write_text(REFERENCES)
    # a track from Alpha to Beta, and one from Beta to Gamma that goes round by the north
    tracks = [(1, 0, 48.001, 2.0), (1, 1, 48.001, 2.02), (2, 0, 48.001, 2.02), (2, 1, 48.06, 2.03), (2, 2, 48.001, 2.04)]
    rail = spark.createDataFrame(tracks, "line long, i int, lat double, lon double")
    return build.national_build(spark, str(tmp_path / "gtfs.zip"), str(tmp_path / "stations.csv"), "sncf-fr-gtfs", rail, **kw)


def test_national_build(spark, tmp_path):
    out = made(spark, tmp_path, overrides=spark.createDataFrame([("S-d", "delta-city")], "raw_id string, target string"))
    found = {r.k: (r.strategy, r.confidence, r.r) for r in out["mappings"].collect()}
    assert found == {"S-87000001": ("reference_uic", 100, "R1"), "S-b": ("reference_name", 80, "R2"), "S-c": ("fallback_reference_gap", 50, None), "S-d": ("manual_override", 100, None), "S-e": ("fallback_reference_gap", 50, None)}
    cities = {r.display_name: (r.city, r.country, r.stations) for r in out["cities"].collect()}
    assert cities["Alphaville"] == ("alphaville-fr-11111", "FR", 1) and cities["Beta"] == ("beta-fr-75056", "FR", 1) and cities["Delta"] == ("delta-city", "FR", 1)
    gamma, far = cities["Gamma"][0], cities["Far"][0]
    assert gamma.startswith("gamma-") and cities["Gamma"][1] == "ZZ"
    assert {(r.alias, r.city) for r in out["aliases"].collect()} >= {("alpha gare", "alphaville-fr-11111"), ("alphaville", "alphaville-fr-11111"), ("gamma", gamma)}
    edges = {(r.from_city, r.to_city): (r.duration_min, r.confidence) for r in out["edges"].collect()}
    assert edges == {("alphaville-fr-11111", "beta-fr-75056"): (19, 80), ("beta-fr-75056", gamma): (19, 50), (gamma, "delta-city"): (30, 50)}
    lines = {r.edge.split("->")[0].split("-")[0]: r for r in out["geometries"].collect()}
    # the rail is preferred where its length is plausible, a detour by the north isn't and gives way to the shape
    assert lines["alphaville"].geometry == "rail" and 1_480 < lines["alphaville"].metres < 1_560
    assert lines["beta"].geometry == "shape" and 1_500 < lines["beta"].metres < 1_620 and lines["beta"].points == 3
    assert lines["gamma"].geometry == "straight" and lines["gamma"].points == 2 and 8_100 < lines["gamma"].metres < 8_250
    issues = {(r.issue, r.entity) for r in out["issues"].collect()}
    assert issues == {("no_reference", "S-c"), ("no_reference", "S-e"), ("impossible_edge", f"{gamma}->{far}")}
    assert {tuple(r.stops): r.trip_count for r in out["patterns"].collect()} == {("S-87000001", "S-b", "S-c"): 2, ("S-c", "S-e"): 1, ("S-c", "S-d"): 1}
    assert {r.measure: r.value for r in out["summary"].collect()} == {"references": 3, "stations": 5, "matched": 2, "cities": 5, "edges": 3, "patterns": 3, "duplicates": 0, "issues": 3}


def test_segment_priorities(spark):
    rows = spark.createDataFrame([("A",), (" b",), ("C",), ("z",), ("",), (None,)], "s string")
    assert [r.p for r in rows.select(build.segment_priority(F.col("s")).alias("p")).collect()] == [4, 3, 2, 1, 1, 0]
