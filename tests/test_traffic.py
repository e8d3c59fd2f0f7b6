"""Traffic metrics, the spatial join, the example shapes of maps."""

import math

from pyspark.sql import functions as F

from roadlens.operators import spatial, traffic
from roadlens.sources import opendrive


def samples(spark, rows, extra=""):
    return spark.createDataFrame(rows, "scene string, frame int, id long, x double, y double, vx double, vy double" + extra)


def test_cleaning(spark):
    parked = [("s", f, 1, 0.1 * f / 9 * 1.9 * 10, 0.0, 0.0, 0.0) for f in range(10)]
    queued = [("s", f, 2, 2.1 * f / 9, 0.0, 0.1, 0.0) for f in range(10)]
    short = [("s", f, 3, 10.0 * f, 0.0, 1.0, 0.0) for f in range(4)]
    fast = [("s", f, 4, 30.0 * f, 0.0, 56.0 if f == 3 else 20.0, math.nan if f == 0 else 0.0) for f in range(10)]
    out = traffic.clean_tracks(samples(spark, parked + queued + short + fast), hz=10.0)
    kept = {r.id: r.n for r in out.where("keep").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert kept == {2: 10, 4: 9}
    r = traffic.cleaning_report(out).first()
    assert (r.n_objects, r.n_static, r.n_short_tracks, r.n_teleport_samples) == (4, 1, 1, 1)


def square(i, a, b, c, d):
    return (i, [{"x": x, "y": y} for x, y in ((a, b), (c, b), (c, d), (a, d))])


def test_points_in_polygons(spark):
    lanes = spark.createDataFrame([square(0, 0.0, 0.0, 10.0, 10.0), square(1, 10.0, 0.0, 20.0, 10.0), square(2, 5.0, 5.0, 15.0, 15.0)], "lane_idx int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 10.0, 1.0), (3, 6.0, 6.0), (4, 14.0, 14.0), (5, 30.0, 1.0), (6, 12.0, 2.0)], "k int, x double, y double")
    got = {r.k: r.lane_idx for r in spatial.assign_lanes(pts, lanes, 4.0).collect()}
    assert got == {1: 0, 2: None, 3: 0, 4: 2, 5: None, 6: 1}
    assert spatial.in_areas(pts, lanes.where("lane_idx = 9")).where("parking").count() == 0
    assert lanes.select(F.sum(spatial.ring_area())).first()[0] == 300.0
    assert abs(spatial.union_area(lanes, 0.5).first()[0] - 250.0) < 1e-6


def test_turning_movements_keep_the_gap_rule(spark):
    roads = ["in", "C", "", "C", "out"]
    rows = [("s", f, 1, r) for f, r in enumerate(roads)]
    df = spark.createDataFrame(rows, "scene string, frame int, id long, road string")
    con = spark.createDataFrame([("C", "j")], "road string, junction string")
    got = {(r["from"], r["to"]) for r in traffic.turning_movements(df, con, 1.0).collect()}
    assert got == {("in", "C"), ("C", "out")}
    got = {(r["from"], r["to"]) for r in traffic.turning_movements(df, con, None, collapse_gaps=True).collect()}
    assert got == {("in", "out")}


def ring(spark, sign):
    rows = [("s", f, i, sign * (f * 0.2 + i)) for i in (1, 2) for f in range(40)]
    df = spark.createDataFrame(rows, "scene string, frame int, id long, a double")
    return df.select("scene", "frame", "id", F.atan2(F.sin("a"), F.cos("a")).alias("phi"))


def test_ring(spark):
    arms = spark.createDataFrame([("n", 1.5), ("w", 3.1)], "road string, theta double")
    for sign in (1, -1):
        assert traffic.circulating_direction(ring(spark, sign)).first().direction == sign
        got = {r.road: r.crossings for r in traffic.circulating_flow(ring(spark, sign), arms, 1.0).collect()}
        assert got["n"] in (2, 3) and got["w"] in (2, 3)


# (x, y) before, (x, y) after: half turns about (40, 50) whose sign depends on the last bits of the angles
HALF_TURNS = [
    (48.4, 64, 36.4, 44), (44.3, 54, 1.3, 14), (90.8, 94, 27.3, 39), (53.16, 56, 26.84, 44), (51.97, 71, 23.47, 21), (45.76, 54, 34.24, 46),
    (0.65, 70, 47.87, 46), (90.68, 71, 11.04, 38), (48.12, 53, 31.88, 47), (168.96, 89, 0.32, 38), (10.0, 50, 90.0, 50), (40.0, 10, 40.0, 90),
]


def test_angles_are_the_c_librarys(spark):
    from roadlens.functions.core import angle

    at = [(v - 40, k - 50.0) for x0, y0, x, y in HALF_TURNS for v, k in ((x0, y0), (x, y))] + [(math.nan, 1.0), (None, 1.0), (1.0, None)]
    got = [r.a for r in spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i int, x double, y double").select("i", angle(F.col("y"), F.col("x")).alias("a")).orderBy("i").collect()]
    assert got[:-3] == [math.atan2(y, x) for x, y in at[:-3]]
    assert math.isnan(got[-3]) and got[-2:] == [None, None]


def test_half_turns_have_the_sign_of_a_floored_remainder(spark):
    phi0, phi = 1.0303768265243125, -2.111215827065481
    df = spark.createDataFrame([("s", 0, 1, phi0), ("s", 1, 1, phi)], "scene string, frame int, id long, phi double")
    arms = spark.createDataFrame([("n", 1.5), ("e", 0.1)], "road string, theta double")
    assert (phi - phi0 + math.pi) % (2 * math.pi) - math.pi == math.pi
    assert traffic.circulating_direction(df).first().direction == 1
    assert {r.road: r.crossings for r in traffic.circulating_flow(df, arms, 1.0).collect()} == {"n": 1, "e": 0}


def test_circulating_flow_of_half_turns_matches_sql(spark, tmp_path):
    import duckdb

    from roadlens.plans import registry

    rows = [(2 * u + f, f"2024-01-01 0{f}:30:00", u, "view", float(v), f'{{"k": {k}}}') for u, (x0, y0, x, y) in enumerate(HALF_TURNS) for f, v, k in ((0, x0, y0), (1, x, y))]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    e.selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("circulating_flow", "circulating_direction"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_edie_identities(spark):
    df = samples(spark, [("s", f, 1, float(f), 0.0, 10.0, 0.0) for f in range(10)]).withColumn("speed", F.col("vx"))
    r = traffic.edie_by(df, ["scene"], 20, 0.5).first()
    assert math.isclose(r.flow_veh_per_h, r.density_veh_per_km * r.speed_km_per_h) and r.speed_km_per_h == 36.0
    frames = spark.createDataFrame([("s", 20)], "scene string, n_frames int")
    series = traffic.per_frame(df, frames)
    s = traffic.summary(series).first()
    assert series.count() == 20 and math.isclose(s["mean"] / 0.5, r.density_veh_per_km) and s["min"] == 0.0


def test_grades(spark):
    v = spark.createDataFrame([(x,) for x in (10.0, 15.0, 50.0, 50.01, 2e9)], "v double")
    assert [r[0] for r in v.select(traffic.grade(F.col("v"))).collect()] == ["A", "B", "E", "F", "F"]


XML = """<?xml version='1.0'?><OpenDRIVE xmlns="http://x">
<header><geoReference>+proj=utm +zone=33 +lat_0=57.4 +lon_0=12.0</geoReference><offset x="1" y="2" z="0" hdg="0"/></header>
%s</OpenDRIVE>"""


def road(rid, geometry, junction="-1", objects=""):
    return f"""<road id="{rid}" junction="{junction}"><planView>{geometry}</planView><lanes><laneSection s="0">
<left><lane id="1" type="driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></left><center><lane id="0" type="none"/></center>
<right><lane id="-1" type="sidewalk"><width sOffset="0" a="1" b="0" c="0" d="0"/></lane><lane id="-2" type="driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></right></laneSection></lanes>{objects}</road>"""


def test_map(spark, tmp_path):
    line = '<geometry s="0" x="0" y="0" hdg="0" length="10"><line/></geometry>'
    poly = '<geometry s="0" x="0" y="0" hdg="1.5707963267948966" length="10"><paramPoly3 aU="0" bU="10" cU="0" dU="0" aV="0" bV="0" cV="0" dV="0" pRange="normalized"/></geometry>'
    lot = '<objects><object id="1" type="parking" s="5" t="6" hdg="0"><outline><cornerLocal u="-1" v="-1"/><cornerLocal u="1" v="-1"/><cornerLocal u="1" v="1"/><cornerLocal u="-1" v="1"/></outline></object></objects>'
    path = tmp_path / "m.xodr"
    path.write_text(XML % (road("007", line, objects=lot) + road("8", poly, "3")))
    roads = opendrive.read(spark, str(path), "road", opendrive.ROAD)
    lanes = opendrive.numbered(opendrive.lanes(roads)).collect()
    assert [(r.road_id, r.lane_id) for r in lanes] == [("007", 1), ("007", -2), ("8", 1), ("8", -2)]
    assert all(math.isclose(r.length_m, 10.0) for r in lanes)
    assert {p.y for p in lanes[0].centerline} == {1.5} and {p.y for p in lanes[1].centerline} == {-2.5}
    area = opendrive.parking_areas(roads).first().ring
    assert sorted((round(p.x), round(p.y)) for p in area) == [(4, 5), (4, 7), (6, 5), (6, 7)]
    assert opendrive.read(spark, str(path), "header", opendrive.HEADER).select(opendrive.base_crs("geoReference")).first()[0] == "+proj=utm +zone=33"
    text = spark.createDataFrame([(path.read_text(),)], "xml string")
    assert opendrive.from_text(text).count() == 2


def test_roundabout(spark):
    def arc(k, n=8, r=20.0):
        a = [2 * math.pi * (k + q / 12) / n for q in range(13)]
        return [{"x": r * math.cos(t), "y": r * math.sin(t)} for t in a]

    rows = [(f"r{k}", 1, "-1", 15.0, arc(k)) for k in range(8)] + [("arm", 1, "-1", 30.0, [{"x": 22.0, "y": 0.0}, {"x": 52.0, "y": 0.0}])]
    lanes = spark.createDataFrame(rows, "road_id string, lane_id int, junction string, length_m double, centerline array<struct<x: double, y: double>>")
    roles, found, centre = opendrive.classify(lanes)
    assert found and max(map(abs, centre)) < 0.5
    assert {r.road_id: r.role for r in roles.collect()}["arm"] == "approach"
    assert abs(opendrive.approach_angles(roles, centre).first().theta) < 0.1
    _, found, _ = opendrive.classify(lanes.where("road_id in ('r0', 'arm')"))
    assert not found
