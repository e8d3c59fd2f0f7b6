"""Small recordings with results worked out by hand."""

import math

from pyspark.sql import functions as F

from roadlens.functions import taxonomies as T
from roadlens.operators import tracks

COLUMNS = "file string, msg_seq long, obj_seq int, total_nanos long, idx long, x double, y double, z double, vel_x double, vel_y double, vel_z double, acc_x double, acc_y double, acc_z double, length double, width double, height double, roll double, pitch double, yaw double, type int, subtype int, role int"
STEP = 100_000_000


def sample(t, idx, **k):
    base = dict(file="f", msg_seq=t, obj_seq=0, total_nanos=t * STEP, idx=idx, x=1.0 + t, y=2.0, z=0.5, vel_x=1.0, vel_y=0.0, vel_z=0.0, acc_x=0.0, acc_y=0.0, acc_z=0.0, length=4.0, width=2.0, height=1.5, roll=0.0, pitch=0.0, yaw=0.0, type=2, subtype=4, role=2)
    base.update(k)
    return tuple(base[c.split()[0]] for c in COLUMNS.split(", "))


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_one_missing_frame(spark):
    df = frame(spark, [sample(t, 1) for t in (0, 1, 2, 4, 5)] + [sample(t, 2) for t in range(6)])
    r = tracks.temporal_completeness(df).first()
    assert (r.n_objects, r.total_actual, r.total_expected, r.n_objects_with_gaps) == (2, 11, 12, 1)
    assert r.completeness_pct == 91.67 and not r.passes_threshold and r.inferred_hz == 10.0
    g = tracks.temporal_gaps(df).first()
    assert (g.idx, g.n_gaps, g.missing_frames) == (1, 1, 1)
    assert [tuple(x) for x in g.gaps] == [(2 * STEP, 2 * STEP, 1)]


def test_repeats_after_the_first_count(spark):
    r = tracks.duplicate_rate(frame(spark, [sample(0, 1)] * 3 + [sample(1, 1)])).first()
    assert (r.total_records, r.duplicate_records, r.duplicate_rate_pct) == (4, 2, 50.0)


def test_missing_and_zero(spark):
    df = frame(spark, [sample(0, 1, x=math.nan), sample(1, 1, y=None), sample(2, 1, width=0.0), sample(3, 1)])
    r = tracks.record_completeness(df).first()
    assert (r.complete_records, r.completeness_pct, r.missing_x, r.missing_y, r.missing_width) == (2, 50.0, 0.25, 0.25, 0.0)
    d = tracks.default_value_issues(df).first()
    assert d.zero_dimension_records == 1 and not d.passes


def test_angles_enums_sizes(spark):
    rows = [sample(0, 1, yaw=math.pi), sample(1, 1, yaw=math.pi + 1e-6), sample(2, 1, yaw=190.0), sample(3, 1, type=5, width=0.0)]
    r = tracks.format_consistency(frame(spark, rows)).first()
    assert (r.invalid_yaw, r.invalid_type, r.invalid_width, r.invalid_records, r.consistency_pct) == (2, 1, 1, 3, 25.0)


def test_origin_and_untyped(spark):
    rows = [sample(0, i, x=0.0, y=0.0, z=0.0, type=0) for i in (1, 2)]
    r = tracks.default_value_issues(frame(spark, rows)).first()
    assert r.timestamp_constant and r.all_type_unknown and r.objects_all_zero_position == 2
    assert tracks.temporal_completeness(frame(spark, rows)).first().completeness_pct == 100.0


def test_classes(spark):
    df = frame(spark, [sample(0, 1, type=0), sample(1, 1, type=2)])
    r = tracks.class_diversity(df, {"type": True, "subtype": False}).first()
    assert (r.n_type, r.type_ok, r.passes) == (1, False, False)
    c = tracks.class_coverage(df, "type", T.OBJECT_TYPES, [2, 3]).first()
    assert (c.observed, c.absent, c.coverage_pct) == (["TYPE_VEHICLE"], ["TYPE_PEDESTRIAN"], 50.0)


def test_implausible(spark):
    rows = [sample(0, 1, vel_x=51.0), sample(0, 2, x=0.0), sample(10, 2, x=60.0), sample(0, 3), sample(0, 3, obj_seq=1, x=900.0), sample(1, 4, x=math.nan), sample(2, 4)]
    r = tracks.trajectory_plausibility(frame(spark, rows)).first()
    assert (r.n_objects, r.n_implausible) == (4, 2)


def test_empty_and_single(spark):
    empty = frame(spark, [])
    for metric in tracks.METRICS.values():
        assert metric(empty).count() == 0
    assert tracks.temporal_completeness(frame(spark, [sample(0, 1)])).first().completeness_pct == 100.0


def test_order_of_rows_changes_nothing(spark):
    rows = [sample(t, i, x=float(t * i)) for t in range(5) for i in (1, 2)]
    for metric in tracks.METRICS.values():
        assert metric(frame(spark, rows)).collect() == metric(frame(spark, rows[::-1])).collect()


def test_errors_stay_apart(spark):
    out = tracks.run_metrics(frame(spark, [sample(0, 1)]).drop("vel_x"))
    assert set(out["trajectory_plausibility"]) == {"error"} and out["duplicate_rate"].count() == 1


def test_headers(spark):
    schema = "file string, country_code string, proj_string string, host_vehicle_id long, version struct<major: int, minor: int, patch: int>"
    df = spark.createDataFrame([("a", "752", "+proj=utm", 1, (0, 1, 0)), ("b", "75x", "", None, (0, 0, 0)), ("c", None, None, None, None)], schema)
    r = {x.file: x for x in tracks.file_metadata(df).collect()}
    assert r["a"].passes and r["b"].issues == ["country_code invalid", "proj_string missing", "host_vehicle_id missing"]
    a = {x.file: x for x in tracks.attribute_completeness(df, T.LOG_COLUMNS).collect()}
    assert a["a"].passes_threshold and a["b"].missing == ["proj_string", "host_vehicle_id", "version"] and a["c"].present == 20


def test_half_even_and_wrap(spark):
    from roadlens.functions.core import wrap_angle

    r = spark.range(1).select(F.rint(F.lit(2.5)).alias("a"), wrap_angle(F.pi()).alias("b")).first()
    assert r.a == 2.0 and r.b == -math.pi
