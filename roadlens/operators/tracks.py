"""Quality metrics of trajectory logs: one row per file, from a table of track samples.

A sample is one object at one time: file, total_nanos, idx and the columns that a metric names.
msg_seq and obj_seq, where present, order samples of equal time. Every metric maps a DataFrame to a
DataFrame and groups by `file`, so one scan of many recordings serves all of them; percentages stay
unrounded unless a flag is defined on the rounded value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import taxonomies as T
from roadlens.functions.core import given, missing, names_of, over, ratio


def _any(cols) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def _all(cols) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def record_completeness(samples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Samples with every mandatory column given, and each column's share of missing values."""
    columns = columns or [c for c in T.LOG_COLUMNS if c in samples.columns]
    out = samples.groupBy("file").agg(
        F.count("*").alias("total_records"),
        F.count_if(_all(~missing(c) for c in columns)).alias("complete_records"),
        *(F.avg(missing(c).cast("double")).alias(f"missing_{c}") for c in columns),
    )
    pct = 100.0 * ratio(F.col("complete_records"), F.col("total_records"))
    return out.withColumn("completeness_pct", pct).withColumn("passes_threshold", pct >= 95.0)


def default_value_issues(samples: DataFrame) -> DataFrame:
    """Values that are given but implausible: zero sizes, one time for all rows, objects that never
    leave the origin, no type known."""
    zero = lambda c: F.coalesce(given(c) == 0, F.lit(False))
    per_object = samples.groupBy("file", "idx").agg(
        F.count("*").alias("n"),
        F.count_if(_any(zero(c) for c in T.SIZE_COLUMNS)).alias("zero_size"),
        F.bool_and(_all(zero(c) for c in ("x", "y", "z"))).alias("at_origin"),
        F.min("total_nanos").alias("t0"),
        F.max("total_nanos").alias("t1"),
        F.bool_and(zero("type")).alias("untyped"),
    )
    out = per_object.groupBy("file").agg(
        F.sum("zero_size").alias("zero_dimension_records"),
        ((F.min("t0") == F.max("t1")) & (F.sum("n") > 1)).alias("timestamp_constant"),
        F.count_if(F.col("at_origin") & F.col("idx").isNotNull()).alias("objects_all_zero_position"),
        F.count("idx").alias("total_objects"),
        F.bool_and("untyped").alias("all_type_unknown"),
    )
    # sorted distinct times never decrease, so this check can't fail
    out = out.withColumn("timestamp_nonmonotonic", F.lit(False))
    bad = (F.col("zero_dimension_records") > 0) | F.col("timestamp_constant") | (F.col("objects_all_zero_position") > 0) | F.col("all_type_unknown")
    return out.withColumn("passes", ~bad)


def time_order(samples: DataFrame) -> DataFrame:
    """Messages whose time is before that of the message before them, by msg_seq."""
    messages = samples.groupBy("file", "msg_seq").agg(F.min("total_nanos").alias("t"))
    w = Window.partitionBy("file").orderBy("msg_seq")
    back = messages.withColumn("back", F.col("t") < F.lag("t").over(w))
    return back.groupBy("file").agg(F.count("*").alias("messages"), F.count_if("back").alias("messages_back_in_time"))


def class_coverage(samples: DataFrame, field: str, taxonomy: list[str], expected: list[int] | None = None) -> DataFrame:
    """Observed, absent and covered codes of a field against the expected ones or all of its
    taxonomy but the unknown code."""
    codes = list(expected) if expected else list(range(1, len(taxonomy)))
    wanted = F.array(*(F.lit(c).cast("int") for c in codes))
    seen = samples.groupBy("file").agg(F.array_sort(F.collect_set(F.col(field).cast("int"))).alias("codes"))
    hit = F.array_intersect("codes", wanted)
    return seen.select("file", names_of(taxonomy, hit).alias("observed"), names_of(taxonomy, F.array_except(wanted, "codes")).alias("absent"), (100.0 * ratio(F.size(hit), F.lit(len(codes)))).alias("coverage_pct"))


def class_diversity(samples: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """Whether each field shows two codes or more. fields: by name, whether its unknown code 0
    doesn't count (traffic-light fields count it)."""
    distinct = [F.count_distinct(F.when(F.col(f) != 0, F.col(f)) if skip else F.col(f)).alias(f"n_{f}") for f, skip in fields.items()]
    out = samples.groupBy("file").agg(*distinct)
    checks = {f: F.col(f"n_{f}") >= 2 for f in fields}
    return out.select("file", *(F.col(f"n_{f}") for f in fields), *(c.alias(f"{f}_ok") for f, c in checks.items()), _all(checks.values()).alias("passes"))


def format_consistency(samples: DataFrame) -> DataFrame:
    """Samples with an invalid cell, and invalid cells by field. Five checks: numeric cells are
    numbers; enum codes are known; angles are radians; sizes are positive; labels are in their
    vocabulary (a missing label isn't)."""
    have = set(samples.columns)
    checks: list[tuple[str, Column]] = []
    checks += [(c, F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in T.LOG_COLUMNS if c in have]
    enums = {"type": T.OBJECT_TYPES, "subtype": T.VEHICLE_SUBTYPES, "role": T.VEHICLE_ROLES}
    checks += [(c, F.coalesce(~given(c).isin(*map(float, range(len(names)))), F.lit(False))) for c, names in enums.items() if c in have]
    checks += [(c, F.coalesce(F.abs(given(c)) > F.pi(), F.lit(False))) for c in T.ANGLE_COLUMNS if c in have]
    checks += [(c, F.coalesce(given(c) <= 0, F.lit(False))) for c in T.SIZE_COLUMNS if c in have]
    words = {"type_name": T.PIPELINE_TYPES, "subtype_name": T.PIPELINE_SUBTYPES, "role_name": T.PIPELINE_ROLES}
    checks += [(c, F.coalesce(~F.upper(F.col(c)).isin(*names), F.lit(True))) for c, names in words.items() if c in have]
    by_field: dict[str, Column] = {}
    for c, bad in checks:
        by_field[c] = by_field.get(c, F.lit(0)) + bad.cast("int")
    out = samples.groupBy("file").agg(
        F.count("*").alias("total_records"),
        F.count_if(_any(bad for _, bad in checks)).alias("invalid_records"),
        *(F.sum(n).alias(f"invalid_{c}") for c, n in by_field.items()),
    )
    pct = 100.0 * ratio(F.col("total_records") - F.col("invalid_records"), F.col("total_records"))
    return out.withColumn("consistency_pct", F.bround(pct, 2)).withColumn("passes_threshold", F.bround(pct, 2) >= 95.0)


def duplicate_rate(samples: DataFrame, key: tuple[str, ...] = ("total_nanos", "idx")) -> DataFrame:
    """Rows after the first of each key, in percent of all rows."""
    per_key = samples.groupBy("file", *key).agg(F.count("*").alias("n"))
    out = per_key.groupBy("file").agg(F.sum("n").alias("total_records"), F.sum(F.col("n") - 1).alias("duplicate_records"))
    pct = 100.0 * ratio(F.col("duplicate_records"), F.col("total_records"))
    return out.withColumn("duplicate_rate_pct", F.bround(pct, 4)).withColumn("passes_threshold", F.bround(pct, 4) <= 1.0)


def _steps(samples: DataFrame) -> DataFrame:
    """Distinct times of each track with the time since the one before; null keys left out."""
    times = samples.where("idx is not null and total_nanos is not null").select("file", "idx", "total_nanos").distinct()
    w = Window.partitionBy("file", "idx").orderBy("total_nanos")
    return times.withColumn("diff", F.col("total_nanos") - F.lag("total_nanos").over(w))


def _per_track(samples: DataFrame, expected_hz: float | None) -> DataFrame:
    steps = _steps(samples)
    if expected_hz is not None:
        if not expected_hz > 0:
            raise ValueError("expected_hz must be positive")
        step = steps.select("file").distinct().withColumn("dt", F.lit(1e9 / expected_hz))
    else:
        within = steps.groupBy("file").agg(F.median("diff").alias("dt"))
        # only files without a step in any track need the median over all their times
        alone = steps.join(within.where("dt is null"), "file", "left_semi").select("file", "total_nanos").distinct()
        w = Window.partitionBy("file").orderBy("total_nanos")
        overall = alone.withColumn("step", F.col("total_nanos") - F.lag("total_nanos").over(w)).groupBy("file").agg(F.median("step").alias("overall"))
        step = within.join(overall, "file", "left").select("file", F.coalesce("dt", "overall").alias("dt"))
    steps = steps.join(step, "file")
    gap = F.col("diff") > 1.5 * F.col("dt")
    lost = F.rint(F.col("diff") / F.col("dt") - 1)
    steps = steps.withColumn("nth", F.count_if(gap).over(Window.partitionBy("file", "idx").orderBy("total_nanos")))
    found = F.when(gap & (F.col("nth") <= 5), F.struct((F.col("total_nanos") - F.col("diff")).alias("at_nanos"), F.col("diff").alias("gap_ns"), lost.cast("long").alias("missing_frames")))
    return steps.groupBy("file", "idx").agg(
        F.first("dt").alias("dt"),
        F.count("*").alias("n_actual"),
        F.when(F.count("*") > 1, F.rint((F.max("total_nanos") - F.min("total_nanos")) / F.first("dt")).cast("long") + 1).otherwise(F.count("*")).alias("n_expected"),
        F.count_if(gap).alias("n_gaps"),
        F.coalesce(F.sum(F.when(gap, lost)), F.lit(0.0)).cast("long").alias("missing_frames"),
        F.array_sort(F.collect_list(found)).alias("gaps"),
    )


def temporal_completeness(samples: DataFrame, expected_hz: float | None = None) -> DataFrame:
    """Object frames present against those expected from each track's span and the file's time step:
    the given rate's, else the median within tracks, else the median over all times."""
    per_track = _per_track(samples, expected_hz).drop("gaps")
    frames = samples.groupBy("file").agg(F.count_distinct("total_nanos").alias("n_global_frames"))
    out = per_track.groupBy("file").agg(
        F.count("*").alias("n_objects"),
        F.count_if(F.col("n_gaps") > 0).alias("n_objects_with_gaps"),
        F.sum("n_actual").alias("total_actual"),
        F.sum("n_expected").alias("total_expected"),
        F.max("dt").alias("dt_ns"),
    ).join(frames, "file")
    pct = F.bround(100.0 * ratio(F.col("total_actual"), F.col("total_expected")), 2)
    pct = F.when((F.col("n_global_frames") < 2) | (F.col("total_expected") == 0), F.lit(100.0)).otherwise(pct)
    return out.withColumn("completeness_pct", pct).withColumn("inferred_hz", F.bround(ratio(F.lit(1e9), F.col("dt_ns")), 2)).withColumn("passes_threshold", pct >= 98.0)


def temporal_gaps(samples: DataFrame, expected_hz: float | None = None) -> DataFrame:
    """Tracks with gaps, each with its first five."""
    return _per_track(samples, expected_hz).where("n_gaps > 0").select("file", "idx", "n_actual", "n_expected", "n_gaps", "missing_frames", "gaps")


def object_type_coverage(samples: DataFrame, required: list[int]) -> DataFrame:
    """Required types seen, and detections per frame."""
    wanted = F.array(*(F.lit(c).cast("int") for c in dict.fromkeys(required)))
    frames = samples.groupBy("file", "total_nanos").agg(F.count("*").alias("n"), F.collect_set(F.col("type").cast("int")).alias("codes"))
    out = frames.groupBy("file").agg(
        F.count("total_nanos").alias("total_frames"),
        F.avg("n").alias("mean_detections"),
        F.min("n").alias("min_detections"),
        F.max("n").alias("max_detections"),
        F.median("n").alias("median_detections"),
        F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"),
    )
    out = out.join(samples.groupBy("file").agg(F.count_distinct("idx").alias("unique_objects")), "file")
    hit = F.array_intersect("codes", wanted)
    return out.select("file", "total_frames", "mean_detections", "min_detections", "max_detections", "median_detections", "unique_objects", names_of(T.OBJECT_TYPES, hit).alias("matched_types"), names_of(T.OBJECT_TYPES, F.array_except(wanted, "codes")).alias("missing_types"), (100.0 * ratio(F.size(hit), F.lit(len(set(required))))).alias("coverage_pct"), (F.size(hit) == F.size(wanted)).alias("passes"))


def frame_density_by_type(samples: DataFrame) -> DataFrame:
    """Share of a file's frames in which each type appears, in percent."""
    frames = samples.groupBy("file").agg(F.count_distinct("total_nanos").alias("total_frames"))
    by_type = samples.where("type is not null").groupBy("file", F.col("type").cast("int").alias("type")).agg(F.count_distinct("total_nanos").alias("frames"))
    name = F.element_at(names_of(T.OBJECT_TYPES, F.array("type")), 1)
    return by_type.join(frames, "file").select("file", name.alias("type_name"), "frames", (100.0 * ratio(F.col("frames"), F.col("total_frames"))).alias("density_pct"))


def implausible_tracks(samples: DataFrame, max_speed_ms: float = 50.0) -> DataFrame:
    """Each track's fast samples and jumps. A jump is a consecutive displacement in the plane that
    implies more than max_speed_ms; equal times imply none."""
    ties = [c for c in ("msg_seq", "obj_seq") if c in samples.columns]
    w = Window.partitionBy("file", "idx").orderBy("total_nanos", *ties)
    v = F.sqrt(F.col("vel_x") ** 2 + F.col("vel_y") ** 2 + F.col("vel_z") ** 2)
    dt = (F.col("total_nanos") - F.lag("total_nanos").over(w)) / 1e9
    dist = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    steps = samples.where("idx is not null").select("file", "idx", v.alias("v"), F.when(dt > 0, dist / dt).when(dt <= 0, 0.0).alias("implied"))
    return steps.groupBy("file", "idx").agg(
        F.count_if(over(F.col("v"), max_speed_ms)).alias("n_fast"),
        F.max("v").alias("max_speed_ms"),
        F.count_if(over(F.col("implied"), max_speed_ms)).alias("n_jumps"),
        F.max("implied").alias("max_implied_speed_ms"),
    )


def trajectory_plausibility(samples: DataFrame, max_speed_ms: float = 50.0, max_fraction: float = 0.02) -> DataFrame:
    """The share of tracks with a fast sample or a jump."""
    per_track = implausible_tracks(samples, max_speed_ms)
    out = per_track.groupBy("file").agg(F.count("*").alias("n_objects"), F.count_if((F.col("n_fast") > 0) | (F.col("n_jumps") > 0)).alias("n_implausible"))
    share = ratio(F.col("n_implausible"), F.col("n_objects"))
    return out.withColumn("implausible_fraction", share).withColumn("passes_threshold", share <= max_fraction)


def file_metadata(headers: DataFrame) -> DataFrame:
    """Issues of each file's header: country code, projection, host vehicle."""
    code = F.trim(F.col("country_code").cast("string"))
    valid = code.rlike("^[0-9]+$") & code.try_cast("int").between(100, 999)
    issues = F.filter(
        F.array(
            F.when(code.isNull() | (code == ""), "country_code missing").when(~F.coalesce(valid, F.lit(False)), "country_code invalid"),
            F.when(F.col("proj_string").isNull() | (F.trim("proj_string") == ""), "proj_string missing"),
            F.when(F.col("host_vehicle_id").isNull(), "host_vehicle_id missing"),
        ),
        lambda x: x.isNotNull(),
    )
    return headers.select("file", "country_code", "proj_string", "host_vehicle_id", issues.alias("issues"), (F.size(issues) == 0).alias("passes"))


def attribute_completeness(headers: DataFrame, columns: list[str]) -> DataFrame:
    """Present columns and header fields in percent of all mandatory ones. columns: what the
    samples' schema has; a version counts if a part of it isn't 0."""
    here = [c for c in T.LOG_COLUMNS if c in columns]
    version = F.greatest(*(F.coalesce(F.col(f"version.{p}"), F.lit(0)) for p in ("major", "minor", "patch"))) > 0
    present = {
        "country_code": F.coalesce(F.col("country_code").cast("string") != "", F.lit(False)),
        "proj_string": F.coalesce(F.col("proj_string") != "", F.lit(False)),
        "host_vehicle_id": F.col("host_vehicle_id").isNotNull(),
        "version": F.coalesce(version, F.lit(False)),
    }
    n = reduce(lambda a, b: a + b, (p.cast("int") for p in present.values())) + len(here)
    absent = F.filter(F.array(*(F.when(~p, k) for k, p in present.items())), lambda x: x.isNotNull())
    total = len(T.LOG_COLUMNS) + len(T.HEADER_FIELDS)
    columns_absent = F.array(*(F.lit(c) for c in T.LOG_COLUMNS if c not in here)).cast("array<string>")
    return headers.select("file", n.alias("present"), F.lit(total).alias("mandatory"), F.concat(columns_absent, absent).alias("missing"), (100.0 * n / total).alias("completeness_pct"), (n == total).alias("passes_threshold"))


#: Metrics of a log by the name of its section in the report.
METRICS = {
    "record_completeness": record_completeness,
    "default_value_issues": default_value_issues,
    "format_consistency": format_consistency,
    "duplicate_rate": duplicate_rate,
    "temporal_completeness": temporal_completeness,
    "trajectory_plausibility": trajectory_plausibility,
}


def run_metrics(samples: DataFrame, metrics: dict | None = None) -> dict[str, DataFrame | dict]:
    """Every metric of the samples; one that can't be planned gives {"error": ...} and leaves the
    others alone. Cache samples first: all metrics read them."""
    out: dict[str, DataFrame | dict] = {}
    for name, metric in (metrics or METRICS).items():
        try:
            out[name] = metric(samples)
        except Exception as e:  # noqa: BLE001
            out[name] = {"error": f"{type(e).__name__}: {e}"}
    return out
