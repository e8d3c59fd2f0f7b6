"""Traffic metrics of cleaned trajectories: one row per scene, road or class.

Samples: scene, frame, id, x, y, length, width, vx, vy, vclass; with lanes assigned also road, role.
Constants: lengths in km, speeds in m/s in and km/h out, rates per hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.core import ratio, speed, wrap_angle
from roadlens.functions.taxonomies import DELAY_GRADES

FREE_FLOW = 0.85


def finite_difference_velocity(samples: DataFrame, hz: float) -> DataFrame:
    """vx, vy from each track's consecutive positions, whatever frames lie between; none at first."""
    w = Window.partitionBy("scene", "id").orderBy("frame")
    step = lambda c: (F.col(c) - F.lag(c).over(w)) * hz
    return samples.withColumns({"vx": step("x"), "vy": step("y")})


def dense_frames(samples: DataFrame) -> DataFrame:
    """samples with frame, the dense rank of total_nanos within a scene from 0, by a join with the
    distinct times instead of a sort of all samples in one task."""
    times = samples.select("scene", "total_nanos").distinct()
    w = Window.partitionBy("scene").orderBy("total_nanos")
    return samples.join(times.withColumn("frame", (F.row_number().over(w) - 1).cast("int")), ["scene", "total_nanos"])


def sample_rate(samples: DataFrame) -> DataFrame:
    """Each scene's rate in Hz: one over the median step between distinct times."""
    times = samples.select("scene", "total_nanos").distinct()
    w = Window.partitionBy("scene").orderBy("total_nanos")
    return times.withColumn("dt", F.col("total_nanos") - F.lag("total_nanos").over(w)).groupBy("scene").agg((ratio(F.lit(1e9), F.median("dt"))).alias("hz"))


def track_spans(samples: DataFrame, hz: float, min_track_s: float = 0.5, static_disp_m: float = 2.0) -> DataFrame:
    """Each track's duration and extent, and whether it is short or parked."""
    out = samples.groupBy("scene", "id").agg(
        (F.count("*") / F.lit(float(hz))).alias("duration_s"),
        F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent_m"),
    )
    short = F.col("duration_s") < min_track_s
    return out.withColumn("short", short).withColumn("static", ~short & (F.col("extent_m") < static_disp_m))


def clean_tracks(samples: DataFrame, hz: float, min_track_s: float = 0.5, static_disp_m: float = 2.0, max_speed_ms: float = 55.0) -> DataFrame:
    """samples with speed, teleport and keep: of tracks neither short nor parked, and not faster than
    max_speed_ms."""
    spans = track_spans(samples, hz, min_track_s, static_disp_m)
    out = samples.join(spans, ["scene", "id"]).withColumn("speed", speed())
    teleport = F.col("speed") > max_speed_ms
    return out.withColumn("teleport", teleport).withColumn("keep", ~F.col("short") & ~F.col("static") & ~teleport)


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    per_track = cleaned.groupBy("scene", "id").agg(F.first("duration_s").alias("duration_s"), F.first("short").alias("short"), F.first("static").alias("static"), F.count_if("teleport").alias("teleports"), F.count_if("keep").alias("kept"), F.count("*").alias("n"))
    return per_track.groupBy("scene").agg(
        F.count("*").alias("n_objects"),
        F.count_if("static").alias("n_static"),
        F.count_if("short").alias("n_short_tracks"),
        F.sum("teleports").alias("n_teleport_samples"),
        ratio(F.sum("kept"), F.sum("n")).alias("samples_kept_fraction"),
        F.median("duration_s").alias("median_duration_s"),
        F.percentile("duration_s", 0.1).alias("p10_duration_s"),
    )


def data_quality(placed: DataFrame) -> DataFrame:
    """Reliability of the samples: placed has keep, lane_idx (null off all lanes), parking."""
    off = F.col("lane_idx").isNull().cast("double")
    return placed.groupBy("scene").agg(
        F.coalesce(F.avg(F.when(F.col("keep"), off)), F.lit(0.0)).alias("off_lane_fraction"),
        F.count_distinct(F.when(F.col("vclass") == "other", F.col("id"))).alias("unknown_type_objects"),
        F.count_if("parking").alias("parking_samples"),
        F.count_distinct(F.when(F.col("parking"), F.col("id"))).alias("parking_vehicles"),
    )


def edie(n: Column, speed_sum: Column, frames, length_km) -> list[Column]:
    """Density (veh/km/lane), flow (veh/h/lane) and mean speed (km/h) of n samples over frames and
    length; all 0 where one of these is."""
    frames = frames if isinstance(frames, Column) else F.lit(frames)
    length_km = length_km if isinstance(length_km, Column) else F.lit(length_km)
    some = (n > 0) & (frames > 0) & (length_km > 0)
    k = F.coalesce(F.when(some, ratio(n, frames * length_km)), F.lit(0.0))
    v = F.coalesce(F.when(some, 3.6 * ratio(speed_sum, n)), F.lit(0.0))
    return [k.alias("density_veh_per_km"), (k * v).alias("flow_veh_per_h"), v.alias("speed_km_per_h")]


def edie_by(on_road: DataFrame, keys: list[str], frames: int, length_km) -> DataFrame:
    """Edie's measures by keys of samples on the road; objects are counted once a key."""
    out = on_road.groupBy(*keys).agg(F.count_distinct("id").alias("objects"), F.count("*").alias("samples"), F.sum("speed").alias("speed_sum"))
    return out.select(*keys, "objects", "samples", *edie(F.col("samples"), F.col("speed_sum"), frames, length_km))


def edie_by_road(on_road: DataFrame, road_km: DataFrame, frames: int) -> DataFrame:
    """Edie's measures of each road with a length, most flow first, then by name. road_km: road, km;
    a map's size, joined as Spark finds best for its measured size."""
    out = on_road.where("road <> ''").groupBy("scene", "road").agg(F.count("*").alias("samples"), F.sum("speed").alias("speed_sum"))
    out = out.join(road_km.where("km > 0"), "road")
    return out.select("scene", "road", "km", "samples", *edie(F.col("samples"), F.col("speed_sum"), frames, F.col("km"))).orderBy(F.bround("flow_veh_per_h", 2).desc(), "road")


def per_frame(samples: DataFrame, frames: DataFrame, weight: Column | None = None) -> DataFrame:
    """scene, frame, value for every frame of frames(scene, n_frames): the number of samples or the
    sum of their weights, 0 without samples."""
    spine = frames.select("scene", F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int"))).alias("frame"))
    value = samples.groupBy("scene", "frame").agg((F.sum(weight) if weight is not None else F.count("*").cast("double")).alias("value"))
    return spine.join(value, ["scene", "frame"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def summary(series: DataFrame, value: str = "value") -> DataFrame:
    """Mean, peak, 95th percentile and minimum of a scene's finite values."""
    v = F.col(value)
    finite = series.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite.groupBy("scene").agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.percentile(value, 0.95).alias("p95"), F.min(value).alias("min"))


def occupancy(on_road: DataFrame, frames: DataFrame, area_m2: float) -> DataFrame:
    """Per frame the share of the drivable area that footprints cover."""
    series = per_frame(on_road, frames, F.col("length") * F.col("width"))
    return series.withColumn("value", ratio(F.col("value"), F.lit(area_m2)))


def time_series(series: DataFrame, digits: int) -> DataFrame:
    """A scene's values in frame order as one array (a report of one recording)."""
    pairs = F.array_sort(F.collect_list(F.struct("frame", F.bround("value", digits).alias("v"))))
    return series.groupBy("scene").agg(F.transform(pairs, lambda p: p["v"]).alias("series"))


def turning_movements(samples: DataFrame, connectors: DataFrame, hours: float | None, collapse_gaps: bool = False) -> DataFrame:
    """Counts of (from, to) around each connector of a junction. samples: scene, id, frame, road
    ('' off all roads); connectors: road, junction. A run of one road counts once; a gap splits a
    run unless collapse_gaps."""
    w = Window.partitionBy("scene", "id").orderBy("frame")
    rows = samples.where("road <> ''") if collapse_gaps else samples
    new = F.lag("road").over(w).isNull() | (F.lag("road").over(w) != F.col("road"))
    runs = rows.withColumn("new", new).where("new and road <> ''")
    around = runs.withColumns({"from": F.lag("road").over(w), "to": F.lead("road").over(w)})
    moves = around.where("from is not null and to is not null").join(connectors, "road")
    out = moves.groupBy("scene", "junction", "from", "to").agg(F.count("*").alias("count"), F.min(F.struct("id", "frame")).alias("first"))
    return out.withColumn("veh_per_h", ratio(F.col("count"), F.lit(hours) if hours else F.lit(None).cast("double"))).orderBy("junction", F.desc("count"), "first").drop("first")


def _sweeps(ring: DataFrame) -> DataFrame:
    """Steps of ring samples between consecutive frames: angle before, wrapped change."""
    w = Window.partitionBy("scene", "id").orderBy("frame")
    steps = ring.withColumns({"phi0": F.lag("phi").over(w), "gap": F.col("frame") - F.lag("frame").over(w)})
    return steps.where("gap = 1").select("scene", "id", "frame", "phi0", wrap_angle(F.col("phi") - F.col("phi0")).alias("dphi"))


def circulating_direction(ring: DataFrame) -> DataFrame:
    """1 where a scene's summed sweep is counter-clockwise, else -1. ring: scene, id, frame, phi."""
    swept = _sweeps(ring).groupBy("scene").agg(F.sum("dphi").alias("sweep"))
    scenes = ring.select("scene").distinct().join(swept, "scene", "left")
    return scenes.select("scene", F.when(F.col("sweep") >= 0, 1).otherwise(-1).alias("direction"))


def circulating_flow(ring: DataFrame, arms: DataFrame, hours: float) -> DataFrame:
    """Steps that pass each arm's angle in the circulating direction, per hour. arms: road, theta (a
    roundabout's few arms)."""
    steps = _sweeps(ring).join(circulating_direction(ring), "scene").where(F.signum("dphi") == F.col("direction"))
    gates = arms.agg(F.collect_list(F.struct("road", "theta")).alias("gates"))  # one row: a map's arms
    passed = steps.join(F.broadcast(gates)).select("scene", "direction", "phi0", "dphi", F.explode("gates").alias("g"))
    rel = wrap_angle(F.col("g.theta") - F.col("phi0"))
    hit = F.when(F.col("direction") > 0, (rel > 0) & (rel <= F.col("dphi"))).otherwise((rel < 0) & (rel >= F.col("dphi")))
    return passed.groupBy("scene", F.col("g.road").alias("road")).agg(F.count_if(hit).alias("crossings")).withColumn("veh_per_h", ratio(F.col("crossings"), F.lit(hours)))


def arm_direction(samples: DataFrame, cx: float, cy: float) -> DataFrame:
    """entry for arms whose samples move towards the centre on the whole, else exit."""
    phi = F.atan2(F.col("y") - cy, F.col("x") - cx)
    radial = F.cos(phi) * F.col("vx") + F.sin(phi) * F.col("vy")
    out = samples.groupBy("scene", "road").agg(F.coalesce(F.sum(F.nanvl(radial, F.lit(0.0))), F.lit(0.0)).alias("radial"))
    return out.select("scene", "road", F.when(F.col("radial") < 0, "entry").otherwise("exit").alias("direction"))


def control_delay(samples: DataFrame, keys: list[str], hz: float) -> DataFrame:
    """Mean seconds lost per vehicle against the keys' free-flow speed (the 85th percentile)."""
    free = samples.groupBy(*keys).agg(F.percentile("speed", FREE_FLOW).alias("v_ff"))
    lost = samples.join(free, keys).withColumn("lost", F.when(F.col("v_ff") > 0, (1 - ratio(F.col("speed"), F.col("v_ff"))) / hz).otherwise(0.0))
    per_vehicle = lost.groupBy(*keys, "id").agg(F.greatest(F.sum("lost"), F.lit(0.0)).alias("lost"))
    return per_vehicle.groupBy(*keys).agg(F.avg("lost").alias("control_delay_s"))


def grade(value: Column, table: list | None = None) -> Column:
    """The first grade whose upper bound holds the value, else the last."""
    table = table or DELAY_GRADES
    out = F.lit(None).cast("string")
    for name, upper in reversed(table):
        out = F.when(value <= float(upper), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(table[-1][0]))
