"""Whole reports: the metrics of recordings, of scenes and of a dataset, as JSON or text.

One scan of the samples, cached, feeds all metrics; results of one row per file or scene come to the
driver, where numbers are rounded half-even as reports show them."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.functions import taxonomies as T
from roadlens.functions.core import angle, speed
from roadlens.operators import kernels, spatial, summary, tracks, traffic, video
from roadlens.sources import documents, mcap, opendrive


def _plain(v, digits: int = 4):
    if isinstance(v, float):
        return None if v != v else round(v, digits)
    if hasattr(v, "asDict"):
        return {k: _plain(x, digits) for k, x in v.asDict().items()}
    return [_plain(x, digits) for x in v] if isinstance(v, list) else v


def _by_file(name: str, df: DataFrame, key: str = "file") -> dict:
    return {r[key]: {k: _plain(v) for k, v in r.asDict().items() if k != key} for r in df.collect()}


def log_metrics(samples: DataFrame, headers: DataFrame, lights: DataFrame | None = None, spec: dict | None = None, expected_hz: float | None = None, check_role: bool = True) -> dict[str, dict]:
    """Every metric of trajectory logs by file and section; one that fails is {"error": ...} and
    leaves the others alone."""
    spec = spec or {}
    samples = samples.cache()
    fields = {"type": True, "subtype": True} | ({"role": True} if check_role else {})
    sections = {
        "file_metadata": lambda: tracks.file_metadata(headers),
        "attribute_completeness": lambda: tracks.attribute_completeness(headers, samples.columns),
        "record_completeness": lambda: tracks.record_completeness(samples),
        "default_value_issues": lambda: tracks.default_value_issues(samples),
        "format_consistency": lambda: tracks.format_consistency(samples),
        "duplicate_rate": lambda: tracks.duplicate_rate(samples),
        "temporal_completeness": lambda: tracks.temporal_completeness(samples, expected_hz),
        "class_completeness_type": lambda: tracks.class_coverage(samples, "type", T.OBJECT_TYPES, spec.get("expected_types")),
        "class_completeness_subtype": lambda: tracks.class_coverage(samples, "subtype", T.VEHICLE_SUBTYPES, spec.get("expected_subtypes")),
        "class_completeness_role": lambda: tracks.class_coverage(samples, "role", T.VEHICLE_ROLES, spec.get("expected_roles")),
        "class_diversity": lambda: tracks.class_diversity(samples, fields),
        "object_type_coverage": lambda: tracks.object_type_coverage(samples, spec.get("required_types") or [2]),
        "frame_density_by_type": lambda: tracks.frame_density_by_type(samples).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("type_name", "density_pct"))).alias("density")),
        "trajectory_plausibility": lambda: tracks.trajectory_plausibility(samples),
    }
    if lights is not None:
        kinds = {"color": T.LIGHT_COLORS, "mode": T.LIGHT_MODES, "icon": T.LIGHT_ICONS}
        sections |= {f"lights_{k}": (lambda k=k, names=names: tracks.class_coverage(lights, k, names, list(range(len(names))))) for k, names in kinds.items()}
        sections["lights_diversity"] = lambda: tracks.class_diversity(lights, dict.fromkeys(kinds, False))
    out: dict[str, dict] = {}
    try:
        for name, make in sections.items():
            try:
                for file, result in _by_file(name, make()).items():
                    out.setdefault(file, {})[name] = result
            except Exception as e:  # noqa: BLE001
                out.setdefault("*", {})[name] = {"error": f"{type(e).__name__}: {str(e)[:300]}"}
    finally:
        samples.unpersist()
    return out


def log_report(spark: SparkSession, path: str, spec_text: str | None = None, **options) -> str:
    """JSON of the metrics of trajectory-log files (several by commas)."""
    mcap.register(spark)
    read = lambda table: spark.read.format("trajectory_log").option("table", table).load(path)
    spec = documents.dataset_spec(spec_text) if spec_text else None
    return json.dumps(log_metrics(read("samples"), read("header"), read("lights"), spec, **options), indent=2, default=str)


def video_metrics(frames: DataFrame, stride: int = 5, most: int | None = 500, expected_hz: float | None = None, views: bool = True) -> dict[str, dict]:
    """Every metric of frames(video, frame_no, ts, height, width, nChannels, data) by video. views:
    compare scale and rotation with the first frame, too; without, what depends on them is null."""
    sampled = video.sampled(frames, stride, most)
    features = kernels.frame_features(sampled).cache()
    sections = {
        "duplicate_record_rate": lambda: video.duplicate_rate(frames),
        "temporal_metrics": lambda: video.temporal(frames, expected_hz),
        "sensor_consistency": lambda: video.sensor_consistency(features),
        "sensor_degradation": lambda: video.degradation(features, kernels.view_changes(frames) if views else None),
        "traffic_presence": lambda: video.traffic_presence(kernels.traffic_scores(frames), frames),
    }
    out: dict[str, dict] = {}
    try:
        for name, make in sections.items():
            try:
                for v, result in _by_file(name, make(), "video").items():
                    out.setdefault(v, {})[name] = result
            except Exception as e:  # noqa: BLE001
                out.setdefault("*", {})[name] = {"error": f"{type(e).__name__}: {str(e)[:300]}"}
    finally:
        features.unpersist()
    return out


def write_provenance(source: str, report: str, flags: dict[str, bool], earlier: str | None = None) -> str:
    """A sidecar DPR_{report's stem}.json beside a written report, saying what it was made from and
    which warnings hold; returns its path."""
    now = datetime.datetime.now(datetime.timezone.utc).isoformat()
    out = Path(report).parent / f"DPR_{Path(report).stem}.json"
    doc = {"entity": f"{Path(source).stem}_quality_metrics", "started_at": now, "ended_at": now, "tool": "roadlens", "operation": "video quality metrics computation", "inputs": [source], "outputs": [report], "input_provenance": [earlier] if earlier else [], "warnings": [k for k, v in flags.items() if v]}
    out.write_text(json.dumps(doc, indent=2))
    return str(out)


def load_map(spark: SparkSession, path: str | None = None, log: str | None = None) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """(driving lanes, parking areas, offset) of an explicit map file, else of the map in a log."""
    if path:
        roads = opendrive.read(spark, path, "road", opendrive.ROAD)
        head = opendrive.read(spark, path, "header", opendrive.HEADER).first()
    elif log:
        mcap.register(spark)
        xml = spark.read.format("trajectory_log").option("table", "map").load(log).select("xml")
        if xml.isEmpty():
            raise ValueError("no map is given and the log has none")
        roads = opendrive.from_text(xml)
        offset = F.from_xml("xml", "header STRUCT<offset: STRUCT<_x: DOUBLE, _y: DOUBLE>>", {"ignoreNamespace": "true"})["header"]
        head = xml.select(offset.alias("h")).select("h.*").first()
    else:
        raise ValueError("a map is needed")
    off = (head.offset._x or 0.0, head.offset._y or 0.0) if head is not None and head.offset is not None else (0.0, 0.0)
    return opendrive.numbered(opendrive.lanes(roads)), opendrive.parking_areas(roads).withColumn("lane_idx", F.lit(0)), off


def traffic_metrics(samples: DataFrame, lanes: DataFrame, parking: DataFrame, offset: tuple[float, float], hz: float, cleaning: dict | None = None, levels: list | None = None, series: bool = False) -> dict:
    """The traffic report of one scene's samples on its map."""
    roles, roundabout, centre = opendrive.classify(lanes)
    roles = roles.cache()
    road_km = roles.groupBy(F.col("road_id").alias("road")).agg((F.sum("length_m") / 1000).alias("km"))
    total_km = roles.agg(F.sum("length_m")).first()[0] / 1000
    area = spatial.union_area(roles).first()[0]
    moved = traffic.clean_tracks(samples, hz, **(cleaning or {})).withColumns({"x": F.col("x") - offset[0], "y": F.col("y") - offset[1]})
    placed = spatial.in_areas(spatial.assign_lanes(moved, roles), parking)
    placed = spatial.with_road(placed, roles).withColumn("keep", F.col("keep") & ~F.col("parking")).withColumn("speed", speed()).cache()
    n_frames = (placed.agg(F.max("frame")).first()[0] or -1) + 1
    hours = n_frames / hz / 3600 if hz else None
    kept = placed.where("keep")
    on_road = kept.where("lane_idx is not null")
    frames = placed.select("scene").distinct().withColumn("n_frames", F.lit(n_frames))
    one = lambda df: {k: _plain(v) for k, v in (df.drop("scene").first().asDict() if not df.isEmpty() else {}).items()}
    rows = lambda df: [{k: _plain(v) for k, v in r.asDict().items() if k != "scene"} for r in df.collect()]
    counts, used = traffic.per_frame(on_road, frames), traffic.occupancy(on_road, frames, area)
    per_km = counts.withColumn("value", F.col("value") / total_km)
    out = {
        "data_quality": one(traffic.data_quality(placed)) | one(traffic.cleaning_report(placed)),
        "geometry_agnostic": {"area_occupancy": one(traffic.summary(used)), "density_per_m2": one(traffic.summary(counts.withColumn("value", F.col("value") / area)))},
        "network": one(traffic.edie_by(on_road, ["scene"], n_frames, total_km)) | {"instantaneous_density": one(traffic.summary(per_km))},
        "by_type": rows(traffic.edie_by(on_road, ["scene", "vclass"], n_frames, total_km).orderBy("vclass")),
        "roads": rows(traffic.edie_by_road(on_road, road_km, n_frames)),
        "turning_movements": rows(traffic.turning_movements(kept, roles.where("junction <> '-1'").select(F.col("road_id").alias("road"), "junction").distinct(), hours)),
        "roundabout": {"detected": False},
    }
    if series:
        out["series"] = {"area_occupancy": one(traffic.time_series(used, 5)), "density": one(traffic.time_series(per_km, 4))}
    if roundabout:
        ring = on_road.where("role = 'ring'").withColumn("phi", angle(F.col("y") - centre[1], F.col("x") - centre[0]))
        arms = on_road.where("role = 'approach'")
        ring_lanes = roles.where("role = 'ring'")
        ring_km = ring_lanes.agg(F.sum("length_m")).first()[0] / 1000
        graded = lambda df: df.withColumn("level_of_service", traffic.grade(F.bround("control_delay_s", 2), levels))
        direction = one(traffic.circulating_direction(ring)).get("direction", -1)
        per_arm = traffic.edie_by_road(arms, road_km, n_frames)
        per_arm = per_arm.join(traffic.arm_direction(arms, *centre), ["scene", "road"], "left").join(graded(traffic.control_delay(arms, ["scene", "road"], hz)), ["scene", "road"], "left")
        flow = traffic.circulating_flow(ring, opendrive.approach_angles(roles, centre), hours or 0.0)
        per_arm = per_arm.join(flow.select("scene", "road", F.col("veh_per_h").alias("circulating_veh_per_h")), ["scene", "road"], "left")
        out["roundabout"] = {
            "detected": True,
            "circulating_direction": "CCW" if direction > 0 else "CW",
            "ring": one(traffic.edie_by(ring, ["scene"], n_frames, ring_km)) | one(graded(traffic.control_delay(ring, ["scene"], hz))) | {"area_occupancy": one(traffic.summary(traffic.occupancy(ring, frames, spatial.union_area(ring_lanes).first()[0])))},
            "approaches": rows(per_arm.orderBy("road")),
        }
    placed.unpersist()
    roles.unpersist()
    return out


def traffic_report(spark: SparkSession, log: str | None = None, openlabel: str | None = None, map_path: str | None = None, expected_hz: float | None = None, levels_text: str | None = None, **options) -> str:
    """JSON of one scene's traffic metrics; any failure is {"error": ...}."""
    try:
        if (log is None) == (openlabel is None):
            raise ValueError("give either a log or an OpenLABEL file")
        lanes, parking, offset = load_map(spark, map_path, log)
        if log:
            mcap.register(spark)
            view = mcap.traffic_view(spark.read.format("trajectory_log").load(log))
            hz = traffic.sample_rate(view).first().hz
            samples = traffic.dense_frames(view)
        else:
            hz = expected_hz or 30.0
            samples = traffic.finite_difference_velocity(documents.openlabel(documents.texts(spark, openlabel)), hz)
        levels = documents.service_levels(levels_text) if levels_text else None
        return json.dumps(traffic_metrics(samples, lanes, parking, offset, hz, levels=levels, **options), indent=2, default=str)
    except Exception as e:  # noqa: BLE001
        return json.dumps({"error": f"{type(e).__name__}: {str(e)[:500]}"})


def dataset_report(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.json",), official: bool = False) -> tuple[str, str]:
    """(text, JSON) of all metric documents under root."""
    docs = documents.metric_documents(spark, root, patterns).cache()
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("\\", "\\\\") + "/", "")
    docs = docs.withColumn("path", path)
    videos, logs, n = documents.video_rows(docs), documents.log_rows(docs), docs.count()
    out = summary.report(root, videos, logs, n, official), summary.document(root, videos, logs, n)
    docs.unpersist()
    return out
