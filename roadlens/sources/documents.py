"""Semi-structured inputs: metric JSON, OpenLABEL, sidecar subtitles, stream listings, specs."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.functions.taxonomies import GROUP_OF_LABEL, OBJECT_TYPES, VEHICLE_ROLES, VEHICLE_SUBTYPES


def plain(raw: bytes) -> bytes:
    """The content of plain, gzip, bzip2, xz or zip bytes, told by their first bytes; of a zip, the
    first .json member, else the first."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    if raw[:3] == b"BZh":
        return bz2.decompress(raw)
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(raw)
    if raw[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.namelist()
            return z.read(next((n for n in names if n.endswith(".json")), names[0]))
    return raw


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, text of files, decompressed where they are, found recursively."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda b: plain(bytes(b)).decode("utf-8", "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", read("content").alias("text"))


_CUBOID = "STRUCT<object_data: STRUCT<cuboid: ARRAY<STRUCT<val: ARRAY<DOUBLE>>>>>"
OPENLABEL = f"openlabel STRUCT<objects: MAP<STRING, STRUCT<type: STRING>>, frames: MAP<STRING, STRUCT<objects: MAP<STRING, {_CUBOID}>>>>"


def openlabel(documents: DataFrame) -> DataFrame:
    """scene, frame, id, x, y, yaw, length, width, vclass of documents(path, text); objects without
    a cuboid are left out, unknown ones are of class other."""
    doc = documents.select(F.col("path").alias("scene"), F.from_json("text", OPENLABEL)["openlabel"].alias("d"))
    kinds = doc.select("scene", F.explode("d.objects").alias("id", "o")).select("scene", "id", F.lower("o.type").alias("kind"))
    frames = doc.select("scene", F.explode("d.frames").alias("frame", "f"))
    objects = frames.select("scene", "frame", F.explode("f.objects").alias("id", "o"))
    val = F.try_element_at("o.object_data.cuboid", F.lit(1))["val"]
    rows = objects.select("scene", F.col("frame").cast("int").alias("frame"), "id", val.alias("v")).where("v is not null")
    group = F.create_map(*(F.lit(x) for kv in GROUP_OF_LABEL.items() for x in kv))
    out = rows.join(kinds, ["scene", "id"], "left")
    at = lambda k: F.try_element_at("v", F.lit(k + 1))
    return out.select("scene", "frame", F.col("id").cast("long").alias("id"), at(0).alias("x"), at(1).alias("y"), at(5).alias("yaw"), at(6).alias("length"), at(7).alias("width"), F.coalesce(F.try_element_at(group, F.col("kind")), F.lit("other")).alias("vclass"))


# Keys of the metric documents.
_V = {
    "compute_temporal_metrics": ["Temporal Distortion Score (TDS)", "Temporal Completeness (%)"],
    "compute_duplicate_record_rate_video": ["Duplicate Record Rate (%)"],
    "compute_sensor_consistency": ["Composite SCI (0..1)"],
    "compute_sensor_degradation": ["Partial Blockage Score (0..1)", "FOV Change Score (0..1)"],
}
_O = {
    "attribute_completeness": "completeness_pct DOUBLE, passes_threshold BOOLEAN",
    "record_completeness": "completeness_pct DOUBLE, passes_threshold BOOLEAN",
    "format_consistency": "consistency_pct DOUBLE, passes_threshold BOOLEAN",
    "duplicate_rate": "duplicate_rate_pct DOUBLE, passes_threshold BOOLEAN",
    "temporal_completeness": "completeness_pct DOUBLE, passes_threshold BOOLEAN",
    "class_completeness": "case2_passes BOOLEAN, case2_checks MAP<STRING, BOOLEAN>",
    "object_type_coverage": "passes BOOLEAN",
    "trajectory_plausibility": "passes_threshold BOOLEAN, implausible_fraction DOUBLE",
    "file_metadata": "passes BOOLEAN",
}
_colon = lambda s: ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in s.replace("MAP<STRING, BOOLEAN>", "MAP<STRING;BOOLEAN>").split(", "))).replace(";", ", ")
METRIC_JSON = (
    "video STRUCT<" + ", ".join(f"{k}: STRUCT<{', '.join(f'`{c}`: DOUBLE' for c in v)}>" for k, v in _V.items()) + ">, "
    "omegaprime STRUCT<" + ", ".join(f"{k}: STRUCT<{_colon(v)}>" for k, v in _O.items()) + ">, aggregated STRING"
)


def metric_documents(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.json",)) -> DataFrame:
    """path, doc of metric JSON files under root, by any of the patterns, each once. Files that don't
    parse, aren't objects, or are summaries themselves are left out."""
    found = None
    for p in patterns:
        part = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=p).select(F.col("_metadata.file_path").alias("path"), "value")
        found = part if found is None else found.union(part)
    found = found.dropDuplicates(["path"])
    parsed = found.select("path", F.from_json("value", METRIC_JSON).alias("doc"))
    return parsed.where("doc is not null and doc.aggregated is null and (doc.video is not null or doc.omegaprime is not null)")


def video_rows(documents: DataFrame) -> DataFrame:
    """path and the six scalars of documents with a video section, in percent."""
    v = lambda s, c: F.col("doc.video")[s][c]
    pct = lambda c: F.bround(c * 100, 2)
    return documents.where("doc.video is not null").select(
        "path",
        pct(v("compute_temporal_metrics", "Temporal Distortion Score (TDS)")).alias("tds"),
        v("compute_temporal_metrics", "Temporal Completeness (%)").alias("tcomp"),
        F.bround(100 - v("compute_duplicate_record_rate_video", "Duplicate Record Rate (%)"), 2).alias("dup"),
        pct(v("compute_sensor_consistency", "Composite SCI (0..1)")).alias("sci"),
        pct(v("compute_sensor_degradation", "Partial Blockage Score (0..1)")).alias("blk"),
        pct(v("compute_sensor_degradation", "FOV Change Score (0..1)")).alias("fov"),
    )


def log_rows(documents: DataFrame) -> DataFrame:
    """path, scalars and flags of documents with a trajectory-log section."""
    o = lambda s, c: F.col("doc.omegaprime")[s][c]
    checks = F.map_values(o("class_completeness", "case2_checks"))
    diversity = F.when(F.size(checks) > 0, F.bround(100.0 * F.size(F.filter(checks, lambda c: c)) / F.size(checks), 2))
    return documents.where("doc.omegaprime is not null").select(
        "path",
        o("attribute_completeness", "completeness_pct").alias("attr"),
        o("record_completeness", "completeness_pct").alias("rec"),
        o("format_consistency", "consistency_pct").alias("fmt"),
        o("duplicate_rate", "duplicate_rate_pct").alias("dup"),
        o("temporal_completeness", "completeness_pct").alias("tcomp"),
        diversity.alias("cls_pct"),
        F.bround((1 - o("trajectory_plausibility", "implausible_fraction")) * 100, 2).alias("traj_pct"),
        o("attribute_completeness", "passes_threshold").alias("attr_ok"),
        o("record_completeness", "passes_threshold").alias("rec_ok"),
        o("format_consistency", "passes_threshold").alias("fmt_ok"),
        o("duplicate_rate", "passes_threshold").alias("dup_ok"),
        o("temporal_completeness", "passes_threshold").alias("tcomp_ok"),
        o("class_completeness", "case2_passes").alias("cls"),
        o("object_type_coverage", "passes").alias("obj_cov"),
        o("trajectory_plausibility", "passes_threshold").alias("traj"),
        o("file_metadata", "passes").alias("fmeta"),
    )


def subtitle_spans(spark: SparkSession, path: str) -> DataFrame:
    """file, t0, t1: the first and last times in file order of subtitle files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    stamp = F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    times = whole.select("file", "line", F.when(stamp != "", stamp.try_cast("timestamp_ntz")).alias("t")).where("t is not null")
    return times.groupBy("file").agg(F.min_by("t", "line").alias("t0"), F.max_by("t", "line").alias("t1"))


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """sequence, path of the recordings VIDc_*.mp4 under root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "VIDc_*.mp4").load(root).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sequence"), "path")


def dataset_spec(text: str) -> dict[str, list[int] | None]:
    """Required and expected classes of a spec, names resolved to codes; empty lists are None."""
    spec = json.loads(text)
    names = {"required_types": OBJECT_TYPES, "expected_types": OBJECT_TYPES, "expected_subtypes": VEHICLE_SUBTYPES, "expected_roles": VEHICLE_ROLES}
    out: dict[str, list[int] | None] = {}
    for key, table in names.items():
        codes = []
        for v in spec.get(key) or []:
            if isinstance(v, int):
                codes.append(v)
            elif v in table:
                codes.append(table.index(v))
            else:
                raise ValueError(f"{key}: unknown name {v!r}")
        out[key] = codes or None
    return out


def service_levels(text: str) -> list[list]:
    """[[grade, upper bound], ...] in ascending order."""
    table = [[str(g), float(u)] for g, u in json.loads(text)]
    if not table or table != sorted(table, key=lambda x: x[1]):
        raise ValueError("grades must have ascending bounds")
    return table


def first_per_file(rows: DataFrame, order: str = "msg_seq") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(order))).where("_n = 1").drop("_n")
