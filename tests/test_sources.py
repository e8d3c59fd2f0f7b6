"""Readers and reports: files written here, read back."""

import bz2
import gzip
import io
import json
import lzma
import struct
import zipfile

import pytest

from roadlens.operators import summary
from roadlens.plans import reports
from roadlens.sources import documents, mcap


def proto():
    """A descriptor set with the fields that the reader looks for, and a maker of messages."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    f = descriptor_pb2.FileDescriptorProto(name="log.proto", package="t", syntax="proto3")
    kind = descriptor_pb2.FieldDescriptorProto

    def message(name, **fields):
        m = f.message_type.add(name=name)
        for k, (field, spec) in enumerate(fields.items(), 1):
            many = spec.startswith("*")
            spec = spec.lstrip("*")
            d = m.field.add(name=field, number=k, label=kind.LABEL_REPEATED if many else kind.LABEL_OPTIONAL)
            if spec in ("double", "int64", "int32", "string"):
                d.type = getattr(kind, f"TYPE_{spec.upper()}")
            else:
                d.type, d.type_name = kind.TYPE_MESSAGE, f".t.{spec}"

    message("Xyz", x="double", y="double", z="double")
    message("Size", length="double", width="double", height="double")
    message("Turn", roll="double", pitch="double", yaw="double")
    message("Base", position="Xyz", velocity="Xyz", acceleration="Xyz", dimension="Size", orientation="Turn")
    message("Id", value="int64")
    message("Vehicle", type="int32", role="int32")
    message("Moving", id="Id", base="Base", type="int32", vehicle_classification="Vehicle")
    message("Time", seconds="int64", nanos="int32")
    message("Frame", position="Xyz", yaw="double")
    message("LightKind", color="int32", mode="int32", icon="int32")
    message("Light", classification="LightKind")
    message("Version", version_major="int32", version_minor="int32", version_patch="int32")
    message("Truth", timestamp="Time", moving_object="*Moving", proj_frame_offset="Frame", traffic_light="*Light", country_code="int32", proj_string="string", host_vehicle_id="Id", version="Version")
    message("Map", open_drive_xml_content="string")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    make = lambda n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"t.{n}"))
    return descriptor_pb2.FileDescriptorSet(file=[f]).SerializeToString(), make


def record(op, body):
    return bytes([op]) + struct.pack("<Q", len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def write_log(path, codec, xml, chunks=1, indexed=False, counted=40):
    """A log of 40 messages and a map in so many chunks, with a summary of them if indexed."""
    import pyarrow as pa

    schema, make = proto()
    truth, mapped = make("Truth"), make("Map")
    setup = b"".join(record(3, struct.pack("<H", k) + text(f"t.{n}") + text("protobuf") + struct.pack("<I", len(schema)) + schema) for k, n in ((1, "Truth"), (2, "Map")))
    setup += b"".join(record(4, struct.pack("<HH", k, k) + text(topic) + text("protobuf") + struct.pack("<I", 0)) for k, topic in ((1, "ground_truth"), (2, "ground_truth_map")))
    bodies = []
    for k in range(40):
        m = truth()
        m.timestamp.seconds, m.timestamp.nanos = 100 + k // 10, k % 10 * 100_000_000
        m.proj_frame_offset.position.x, m.country_code, m.proj_string = 10.0, 752, "+proj=utm"
        m.host_vehicle_id.value, m.version.version_minor = 1, 8
        for i in (1, 2):
            o = m.moving_object.add(type=2)
            o.id.value = i
            o.base.position.x, o.base.position.y, o.base.velocity.x = 0.2 * k + i, 1.5, 2.0
            o.base.dimension.length, o.base.dimension.width, o.base.dimension.height = 4.0, 2.0, 1.5
            o.vehicle_classification.type, o.vehicle_classification.role = 4 if i == 1 else 12, 2
        m.traffic_light.add().classification.color = 2 + k % 2
        data = m.SerializeToString()
        bodies.append((1, record(5, struct.pack("<HIQQ", 1, k, 0, 0) + data)))
    bodies.append((2, record(5, struct.pack("<HIQQ", 2, 0, 0, 0) + mapped(open_drive_xml_content=xml).SerializeToString())))
    out, summary_part, per = mcap.MAGIC + record(1, text("") + text("")) + setup, b"", -(-41 // chunks)
    for x in range(0, 41, per):
        some = bodies[x : x + per]
        body = b"".join(b for _, b in some)
        packed = body if not codec else pa.Codec(codec).compress(body, asbytes=True)
        at, chunk = len(out), record(6, struct.pack("<QQQI", 0, 0, len(body), 0) + text(codec) + struct.pack("<Q", len(packed)) + packed)
        own = sorted({c for c, _ in some})
        index = b"".join(record(7, struct.pack("<HI", c, 16 * n) + b"\0" * 16 * n) for c in own for n in [sum(o == c for o, _ in some)])
        places = b"".join(struct.pack("<HQ", c, 0) for c in own)
        summary_part += record(8, struct.pack("<QQQQI", 0, 0, at, len(chunk), len(places)) + places + struct.pack("<Q", len(index)) + text(codec) + struct.pack("<QQ", len(packed), len(body)))
        out += chunk + index * indexed
    out += record(0x0F, b"\0" * 4)
    start = len(out) if indexed else 0
    if indexed:
        totals = struct.pack("<HQHQ", 1, counted, 2, 1)
        out += setup + record(0x0B, struct.pack("<QHIIIIQQ", counted + 1, 2, 2, 0, 0, chunks, 0, 0) + struct.pack("<I", len(totals)) + totals) + summary_part
    path.write_bytes(out + record(2, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC)


@pytest.mark.parametrize("codec", ["", "lz4", "zstd"])
def test_large_logs_are_dealt_by_chunks(spark, tmp_path, monkeypatch, codec):
    """Tasks of runs of chunks give the rows of one task; a summary that misses messages isn't trusted."""
    from pyspark.sql.types import StructType

    for name, options in {"plain": {"chunks": 7}, "indexed": {"chunks": 7, "indexed": True}, "short": {"chunks": 7, "indexed": True, "counted": 41}}.items():
        write_log(tmp_path / f"{name}.mcap", codec, XML, **options)

    def rows(name, table, split):
        monkeypatch.setattr(mcap, "SPLIT", split)
        reader = mcap._Reader([str(tmp_path / f"{name}.mcap")], table, StructType.fromDDL(mcap.SCHEMAS[table]))
        parts = reader.partitions()
        return len(parts), [{**r, "file": ""} for p in parts for b in reader.read(p) for r in b.to_pylist()]

    for table, n in (("samples", 80), ("lights", 40), ("header", 1), ("map", 1)):
        tasks, want = rows("plain", table, 1 << 20)
        assert tasks == 1 and len(want) == n
        assert rows("plain", table, 1) == (1, want) and rows("short", table, 1) == (1, want)
        assert rows("indexed", table, 1) == (7 if n > 1 else 1, want)
        tasks, got = rows("indexed", table, 4000)
        assert got == want and (n == 1 or 1 < tasks < 7)


XML = """<?xml version='1.0'?><OpenDRIVE xmlns="http://x"><header><offset x="10" y="0" z="0" hdg="0"/></header>
<road id="7" junction="-1"><planView><geometry s="0" x="0" y="0" hdg="0" length="30"><line/></geometry></planView>
<lanes><laneSection s="0"><left><lane id="1" type="driving"><width sOffset="0" a="3" b="0" c="0" d="0"/></lane></left></laneSection></lanes></road></OpenDRIVE>"""


@pytest.mark.parametrize("codec", ["", "zstd", "lz4"])
def test_trajectory_log(spark, tmp_path, codec):
    path = tmp_path / "a.mcap"
    write_log(path, codec, XML)
    mcap.register(spark)
    read = lambda table: spark.read.format("trajectory_log").option("table", table).load(str(path))
    s = read("samples")
    assert s.count() == 80 and s.agg({"total_nanos": "max"}).first()[0] == 103_900_000_000
    h = read("header").first()
    assert (h.country_code, h.proj_string, h.host_vehicle_id, tuple(h.version)) == ("752", "+proj=utm", 1, (0, 8, 0))
    assert sorted(r.color for r in read("lights").select("color").distinct().collect()) == [2, 3]
    assert read("map").first().xml == XML
    v = mcap.traffic_view(s).where("id = 1").orderBy("total_nanos").first()
    assert (v.x, v.y, v.vclass) == (11.0, 1.5, "car")


def test_folders_and_patterns_of_logs(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    names = ["d/a.mcap", "d/b.mcap", "d/e/c.mcap", "d/note.txt"]
    for n in names:
        write_log(tmp_path / n, "", XML)
    at = lambda *some: [f"{tmp_path}/{n}" for n in some]
    assert mcap.files_of(f"{tmp_path}/d") == at(*names[:3])
    assert mcap.files_of(f"{tmp_path}/d/*.mcap") == at(*names[:2]) and mcap.files_of(f"{tmp_path}/d/*/c.mcap") == at(names[2])
    assert mcap.files_of(f"{tmp_path}/d/[b].mcap,{tmp_path}/d/a.mcap") == at(names[1], names[0])
    mcap.register(spark)
    assert spark.read.format("trajectory_log").load(f"{tmp_path}/d").count() == 240


def test_prefixed_maps(spark, tmp_path):
    import re

    from roadlens.sources import opendrive

    plain, prefixed = tmp_path / "a.xodr", tmp_path / "b.xodr"
    plain.write_text(XML)
    prefixed.write_text(re.sub(r"(</?)(?=\w)", r"\1od:", XML).replace('xmlns="', 'xmlns:od="'))
    found = [opendrive.lanes(opendrive.read(spark, str(p), "road", opendrive.ROAD)).collect() for p in (plain, prefixed)]
    assert len(found[0]) == 1 and found[0] == found[1]
    assert opendrive.read(spark, str(prefixed), "header", opendrive.HEADER).first().offset._x == 10.0
    t = json.loads(reports.traffic_report(spark, log=_log(tmp_path), map_path=str(prefixed)))
    assert t["network"]["objects"] == 2


def _log(folder):
    write_log(folder / "own.mcap", "", XML)
    return str(folder / "own.mcap")


def test_arcs_and_spirals():
    import numpy as np

    from roadlens.sources.opendrive import reference_line

    def segment(**shape):
        return {"_s": 0.0, "_x": 1.0, "_y": 2.0, "_hdg": 0.3, "_length": 50.0, "paramPoly3": None, "arc": None, "spiral": None, **shape}

    line = reference_line([segment(arc={"_curvature": 0.02})])
    s = line[:, 0]
    assert np.allclose(line[:, 1], 1 + (np.sin(0.3 + 0.02 * s) - np.sin(0.3)) / 0.02) and np.allclose(line[:, 2], 2 - (np.cos(0.3 + 0.02 * s) - np.cos(0.3)) / 0.02)
    same = reference_line([segment(spiral={"_curvStart": 0.02, "_curvEnd": 0.02})])
    assert np.allclose(same, line) and np.allclose(reference_line([segment(arc={"_curvature": 0.0})])[-1], [50, 1 + 50 * np.cos(0.3), 2 + 50 * np.sin(0.3), 0.3])
    bent = reference_line([segment(spiral={"_curvStart": -0.01, "_curvEnd": 0.05})])
    t = np.linspace(0, 50, 200_001)
    angle = 0.3 - 0.01 * t + 0.06 / 100 * t * t
    assert np.allclose(bent[-1, 1:3], [1 + np.trapezoid(np.cos(angle), t), 2 + np.trapezoid(np.sin(angle), t)], atol=1e-6) and np.isclose(bent[-1, 3], angle[-1])


def test_reports(spark, tmp_path):
    path = tmp_path / "a.mcap"
    write_log(path, "zstd", XML)
    out = list(json.loads(reports.log_report(spark, str(path), '{"required_types": ["TYPE_VEHICLE", 3]}')).values())[0]
    assert out["temporal_completeness"]["completeness_pct"] == 100.0 and out["attribute_completeness"]["passes_threshold"]
    assert out["object_type_coverage"]["missing_types"] == ["TYPE_PEDESTRIAN"] and out["lights_color"]["observed"] == ["COLOR_RED", "COLOR_YELLOW"]
    t = json.loads(reports.traffic_report(spark, log=str(path), series=True))
    assert t["network"]["objects"] == 2 and abs(t["network"]["speed_km_per_h"] - 7.2) < 1e-6
    assert t["data_quality"]["off_lane_fraction"] == 0.0 and t["roundabout"] == {"detected": False}
    assert [r["vclass"] for r in t["by_type"]] == ["bus", "car"] and len(t["series"]["density"]["series"]) == 40
    assert "error" in json.loads(reports.traffic_report(spark))


LABEL = {"openlabel": {"objects": {"7": {"type": "Car"}, "8": {"type": "Boat"}}, "frames": {str(f): {"objects": {"7": {"object_data": {"cuboid": [{"val": [f * 1.0, 1.5, 0, 0, 0, 0.1, 4.5, 1.8, 1.5]}]}}, "8": {"object_data": {}}}} for f in range(60)}}}


def test_compressed_openlabel(spark, tmp_path):
    raw = json.dumps(LABEL).encode()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("readme.txt", "x")
        f.writestr("a.json", raw)
    for name, data in {"a": raw, "b": gzip.compress(raw), "c": bz2.compress(raw), "d": lzma.compress(raw), "e": z.getvalue()}.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    rows = documents.openlabel(documents.texts(spark, str(tmp_path))).collect()
    assert len(rows) == 300 and {(r.id, r.vclass, r.length) for r in rows} == {(7, "car", 4.5)}
    (tmp_path / "m.xodr").write_text(XML)
    t = json.loads(reports.traffic_report(spark, openlabel=str(tmp_path / "b.bin"), map_path=str(tmp_path / "m.xodr")))
    assert t["data_quality"]["n_objects"] == 1 and t["data_quality"]["samples_kept_fraction"] == 1.0


def test_metric_documents(spark, tmp_path):
    v = {"compute_temporal_metrics": {"Temporal Distortion Score (TDS)": 0.91, "Temporal Completeness (%)": 99.0}, "compute_duplicate_record_rate_video": {"Duplicate Record Rate (%)": 2.5}, "compute_sensor_consistency": {"error": "x"}}
    o = {"record_completeness": {"completeness_pct": 90.0, "passes_threshold": False}, "class_completeness": {"case2_passes": True, "case2_checks": {"type": True, "role": False}}, "trajectory_plausibility": {"implausible_fraction": 0.25, "passes_threshold": False}}
    (tmp_path / "sub").mkdir()
    for name, doc in {"v": {"video": v}, "sub/o": {"omegaprime": o}, "both": {"video": v, "omegaprime": o}, "none": {"x": 1}, "old": {"aggregated": {}, "video": v}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "broken.json").write_text("{")
    docs = documents.metric_documents(spark, str(tmp_path), ("*.json", "v*.json"))
    assert docs.count() == 3
    r = documents.video_rows(docs).first()
    assert (r.tds, r.tcomp, r.dup, r.sci) == (91.0, 99.0, 97.5, None)
    r = documents.log_rows(docs).first()
    assert (r.rec, r.rec_ok, r.cls_pct, r.traj_pct, r.fmt_ok) == (90.0, False, 50.0, 75.0, None)
    for official in (False, True):
        said, doc = reports.dataset_report(spark, str(tmp_path), official=official)
        assert "Rec↓" in said and "✗ 0/2" in said
        lines = [line.split() for line in said.splitlines()]
        assert ["Attribute", "Completeness", "—", "—", "—", "=100%"] in lines  # a metric without values
        assert ("FilM" in said) is official and "File Metadata" not in said
        own = next(line for line in lines if line and line[0] == "sub/o.json")
        assert own[1:] == ["—", "90.0", "—", "—", "—", *(["✓", "—", "✗", "—"] if official else []), *(["Rec↓,", "Traj↓"] if official else ["Rec↓"])]
        assert [line[1:] for line in lines if line and line[0] == "v.json"] == [["99.0", "97.50", "—", "91.0", "—", "—", "TDS↓,", "Dup↓"] if official else ["91.0", "99.0", "97.5", "—", "—", "—", "TDS↓,", "Dup↓"]]
        assert json.loads(doc)["aggregated"]["video"]["dup"]["n"] == 2 and len(json.loads(doc)["rows"]) == 4


def test_summary_lines(spark):
    keys = ["attr", "rec", "fmt", "dup", "tcomp", "cls_pct", "traj_pct"]
    flags = ["attr_ok", "rec_ok", "fmt_ok", "dup_ok", "tcomp_ok", "cls", "obj_cov", "traj", "fmeta"]
    schema = "path string, " + ", ".join([f"{k} double" for k in keys] + [f"{k} boolean" for k in flags])
    rows = [("a", *[50.0] * 7, *[True] * 8, f) for f in (True, False)]
    logs = spark.createDataFrame(rows, schema)
    videos = spark.createDataFrame([], "path string, tds double, tcomp double, dup double, sci double, blk double, fov double")
    said = summary.report("r", videos, logs, 2)
    assert "File Metadata [custom]" in said and "~ 1/2" in said and "Video (" not in said
    assert "Trajectory logs" not in summary.report("r", videos, logs.limit(0), 0)


def test_subtitles_streams_specs(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00 --> 00:01\n2025-10-16 07:10:00.500 x\n\n2025-13-99 00:00:00\n2025-10-16 07:40:00\n")
    r = documents.subtitle_spans(spark, str(tmp_path / "a.srt")).first()
    assert (r.t0.minute, r.t1.minute) == (10, 40)
    from roadlens.operators import video

    w = video.window_coverage(documents.subtitle_spans(spark, str(tmp_path / "a.srt")), [("07:00", "07:30"), ("08:00", "08:00")]).collect()
    assert len(w) == 1 and round(w[0].overlap_minutes, 2) == 19.99
    (tmp_path / "s1").mkdir()
    for n in ("VIDc_1_D.mp4", "VIDc_1_t.mp4", "other_D.mp4"):
        (tmp_path / "s1" / n).write_bytes(b"x")
    r = video.stream_coverage(documents.stream_files(spark, str(tmp_path)), ("V", "T", "L")).first()
    assert (r.sequence, r.present, r.missing, r.coverage_pct) == ("s1", ["D", "T"], ["L"], 66.7)
    assert documents.dataset_spec('{"expected_roles": ["ROLE_CIVIL", 3]}')["expected_roles"] == [2, 3]
    with pytest.raises(ValueError):
        documents.dataset_spec('{"required_types": ["BOAT"]}')
    with pytest.raises(ValueError):
        documents.service_levels('[["A", 5], ["B", 1]]')


def test_provenance(tmp_path):
    path = reports.write_provenance("/a/b.mp4", str(tmp_path / "q.json"), {"scale_change": True, "border_intrusion": False})
    doc = json.loads((tmp_path / "DPR_q.json").read_text())
    assert path.endswith("DPR_q.json") and doc["warnings"] == ["scale_change"] and doc["inputs"] == ["/a/b.mp4"]
