"""Road maps: OpenDRIVE XML to lanes, parking areas, junctions and roles.

The XML is read with explicit schemas (ids are strings); lane geometry is sampled in Python, one road
at a time; roles and everything after are column expressions on a map's few hundred lanes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 1.0
RING_LEAST = 0.75
SECTORS_LEAST = 0.75

_POLY = "STRUCT<_aU: DOUBLE, _bU: DOUBLE, _cU: DOUBLE, _dU: DOUBLE, _aV: DOUBLE, _bV: DOUBLE, _cV: DOUBLE, _dV: DOUBLE, _pRange: STRING>"
_GEOMETRY = f"ARRAY<STRUCT<_s: DOUBLE, _x: DOUBLE, _y: DOUBLE, _hdg: DOUBLE, _length: DOUBLE, line: STRING, paramPoly3: {_POLY}, arc: STRUCT<_curvature: DOUBLE>, spiral: STRUCT<_curvStart: DOUBLE, _curvEnd: DOUBLE>>>"
_LANES = "STRUCT<lane: ARRAY<STRUCT<_id: INT, _type: STRING, width: ARRAY<STRUCT<_sOffset: DOUBLE, _a: DOUBLE, _b: DOUBLE, _c: DOUBLE, _d: DOUBLE>>>>>"
_OBJECTS = "STRUCT<object: ARRAY<STRUCT<_id: STRING, _type: STRING, _s: DOUBLE, _t: DOUBLE, _hdg: DOUBLE, outline: STRUCT<cornerLocal: ARRAY<STRUCT<_u: DOUBLE, _v: DOUBLE>>>>>>"
ROAD = f"_id STRING, _junction STRING, planView STRUCT<geometry: {_GEOMETRY}>, lanes STRUCT<laneSection: ARRAY<STRUCT<_s: DOUBLE, left: {_LANES}, right: {_LANES}>>>, objects {_OBJECTS}"
HEADER = "geoReference STRING, offset STRUCT<_x: DOUBLE, _y: DOUBLE, _z: DOUBLE, _hdg: DOUBLE>"
JUNCTION = "_id STRING, _name STRING"
LANE = "road_id string, lane_id int, junction string, length_m double, centerline array<struct<x: double, y: double>>, ring array<struct<x: double, y: double>>"
PARKING = "ring array<struct<x: double, y: double>>"


def read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of one element (road, header, junction) of a map file, whatever namespace prefix its
    elements have."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def from_text(texts: DataFrame, column: str = "xml") -> DataFrame:
    """Roads of maps held as text: one row per road, with the other columns."""
    doc = f"header STRUCT<{HEADER.replace(' STRING', ': STRING', 1).replace('offset STRUCT', 'offset: STRUCT')}>, road ARRAY<STRUCT<_id: STRING, _junction: STRING, planView: STRUCT<geometry: {_GEOMETRY}>, lanes: STRUCT<laneSection: ARRAY<STRUCT<_s: DOUBLE, left: {_LANES}, right: {_LANES}>>>, objects: {_OBJECTS}>>"
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.explode(F.from_xml(F.col(column), doc, {"ignoreNamespace": "true"})["road"]).alias("r")).select(*others, "r.*")


def base_crs(reference: str):
    """A projection string without its local origin terms."""
    return F.trim(F.regexp_replace(F.col(reference), r"\s*\+(lat|lon)_0=[0-9.eE+\-]+", ""))


def reference_line(geometry) -> np.ndarray:
    """Rows (s, x, y, heading) of a road's reference line, every STEP metres and at segment ends."""
    out = []
    for g in geometry:
        n = max(1, int(np.ceil(g["_length"] / STEP)))
        d = np.linspace(0.0, g["_length"], n + 1)
        c, s = np.cos(g["_hdg"]), np.sin(g["_hdg"])
        poly = g["paramPoly3"]
        if poly is not None:
            p = d if poly["_pRange"] == "arcLength" else d / g["_length"]
            u, v = (sum((poly[f"_{k}{a}"] or 0.0) * p**i for i, k in enumerate("abcd")) for a in "UV")
            du, dv = (sum(i * (poly[f"_{k}{a}"] or 0.0) * p ** (i - 1) for i, k in enumerate("abcd") if i) for a in "UV")
            x, y, h = g["_x"] + u * c - v * s, g["_y"] + u * s + v * c, g["_hdg"] + np.arctan2(dv, du)
        elif g["arc"] is not None or g["spiral"] is not None:
            ends = (g["arc"]["_curvature"],) * 2 if g["arc"] is not None else (g["spiral"]["_curvStart"], g["spiral"]["_curvEnd"])
            x, y, h = _bent(g, d, *((k or 0.0) for k in ends))
        else:
            x, y, h = g["_x"] + d * c, g["_y"] + d * s, np.full(len(d), g["_hdg"])
        part = np.stack([g["_s"] + d, x, y, h], axis=1)
        out.append(part if not out else part[1:])
    return np.concatenate(out)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(6)


def _bent(g, d: np.ndarray, k0: float, k1: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, heading) at the distances d (from 0 on) along a segment whose curvature goes linearly
    from k0 to k1: an arc where they are equal, else a spiral. Headings are exact, and places their
    integrals by quadrature between neighbouring distances."""
    turn = lambda t: g["_hdg"] + k0 * t + (k1 - k0) * t * t / (2 * g["_length"])
    half = np.diff(d) / 2
    angle = turn((d[:-1] + half)[:, None] + half[:, None] * _NODES)
    place = lambda start, f: start + np.r_[0.0, np.cumsum((f(angle) * _WEIGHTS).sum(axis=1) * half)]
    return place(g["_x"], np.cos), place(g["_y"], np.sin), turn(d)


def _width(widths, ds: np.ndarray, polynomial: bool) -> np.ndarray:
    if not polynomial:
        return np.full(len(ds), widths[0]["_a"])
    out = np.zeros(len(ds))
    for w in widths:
        t = ds - w["_sOffset"]
        out = np.where(t >= 0, w["_a"] + w["_b"] * t + w["_c"] * t**2 + w["_d"] * t**3, out)
    return out


def _points(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def lanes(roads: DataFrame, polynomial_width: bool = False) -> DataFrame:
    """Driving lanes of roads, with centre lines and outlines. Bands lie outward from the reference
    line, each as wide as its lane's first width (or its width polynomial)."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                line = reference_line(r["planView"]["geometry"])
                sections = r["lanes"]["laneSection"]
                for k, section in enumerate(sections):
                    end = sections[k + 1]["_s"] if k + 1 < len(sections) else np.inf
                    own = line[(line[:, 0] >= section["_s"] - 1e-9) & (line[:, 0] <= end + 1e-9)]
                    if len(own) < 2:
                        continue
                    normal = np.stack([-np.sin(own[:, 3]), np.cos(own[:, 3])], axis=1)
                    for side, sign in (("left", 1), ("right", -1)):
                        inner = np.zeros(len(own))
                        for lane in sorted((section[side] or {}).get("lane") if section[side] is not None and section[side]["lane"] is not None else [], key=lambda x: abs(x["_id"])):
                            wide = lane["width"]
                            width = _width(wide, own[:, 0] - section["_s"], polynomial_width) if wide is not None and len(wide) else np.zeros(len(own))
                            outer = inner + width
                            if lane["_type"] == "driving":
                                at = lambda o: own[:, 1:3] + sign * o[:, None] * normal  # noqa: B023, E731
                                centre = at((inner + outer) / 2)
                                length = float(np.hypot(*np.diff(centre, axis=0).T).sum())
                                rows.append((r["_id"], int(lane["_id"]), r["_junction"] or "-1", length, _points(centre), _points(np.r_[at(outer), at(inner)[::-1]])))
                            inner = outer
            yield pd.DataFrame(rows, columns=["road_id", "lane_id", "junction", "length_m", "centerline", "ring"])

    return roads.select("_id", "_junction", "planView", "lanes").mapInPandas(run, LANE)


def parking_areas(roads: DataFrame) -> DataFrame:
    """Outlines of parking objects, placed at their roads' (s, t) and heading."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                found = r["objects"]["object"] if r["objects"] is not None else None
                for o in found if found is not None else []:
                    if o["_type"] != "parking" or o["outline"] is None:
                        continue
                    line = reference_line(r["planView"]["geometry"])
                    x, y, h = (np.interp(o["_s"], line[:, 0], line[:, c]) for c in (1, 2, 3))
                    x, y, turn = x - o["_t"] * np.sin(h), y + o["_t"] * np.cos(h), h + (o["_hdg"] or 0.0)
                    corners = np.array([(c["_u"], c["_v"]) for c in o["outline"]["cornerLocal"]])
                    c, s = np.cos(turn), np.sin(turn)
                    rows.append((_points(np.stack([x + corners[:, 0] * c - corners[:, 1] * s, y + corners[:, 0] * s + corners[:, 1] * c], axis=1)),))
            yield pd.DataFrame(rows, columns=["ring"])

    return roads.select("planView", "objects").mapInPandas(run, PARKING)


def numbered(lane_rows: DataFrame) -> DataFrame:
    """lanes with lane_idx in order of road and lane (a map's lanes)."""
    from pyspark.sql import Window

    return lane_rows.withColumn("lane_idx", F.row_number().over(Window.orderBy("road_id", F.abs("lane_id"), "lane_id")) - 1)


def _circumferential(lane_rows: DataFrame, cx, cy) -> DataFrame:
    """road_id, circ: each road's mean share of its lanes' lengths that runs around (cx, cy)."""
    line = F.col("centerline")
    seg = lane_rows.select("road_id", "lane_id", F.inline(F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    mx, my = (F.col("x1") + F.col("x2")) / 2 - cx, (F.col("y1") + F.col("y2")) / 2 - cy
    along = F.coalesce(F.try_divide(F.abs((F.col("x2") - F.col("x1")) * mx + (F.col("y2") - F.col("y1")) * my), F.hypot(mx, my)), F.lit(0.0))
    per_lane = seg.groupBy("road_id", "lane_id").agg(F.coalesce(1 - F.try_divide(F.sum(along), F.sum(length)), F.lit(0.0)).alias("circ"))
    return per_lane.groupBy("road_id").agg(F.avg("circ").alias("circ"))


def _centre(lane_rows: DataFrame) -> tuple[float, float] | None:
    p = lane_rows.select(F.explode("centerline").alias("p")).agg(F.avg("p.x"), F.avg("p.y")).first()
    return None if p[0] is None else (p[0], p[1])


def _roles(lane_rows: DataFrame, centre) -> DataFrame:
    circ = _circumferential(lane_rows, *map(F.lit, centre))
    role = F.when(F.col("circ") >= RING_LEAST, "ring").when(F.col("junction") == "-1", "approach").otherwise("normal")
    return lane_rows.drop("role", "circ").join(circ, "road_id").withColumn("role", role)


def classify(lane_rows: DataFrame) -> tuple[DataFrame, bool, tuple[float, float]]:
    """(lanes with role, whether there is a roundabout, its centre): ring lanes run around the
    centre of all lanes, then of the ring; a ring must come by three quarters of all directions."""
    centre = _centre(lane_rows)
    if centre is None:
        raise ValueError("the map has no driving lanes")
    roles = _roles(lane_rows, centre)
    better = _centre(roles.where("role = 'ring'"))
    if better is not None:
        centre = better
        roles = _roles(lane_rows, centre)
    points = roles.where("role = 'ring'").select(F.explode("centerline").alias("p"))
    sector = F.floor((F.atan2(F.col("p.y") - centre[1], F.col("p.x") - centre[0]) + F.pi()) / (F.pi() / 18))
    detected = points.agg(F.count_distinct(sector)).first()[0] / 36.0 >= SECTORS_LEAST
    if not detected:
        demoted = F.when(F.col("junction") == "-1", "approach").otherwise("normal")
        roles = roles.withColumn("role", F.when(F.col("role") == "ring", demoted).otherwise(F.col("role")))
    return roles, detected, centre


def approach_angles(lane_rows: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """road, theta: the direction from the centre of each approach's nearest centre-line point."""
    p = lane_rows.where("role = 'approach'").select("road_id", "lane_id", F.posexplode("centerline").alias("i", "p"))
    dx, dy = F.col("p.x") - centre[0], F.col("p.y") - centre[1]
    return p.groupBy(F.col("road_id").alias("road")).agg(F.min_by(F.atan2(dy, dx), F.struct(F.hypot(dx, dy), "lane_id", "i")).alias("theta"))
