"""Points in polygons by an equi-join on grid cells.

Polygons are spread over the cells of their bounding boxes, and each cell gathers its polygons once;
a sample then joins at most one row (a map's cells, which Spark broadcasts when they are small) and
tests that cell's candidates by ray casting in column expressions. Points on an edge are outside;
of overlapping polygons the smallest index wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 10.0


def _edges(ring: str = "ring") -> Column:
    ring_c = F.col(ring)
    after = F.concat(F.slice(ring_c, 2, F.size(ring_c)), F.slice(ring_c, 1, 1))
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.zip_with(ring_c, after, pair)


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Whether the ring of edges holds (x, y) strictly inside: an odd number of edges right of the
    point, and none through it."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"])
    on = lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(edges, on)


def cells(polygons: DataFrame, cell: float = CELL) -> DataFrame:
    """Per grid cell the polygons whose boxes meet it. polygons: lane_idx, ring of (x, y)."""
    box = polygons.select("lane_idx", _edges().alias("edges"), *(F.floor(f(F.transform("ring", lambda p: p[a])) / cell).alias(f"{a}{k}") for a in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))))
    spread = box.select("lane_idx", "edges", F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select("lane_idx", "edges", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    return spread.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("lane_idx", "edges"))).alias("near"))


def _near(samples: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    keyed = samples.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return keyed.join(cells(polygons, cell), ["cx", "cy"], "left")


def assign_lanes(samples: DataFrame, lanes: DataFrame, cell: float = CELL) -> DataFrame:
    """samples with lane_idx of the first lane that holds them, else null."""
    hit = F.filter("near", lambda p: contains(p["edges"], F.col("x"), F.col("y")))
    first = F.try_element_at(F.transform(hit, lambda p: p["lane_idx"]), F.lit(1))
    return _near(samples, lanes, cell).withColumn("lane_idx", first).drop("near", "cx", "cy")


def in_areas(samples: DataFrame, areas: DataFrame, name: str = "parking", cell: float = CELL) -> DataFrame:
    """samples with whether any area(lane_idx, ring) holds them."""
    hit = F.exists("near", lambda p: contains(p["edges"], F.col("x"), F.col("y")))
    return _near(samples, areas, cell).withColumn(name, F.coalesce(hit, F.lit(False))).drop("near", "cx", "cy")


def with_road(placed: DataFrame, lanes: DataFrame) -> DataFrame:
    """placed with the road and role of its lane; '' and off where it has none."""
    return placed.join(lanes.select("lane_idx", F.col("road_id").alias("road"), "role"), "lane_idx", "left").withColumns({"road": F.coalesce("road", F.lit("")), "role": F.coalesce("role", F.lit("off"))})


def ring_area(ring: str = "ring") -> Column:
    """Area of a simple ring."""
    cross = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(cross) / 2


def union_area(polygons: DataFrame, step: float = 0.25) -> DataFrame:
    """Area that a map's polygons cover together, by counting the points of a grid of `step` inside
    any of them; off by about the outline's length times step at most."""
    box = polygons.select(_edges().alias("edges"), *(F.floor(f(F.transform("ring", lambda p: p[a])) / step).alias(f"{a}{k}") for a in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))))
    spots = box.select("edges", F.explode(F.sequence("x0", "x1")).alias("ix"), "y0", "y1").select("edges", "ix", F.explode(F.sequence("y0", "y1")).alias("iy"))
    inside = spots.where(contains(F.col("edges"), (F.col("ix") + 0.5) * step, (F.col("iy") + 0.5) * step))
    return inside.select("ix", "iy").distinct().agg((F.count("*") * step * step).alias("area_m2"))
