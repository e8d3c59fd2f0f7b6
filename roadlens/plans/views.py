"""The driver's tables in the shapes that the metrics take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.functions.core import angle

TYPES = ["view", "click", "signup", "purchase", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as track samples: users are objects, values and props positions, sizes and angles."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    nanos = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) * 1000")
    kind = F.lit(None).cast("int")
    for i, t in enumerate(TYPES):
        kind = F.when(F.col("event_type") == t, i).otherwise(kind)
    d = lambda c: c.cast("double")
    k, v = d(F.col("k")), F.col("value")
    z = F.when(F.col("k") == 13, F.lit(None).cast("double")).when(F.col("k") == 17, F.lit(float("nan"))).otherwise(F.lit(0.0))
    return e.select(
        F.lit("events").alias("file"), nanos.alias("total_nanos"), F.col("user_id").alias("idx"), F.col("event_id").alias("msg_seq"),
        v.alias("x"), k.alias("y"), z.alias("z"),
        (v / 4).alias("vel_x"), (k / 4).alias("vel_y"), F.lit(0.0).alias("vel_z"), *(F.lit(0.0).alias(f"acc_{a}") for a in "xyz"),
        k.alias("length"), v.alias("width"), (k - 5).alias("height"), (v / 100).alias("roll"), (-v / 100).alias("pitch"), (k / 20 - 2).alias("yaw"),
        kind.alias("type"), (F.col("k") % 25).alias("subtype"), (F.col("k") % 12).alias("role"),
    )


TRACKS_SQL = """tracks AS (
  SELECT 'events' AS file, epoch_us(ts) * 1000 AS total_nanos, user_id AS idx, event_id AS msg_seq, value AS x, k::DOUBLE AS y,
    CASE WHEN k = 13 THEN NULL WHEN k = 17 THEN 'nan'::DOUBLE ELSE 0.0::DOUBLE END AS z,
    value / 4 AS vel_x, k / 4.0::DOUBLE AS vel_y, 0.0::DOUBLE AS vel_z, 0.0::DOUBLE AS acc_x, 0.0::DOUBLE AS acc_y, 0.0::DOUBLE AS acc_z,
    k::DOUBLE AS length, value AS width, k::DOUBLE - 5 AS height, value / 100 AS roll, -value / 100 AS pitch, k::DOUBLE / 20 - 2 AS yaw,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS type,
    k % 25 AS subtype, k % 12 AS role
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as traffic samples: one frame per hour, at most one sample of a user and frame; roads
    by event type ('' for error), a ring angle from the position about (40, 50)."""
    t = tracks(spark, sf_dir)
    hour = F.floor((F.col("total_nanos") - F.lit(1704067200000000000)) / F.lit(3600000000000)).cast("int")
    road = F.lit("")
    for i, r in enumerate(["A", "B", "C", "D"]):
        road = F.when(F.col("type") == i, r).otherwise(road)
    group = F.when(F.col("subtype") < 10, "car").when(F.col("subtype") < 20, "truck").otherwise("other")
    rows = t.withColumn("frame", hour).groupBy("frame", F.col("idx").alias("id")).agg(F.min(F.struct("total_nanos", "msg_seq", "x", "y", "vel_x", "vel_y", "type", "subtype")).alias("s")).select("frame", "id", "s.*")
    return rows.select(
        F.lit("events").alias("scene"), "frame", "id", "x", "y", F.lit(4.0).alias("length"), F.lit(2.0).alias("width"),
        (F.col("vel_x") - 10).alias("vx"), (F.col("vel_y") - 10).alias("vy"), group.alias("vclass"), road.alias("road"),
        angle(F.col("y") - 50, F.col("x") - 40).alias("phi"),
    ).withColumn("speed", F.hypot("vx", "vy"))


SCENE_SQL = TRACKS_SQL + """,
scene AS (
  SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (
    SELECT 'events' AS scene, frame, idx AS id, x, y, 4.0::DOUBLE AS length, 2.0::DOUBLE AS width, vel_x - 10 AS vx, vel_y - 10 AS vy,
      CASE WHEN subtype < 10 THEN 'car' WHEN subtype < 20 THEN 'truck' ELSE 'other' END AS vclass,
      CASE type WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE '' END AS road, atan2(y - 50, x - 40) AS phi
    FROM (SELECT *, CAST(floor((total_nanos - 1704067200000000000)::DOUBLE / 3600000000000) AS INT) AS frame FROM tracks)
    QUALIFY row_number() OVER (PARTITION BY frame, idx ORDER BY total_nanos, msg_seq) = 1))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events and embeddings as feature rows of frames, a video per event type or label."""
    e = table(spark, sf_dir, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(1e6)
    return e.select(F.col("event_type").alias("video"), F.col("event_id").alias("frame_no"), seconds.alias("ts"), F.col("value").alias("brightness"), F.get_json_object("props", "$.k").cast("double").alias("laplacian_variance"))


FEATURES_SQL = """features AS (
  SELECT event_type AS video, event_id AS frame_no, epoch_us(ts) / 1e6::DOUBLE AS ts, value AS brightness, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS laplacian_variance
  FROM events)"""


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames: normalised absolute components as histograms, three as channels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("video"), F.col("vec_id").alias("frame_no"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + x)
    at = lambda i: F.get("h", F.lit(i)) * 100
    return e.select("video", "frame_no", F.transform("h", lambda x: x / total).alias("hist"), at(0).alias("mean_b"), at(1).alias("mean_g"), at(2).alias("mean_r"))


HISTOGRAMS_SQL = """hv AS (SELECT CAST(label AS VARCHAR) AS video, vec_id AS frame_no, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS h FROM embeddings),
histograms AS (SELECT video, frame_no, list_transform(h, lambda x: x / list_sum(h)) AS hist, h[1] * 100 AS mean_b, h[2] * 100 AS mean_g, h[3] * 100 AS mean_r FROM hv)"""


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer segment and month as per-file metric rows, with missing values."""
    o = table(spark, sf_dir, "orders").withColumn("k", (F.col("o_orderkey") % 97).cast("double"))
    some = lambda c, p: F.when(F.col("o_orderkey") % p != 0, c)
    return o.select(
        F.concat(F.lit("recordings/session-"), F.col("o_orderkey").cast("string"), F.lit("/metrics-of-this-file.json")).alias("path"),
        some(F.col("k") + 3, 7).alias("tds"), some(F.col("k") + 4, 5).alias("tcomp"), some(100 - F.col("k") / 50, 11).alias("dup"),
        some(F.col("k"), 13).alias("sci"), some(F.col("k") / 2 + 50, 3).alias("blk"), some(100 - F.col("k"), 17).alias("fov"),
        some(F.col("o_totalprice") > 100000, 4).alias("rec_ok"), some(F.col("o_orderstatus") == "O", 6).alias("fmt_ok"),
        some(F.col("k") > 20, 9).alias("dup_ok"), some(F.col("k") < 90, 10).alias("tcomp_ok"),
    )


METRIC_ROWS_SQL = """metric_rows AS (
  SELECT 'recordings/session-' || o_orderkey || '/metrics-of-this-file.json' AS path,
    CASE WHEN o_orderkey % 7 <> 0 THEN k + 3 END AS tds, CASE WHEN o_orderkey % 5 <> 0 THEN k + 4 END AS tcomp, CASE WHEN o_orderkey % 11 <> 0 THEN 100 - k / 50 END AS dup,
    CASE WHEN o_orderkey % 13 <> 0 THEN k END AS sci, CASE WHEN o_orderkey % 3 <> 0 THEN k / 2 + 50 END AS blk, CASE WHEN o_orderkey % 17 <> 0 THEN 100 - k END AS fov,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice > 100000 END AS rec_ok, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus = 'O' END AS fmt_ok,
    CASE WHEN o_orderkey % 9 <> 0 THEN k > 20 END AS dup_ok, CASE WHEN o_orderkey % 10 <> 0 THEN k < 90 END AS tcomp_ok
  FROM (SELECT *, (o_orderkey % 97)::DOUBLE AS k FROM orders))"""
