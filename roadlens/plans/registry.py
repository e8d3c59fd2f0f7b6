"""Named queries over the driver's tables and their SQL oracles.

A query applies one operator to a table shaped as the operator's input (views.py); its oracle says the
same in SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions import taxonomies as T
from roadlens.functions.core import entropy_of, gini_of, relative_spread, rms, weighted_mean
from roadlens.operators import kernels, spatial, summary, tracks, traffic, video
from roadlens.plans import views as V
from roadlens.sources import documents, opendrive

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HZ = 1 / 3600
FRAMES = 720
FRAMES_A_TASK = 8192


def query(name: str, sql: str | None = None, doubles: str = "", views: str = ""):
    """Register a query. doubles: the oracle's columns to round; views: CTEs before the SQL."""

    def add(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[name] = run
        if sql:
            fixed = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
            body = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if fixed else sql
            ORACLES[name] = f"WITH {views} {body}" if views else body
        return f

    return add


TR, SC, FE, HI, MR = V.TRACKS_SQL, V.SCENE_SQL, V.FEATURES_SQL, V.HISTOGRAMS_SQL, V.METRIC_ROWS_SQL

# ------------------------------------------------------------------ trajectory-log quality

_PER_TRACK = """, d AS (SELECT DISTINCT idx, total_nanos FROM tracks),
s AS (SELECT *, total_nanos - lag(total_nanos) OVER (PARTITION BY idx ORDER BY total_nanos) AS diff FROM d),
m AS (SELECT median(diff)::DOUBLE AS dt FROM s),
p AS (SELECT idx, count(*) AS n_actual,
  CASE WHEN count(*) > 1 THEN CAST(round_even((max(total_nanos) - min(total_nanos)) / any_value(dt), 0) AS BIGINT) + 1 ELSE count(*) END AS n_expected,
  count(*) FILTER (diff > 1.5 * dt) AS n_gaps,
  CAST(coalesce(sum(round_even(diff / dt - 1, 0)) FILTER (diff > 1.5 * dt), 0) AS BIGINT) AS missing_frames,
  list_sort(list(total_nanos - diff) FILTER (diff > 1.5 * dt))[1:5] AS ats
  FROM s, m GROUP BY idx)"""


@query(
    "temporal_completeness",
    """SELECT 'events' AS file, count(*) AS n_objects, count(*) FILTER (n_gaps > 0) AS n_objects_with_gaps,
  CAST(sum(n_actual) AS BIGINT) AS total_actual, CAST(sum(n_expected) AS BIGINT) AS total_expected, (SELECT dt FROM m) AS dt_ns,
  (SELECT count(DISTINCT total_nanos) FROM tracks) AS n_global_frames,
  round_even(100.0::DOUBLE * sum(n_actual) / sum(n_expected), 2) AS completeness_pct,
  round_even(1e9::DOUBLE / (SELECT dt FROM m), 2) AS inferred_hz,
  round_even(100.0::DOUBLE * sum(n_actual) / sum(n_expected), 2) >= 98 AS passes_threshold FROM p""",
    "dt_ns completeness_pct inferred_hz",
    TR + _PER_TRACK,
)
def _(spark, sf):
    return tracks.temporal_completeness(V.tracks(spark, sf))


@query("temporal_gaps", "SELECT 'events' AS file, idx, n_actual, n_expected, n_gaps, missing_frames, array_to_string(ats, ',') AS at_nanos FROM p WHERE n_gaps > 0", "", TR + _PER_TRACK)
def _(spark, sf):
    out = tracks.temporal_gaps(V.tracks(spark, sf))
    return out.withColumn("at_nanos", F.array_join(F.transform("gaps", lambda g: g["at_nanos"].cast("string")), ",")).drop("gaps")


@query(
    "duplicate_rate",
    """SELECT 'lineitem' AS file, CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(n - 1) AS BIGINT) AS duplicate_records,
  round_even(100.0::DOUBLE * sum(n - 1) / sum(n), 4) AS duplicate_rate_pct, round_even(100.0::DOUBLE * sum(n - 1) / sum(n), 4) <= 1 AS passes_threshold
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "duplicate_rate_pct",
)
def _(spark, sf):
    return tracks.duplicate_rate(V.table(spark, sf, "lineitem").withColumn("file", F.lit("lineitem")), ("l_orderkey", "l_linenumber"))


_MISS = " OR ".join(f"({c} IS NULL OR isnan({c}::DOUBLE))" for c in T.LOG_COLUMNS)


@query(
    "record_completeness",
    f"""SELECT 'events' AS file, count(*) AS total_records, count(*) FILTER (NOT ({_MISS})) AS complete_records,
  {", ".join(f"avg(({c} IS NULL OR isnan({c}::DOUBLE))::INT::DOUBLE) AS missing_{c}" for c in T.LOG_COLUMNS)},
  100.0::DOUBLE * count(*) FILTER (NOT ({_MISS})) / count(*) AS completeness_pct, 100.0::DOUBLE * count(*) FILTER (NOT ({_MISS})) / count(*) >= 95 AS passes_threshold FROM tracks""",
    "completeness_pct " + " ".join(f"missing_{c}" for c in T.LOG_COLUMNS),
    TR,
)
def _(spark, sf):
    return tracks.record_completeness(V.tracks(spark, sf))


@query(
    "default_value_issues",
    """SELECT 'events' AS file, CAST(sum(zero) AS BIGINT) AS zero_dimension_records, (min(t0) = max(t1) AND sum(n) > 1) AS timestamp_constant,
  count(*) FILTER (origin) AS objects_all_zero_position, count(*) AS total_objects, bool_and(untyped) AS all_type_unknown, false AS timestamp_nonmonotonic,
  NOT (sum(zero) > 0 OR (min(t0) = max(t1) AND sum(n) > 1) OR count(*) FILTER (origin) > 0 OR bool_and(untyped)) AS passes
  FROM (SELECT idx, count(*) AS n, count(*) FILTER (length = 0 OR width = 0 OR height = 0) AS zero, bool_and(coalesce(x = 0 AND y = 0 AND z = 0, false)) AS origin,
    min(total_nanos) AS t0, max(total_nanos) AS t1, bool_and(type = 0) AS untyped FROM tracks GROUP BY idx)""",
    "",
    TR,
)
def _(spark, sf):
    return tracks.default_value_issues(V.tracks(spark, sf))


@query("time_order", "SELECT 'events' AS file, count(*) AS messages, count(*) FILTER (t < p) AS messages_back_in_time FROM (SELECT t, lag(t) OVER (ORDER BY msg_seq) AS p FROM (SELECT msg_seq, min(total_nanos) AS t FROM tracks GROUP BY 1))", "", TR)
def _(spark, sf):
    return tracks.time_order(V.tracks(spark, sf))


_BAD = {
    "subtype": "(subtype NOT BETWEEN 0 AND 22)::INT", "role": "(role NOT BETWEEN 0 AND 10)::INT", "type": "(type NOT BETWEEN 0 AND 4)::INT",
    "roll": "(abs(roll) > pi())::INT", "pitch": "(abs(pitch) > pi())::INT", "yaw": "(abs(yaw) > pi())::INT",
    "length": "(length <= 0)::INT", "width": "(width <= 0)::INT", "height": "(height <= 0)::INT",
}
_ANY = "(" + " + ".join(_BAD.values()) + " > 0)"


@query(
    "format_consistency",
    f"""SELECT 'events' AS file, count(*) AS total_records, count(*) FILTER {_ANY} AS invalid_records,
  {", ".join(f"CAST({f'sum({_BAD[c]})' if c in _BAD else 0} AS BIGINT) AS invalid_{c}" for c in T.LOG_COLUMNS)},
  round_even(100.0::DOUBLE * (count(*) - count(*) FILTER {_ANY}) / count(*), 2) AS consistency_pct,
  round_even(100.0::DOUBLE * (count(*) - count(*) FILTER {_ANY}) / count(*), 2) >= 95 AS passes_threshold FROM tracks""",
    "consistency_pct",
    TR,
)
def _(spark, sf):
    return tracks.format_consistency(V.tracks(spark, sf))


@query(
    "class_case1",
    "SELECT 'events' AS file, (SELECT string_agg(n, ',' ORDER BY n) FROM (VALUES (1, 'TYPE_OTHER'), (2, 'TYPE_VEHICLE'), (3, 'TYPE_PEDESTRIAN'), (4, 'TYPE_ANIMAL')) v(c, n) WHERE c IN (SELECT type FROM few)) AS observed, (SELECT coalesce(string_agg(n, ',' ORDER BY n), '') FROM (VALUES (1, 'TYPE_OTHER'), (2, 'TYPE_VEHICLE'), (3, 'TYPE_PEDESTRIAN'), (4, 'TYPE_ANIMAL')) v(c, n) WHERE c NOT IN (SELECT type FROM few)) AS absent, 100.0::DOUBLE * (SELECT count(DISTINCT type) FROM few WHERE type BETWEEN 1 AND 4) / 4 AS coverage_pct",
    "coverage_pct",
    TR + ", few AS (SELECT type FROM tracks)",
)
def _(spark, sf):
    out = tracks.class_coverage(V.tracks(spark, sf), "type", T.OBJECT_TYPES)
    return out.withColumns({c: F.array_join(c, ",") for c in ("observed", "absent")})


@query(
    "class_case2",
    """SELECT 'events' AS file, count(DISTINCT type) FILTER (type <> 0) AS n_type, count(DISTINCT subtype) FILTER (subtype <> 0) AS n_subtype, count(DISTINCT role) AS n_role,
  count(DISTINCT type) FILTER (type <> 0) >= 2 AS type_ok, count(DISTINCT subtype) FILTER (subtype <> 0) >= 2 AS subtype_ok, count(DISTINCT role) >= 2 AS role_ok,
  count(DISTINCT type) FILTER (type <> 0) >= 2 AND count(DISTINCT subtype) FILTER (subtype <> 0) >= 2 AND count(DISTINCT role) >= 2 AS passes FROM tracks""",
    "",
    TR,
)
def _(spark, sf):
    return tracks.class_diversity(V.tracks(spark, sf), {"type": True, "subtype": True, "role": False})


_BY_DAY = ", daily AS (SELECT * REPLACE (total_nanos - total_nanos % 86400000000000 AS total_nanos) FROM tracks)"


def _daily(spark, sf):
    return V.tracks(spark, sf).withColumn("total_nanos", F.col("total_nanos") - F.col("total_nanos") % 86400000000000)


@query(
    "object_type_coverage",
    """SELECT 'events' AS file, count(*) AS total_frames, avg(n)::DOUBLE AS mean_detections, min(n) AS min_detections, max(n) AS max_detections, median(n)::DOUBLE AS median_detections,
  (SELECT count(DISTINCT idx) FROM daily) AS unique_objects, (SELECT coalesce(string_agg(n, ',' ORDER BY n), '') FROM wanted WHERE c IN (SELECT type FROM daily)) AS matched_types,
  (SELECT coalesce(string_agg(n, ',' ORDER BY n), '') FROM wanted WHERE c NOT IN (SELECT type FROM daily)) AS missing_types, 100.0::DOUBLE * (SELECT count(*) FROM wanted WHERE c IN (SELECT type FROM daily)) / (SELECT count(*) FROM wanted) AS coverage_pct,
  (SELECT count(*) FROM wanted WHERE c NOT IN (SELECT type FROM daily)) = 0 AS passes
  FROM (SELECT total_nanos, count(*) AS n FROM daily GROUP BY 1)""",
    "mean_detections median_detections coverage_pct",
    TR + _BY_DAY + ", wanted AS (SELECT * FROM (VALUES (2, 'TYPE_VEHICLE'), (3, 'TYPE_PEDESTRIAN'), (9, '9')) v(c, n))",
)
def _(spark, sf):
    out = tracks.object_type_coverage(_daily(spark, sf), [2, 3, 9])
    return out.withColumns({c: F.array_join(c, ",") for c in ("matched_types", "missing_types")})


@query(
    "frame_density_by_type",
    """SELECT 'events' AS file, CASE type WHEN 0 THEN 'TYPE_UNKNOWN' WHEN 1 THEN 'TYPE_OTHER' WHEN 2 THEN 'TYPE_VEHICLE' WHEN 3 THEN 'TYPE_PEDESTRIAN' ELSE 'TYPE_ANIMAL' END AS type_name,
  count(DISTINCT total_nanos) AS frames, 100.0::DOUBLE * count(DISTINCT total_nanos) / (SELECT count(DISTINCT total_nanos) FROM daily) AS density_pct FROM daily GROUP BY type""",
    "density_pct",
    TR + _BY_DAY,
)
def _(spark, sf):
    return tracks.frame_density_by_type(_daily(spark, sf))


_IMPLAUSIBLE = """, w AS (SELECT idx, sqrt(vel_x * vel_x + vel_y * vel_y + vel_z * vel_z) AS v, (total_nanos - lag(total_nanos) OVER o)::DOUBLE / 1e9 AS dt,
  sqrt(pow(x - lag(x) OVER o, 2) + pow(y - lag(y) OVER o, 2)) AS dist FROM tracks WINDOW o AS (PARTITION BY idx ORDER BY total_nanos, msg_seq)),
im AS (SELECT idx, count(*) FILTER (v > 50) AS n_fast, max(v) AS max_speed_ms, count(*) FILTER (dt > 0 AND dist / nullif(dt, 0) > 50) AS n_jumps, max(CASE WHEN dt > 0 THEN dist / dt WHEN dt <= 0 THEN 0 END) AS max_implied_speed_ms FROM w GROUP BY idx)"""


@query("implausible_tracks", "SELECT 'events' AS file, idx, n_fast, max_speed_ms, n_jumps, max_implied_speed_ms FROM im", "max_speed_ms max_implied_speed_ms", TR + _IMPLAUSIBLE)
def _(spark, sf):
    return tracks.implausible_tracks(V.tracks(spark, sf))


@query(
    "trajectory_plausibility",
    "SELECT 'events' AS file, count(*) AS n_objects, count(*) FILTER (n_fast > 0 OR max_implied_speed_ms > 50) AS n_implausible, (count(*) FILTER (n_fast > 0 OR max_implied_speed_ms > 50))::DOUBLE / count(*) AS implausible_fraction, (count(*) FILTER (n_fast > 0 OR max_implied_speed_ms > 50))::DOUBLE / count(*) <= 0.02 AS passes_threshold FROM im",
    "implausible_fraction",
    TR + _IMPLAUSIBLE,
)
def _(spark, sf):
    return tracks.trajectory_plausibility(V.tracks(spark, sf))


def _headers(spark, sf):
    c = V.table(spark, sf, "customer")
    key = F.col("c_custkey")
    version = F.struct(*(F.lit(v).cast("int").alias(p) if v is not None else (key % 3).cast("int").alias(p) for p, v in (("major", 0), ("minor", None), ("patch", 0))))
    return c.select(F.col("c_name").alias("file"), (key % 1100).cast("string").alias("country_code"), F.when(key % 5 != 0, F.col("c_mktsegment")).alias("proj_string"), F.when(key % 7 != 0, key).alias("host_vehicle_id"), version.alias("version"))


@query(
    "file_metadata",
    """SELECT c_name AS file, concat_ws(',', CASE WHEN c_custkey % 1100 NOT BETWEEN 100 AND 999 THEN 'country_code invalid' END, CASE WHEN c_custkey % 5 = 0 THEN 'proj_string missing' END, CASE WHEN c_custkey % 7 = 0 THEN 'host_vehicle_id missing' END) AS issues,
  c_custkey % 1100 BETWEEN 100 AND 999 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS passes FROM customer""",
)
def _(spark, sf):
    return tracks.file_metadata(_headers(spark, sf)).select("file", F.array_join("issues", ",").alias("issues"), "passes")


@query(
    "attribute_completeness",
    """SELECT c_name AS file, n AS present, 24 AS mandatory, concat_ws(',', 'role', CASE WHEN c_custkey % 5 = 0 THEN 'proj_string' END, CASE WHEN c_custkey % 7 = 0 THEN 'host_vehicle_id' END, CASE WHEN c_custkey % 3 = 0 THEN 'version' END) AS missing,
  100.0::DOUBLE * n / 24 AS completeness_pct, n = 24 AS passes_threshold FROM (SELECT *, CAST(20 + (c_custkey % 5 <> 0)::INT + (c_custkey % 7 <> 0)::INT + (c_custkey % 3 <> 0)::INT AS INT) AS n FROM customer)""",
    "completeness_pct",
)
def _(spark, sf):
    columns = [c for c in T.LOG_COLUMNS if c != "role"]
    return tracks.attribute_completeness(_headers(spark, sf), columns).withColumn("missing", F.array_join("missing", ","))


# --------------------------------------------------------------------------------- video


@query(
    "video_duplicates",
    """SELECT *, 100.0::DOUBLE * duplicates / frames AS duplicate_rate_pct, 100.0::DOUBLE * duplicates / frames <= 1 AS passes_threshold FROM (SELECT video, count(*) AS frames,
  greatest(count(*) FILTER (frame_no % 11 <> 3) - count(DISTINCT frame_no // 3) FILTER (frame_no % 11 <> 3), count(*) - count(DISTINCT brightness)) AS duplicates FROM features GROUP BY video)""",
    "duplicate_rate_pct",
    FE,
)
def _(spark, sf):
    # three frames share a time; some times are missing, as null or NaN
    late = F.when(F.col("frame_no") % 22 == 3, F.lit(float("nan"))).when(F.col("frame_no") % 11 != 3, F.floor(F.col("frame_no") / 3).cast("double"))
    return video.duplicate_rate(V.features(spark, sf).withColumns({"ts": late, "thumbnail_md5": F.md5(F.col("brightness").cast("string"))}), hashes=True)


_VT = """, st AS (SELECT *, ts - lag(ts) OVER (PARTITION BY video ORDER BY frame_no) AS dt FROM features),
pv AS (SELECT video, count(*) AS frames, arg_min(ts, frame_no) AS t0, arg_max(ts, frame_no) AS t1, avg(dt) AS step FROM st GROUP BY video HAVING count(*) > 1)"""


@query(
    "video_temporal",
    """SELECT video, frames, ex AS expected_frames, 100.0::DOUBLE * frames / ex AS completeness_pct, greatest(0, 1 - rms) AS distortion_score
  FROM (SELECT video, any_value(frames) AS frames, CAST(round_even(any_value((t1 - t0) / step), 0) AS BIGINT) + 1 AS ex, sqrt(avg(pow((dt - step) / step, 2))) AS rms FROM st JOIN pv USING (video) WHERE dt IS NOT NULL GROUP BY video)""",
    "completeness_pct distortion_score",
    FE + _VT,
)
def _(spark, sf):
    return video.temporal(V.features(spark, sf))


_MA = """, nu AS (SELECT *, row_number() OVER o AS rn, count(*) OVER (PARTITION BY video) AS n, avg(brightness) OVER (PARTITION BY video ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS raw FROM features WINDOW o AS (PARTITION BY video ORDER BY frame_no)),
ma AS (SELECT video, frame_no, brightness, CASE WHEN n < 15 THEN brightness WHEN rn <= 7 THEN max(CASE WHEN rn = 8 THEN raw END) OVER (PARTITION BY video) WHEN rn > n - 7 THEN max(CASE WHEN rn = n - 7 THEN raw END) OVER (PARTITION BY video) ELSE raw END AS smooth FROM nu)"""


@query("moving_average_15", "SELECT video, frame_no, brightness, smooth FROM ma", "brightness smooth", FE + _MA)
def _(spark, sf):
    return video.moving_average(V.features(spark, sf).select("video", "frame_no", "brightness"), "brightness")


@query("brightness_stability", "SELECT video, reference, value, greatest(0, 1 - value / 0.35) AS stability FROM (SELECT video, any_value(ref) AS reference, avg(abs(brightness - ref) / abs(ref)) AS value FROM features JOIN (SELECT video, median(brightness) AS ref FROM features GROUP BY video) USING (video) GROUP BY video)", "reference value stability", FE)
def _(spark, sf):
    return video.brightness_stability(V.features(spark, sf))


@query("sharpness_stability", "SELECT video, value, greatest(0, 1 - value / 0.35) AS stability FROM (SELECT video, stddev_pop(laplacian_variance) / abs(avg(laplacian_variance)) AS value FROM features GROUP BY video)", "value stability", FE)
def _(spark, sf):
    return video.spread_stability(V.features(spark, sf), "laplacian_variance", 0.35)


@query("flicker", "SELECT video, value, true AS uses_timebase, greatest(0, 1 - value / 0.4) AS stability FROM (SELECT video, sqrt(avg(pow(db / greatest(dt, 1e-6), 2))) / any_value(mu) AS value FROM (SELECT video, brightness - lag(brightness) OVER o AS db, ts - lag(ts) OVER o AS dt, avg(brightness) OVER (PARTITION BY video) AS mu FROM features WINDOW o AS (PARTITION BY video ORDER BY frame_no)) GROUP BY video)", "value stability", FE)
def _(spark, sf):
    return video.flicker_stability(V.features(spark, sf))


@query("flicker_untimed", "SELECT video, value, false AS uses_timebase, greatest(0, 1 - value / 0.4) AS stability FROM (SELECT video, stddev_pop(brightness - smooth) / avg(brightness) AS value FROM ma GROUP BY video)", "value stability", FE + _MA)
def _(spark, sf):
    return video.flicker_stability(V.features(spark, sf).withColumn("ts", F.when(F.col("frame_no") % 50 != 0, F.col("ts"))))


@query("color_stability", "SELECT video, value, greatest(0, 1 - value / 0.35) AS stability FROM (SELECT video, avg(sqrt((pow((mean_b - b) / b, 2) + pow((mean_g - g) / g, 2) + pow((mean_r - r) / r, 2)) / 3)) AS value FROM histograms JOIN (SELECT video, median(mean_b) AS b, median(mean_g) AS g, median(mean_r) AS r FROM histograms GROUP BY video) USING (video) GROUP BY video)", "value stability", HI)
def _(spark, sf):
    return video.color_stability(V.histograms(spark, sf))


@query(
    "histogram_stability",
    "SELECT video, value, median_distance, greatest(0, 1 - value / 0.4) AS stability FROM (SELECT video, avg(d) AS value, median(d) AS median_distance FROM (SELECT u.video, u.frame_no, sqrt(greatest(0, 1 - sum(sqrt(p * m / (t + 1e-9) + 1e-9)))) AS d FROM u JOIN me USING (video, bin) JOIN (SELECT video, sum(m) AS t FROM me GROUP BY video) USING (video) GROUP BY u.video, u.frame_no) GROUP BY video)",
    "value median_distance stability",
    HI + ", u AS (SELECT video, frame_no, unnest(hist) AS p, generate_subscripts(hist, 1) AS bin FROM histograms), me AS (SELECT video, bin, median(p) AS m FROM u GROUP BY video, bin)",
)
def _(spark, sf):
    return video.histogram_stability(V.histograms(spark, sf))


@query("spread_and_rms", "SELECT l_returnflag, stddev_pop(l_quantity) / abs(avg(l_quantity)) AS cov, sqrt(avg(l_quantity * l_quantity)) AS rms, sum(l_quantity * l_discount) / sum(l_discount) AS weighted_mean FROM lineitem GROUP BY 1", "cov rms weighted_mean")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(relative_spread("l_quantity").alias("cov"), rms("l_quantity").alias("rms"), weighted_mean("l_quantity", "l_discount").alias("weighted_mean"))


@query(
    "gini_and_entropy",
    """SELECT video, frame_no, g AS gini, e AS entropy FROM (SELECT video, frame_no, sum((2 * rn - 64 - 1) * y) / (64 * (sum(y) + 1e-9)) AS g, -sum(p * ln(p + 1e-9)) AS e
  FROM (SELECT *, p - min(p) OVER f AS y, row_number() OVER (PARTITION BY video, frame_no ORDER BY p, bin) AS rn FROM (SELECT video, frame_no, unnest(hist) AS p, generate_subscripts(hist, 1) AS bin FROM histograms) WINDOW f AS (PARTITION BY video, frame_no)) GROUP BY video, frame_no)""",
    "gini entropy",
    HI,
)
def _(spark, sf):
    return V.histograms(spark, sf).select("video", "frame_no", gini_of("hist").alias("gini"), entropy_of("hist").alias("entropy"))


@query("composite_sci", "SELECT CAST(o_orderkey AS VARCHAR) AS video, 0.22 * (k / 97) + 0.22 * (k / 98) + 0.15 * (k / 99) + 0.15 * (k / 100) + 0.18 * (k / 101) + 0.08 * (k / 102) AS sci FROM (SELECT o_orderkey, (o_orderkey % 97)::DOUBLE AS k FROM orders)", "sci")
def _(spark, sf):
    k = (F.col("o_orderkey") % 97).cast("double")
    return video.composite(V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video"), *((k / (97 + i)).alias(c) for i, c in enumerate(("brightness", "color", "sharpness", "noise", "flicker", "histogram")))))


@query(
    "degradation_scores",
    """SELECT l_orderkey, l_linenumber, l_discount, greatest(0, 1 - (least(1, l_discount / (0.08 + 1e-9)) + least(1, l_tax / (0.12 + 1e-9)) + least(1, l_quantity / 100 / (0.35 + 1e-9)) + least(1, greatest(0, (3.5 - l_quantity / 10) / 3.5)) + least(1, l_tax / (0.08 + 1e-9))) / 5) AS blockage,
  greatest(0, 1 - (least(1, abs(l_quantity / 25 - 1) / (0.05 + 1e-9)) + least(1, l_discount / (0.10 + 1e-9)) + least(1, l_tax / (0.08 + 1e-9))) / 3) AS fov FROM lineitem""",
    "l_discount blockage fov",
)
def _(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    blockage = video.blockage_score({"low_intensity": d, "low_texture": t, "edge_gini": q / 100, "tile_entropy": q / 10, "border": t})
    view = video.view_score({"scale_mean": q / 25, "scale_cov": d, "border_constant": t})
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", blockage.alias("blockage"), view.alias("fov"))


@query(
    "temporal_window_coverage",
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS file, w AS "window", o AS overlap_minutes, 100 * o / len AS coverage_pct, 100 * sum(o) OVER (PARTITION BY d) / sum(len) OVER (PARTITION BY d) AS total_coverage_pct FROM (
  SELECT d, w, b - a AS len, greatest(0, least(m1, b) - greatest(m0, a)) AS o FROM (SELECT CAST(ts AS DATE) AS d, min(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7 AS m0, max(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 6e7 AS m1 FROM events GROUP BY 1),
  (VALUES ('07:00-09:30', 420.0::DOUBLE, 570.0::DOUBLE), ('22:00-23:59', 1320.0::DOUBLE, 1439.0::DOUBLE)) v(w, a, b))""",
    "overlap_minutes coverage_pct total_coverage_pct",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    spans = e.groupBy(F.col("ts").cast("date").cast("string").alias("file")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return video.window_coverage(spans, [("07:00", "09:30"), ("12:00", "12:00"), ("22:00", "23:59")])


@query("traffic_presence", "SELECT video, count(*) AS total, count(*) FILTER (brightness > 12) AS active, avg(brightness) AS mean_score, (count(*) FILTER (brightness > 12))::DOUBLE / count(*) AS presence_ratio FROM features GROUP BY video", "mean_score presence_ratio", FE)
def _(spark, sf):
    f = V.features(spark, sf)
    return video.traffic_presence(f.withColumn("score", F.col("brightness")), f)


@query("sampled_frames", "SELECT video, frame_no, ts - first_value(ts) OVER (PARTITION BY video ORDER BY frame_no) AS ts FROM features WHERE frame_no % 5 = 0 AND frame_no < 2500", "ts", FE)
def _(spark, sf):
    return video.sampled(V.features(spark, sf).select("video", "frame_no", "ts"))


_STREAMS = "CASE upper(substr(p_type, 1, 1)) WHEN 'S' THEN 'D' WHEN 'M' THEN 'V' ELSE upper(substr(p_type, 1, 1)) END"


@query(
    "stream_coverage",
    """SELECT sequence, present, CASE WHEN d AND p THEN 'X' WHEN d THEN 'P,X' WHEN p THEN 'D,X' ELSE 'D,P,X' END AS missing, round_even(100.0::DOUBLE * (d::INT + p::INT) / 3, 1) AS coverage_pct
  FROM (SELECT sequence, string_agg(DISTINCT s, ',' ORDER BY s) AS present, bool_or(s IN ('D', 'V')) AS d, bool_or(s = 'P') AS p FROM files GROUP BY sequence)""",
    "coverage_pct",
    f"files AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS sequence, {_STREAMS} AS s FROM part WHERE p_type IS NOT NULL)",
)
def _(spark, sf):
    files = V.table(spark, sf, "part").where("p_type is not null").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("sequence"), F.concat(F.lit("/data/VIDc_x_"), F.lower(F.expr(_STREAMS)), F.lit(".mp4")).alias("path"))
    out = video.stream_coverage(files, ("d", "P", "X"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("present", "missing")})


# ------------------------------------------------------------------------------- traffic


@query("dense_frames", "SELECT 'events' AS scene, idx, total_nanos, CAST(dense_rank() OVER (ORDER BY total_nanos) - 1 AS INT) AS frame FROM tracks", "", TR)
def _(spark, sf):
    return traffic.dense_frames(V.tracks(spark, sf).select(F.lit("events").alias("scene"), "idx", "total_nanos"))


@query("sample_rate", "SELECT 'events' AS scene, 1e9::DOUBLE / median(d) AS hz FROM (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM (SELECT DISTINCT total_nanos AS t FROM tracks))", "hz", TR)
def _(spark, sf):
    return traffic.sample_rate(V.tracks(spark, sf).withColumn("scene", F.lit("events")))


@query("finite_difference_velocity", "SELECT scene, id, frame, (x - lag(x) OVER o) * 2 AS vx, (y - lag(y) OVER o) * 2 AS vy FROM scene WINDOW o AS (PARTITION BY id ORDER BY frame)", "vx vy", SC)
def _(spark, sf):
    return traffic.finite_difference_velocity(V.scene(spark, sf), 2.0).select("scene", "id", "frame", "vx", "vy")


_CLEAN = """, sp AS (SELECT id, count(*) / 0.5::DOUBLE AS dur, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS ext FROM scene GROUP BY id),
cl AS (SELECT scene.*, dur, dur < 120 AS short, dur >= 120 AND ext < 110 AS static, speed > 30 AS teleport, NOT (dur < 120) AND NOT (ext < 110) AND NOT speed > 30 AS keep FROM scene JOIN sp USING (id))"""
_clean = dict(hz=0.5, min_track_s=120, static_disp_m=110, max_speed_ms=30)


@query("clean_tracks", "SELECT scene, id, frame, speed, short, static, teleport, keep FROM cl", "speed", SC + _CLEAN)
def _(spark, sf):
    return traffic.clean_tracks(V.scene(spark, sf), **_clean).select("scene", "id", "frame", "speed", "short", "static", "teleport", "keep")


@query(
    "cleaning_report",
    """SELECT 'events' AS scene, count(*) AS n_objects, count(*) FILTER (static) AS n_static, count(*) FILTER (short) AS n_short_tracks, CAST(sum(t) AS BIGINT) AS n_teleport_samples, sum(k)::DOUBLE / sum(n) AS samples_kept_fraction, median(dur) AS median_duration_s, quantile_cont(dur, 0.1) AS p10_duration_s
  FROM (SELECT id, any_value(static) AS static, any_value(short) AS short, count(*) FILTER (teleport) AS t, count(*) FILTER (keep) AS k, count(*) AS n, any_value(dur) AS dur FROM cl GROUP BY id)""",
    "samples_kept_fraction median_duration_s p10_duration_s",
    SC + _CLEAN,
)
def _(spark, sf):
    return traffic.cleaning_report(traffic.clean_tracks(V.scene(spark, sf), **_clean))


def _edie(keys: str, km: str, extra: str = "") -> str:
    return f"SELECT {keys}{extra}, count(DISTINCT id) AS objects, count(*) AS samples, count(*) / ({FRAMES} * {km}::DOUBLE) AS density_veh_per_km, count(*) / ({FRAMES} * {km}::DOUBLE) * 3.6 * sum(speed) / count(*) AS flow_veh_per_h, 3.6 * sum(speed) / count(*) AS speed_km_per_h FROM scene WHERE road <> '' GROUP BY {keys}"


_E = "density_veh_per_km flow_veh_per_h speed_km_per_h"


@query("edie_network", _edie("scene", "1.5"), _E, SC)
def _(spark, sf):
    return traffic.edie_by(V.scene(spark, sf).where("road <> ''"), ["scene"], FRAMES, 1.5)


@query("edie_by_type", _edie("scene, vclass", "1.5"), _E, SC)
def _(spark, sf):
    return traffic.edie_by(V.scene(spark, sf).where("road <> ''"), ["scene", "vclass"], FRAMES, 1.5)


_KM = "(VALUES ('A', 0.5::DOUBLE), ('B', 1.0::DOUBLE), ('C', 0.0::DOUBLE), ('D', 0.25::DOUBLE)) r(road, km)"


@query("edie_by_road", f"SELECT scene, road, km, count(*) AS samples, count(*) / ({FRAMES} * km) AS density_veh_per_km, 3.6 * sum(speed) / ({FRAMES} * km) AS flow_veh_per_h, 3.6 * sum(speed) / count(*) AS speed_km_per_h FROM scene JOIN {_KM} USING (road) WHERE km > 0 GROUP BY scene, road, km", "km " + _E, SC)
def _(spark, sf):
    km = spark.createDataFrame([("A", 0.5), ("B", 1.0), ("C", 0.0), ("D", 0.25)], "road string, km double")
    return traffic.edie_by_road(V.scene(spark, sf), km, FRAMES)


@query(
    "per_frame_summary",
    f"SELECT 'events' AS scene, avg(v) AS mean, max(v) AS peak, quantile_cont(v, 0.95) AS p95, min(v) AS min FROM (SELECT f, coalesce(n, 0)::DOUBLE AS v FROM (SELECT unnest(range(0, {FRAMES}))::INT AS f) LEFT JOIN (SELECT frame AS f, count(*) AS n FROM scene WHERE road = 'A' GROUP BY 1) USING (f))",
    "mean peak p95 min",
    SC,
)
def _(spark, sf):
    frames = spark.createDataFrame([("events", FRAMES)], "scene string, n_frames int")
    return traffic.summary(traffic.per_frame(V.scene(spark, sf).where("road = 'A'"), frames))


@query("occupancy_series", f"SELECT 'events' AS scene, CAST(f AS INT) AS frame, coalesce(n, 0) * 8.0::DOUBLE / 2500 AS value FROM (SELECT unnest(range(0, {FRAMES})) AS f) LEFT JOIN (SELECT frame AS f, count(*) AS n FROM scene WHERE road <> '' GROUP BY 1) USING (f)", "value", SC)
def _(spark, sf):
    frames = spark.createDataFrame([("events", FRAMES)], "scene string, n_frames int")
    return traffic.occupancy(V.scene(spark, sf).where("road <> ''"), frames, 2500.0)


def _quality_rows(spark, sf):
    s = traffic.clean_tracks(V.scene(spark, sf), **_clean)
    return s.withColumns({"lane_idx": F.when(F.col("road") != "", F.ascii("road")), "parking": (F.col("x") < 5) & (F.col("y") < 50)})


@query("data_quality", "SELECT scene, coalesce(avg((road = '')::INT) FILTER (keep), 0) AS off_lane_fraction, count(DISTINCT id) FILTER (vclass = 'other') AS unknown_type_objects, count(*) FILTER (x < 5 AND y < 50) AS parking_samples, count(DISTINCT id) FILTER (x < 5 AND y < 50) AS parking_vehicles FROM cl GROUP BY scene", "off_lane_fraction", SC + _CLEAN)
def _(spark, sf):
    return traffic.data_quality(_quality_rows(spark, sf))


_BOXES = [(0, 0.0, 0.0, 20.0, 30.0), (1, 20.0, 0.0, 45.0, 60.0), (2, 10.0, 20.0, 30.0, 80.0), (3, 60.0, 10.0, 400.0, 35.0)]


def _boxes(spark):
    rows = [(i, [{"x": x, "y": y} for x, y in ((a, b), (c, b), (c, d), (a, d))]) for i, a, b, c, d in _BOXES]
    return spark.createDataFrame(rows, "lane_idx int, ring array<struct<x: double, y: double>>")


_BOX_SQL = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in _BOXES)
_IN = "x > a AND x < c AND y > b AND y < d"


@query("lane_assign", f"SELECT msg_seq, x, y, coalesce((SELECT min(i) FROM (VALUES {_BOX_SQL}) v(i, a, b, c, d) WHERE {_IN}), -1) AS lane_idx FROM tracks", "x y", TR)
def _(spark, sf):
    out = spatial.assign_lanes(V.tracks(spark, sf).select("msg_seq", "x", "y"), _boxes(spark))
    return out.withColumn("lane_idx", F.coalesce("lane_idx", F.lit(-1)))


@query("in_parking", f"SELECT msg_seq, x, y, EXISTS (SELECT 1 FROM (VALUES {_BOX_SQL}) v(i, a, b, c, d) WHERE i >= 2 AND {_IN}) AS parking FROM tracks", "x y", TR)
def _(spark, sf):
    return spatial.in_areas(V.tracks(spark, sf).select("msg_seq", "x", "y"), _boxes(spark).where("lane_idx >= 2"))


@query(
    "turning_movements",
    """SELECT 'events' AS scene, 'J' AS junction, f AS "from", t AS "to", count(*) AS count, count(*) / 2.0::DOUBLE AS veh_per_h FROM (
  SELECT road, lag(road) OVER o AS f, lead(road) OVER o AS t FROM (SELECT id, frame, road, lag(road) OVER (PARTITION BY id ORDER BY frame) AS p FROM scene) WHERE road <> '' AND (p IS NULL OR p <> road) WINDOW o AS (PARTITION BY id ORDER BY frame))
  WHERE road IN ('B', 'D') AND f IS NOT NULL AND t IS NOT NULL GROUP BY f, t""",
    "veh_per_h",
    SC,
)
def _(spark, sf):
    connectors = spark.createDataFrame([("B", "J"), ("D", "J")], "road string, junction string")
    return traffic.turning_movements(V.scene(spark, sf), connectors, 2.0)


_WRAP = "(({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi())"
_SWEEP = f""", swp AS (SELECT id, frame, p AS phi0, {_WRAP.format("(phi - p)")} AS dphi FROM (SELECT id, frame, phi, lag(phi) OVER o AS p, frame - lag(frame) OVER o AS g FROM scene WINDOW o AS (PARTITION BY id ORDER BY frame)) WHERE g = 1),
dir AS (SELECT CAST(CASE WHEN sum(dphi) >= 0 THEN 1 ELSE -1 END AS INT) AS direction FROM swp)"""


@query("circulating_direction", "SELECT 'events' AS scene, direction FROM dir", "", SC + _SWEEP)
def _(spark, sf):
    return traffic.circulating_direction(V.scene(spark, sf))


@query(
    "circulating_flow",
    f"""SELECT 'events' AS scene, road, count(*) FILTER (CASE WHEN direction > 0 THEN rel > 0 AND rel <= dphi ELSE rel < 0 AND rel >= dphi END) AS crossings, (count(*) FILTER (CASE WHEN direction > 0 THEN rel > 0 AND rel <= dphi ELSE rel < 0 AND rel >= dphi END)) / 2.0::DOUBLE AS veh_per_h
  FROM (SELECT road, direction, dphi, {_WRAP.format("(theta - phi0)")} AS rel FROM swp, dir, (VALUES ('N', 1.5::DOUBLE), ('S', -1.5::DOUBLE), ('E', 0.1::DOUBLE)) a(road, theta) WHERE sign(dphi) = direction) GROUP BY road""",
    "veh_per_h",
    SC + _SWEEP,
)
def _(spark, sf):
    arms = spark.createDataFrame([("N", 1.5), ("S", -1.5), ("E", 0.1)], "road string, theta double")
    return traffic.circulating_flow(V.scene(spark, sf), arms, 2.0)


@query("arm_direction", "SELECT scene, road, CASE WHEN sum(cos(phi) * vx + sin(phi) * vy) < 0 THEN 'entry' ELSE 'exit' END AS direction FROM scene GROUP BY scene, road", "", SC)
def _(spark, sf):
    return traffic.arm_direction(V.scene(spark, sf), 40.0, 50.0)


_DELAY = ", dl AS (SELECT road, avg(greatest(l, 0)) AS control_delay_s FROM (SELECT road, id, sum((1 - speed / v) / 0.5) AS l FROM scene JOIN (SELECT road, quantile_cont(speed, 0.85) AS v FROM scene GROUP BY road) USING (road) GROUP BY road, id) GROUP BY road)"


@query("control_delay", "SELECT 'events' AS scene, road, control_delay_s, CASE WHEN control_delay_s <= 4 THEN 'A' WHEN control_delay_s <= 8 THEN 'B' ELSE 'C' END AS level_of_service FROM dl", "control_delay_s", SC + _DELAY)
def _(spark, sf):
    out = traffic.control_delay(V.scene(spark, sf), ["scene", "road"], 0.5)
    return out.withColumn("level_of_service", traffic.grade(F.col("control_delay_s"), [["A", 4], ["B", 8], ["C", 9]]))


@query("los_grade", "SELECT event_id, CASE WHEN value <= 10 THEN 'A' WHEN value <= 15 THEN 'B' WHEN value <= 25 THEN 'C' WHEN value <= 35 THEN 'D' WHEN value <= 50 THEN 'E' ELSE 'F' END AS grade FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", traffic.grade(F.col("value")).alias("grade"))


# ------------------------------------------------------------------------------- summary

_VK = list(T.VIDEO_LABELS)


@query("summary_aggregate", " UNION ALL ".join(f"SELECT '{k}' AS metric, avg({k}) AS mean, min({k}) AS min, max({k}) AS max, count({k}) AS n FROM metric_rows" for k in _VK), "mean min max", MR)
def _(spark, sf):
    return summary.aggregate(V.metric_rows(spark, sf), _VK)


@query("pass_counts", "SELECT *, CASE WHEN passed = judged THEN '✓' WHEN passed = 0 THEN '✗' ELSE '~' END AS mark FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({k}) AS passed, count({k}) AS judged FROM metric_rows" for k in T.LOG_FLAGS) + ")", "", MR)
def _(spark, sf):
    return summary.pass_counts(V.metric_rows(spark, sf), list(T.LOG_FLAGS))


_LOW = {"tds": ("TDS", 95), "tcomp": ("TComp", 95), "dup": ("Dup", 99), "sci": ("SCI", 70), "blk": ("Blk", 70), "fov": ("FOV", 70)}


@query(
    "warn_flags",
    "SELECT CASE WHEN length(path) > 40 THEN '…' || right(path, 39) ELSE path END AS path, coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {k} < {v} THEN '{n}↓' END" for k, (n, v) in _LOW.items()) + "), ''), '—') AS video_flags, coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {k} THEN '{n}↓' END" for k, n in T.LOG_FLAGS.items()) + "), ''), '—') AS log_flags FROM metric_rows",
    "",
    MR,
)
def _(spark, sf):
    return V.metric_rows(spark, sf).select(summary.clip("path").alias("path"), summary.video_flags().alias("video_flags"), summary.log_flags().alias("log_flags"))


# ------------------------------------------------------------------- documents, maps and kernels


@query(
    "openlabel_scan",
    """SELECT CAST(s_nationkey AS VARCHAR) AS scene, CAST(s_suppkey % 5 AS INT) AS frame, s_suppkey AS id, s_acctbal AS x, s_acctbal / 2 AS y, 0.25 AS yaw, 4.5 AS length, (s_suppkey % 3)::DOUBLE AS width,
  CASE s_suppkey % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'other' ELSE 'other' END AS vclass FROM supplier WHERE s_suppkey % 7 <> 0""",
    "x y yaw length width",
)
def _(spark, sf):
    s = V.table(spark, sf, "supplier")
    kind = F.array(*map(F.lit, ("Car", "truck", "Boat", "")))[(F.col("s_suppkey") % 4).cast("int")]
    val = F.array(*(F.col("s_acctbal").cast("double") * k for k in (1.0, 0.5, 0.0, 0.0, 0.0)), F.lit(0.25), F.lit(4.5), (F.col("s_suppkey") % 3).cast("double"))
    cuboid = F.struct(F.when(F.col("s_suppkey") % 7 != 0, F.array(F.struct(val.alias("val")))).alias("cuboid"))
    rows = s.select(F.col("s_nationkey").cast("string").alias("path"), F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") % 5).cast("string").alias("frame"), kind.alias("kind"), F.struct(cuboid.alias("object_data")).alias("o"))
    table = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    frames = rows.groupBy("path", "frame").agg(table("id", "o").alias("objects")).groupBy("path").agg(table("frame", F.struct("objects")).alias("frames"))
    kinds = rows.groupBy("path").agg(table("id", F.struct(F.col("kind").alias("type"))).alias("objects"))
    docs = kinds.join(frames, "path").select("path", F.to_json(F.struct(F.struct("objects", "frames").alias("openlabel"))).alias("text"))
    return documents.openlabel(docs)


@query(
    "metric_document_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS path, round_even((o_orderkey % 101) / 101.0::DOUBLE * 100, 2) AS tds, (o_orderkey % 97)::DOUBLE AS tcomp, round_even(100 - (o_orderkey % 89) / 8.0::DOUBLE, 2) AS dup,
  CASE WHEN o_orderkey % 3 <> 0 THEN round_even((o_orderkey % 83) / 83.0::DOUBLE * 100, 2) END AS sci, round_even((o_orderkey % 79) / 79.0::DOUBLE * 100, 2) AS blk, CAST(NULL AS DOUBLE) AS fov FROM orders""",
    "tds tcomp dup sci blk",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    share = lambda n: (k % n).cast("double") / n
    one = lambda name, v: F.struct(v.alias(name))
    video_part = F.struct(
        F.struct(share(101).alias("Temporal Distortion Score (TDS)"), (k % 97).cast("double").alias("Temporal Completeness (%)")).alias("compute_temporal_metrics"),
        one("Duplicate Record Rate (%)", (k % 89).cast("double") / 8).alias("compute_duplicate_record_rate_video"),
        one("Composite SCI (0..1)", F.when(k % 3 != 0, share(83))).alias("compute_sensor_consistency"),
        one("Partial Blockage Score (0..1)", share(79)).alias("compute_sensor_degradation"),
    )
    text = F.to_json(F.struct(video_part.alias("video")))
    docs = V.table(spark, sf, "orders").select(k.cast("string").alias("path"), F.from_json(text, documents.METRIC_JSON).alias("doc"))
    return documents.video_rows(docs)


@query(
    "map_lanes",
    """SELECT CAST(n_nationkey AS VARCHAR) AS road_id, lane_id, '-1' AS junction, CASE WHEN n_nationkey % 2 = 0 THEN 20.0 + n_nationkey
    ELSE (20 + n_nationkey) * 2 * (100 - side * (i + 0.5) * 3) * sin(1 / 200.0::DOUBLE) END AS length_m
  FROM nation, (VALUES (1, 1, 0), (2, 1, 1), (-1, -1, 0)) v(lane_id, side, i)""",
    "length_m",
)
def _(spark, sf):
    # roads along a line, or bent to the left with a radius of 100 m, 1 m between sampled points
    n = F.col("n_nationkey").cast("string")
    at = F.format_string('s="0" x="%s" y="5" hdg="0.5" length="%s"', n, (F.col("n_nationkey") + 20).cast("string"))
    shape = F.when(F.col("n_nationkey") % 2 == 0, F.lit("<p:line/>")).otherwise(F.lit('<p:arc curvature="0.01"/>'))
    lane = lambda k, kind="driving": f'<p:lane id="{k}" type="{kind}"><p:width sOffset="0" a="3" b="0" c="0" d="0"/></p:lane>'
    sides = F.lit(f"<p:lanes><p:laneSection s=\"0\"><p:left>{lane(2)}{lane(1)}</p:left><p:right>{lane(-1)}{lane(-2, 'sidewalk')}</p:right></p:laneSection></p:lanes>")
    road = F.concat(F.lit('<p:road id="'), n, F.lit('" junction="-1"><p:planView><p:geometry '), at, F.lit(">"), shape, F.lit("</p:geometry></p:planView>"), sides, F.lit("</p:road>"))
    maps = V.table(spark, sf, "nation").select(F.concat(F.lit('<p:OpenDRIVE xmlns:p="urn:x">'), road, F.lit("</p:OpenDRIVE>")).alias("xml"))
    return opendrive.lanes(opendrive.from_text(maps)).select("road_id", "lane_id", "junction", "length_m")


@query(
    "frame_kernels",
    """SELECT CAST(c_custkey AS VARCHAR) AS video, (c_custkey % 256)::DOUBLE AS brightness, (c_custkey % 256)::DOUBLE AS mean_b, 0.0::DOUBLE AS laplacian_variance, 0.0::DOUBLE AS noise_std, CASE WHEN c_custkey % 256 <= 30 THEN 1.0::DOUBLE ELSE 0.0 END AS low_intensity,
  1.0::DOUBLE AS low_texture, CASE WHEN c_custkey % 256 <= 30 THEN 1.0::DOUBLE ELSE 0.0 END AS border_left, 0.0::DOUBLE AS edge_gini, 0.0::DOUBLE AS tile_entropy, 1.0::DOUBLE AS border_constant FROM customer""",
    "brightness mean_b low_intensity border_left",
)
def _(spark, sf):
    # an image is a thousand times its row: rows are dealt before, as one file of them is little for Spark
    keys = V.table(spark, sf, "customer").select("c_custkey")
    keys = keys.repartition(max(spark.sparkContext.defaultParallelism, keys.count() // FRAMES_A_TASK + 1))
    frames = keys.select(F.col("c_custkey").cast("string").alias("video"), F.lit(0).cast("long").alias("frame_no"), F.lit(0.0).alias("ts"), F.lit(32).alias("height"), F.lit(48).alias("width"), F.lit(3).alias("nChannels"), F.unhex(F.repeat(F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"), 32 * 48 * 3)).alias("data"))
    return kernels.frame_features(frames).select("video", "brightness", "mean_b", "laplacian_variance", "noise_std", "low_intensity", "low_texture", "border_left", "edge_gini", "tile_entropy", "border_constant")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
