"""Video quality metrics from frame timestamps and feature rows: one row per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.core import EPS, missing, ratio, relative_spread

# Effective limits and weights of the composite, and warning levels of degradation.
LIMITS = {"brightness": 0.35, "color": 0.35, "sharpness": 0.35, "noise": 0.40, "flicker": 0.40, "histogram": 0.40}
WEIGHTS = {"brightness": 0.22, "color": 0.22, "sharpness": 0.15, "noise": 0.15, "flicker": 0.18, "histogram": 0.08}
WARN = {
    "low_intensity": 0.08, "low_texture": 0.12, "edge_gini": 0.35, "tile_entropy": 3.5, "border": 0.08,
    "scale": 0.05, "scale_cov": 0.10, "border_constant": 0.08,
}

def _in_video():
    return Window.partitionBy("video").orderBy("frame_no")


def stability(value: Column, limit: float) -> Column:
    """1 at no deviation, 0 from the limit on."""
    return F.greatest(F.lit(0.0), 1 - value / max(limit, EPS))


def duplicate_rate(frames: DataFrame, hashes: bool = False) -> DataFrame:
    """Frames after the first of each timestamp (in ms) or, if more, of each thumbnail, in percent."""
    times = F.count("*") - F.count_distinct(F.when(~missing("ts"), F.round(F.col("ts") * 1000, 3))) - F.count_if(missing("ts"))
    extra = [(F.count("*") - F.count_distinct("thumbnail_md5")).alias("same_image")] if hashes else []
    out = frames.groupBy("video").agg(F.count("*").alias("frames"), times.alias("same_time"), *extra)
    n = F.greatest("same_time", "same_image") if hashes else F.col("same_time")
    pct = 100.0 * ratio(n, F.col("frames"))
    return out.select("video", "frames", n.alias("duplicates"), pct.alias("duplicate_rate_pct"), (pct <= 1.0).alias("passes_threshold"))


def temporal(frames: DataFrame, expected_hz: float | None = None) -> DataFrame:
    """Completeness against the time span and step, and the distortion score, 1 less the RMS of the
    steps' relative deviations; no row for videos of fewer than two frames."""
    if expected_hz is not None and not expected_hz > 0:
        raise ValueError("expected_hz must be positive")
    steps = frames.select("video", "frame_no", "ts").withColumn("dt", F.col("ts") - F.lag("ts").over(_in_video()))
    per = steps.groupBy("video").agg(F.count("*").alias("frames"), F.min_by("ts", "frame_no").alias("t0"), F.max_by("ts", "frame_no").alias("t1"), F.avg("dt").alias("mean_dt")).where("frames > 1")
    dt = F.lit(1.0 / expected_hz) if expected_hz else F.col("mean_dt")
    per = per.withColumn("step", dt)
    rms = steps.join(per, "video").where("dt is not null").groupBy("video").agg(F.sqrt(F.avg(F.pow(ratio(F.col("dt") - F.col("step"), F.col("step")), 2))).alias("rms"))
    expected = F.rint(ratio(F.col("t1") - F.col("t0"), F.col("step"))).cast("long") + 1
    return per.join(rms, "video").select("video", "frames", expected.alias("expected_frames"), (100.0 * ratio(F.col("frames"), expected)).alias("completeness_pct"), F.greatest(F.lit(0.0), 1 - F.col("rms")).alias("distortion_score"))


def moving_average(series: DataFrame, value: str, window: int = 15) -> DataFrame:
    """series with smooth, the centred mean over an odd window; near an end that of the nearest full
    window, and the value itself in series shorter than the window."""
    r = window // 2
    numbered = series.withColumns({"rn": F.row_number().over(_in_video()), "n": F.count("*").over(Window.partitionBy("video"))})
    numbered = numbered.withColumn("raw", F.avg(value).over(_in_video().rowsBetween(-r, r)))
    whole = Window.partitionBy("video")
    first = F.max(F.when(F.col("rn") == r + 1, F.col("raw"))).over(whole)
    last = F.max(F.when(F.col("rn") == F.col("n") - r, F.col("raw"))).over(whole)
    smooth = F.when(F.col("n") < window, F.col(value)).when(F.col("rn") <= r, first).when(F.col("rn") > F.col("n") - r, last).otherwise(F.col("raw"))
    return numbered.withColumn("smooth", smooth).drop("rn", "n", "raw")


def brightness_stability(features: DataFrame, limit: float = LIMITS["brightness"]) -> DataFrame:
    """Mean relative deviation of brightness from its median."""
    ref = features.groupBy("video").agg(F.median("brightness").alias("ref"))
    near = F.when(F.abs("ref") > EPS, F.abs("ref")).otherwise(F.lit(EPS))
    dev = features.join(ref, "video").select("video", "ref", (F.abs(F.col("brightness") - F.col("ref")) / near).alias("dev"))
    out = dev.groupBy("video").agg(F.first("ref").alias("reference"), F.avg("dev").alias("value"))
    return out.withColumn("stability", stability(F.col("value"), limit))


def color_stability(features: DataFrame, limit: float = LIMITS["color"]) -> DataFrame:
    """Mean over frames of the RMS of the channels' relative deviations from their medians."""
    ch = ("mean_b", "mean_g", "mean_r")
    refs = features.groupBy("video").agg(*(F.median(c).alias(f"ref_{c}") for c in ch))
    sq = sum((F.pow((F.col(c) - F.col(f"ref_{c}")) / F.when(F.abs(f"ref_{c}") > EPS, F.col(f"ref_{c}")).otherwise(F.lit(EPS)), 2) for c in ch), F.lit(0.0))
    dev = features.join(refs, "video").select("video", F.sqrt(sq / 3).alias("dev"))
    return dev.groupBy("video").agg(F.avg("dev").alias("value")).withColumn("stability", stability(F.col("value"), limit))


def spread_stability(features: DataFrame, column: str, limit: float) -> DataFrame:
    """Stability of a feature by its coefficient of variation (sharpness, noise)."""
    return features.groupBy("video").agg(relative_spread(column).alias("value")).withColumn("stability", stability(F.col("value"), limit))


def flicker_stability(features: DataFrame, limit: float = LIMITS["flicker"]) -> DataFrame:
    """RMS of brightness change per second over the mean brightness where all times are known, else
    the spread of brightness about its moving average."""
    rate = (F.col("brightness") - F.lag("brightness").over(_in_video())) / F.greatest(F.col("ts") - F.lag("ts").over(_in_video()), F.lit(1e-6))
    rows = moving_average(features.select("video", "frame_no", "ts", "brightness"), "brightness").withColumn("rate", rate)
    out = rows.groupBy("video").agg(F.avg("brightness").alias("mu"), F.sqrt(F.avg(F.col("rate") * F.col("rate"))).alias("rms"), F.stddev_pop(F.col("brightness") - F.col("smooth")).alias("sd"), F.bool_or(missing("ts")).alias("untimed"), F.count("*").alias("n"))
    mu = F.when(F.col("mu") > EPS, F.col("mu")).otherwise(F.lit(EPS))
    value = F.when(~F.col("untimed") & (F.col("n") > 1), F.col("rms") / mu).otherwise(F.col("sd") / mu)
    return out.select("video", value.alias("value"), (~F.col("untimed")).alias("uses_timebase")).withColumn("stability", stability(F.col("value"), limit))


def histogram_stability(features: DataFrame, limit: float = LIMITS["histogram"]) -> DataFrame:
    """Mean Bhattacharyya distance of frames' histograms from the bin-wise median's."""
    bins = features.select("video", F.posexplode("hist").alias("bin", "p")).groupBy("video", "bin").agg(F.median("p").alias("m"))
    ref = bins.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "m"))), lambda x: x["m"]).alias("ref"))
    total = F.aggregate("ref", F.lit(0.0), lambda s, x: s + x) + EPS
    ref = ref.withColumn("ref", F.transform("ref", lambda x: x / total))
    common = F.aggregate(F.zip_with("hist", "ref", lambda p, q: F.sqrt(p * q + EPS)), F.lit(0.0), lambda s, x: s + x)
    dist = features.join(ref, "video").select("video", F.sqrt(F.greatest(F.lit(0.0), 1 - common)).alias("d"))
    return dist.groupBy("video").agg(F.avg("d").alias("value"), F.median("d").alias("median_distance")).withColumn("stability", stability(F.col("value"), limit))


def composite(stabilities: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """video, sci: the weighted mean of columns named as WEIGHTS; negative weights count as 0."""
    w = {k: max(0.0, v) for k, v in (WEIGHTS | (weights or {})).items()}
    total = sum(w.values())
    total = total if total > EPS else 1.0
    return stabilities.select("video", sum((F.col(k) * (v / total) for k, v in w.items()), F.lit(0.0)).alias("sci"))


def sensor_consistency(features: DataFrame, limits: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The six stabilities of each video and their composite."""
    lim = LIMITS | (limits or {})
    parts = {
        "brightness": brightness_stability(features, lim["brightness"]),
        "color": color_stability(features, lim["color"]),
        "sharpness": spread_stability(features, "laplacian_variance", lim["sharpness"]),
        "noise": spread_stability(features, "noise_std", lim["noise"]),
        "flicker": flicker_stability(features, lim["flicker"]),
        "histogram": histogram_stability(features, lim["histogram"]),
    }
    out = None
    for k, p in parts.items():
        p = p.select("video", F.col("stability").alias(k))
        out = p if out is None else out.join(p, "video")
    return out.join(composite(out, weights), "video")


def blockage_score(c: dict[str, Column]) -> Column:
    """1 less the mean of five penalties, from columns low_intensity, low_texture, edge_gini,
    tile_entropy and border (the worst border)."""
    over = lambda k: F.least(F.lit(1.0), c[k] / (WARN[k] + EPS))
    entropy = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (WARN["tile_entropy"] - c["tile_entropy"]) / WARN["tile_entropy"]))
    return F.greatest(F.lit(0.0), 1 - (over("low_intensity") + over("low_texture") + over("edge_gini") + entropy + over("border")) / 5)


def view_score(c: dict[str, Column]) -> Column:
    """1 less the mean of three penalties, from columns scale_mean, scale_cov, border_constant."""
    capped = lambda v, k: F.least(F.lit(1.0), v / (WARN[k] + EPS))
    return F.greatest(F.lit(0.0), 1 - (capped(F.abs(c["scale_mean"] - 1), "scale") + capped(c["scale_cov"], "scale_cov") + capped(c["border_constant"], "border_constant")) / 3)


def degradation(features: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Blockage and view scores and their flags; videos of fewer than two frames score 1 and 1.
    views: view_changes() of the videos; without it what depends on scales is null."""
    sides = [f"border_{s}" for s in ("left", "right", "top", "bottom")]
    out = features.groupBy("video").agg(F.count("*").alias("frames"), *(F.avg(c).alias(c) for c in ("low_intensity", "low_texture", "edge_gini", "tile_entropy", *sides, "border_constant")))
    if views is not None:
        scales = views.where("scale is not null").groupBy("video").agg(F.avg("scale").alias("scale_mean"), (F.stddev_pop("scale") / (F.avg("scale") + EPS)).alias("scale_cov"), F.avg("rotation_deg").alias("rotation_mean_deg"), F.median("inliers").alias("inliers_median"))
        out = out.join(scales, "video", "left").withColumns({"scale_mean": F.coalesce("scale_mean", F.lit(1.0)), "scale_cov": F.coalesce("scale_cov", F.lit(0.0))})
    else:
        out = out.withColumns({"scale_mean": F.lit(None).cast("double"), "scale_cov": F.lit(None).cast("double")})
    out = out.withColumn("border", F.greatest(*sides))
    c = {k: F.col(k) for k in out.columns}
    few = F.col("frames") < 2
    out = out.withColumns({"partial_blockage_score": F.when(few, 1.0).otherwise(blockage_score(c)), "fov_change_score": F.when(few, 1.0).when(F.col("scale_mean").isNotNull(), view_score(c))})
    return out.withColumns({
        "insufficient_frames": few,
        "partial_blockage_suspected": F.col("partial_blockage_score") < 0.7,
        "fov_change_suspected": F.col("fov_change_score") < 0.7,
        "border_intrusion": ~few & (F.col("border") >= WARN["border"]),
        "scale_change": ~few & (F.abs(F.col("scale_mean") - 1) >= WARN["scale"]),
    })


def traffic_presence(scores: DataFrame, videos: DataFrame, threshold: float = 12.0) -> DataFrame:
    """The share of scored frames over the threshold; 0 for videos without scores."""
    out = scores.groupBy("video").agg(F.count("*").alias("total"), F.count_if(F.col("score") > threshold).alias("active"), F.avg("score").alias("mean_score"))
    out = videos.select("video").distinct().join(out, "video", "left").fillna({"total": 0, "active": 0, "mean_score": 0.0})
    return out.withColumn("presence_ratio", F.coalesce(ratio(F.col("active"), F.col("total")), F.lit(0.0)))


def window_coverage(spans: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """Overlap of recordings(file, t0, t1) with times of day ("HH:MM", "HH:MM"), each and in total;
    windows of no length are left out, recordings don't pass midnight."""
    minutes = lambda t: F.hour(t) * 60 + F.minute(t) + F.date_format(t, "ss.SSSSSS").cast("double") / 60
    of_day = lambda s: int(s.split(":")[0]) * 60 + int(s.split(":")[1])
    known = [(f"{a}-{b}", float(of_day(a)), float(of_day(b))) for a, b in windows if of_day(b) > of_day(a)]
    if not known:
        raise ValueError("no window has a length")
    table = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in known))
    rows = spans.select("file", minutes("t0").alias("m0"), minutes("t1").alias("m1"), F.explode(table).alias("w"))
    overlap = F.greatest(F.lit(0.0), F.least("m1", "w.b") - F.greatest("m0", "w.a"))
    each = rows.select("file", F.col("w.window").alias("window"), overlap.alias("overlap_minutes"), (F.col("w.b") - F.col("w.a")).alias("length"))
    total = Window.partitionBy("file")
    return each.select("file", "window", "overlap_minutes", (100.0 * F.col("overlap_minutes") / F.col("length")).alias("coverage_pct"), (100.0 * F.sum("overlap_minutes").over(total) / F.sum("length").over(total)).alias("total_coverage_pct"))


def stream_coverage(files: DataFrame, required: tuple[str, ...] = ("D",)) -> DataFrame:
    """Required stream letters present among files(sequence, path) named VIDc_*_{letter}.mp4; D and
    V stand for each other."""
    kind = F.upper(F.regexp_extract("path", r"VIDc_[^/]*_([^_/]+)\.mp4$", 1))
    seen = files.groupBy("sequence").agg(F.array_sort(F.array_compact(F.collect_set(F.when(kind != "", kind)))).alias("present"))
    color = F.array_contains("present", "D") | F.array_contains("present", "V")
    wanted = F.array(*(F.lit(r.upper()) for r in required)).cast("array<string>")
    lacking = F.filter(wanted, lambda r: ~F.when(r.isin("D", "V"), color).otherwise(F.array_contains(F.col("present"), r)))
    n = len(required)
    pct = F.lit(100.0) if n == 0 else F.bround(100.0 * (n - F.size(lacking)) / n, 1)
    return seen.select("sequence", "present", lacking.alias("missing"), pct.alias("coverage_pct"))


def sampled(frames: DataFrame, stride: int = 5, most: int | None = 500) -> DataFrame:
    """Every stride-th frame of a video, the first `most` of them, with times from 0 on."""
    out = frames.where(F.col("frame_no") % stride == 0)
    if most is not None:
        out = out.where(F.col("frame_no") < stride * most)
    t0 = F.first("ts").over(_in_video().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("ts", F.when(t0.isNotNull(), F.col("ts") - t0).otherwise(F.col("ts")))


