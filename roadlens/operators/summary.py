"""Dataset summaries: aggregates, pass counts and flags over per-file metric rows, and their texts."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions import taxonomies as T

DASH = "—"


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """metric, mean, min, max, n over the values given; metrics without any are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in keys))).alias("m")
    flat = rows.select(pairs).select("m.*").where("value is not null")
    return flat.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


def pass_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """flag, passed, judged, mark: all, none or some of those judged passed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(k).alias("ok")) for k in flags))).alias("m")
    out = rows.select(pairs).select("m.*").where("ok is not null").groupBy("flag").agg(F.count_if("ok").alias("passed"), F.count("*").alias("judged"))
    mark = F.when(F.col("passed") == F.col("judged"), "✓").when(F.col("passed") == 0, "✗").otherwise("~")
    return out.withColumn("mark", mark)


def _joined(parts: list[Column]) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit(DASH))


def video_flags(limits: dict[str, float] | None = None) -> Column:
    """Labels of the scalars under their limits; missing ones never are."""
    short = {"tds": "TDS", "tcomp": "TComp", "dup": "Dup", "sci": "SCI", "blk": "Blk", "fov": "FOV"}
    return _joined([F.when(F.col(k) < limit, f"{short.get(k, k)}↓") for k, limit in (limits or T.VIDEO_WARN_BELOW).items()])


def log_flags(labels: dict[str, str] | None = None) -> Column:
    """Labels of the flags that are false; missing ones never are."""
    return _joined([F.when(~F.col(k), f"{label}↓") for k, label in (labels or T.LOG_FLAGS).items()])


def clip(path: str, width: int = 40) -> Column:
    p = F.col(path)
    return F.when(F.length(p) > width, F.concat(F.lit("…"), F.right(p, F.lit(width - 1)))).otherwise(p)


def _number(v) -> str:
    return DASH if v is None else f"{v:.1f}"


def _tick(v) -> str:
    return DASH if v is None else "✓" if v else "✗"


def _metric_lines(frame: DataFrame, labels: dict[str, str], logs: bool) -> list[str]:
    """A line per metric; of logs, those without values too, with how many files passed, and then
    what only passes or fails."""
    got = {r.metric: r for r in aggregate(frame, list(labels)).collect()}  # a row per metric
    flags = [flag for flag, _ in T.LOG_PASS_OF.values()] + list(T.LOG_PASS_ONLY)
    passed = {r.flag: r for r in pass_counts(frame, flags).collect()} if logs else {}

    def line(label, a, flag, limit):
        n = "" if a is None else a.n
        values = [None] * 3 if a is None else [a.mean, a["min"], a["max"]]
        p = passed.get(flag)
        verdict = f"{p.mark} {p.passed}/{p.judged}" if p else ""
        numbers = "  ".join(f"{_number(v):>7}" for v in values)
        return f"  {label:<36}  {numbers}  {n:>4}   {verdict:<7}  {limit}".rstrip()

    if not logs:
        return [line(label, got[k], "", "") for k, label in labels.items() if k in got]
    lines = [line(label, got.get(k), *T.LOG_PASS_OF.get(k, ("", ""))) for k, label in labels.items()]
    return lines + [line(label, None, flag, limit) for flag, (label, limit) in T.LOG_PASS_ONLY.items() if flag in passed]


def _file_lines(frame: DataFrame, flags: Column, columns: dict[str, str], ticks: dict[str, str], two_digits: bool):
    """A line per file, in order of path, fetched a partition at a time."""
    yield f"  {'File':<40}  " + "  ".join(f"{c:>7}" for c in [*columns.values(), *ticks.values()]) + "  Flags"
    for r in frame.withColumns({"flags": flags, "short": clip("path")}).orderBy("path").toLocalIterator():
        cells = [f"{r[k]:.2f}" if k == "dup" and two_digits and r[k] is not None else _number(r[k]) for k in columns]
        yield f"  {r.short:<40}  " + "  ".join(f"{c:>7}" for c in [*cells, *(_tick(r[k]) for k in ticks)]) + f"  {r.flags}"


def report_lines(root: str, videos: DataFrame, logs: DataFrame, n_files: int, official: bool = False):
    """The lines of the summary, in either layout; those of files come from the cluster as they are read."""
    v_labels, l_labels, flags = (T.OFFICIAL_VIDEO_LABELS, T.OFFICIAL_LOG_LABELS, T.OFFICIAL_FLAGS) if official else (T.VIDEO_LABELS, T.LOG_LABELS, T.LOG_FLAGS)
    n_videos, n_logs = videos.count(), logs.count()
    yield f"Dataset summary: {root}"
    yield f"Scanned: {datetime.date.today()}  Files: {n_files} (video {n_videos}, log {n_logs})"
    head = f"  {'Metric':<36}  {'mean %':>7}  {'min %':>7}  {'max %':>7}  {'n':>4}"
    if n_videos:
        yield from ("", f"Video ({n_videos} files)", head, *_metric_lines(videos, v_labels, False), "")
        columns = {k: T.VIDEO_FILE_COLUMNS[k] for k in v_labels}
        yield from _file_lines(videos, video_flags(), columns, {}, official)
    if n_logs:
        yield from ("", f"Trajectory logs ({n_logs} files)", head + f"   {'Passed':<7}  Threshold", *_metric_lines(logs, l_labels, True), "")
        yield from _file_lines(logs, log_flags(flags), T.LOG_FILE_COLUMNS, T.OFFICIAL_TICKS if official else {}, True)


def report(root: str, videos: DataFrame, logs: DataFrame, n_files: int, official: bool = False) -> str:
    """The summary as one text."""
    return "\n".join(report_lines(root, videos, logs, n_files, official))


def document(root: str, videos: DataFrame, logs: DataFrame, n_files: int) -> str:
    """The summary as JSON: root, date, counts, aggregates and rows."""
    v_keys, l_keys = list(T.VIDEO_LABELS), list(T.LOG_LABELS)
    block = lambda rows, keys: {r.metric: {"mean": r.mean, "min": r["min"], "max": r["max"], "n": r.n} for r in aggregate(rows, keys).collect()}
    rows = videos.unionByName(logs, allowMissingColumns=True).orderBy("path")
    return json.dumps(
        {
            "root": root,
            "date": datetime.date.today().isoformat(),
            "n_files": n_files,
            "aggregated": {"video": block(videos, v_keys), "omegaprime": block(logs, l_keys)},
            "rows": [json.loads(r) for r in rows.toJSON().collect()],
        },
        indent=2,
        ensure_ascii=False,
    )
