"""python -m roadlens log|traffic|summary ...: the three reports from a shell."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from roadlens.plans import reports


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="roadlens")
    sub = p.add_subparsers(dest="what", required=True)
    log = sub.add_parser("log", help="quality metrics of trajectory logs")
    log.add_argument("path")
    log.add_argument("--dataset-spec")
    log.add_argument("--expected-hz", type=float)
    log.add_argument("--no-role-check", action="store_true")
    tr = sub.add_parser("traffic", help="traffic metrics of one scene")
    source = tr.add_mutually_exclusive_group(required=True)
    source.add_argument("--log")
    source.add_argument("--openlabel")
    tr.add_argument("--opendrive")
    tr.add_argument("--expected-hz", type=float)
    tr.add_argument("--los-spec")
    tr.add_argument("--min-track-s", type=float, default=0.5)
    tr.add_argument("--static-disp-m", type=float, default=2.0)
    tr.add_argument("--max-speed-ms", type=float, default=55.0)
    tr.add_argument("--time-series", action="store_true")
    ds = sub.add_parser("summary", help="summary of many metric files")
    ds.add_argument("--root", required=True)
    ds.add_argument("--pattern", action="append")
    ds.add_argument("--d31", action="store_true")
    for q in (log, tr, ds):
        q.add_argument("--json", help="write the JSON here as well")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("roadlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "log":
        text = out = reports.log_report(spark, a.path, Path(a.dataset_spec).read_text() if a.dataset_spec else None, expected_hz=a.expected_hz, check_role=not a.no_role_check)
    elif a.what == "traffic":
        cleaning = {"min_track_s": a.min_track_s, "static_disp_m": a.static_disp_m, "max_speed_ms": a.max_speed_ms}
        text = out = reports.traffic_report(spark, a.log, a.openlabel, a.opendrive, a.expected_hz, Path(a.los_spec).read_text() if a.los_spec else None, cleaning=cleaning, series=a.time_series)
    else:
        text, out = reports.dataset_report(spark, a.root, tuple(a.pattern or ["*.json"]), a.d31)
    print(text)
    if a.json:
        Path(a.json).write_text(out)


if __name__ == "__main__":
    main()
