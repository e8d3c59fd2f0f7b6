"""Getting the package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let the session's executors import roadlens: its sources go with the application as one zip
    that the driver serves, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_roadlens_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # it came as a zip itself
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "roadlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._roadlens_shipped = True
