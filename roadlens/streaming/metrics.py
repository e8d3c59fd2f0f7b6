"""Track metrics over streams of samples: bounded state by watermarks, late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detections(samples: DataFrame, window: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """Per file and window of event time (column ts): samples, objects (about) and fast samples. late
    is None where samples have a watermark already."""
    fast = F.hypot(F.col("vel_x"), F.col("vel_y")) > 50
    timed = samples if late is None else samples.withWatermark("ts", late)
    out = timed.groupBy("file", F.window("ts", window)).agg(F.count("*").alias("samples"), F.approx_count_distinct("idx").alias("objects"), F.count_if(fast).alias("fast_samples"))
    return out.select("file", F.col("window.start").alias("start"), "samples", "objects", "fast_samples")


def without_repeats(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """samples without rows that repeat (file, ts, idx) within the watermark."""
    return samples.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file", "ts", "idx"])


def per_batch(metric, path: str):
    """A foreachBatch sink that writes metric(batch) to path under the batch's number, so that a
    batch that is tried again replaces its own result."""

    def run(batch: DataFrame, number: int) -> None:
        metric(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
