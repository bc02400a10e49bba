"""Signal quality over a stream of samples, in windows of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import at_rail, is_finite


def windowed_quality(samples: DataFrame, keys: Sequence[str], time: str, value: str, rail: float, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts, mean, extremes and rail samples of each key and window; rows later
    than ``late`` are dropped, as the watermark says. Works on batches alike."""
    rows = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    v = F.col(value)
    out = rows.groupBy(*keys, F.window(time, width).alias("_w")).agg(F.count("*").alias("samples"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.count_if(at_rail(v, rail)).alias("rail_samples"), F.bool_and(is_finite(v)).alias("all_finite"))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "samples", "mean", "minimum", "maximum", "rail_samples", "all_finite")
