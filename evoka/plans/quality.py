"""Stage 2: quality of the raw channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..operators.signal import median_spectrum, spectra
from ..operators.stats import band_power, dominant, signal_quality

KEYS = ["file_name", "channel"]


def channel_spectra(samples: DataFrame, cfg: Settings = Settings(), n_segment: int = 8192) -> DataFrame:
    rows = samples.where(F.col("channel").isin(*cfg.channels))
    return spectra(rows, KEYS, "sample_idx", "value", cfg.sample_rate, n_segment, n_segment // 2)


def recording_spectrum(power: DataFrame) -> DataFrame:
    """Median over the channels of each recording's spectra."""
    return median_spectrum(power, ["file_name"])


def raw_quality(samples: DataFrame, power: DataFrame, recordings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per recording and channel: what ``recordings`` say of it,
    statistics, rail share, band powers and their ratios, dominant frequency
    from 45 to 70 Hz."""
    out = signal_quality(samples.where(F.col("channel").isin(*cfg.channels)), KEYS, "value", cfg.rail)
    for name, low, high in (("power_0_1_0_5", 0.1, 0.5), ("power_1_30", 1.0, 30.0), ("power_59_61", 59.0, 61.0)):
        out = out.join(band_power(power, KEYS, low, high, False, None).withColumnRenamed("band_power", name), KEYS, "left")
    out = out.join(dominant(power, KEYS, 45.0, 70.0).withColumnRenamed("dominant_frequency", "dominant_45_70_hz"), KEYS, "left")
    ratio = lambda c: F.col(c) / F.when(F.col("power_1_30") > 0, F.col("power_1_30"))
    out = out.join(recordings.select("file_name", "subject", "task", "sample_rate_hz"), "file_name", "left")
    return out.withColumn("low_to_1_30_ratio", ratio("power_0_1_0_5")).withColumn("line60_to_1_30_ratio", ratio("power_59_61"))
