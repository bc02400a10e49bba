"""Stage 3: filtered epochs, artifact rules and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..functions.columns import at_rail, in_window, is_finite, reasons
from ..operators.segments import fill_gaps, slices
from ..operators.signal import bandpass
from ..operators.stats import over_threshold, robust_thresholds

TRIAL = ["file_name", "trial_id"]


def filtered_signals(samples: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(file_name, channel, sample_idx, filtered): faulty samples are bridged in
    the copy that is filtered."""
    rows = samples.where(F.col("channel").isin(*cfg.channels))
    bad = at_rail(F.col("value"), cfg.rail) | ~is_finite(F.col("value"))
    filled = fill_gaps(rows, ["file_name", "channel"], "sample_idx", "value", bad)
    return bandpass(filled, ["file_name", "channel"], "sample_idx", "filled", cfg)


def cut_epochs(trials: DataFrame, filtered: DataFrame, recordings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(file_name, trial_id, channel, values): baseline-corrected epochs of the
    trials whose whole window lies in the recording."""
    low, high = cfg.epoch_offsets
    inside = trials.select(*TRIAL, "cue_onset_sample").join(recordings.select("file_name", "n_samples"), "file_name")
    inside = inside.where((F.col("cue_onset_sample") + low >= 0) & (F.col("cue_onset_sample") + high <= F.col("n_samples"))).drop("n_samples")
    cut = slices(inside, filtered, ["file_name"], "cue_onset_sample", "sample_idx", low, high)
    in_base = in_window((F.col("t_idx") + low) / F.lit(cfg.sample_rate), cfg.baseline)
    whole = cut.groupBy(*TRIAL, "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "filtered"))), lambda s: s["filtered"]).alias("values"), F.avg(F.when(in_base, F.col("filtered"))).alias("_base"))
    return whole.select(*TRIAL, "channel", F.transform("values", lambda v: v - F.col("_base")).alias("values"))


def epoch_metrics(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """peak_to_peak, maximum_absolute and maximum_step of the artifact window,
    from the arrays themselves: no shuffle."""
    low, _ = cfg.epoch_offsets
    at = [k for k, t in enumerate(cfg.times()) if cfg.artifact.low <= t <= cfg.artifact.high]
    part = F.slice("values", at[0] + 1, len(at))
    rows = epochs.select(*TRIAL, "channel", part.alias("_w"))
    steps = F.zip_with(F.slice("_w", 2, len(at) - 1), F.slice("_w", 1, len(at) - 1), lambda a, b: F.abs(a - b))
    return rows.select(*TRIAL, "channel", (F.array_max("_w") - F.array_min("_w")).alias("peak_to_peak"), F.array_max(F.transform("_w", lambda v: F.abs(v))).alias("maximum_absolute"), F.array_max(steps).alias("maximum_step"))


METRICS = ("peak_to_peak", "maximum_absolute", "maximum_step")


def reject_artifacts(trials: DataFrame, epochs: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(epoch_qc, artifact_thresholds). Thresholds come from trials in bounds
    without faulty samples, and only those can be residual artifacts; a
    recording with too few of them fails."""
    metrics = epoch_metrics(epochs, cfg)
    flags = trials.select("file_name", "trial_id", "subject", "task", "cue_value", "cue_direction", "correct_inferred", (F.col("saturation_flag") | F.col("nonfinite_flag")).alias("raw_saturation_or_nonfinite_flag"))
    in_bounds = metrics.select(*TRIAL).distinct().withColumn("_in", F.lit(True))
    flags = flags.join(in_bounds, TRIAL, "left").withColumn("edge_flag", F.col("_in").isNull()).drop("_in")
    long = metrics.unpivot([*TRIAL, "channel"], list(METRICS), "metric", "value")
    long = long.join(flags.select(*TRIAL, "subject", "task", (~F.col("edge_flag") & ~F.col("raw_saturation_or_nonfinite_flag")).alias("_source")), TRIAL)
    source = long.where("_source")
    keys = ["file_name", "metric", "channel"]
    thresholds = robust_thresholds(source, keys, "value", cfg.mad_scale, cfg.mad_multiple)
    enough = source.groupBy("file_name").agg(F.count_distinct("trial_id").alias("_n"))
    thresholds = thresholds.join(enough, "file_name").withColumn("threshold", F.when(F.col("_n") >= cfg.least_threshold_trials, F.col("threshold")).otherwise(F.raise_error(F.lit("too few trials for thresholds")).cast("double"))).drop("_n")
    residual = over_threshold(long, thresholds, keys, TRIAL, "value", F.col("_source"))
    qc = flags.join(residual, TRIAL, "left").withColumn("residual_artifact_flag", F.coalesce("residual_artifact", F.lit(False))).drop("residual_artifact")
    accepted = ~F.col("edge_flag") & ~F.col("raw_saturation_or_nonfinite_flag") & ~F.col("residual_artifact_flag")
    # Names of the reasons, in order.
    qc = qc.withColumn("accepted_for_erp", accepted).withColumn("rejection_reason", reasons(("epoch_out_of_bounds", F.col("edge_flag")), ("raw_saturation_or_nonfinite", F.col("raw_saturation_or_nonfinite_flag")), ("extreme_residual_artifact", F.col("residual_artifact_flag"))))
    return qc, thresholds


def retention(qc: DataFrame) -> DataFrame:
    """Counts of a recording's trials by fate and side."""
    side = lambda s: F.col("cue_direction") == s
    return qc.groupBy("file_name", "subject", "task").agg(F.count("*").alias("total_trials"), F.count_if("edge_flag").alias("rejected_edge"), F.count_if(~F.col("edge_flag") & F.col("raw_saturation_or_nonfinite_flag")).alias("rejected_saturation_or_nonfinite"), F.count_if("residual_artifact_flag").alias("rejected_residual_artifact"), F.count_if("accepted_for_erp").alias("accepted_trials"), *[F.count_if(side(s)).alias(f"total_{s}") for s in "LR"], *[F.count_if(side(s) & F.col("accepted_for_erp")).alias(f"accepted_{s}") for s in "LR"])

