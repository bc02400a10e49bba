"""Stages 4 and 5: robust curves, direction tests, sensitivity of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..functions.columns import in_window
from ..operators.effects import benjamini_hochberg, effect_agreement, hedges_g, resampled_tests, subject_consistency
from ..operators.signal import curve_differences, exploded, fitted_curves, median_curves
from ..operators.stats import compare_curves, window_statistics, with_strategies

CONDITION = ["file_name", "subject", "task", "cue_direction"]


def with_conditions(epochs: DataFrame, qc: DataFrame) -> DataFrame:
    return epochs.join(qc, ["file_name", "trial_id"])


LATERALITY = ("F4_minus_F3", "F4", "F3")


def direction_curves(epochs: DataFrame, cfg: Settings = Settings(), n_bootstraps: int | None = None, extra: tuple[str, ...] = (), keep_draws: bool = False) -> DataFrame:
    """Fitted curves of each recording and side, and F4 less F3 as a channel of
    its own with paired intervals; ``epochs`` hold what is taken."""
    n = cfg.n_curve_bootstraps if n_bootstraps is None else n_bootstraps
    return fitted_curves(epochs, [*CONDITION, *extra], cfg.channels, cfg, n, (LATERALITY,), keep_draws)


def direction_differences(curves: DataFrame) -> DataFrame:
    """Right less left of each recording and channel, with its interval; the
    curves must hold their draws."""
    return curve_differences(curves, ["file_name", "subject", "task", "channel"], "cue_direction", "R", "L")


def preview_curves(epochs: DataFrame) -> DataFrame:
    """Median of the accepted trials of each recording, side and channel."""
    return median_curves(epochs.where("accepted_for_erp"), CONDITION)


def effect_matrix(tests: DataFrame, windows: tuple[str, ...], channels: tuple[str, ...]) -> DataFrame:
    """One row per recording, one effect per window and channel."""
    cells = [F.max(F.when((F.col("window") == w) & (F.col("channel") == c), F.col("hedges_g"))).alias(f"{w}__{c}") for w in windows for c in channels]
    return tests.groupBy("file_name", "subject", "task").agg(*cells)


def curve_features(curves: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Mean, positive peak, its latency and area of each window of a curve."""
    first, _ = cfg.epoch_offsets
    keys = [c for c in curves.columns if c not in ("values", "ci_low", "ci_high", "draws")]
    points = exploded(curves, keys, cfg.sample_rate, first)
    return window_statistics(points, keys, "time_s", "v", cfg.curve_windows, cfg.sample_rate).select(*keys, "window", "mean", "positive_peak", "positive_peak_latency_s", "area")


def trial_means(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """A trial's mean of each of the two test windows, by channel and for F4-F3."""
    low, _ = cfg.epoch_offsets
    keep = [c for c in epochs.columns if c != "values"]
    rows = []
    for w in cfg.curve_windows[:2]:
        at = [k for k, t in enumerate(cfg.times()) if w.low <= t <= w.high]
        mean = F.aggregate(F.slice("values", at[0] + 1, len(at)), F.lit(0.0), lambda a, b: a + b) / len(at)
        rows.append(F.struct(F.lit(w.name).alias("window"), mean.alias("v")))
    means = epochs.select(*keep, F.explode(F.array(*rows)).alias("_w")).select(*keep, "_w.window", "_w.v")
    others = [c for c in keep if c != "channel"]
    apart = means.groupBy(*others, "window").agg((F.max(F.when(F.col("channel") == "F4", F.col("v"))) - F.max(F.when(F.col("channel") == "F3", F.col("v")))).alias("v")).withColumn("channel", F.lit("F4_minus_F3"))
    return means.unionByName(apart)


def direction_tests(epochs: DataFrame, cfg: Settings = Settings(), extra: tuple[str, ...] = (), family: tuple[str, ...] = ()) -> DataFrame:
    """Right against left of each recording, window and channel: effect size,
    permutation p, interval, and p adjusted within ``family``. Differences of
    F4 and F3 are a family of their own."""
    means = trial_means(epochs, cfg)
    keys = ["file_name", "subject", "task", *extra, "window", "channel"]
    effects = hedges_g(means, keys, "v", F.col("cue_direction") == "R", 1e-20)
    tests = resampled_tests(means, keys, "v", "cue_direction", cfg.n_permutations, cfg.n_difference_bootstraps, cfg.seed)
    both = effects.join(tests, keys).withColumn("laterality", F.col("channel") == "F4_minus_F3")
    return benjamini_hochberg(both, [*family, "laterality"], "p_permutation", keys)


def consistency(tests: DataFrame) -> DataFrame:
    return subject_consistency(tests.where("not laterality"), ["task", "window", "channel"], "subject", ("A", "B"), "hedges_g")


def strategies(epochs: DataFrame) -> DataFrame:
    return with_strategies(epochs, "edge_flag", "residual_artifact_flag", "accepted_for_erp")


def trial_counts(qc: DataFrame) -> DataFrame:
    return strategies(qc).groupBy("file_name", "subject", "task", "strategy", "cue_direction").agg(F.count("*").alias("n_side"))


def sensitivity_of_curves(curves: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Each alternative strategy's curve against the strict one: by direction
    and for right - left; latency shifts in ms by window."""
    first, _ = cfg.epoch_offsets
    keys = ["file_name", "subject", "task", "channel"]
    sides = curves.where(F.col("channel") != LATERALITY[0]).select(*keys, "strategy", "cue_direction", "values")
    apart = sides.groupBy(*keys, "strategy").agg(*[F.max(F.when(F.col("cue_direction") == s, F.col("values"))).alias(s) for s in "LR"]).select(*keys, "strategy", F.lit("R_minus_L").alias("cue_direction"), F.zip_with("R", "L", lambda a, b: a - b).alias("values"))
    points = exploded(sides.unionByName(apart), [*keys, "strategy", "cue_direction"], cfg.sample_rate, first)
    keys = [*keys, "cue_direction"]
    strict = points.where("strategy = 'strict_rejection'").select(*keys, "t_idx", "time_s", F.col("v").alias("_p"))
    other = points.where("strategy <> 'strict_rejection'").select(*keys, "strategy", "t_idx", F.col("v").alias("_o"))
    pairs = other.join(strict, [*keys, "t_idx"])
    metrics = compare_curves(pairs.where(in_window(F.col("time_s"), cfg.compare)), [*keys, "strategy"], "_p", "_o")
    peaks = window_statistics(points, [*keys, "strategy"], "time_s", "v", cfg.curve_windows[:2], cfg.sample_rate).select(*keys, "strategy", "window", F.col("positive_peak_latency_s").alias("_l"))
    base = peaks.where("strategy = 'strict_rejection'").drop("strategy").withColumnRenamed("_l", "_b")
    shifts = peaks.where("strategy <> 'strict_rejection'").join(base, [*keys, "window"]).groupBy(*keys, "strategy").pivot("window", [w.name for w in cfg.curve_windows[:2]]).agg(F.first((F.col("_l") - F.col("_b")) * 1000))
    names = [w.name for w in cfg.curve_windows[:2]]
    return metrics.join(shifts.select(*keys, "strategy", *[F.col(n).alias(f"{n}_peak_latency_shift_ms") for n in names]), [*keys, "strategy"])


def sensitivity_summary(metrics: DataFrame, tests: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per alternative: medians and extremes of the curves' changes and
    agreement of effects and decisions. Latencies of differences don't count."""
    one = F.col("cue_direction") != "R_minus_L"
    names = [f"{w.name}_peak_latency_shift_ms" for w in cfg.curve_windows[:2]]
    shift = metrics.where(one).select("strategy", F.explode(F.array(*[F.abs(n) for n in names])).alias("s")).groupBy("strategy").agg(F.median("s").alias("peak_latency_shift_median_ms"), F.max("s").alias("peak_latency_shift_max_ms"))
    pick = lambda c, cond: F.when(cond, F.col(c))
    curves = metrics.groupBy("strategy").agg(F.median(pick("curve_correlation", one)).alias("curve_correlation_median"), F.min(pick("curve_correlation", one)).alias("curve_correlation_min"), F.median(pick("nrmse", one)).alias("nrmse_median"), F.max(pick("nrmse", one)).alias("nrmse_max"), F.median(pick("curve_correlation", ~one)).alias("direction_difference_correlation_median"), F.min(pick("curve_correlation", ~one)).alias("direction_difference_correlation_min"), F.median(pick("nrmse", ~one)).alias("direction_difference_nrmse_median"), F.max(pick("nrmse", ~one)).alias("direction_difference_nrmse_max"))
    keys = ["file_name", "window", "channel"]
    rows = tests.where("not laterality")
    base = rows.where("strategy = 'strict_rejection'").select(*keys, F.col("hedges_g").alias("_g"), F.col("significant").alias("_s"))
    pairs = rows.where("strategy <> 'strict_rejection'").join(base, keys)
    effects = effect_agreement(pairs, ["strategy"], "_g", "hedges_g", "_s", "significant")
    return curves.join(shift, "strategy").join(effects, "strategy")
