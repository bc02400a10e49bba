"""Stage 6: features of each trial, classification across subjects, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Settings, Window
from ..functions.columns import decibels, is_finite
from ..operators.effects import hedges_g, stable_effects
from ..operators.evaluate import confusion_metrics, roc_auc, stratified_inference
from ..operators.relational import best, feature_group, first_or, same_sets, top_per_group
from ..operators.signal import array_bands, channel_difference, coupling, exploded
from ..operators.stats import window_statistics
from ..sources.tables import checks

TRIAL = ["file_name", "trial_id"]
STATS = ("mean", "std", "peak_to_peak", "area", "positive_peak", "positive_peak_latency_s", "negative_peak", "negative_peak_latency_s", "slope_per_s", "line_length_per_s")


def _wide(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(trial, feature columns) of rows that hold one feature name per value."""
    return rows.groupBy(*TRIAL).agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(name) for f, name in columns.items()])


def time_features(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Time statistics of both windows, of each channel and of F4 less F3."""
    first, _ = cfg.epoch_offsets
    apart = channel_difference(epochs, TRIAL, "channel", "F4", "F3").select(*TRIAL, F.lit("F4_minus_F3").alias("channel"), "values")
    points = exploded(epochs.select(*TRIAL, "channel", "values").unionByName(apart), [*TRIAL, "channel"], cfg.sample_rate, first)
    stats = window_statistics(points, [*TRIAL, "channel"], "time_s", "v", cfg.curve_windows[:2], cfg.sample_rate)
    group = F.when(F.col("channel") == "F4_minus_F3", "laterality_time").otherwise("time")
    long = stats.withColumn("_name", F.concat_ws("__", group, "channel", "window")).unpivot([*TRIAL, "_name"], list(STATS), "stat", "value").withColumn("feature", F.concat_ws("__", "_name", "stat"))
    names = [f"{g}__{c}__{w.name}__{s}" for g, cs in (("time", cfg.channels), ("laterality_time", ("F4_minus_F3",))) for c in cs for w in cfg.curve_windows[:2] for s in STATS]
    return _wide(long, {n: n for n in names})


def spectral_features(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Change from the baseline in dB and share of the response power, by band
    and channel, and their differences F4 less F3."""
    at = lambda w: [k for k, t in enumerate(cfg.times()) if w.low <= t and (t < w.high if w.half_open else t <= w.high)]
    before, after = at(cfg.spectral_baseline), at(Window("response", 0.0, 0.9))
    rows = epochs.select(*TRIAL, "channel", array_bands(F.col("values"), before[0], before[-1] + 1, cfg).alias("b"), array_bands(F.col("values"), after[0], after[-1] + 1, cfg).alias("r"))
    out = []
    for i, (name, _, _) in enumerate(cfg.bands):
        change = decibels(F.col("r")[i], F.col("b")[i], cfg.epsilon)
        share = F.col("r")[i] / (F.col("r")[len(cfg.bands)] + cfg.epsilon)
        out += [change.alias(f"{name}__change_db"), share.alias(f"{name}__response_relative")]
    names = [f"{n}__{m}" for n, _, _ in cfg.bands for m in ("change_db", "response_relative")]
    wide = rows.select(*TRIAL, "channel", *out).groupBy(*TRIAL).agg(*[F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"spectral__{c}__{n}") for c in cfg.channels for n in names])
    return wide.select("*", *[(F.col(f"spectral__F4__{n}") - F.col(f"spectral__F3__{n}")).alias(f"laterality_spectral__F4_minus_F3__{n}") for n in names])


def coupling_features(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    rows = epochs.groupBy(*TRIAL).agg(*[F.max(F.when(F.col("channel") == c, F.col("values"))).alias(c) for c in cfg.channels])
    out = []
    for a, b in cfg.pairs:
        for w in (*cfg.curve_windows[:2], cfg.coupling_full):
            at = [k for k, t in enumerate(cfg.times()) if w.low <= t <= w.high]
            part = lambda c: F.slice(c, at[0] + 1, len(at))  # noqa: B023, E731
            out.append((f"coupling__{a}_{b}__{w.name}", coupling(part(a), part(b), cfg)))
    wide = rows.select(*TRIAL, *[x.alias(n) for n, x in out])
    return wide.select(*TRIAL, *[F.col(f"{n}.{m}").alias(f"{n}__{m}") for n, _ in out for m in ("zero_lag_correlation", "max_abs_cross_correlation", "lag_at_max_ms")])


def trial_features(epochs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Ids and 139 features of each trial; ``epochs`` hold accepted trials with
    subject, task, cue_direction. Three groupings by trial share one shuffle key."""
    ids = epochs.select(*TRIAL, "subject", "task", "cue_direction", (F.col("cue_direction") == "R").cast("int").alias("target_R")).distinct()
    return ids.join(time_features(epochs, cfg), TRIAL).join(spectral_features(epochs, cfg), TRIAL).join(coupling_features(epochs, cfg), TRIAL)


def feature_groups(columns: list[str]) -> dict[str, list[str]]:
    time = ("time__", "laterality_time__")
    spectral = (*time, "spectral__", "laterality_spectral__")
    return {"time_only": feature_group(columns, time), "time_plus_spectral": feature_group(columns, spectral), "full_multichannel": feature_group(columns, (*spectral, "coupling__"))}


def bidirectional_summary(predictions: DataFrame, cfg: Settings = Settings(), n_permutations: int = 2000, n_bootstraps: int = 2000) -> DataFrame:
    """Both directions' external predictions together, by scope and group."""
    keys = ["scope", "feature_group"]
    rows = predictions.where("kind = 'prediction'").withColumn("stratum", F.concat_ws("_", "subject", "task"))
    out = confusion_metrics(rows, keys, "truth", "guess").join(roc_auc(rows, keys, "truth", "probability"), keys)
    return out.join(stratified_inference(rows, keys, "stratum", "truth", "guess", n_permutations, n_bootstraps, cfg.seed), keys)


def directional_results(predictions: DataFrame, cfg: Settings = Settings(), n_permutations: int | None = None) -> DataFrame:
    """Each split by itself, with the permutation p of its external predictions
    (truths exchanged within tasks)."""
    keys = ["scope", "feature_group", "train_subject", "test_subject"]
    rows = predictions.where("kind = 'prediction'")
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n_test"), *[F.first(c).alias(name) for c, name in (("n_train", "n_train"), ("n_input", "n_input_features"), ("n_selected", "n_selected_features"), ("best_c", "best_c"), ("inner_balanced_accuracy", "inner_cv_balanced_accuracy"))])
    n = cfg.n_model_permutations if n_permutations is None else n_permutations
    p = stratified_inference(rows, keys, "task", "truth", "guess", n, 0, cfg.seed + 1).select(*keys, F.col("permutation_p").alias("test_permutation_p"))
    return facts.join(confusion_metrics(rows, keys, "truth", "guess"), keys).join(roc_auc(rows, keys, "truth", "probability"), keys).join(p, keys)


def selected_coefficients(predictions: DataFrame) -> DataFrame:
    return predictions.where("kind = 'coefficient'").select("scope", "feature_group", "train_subject", "test_subject", "feature", F.col("coefficient").alias("standardized_coefficient"), F.abs("coefficient").alias("absolute_coefficient"))


def feature_effects(features: DataFrame, names: list[str]) -> DataFrame:
    """Hedges' g of every feature by task and subject, and which are stable."""
    long = features.select("subject", "task", "target_R", *names).unpivot(["subject", "task", "target_R"], names, "feature", "value")
    return hedges_g(long, ["task", "subject", "feature"], "value", F.col("target_R") == 1, 1e-12)


def stable_features(effects: DataFrame) -> DataFrame:
    return stable_effects(effects, ["task", "feature"], "subject", ("A", "B"), "hedges_g")


def shown_features(stable: DataFrame, per_task: int = 6, otherwise: int = 10) -> DataFrame:
    """Features to show: of each task the ``per_task`` of largest conservative
    effect among those of one sign; where no task has any, the ``otherwise`` of
    largest mean effect."""
    order = [F.desc("conservative_abs_g"), F.desc("mean_abs_g"), F.asc("feature")]
    agreed = top_per_group(stable.where("sign_consistent"), ["task"], order, per_task).select("feature").distinct()
    largest = best(stable.groupBy("feature").agg(F.max("mean_abs_g").alias("g")), [F.desc("g"), F.asc("feature")], otherwise).select("feature")
    return first_or(agreed, largest)


def model_checks(features: DataFrame, names: list[str], results: DataFrame, summary: DataFrame, forbidden: tuple[str, ...], n_trials: int, least_of_a_class: int = 40, n_summaries: int = 9) -> DataFrame:
    """(check, passed): what a run must hold to be reported."""
    finite = F.lit(True)
    for n in names:
        finite = finite & is_finite(F.col(n))
    classes = features.groupBy("subject", "task", "cue_direction").agg(F.count("*").alias("n"))
    spoken = any(token in n.lower() for n in names for token in forbidden)
    return checks(
        number_of_trials=features.agg(F.count("*") == n_trials),
        trials_are_unique=features.groupBy(*TRIAL).agg(F.count("*").alias("n")).agg(F.max("n") == 1),
        features_are_finite=features.agg(F.bool_and(finite)),
        features_do_not_tell_the_outcome=features.agg((F.count("*") >= 0) & F.lit(not spoken)),
        subjects_of_a_split_are_apart=results.agg(F.bool_and(F.col("train_subject") != F.col("test_subject"))),
        directions_are_left_and_right=same_sets(features.select("cue_direction"), features.select(F.explode(F.array(F.lit("L"), F.lit("R"))).alias("cue_direction"))),
        classes_are_large_enough=classes.agg(F.min("n") >= least_of_a_class),
        number_of_summaries=summary.agg(F.count("*") == n_summaries),
    )
