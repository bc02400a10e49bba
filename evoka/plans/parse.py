"""Stage 1: trials from the event channels of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import Settings
from ..functions.columns import at_rail, flag_code, is_finite, reasons, side_of, sign_match
from ..operators.segments import first_matches, in_intervals, intervals, run_segments, step_facts
from ..operators.stats import quantiles

KEY = ["file_name"]


def event_runs(samples: DataFrame, channel: str) -> DataFrame:
    """Runs of whole codes other than 0 of an event channel."""
    rows = samples.where(F.col("channel") == channel).select("file_name", "sample_idx", "value")
    return run_segments(rows, KEY, "sample_idx", "value", 0.0).withColumn("value", F.col("value").cast("int"))


def parse_trials(samples: DataFrame, recordings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per cue. ``samples``: file_name, channel, sample_idx, value, with
    channels ``cue``, ``event`` and the signals'; ``recordings``: file_name,
    subject, task, sample_rate_hz, n_samples."""
    facts = recordings.select("file_name", "subject", "task", "sample_rate_hz", "n_samples")
    cues = event_runs(samples, "cue").where(F.abs("value") == 1).join(facts, "file_name")
    cues = intervals(cues, KEY, "start", F.col("n_samples"))
    events = event_runs(samples, "event").select("file_name", "start", "end", "length", F.col("value").alias("code"))
    found = in_intervals(cues, events, KEY, "start")
    trials = first_matches(cues, found, KEY, "start", ["end", "length", "code"], "target", F.abs("code") == 1)
    trials = first_matches(trials, found, KEY, "start", ["end", "length", "code"], "response", F.abs("code") == 2)
    second = F.col("task") == cfg.tasks[1]
    trials = trials.withColumn("response", F.when(second, F.col("response")))
    trials = trials.join(_epoch_faults(trials, samples, cfg), [*KEY, "place"], "left")

    fs, cue, target, response = F.col("sample_rate_hz"), F.col("value"), F.col("target"), F.col("response")
    cue_match, response_match = sign_match(cue, target["code"]), sign_match(target["code"], response["code"])
    both = second & target.isNotNull() & response.isNotNull()
    proxy = ~second & target.isNotNull()
    rail = [F.coalesce(F.col(f"rail_{c}"), F.lit(False)) for c in cfg.channels]
    saturated = rail[0] | rail[1] | rail[2] if len(rail) == 3 else F.exists(F.array(*rail), lambda r: r)
    nonfinite = F.coalesce("nonfinite", F.lit(False))
    # Names of the faults, in order.
    why = reasons(
        ("missing_target_event", F.col("n_target") == 0),
        ("multiple_target_events", F.col("n_target") > 1),
        ("task1_cue_channel9_mismatch", ~second & target.isNotNull() & ~cue_match),
        ("missing_click_event", second & (F.col("n_response") == 0)),
        ("multiple_click_events", second & (F.col("n_response") > 1)),
        ("task2_target_click_mismatch", both & ~response_match),
        ("raw_eeg_rail_saturation", saturated),
        ("nan_or_inf_in_epoch", nonfinite),
    )
    return trials.select(
        "subject", "task", "file_name", F.col("place").cast("int").alias("trial_id"), "sample_rate_hz",
        cue.alias("cue_value"), side_of(cue).alias("cue_direction"), F.col("start").alias("cue_onset_sample"), F.col("end").alias("cue_offset_sample"),
        (F.col("start") / fs).alias("cue_onset_s"), (F.col("end") / fs).alias("cue_offset_s"), (F.col("length") / fs).alias("cue_duration_s"),
        target["code"].alias("target_value"), side_of(target["code"]).alias("target_side"), target["start"].alias("target_onset_sample"), target["end"].alias("target_offset_sample"),
        (target["start"] / fs).alias("target_onset_s"), (target["end"] / fs).alias("target_offset_s"), ((target["start"] - F.col("start")) / fs).alias("cue_to_target_s"),
        response["code"].alias("response_value"), side_of(response["code"]).alias("response_side"), response["start"].alias("response_sample"), (response["start"] / fs).alias("response_time_s"),
        F.when(both, (response["start"] - target["start"]) / fs).alias("reaction_time_s"), F.when(proxy, target["length"] / fs).alias("reaction_time_proxy_s"),
        F.when(both, "target_onset_to_click_pulse").when(proxy, "channel9_segment_duration_proxy").otherwise("unavailable").alias("reaction_time_source"),
        cue_match.alias("cue_target_match"), response_match.alias("target_response_match"), F.when(second, response_match).otherwise(cue_match).alias("correct_inferred"),
        *[r.alias(f"rail_{c}") for r, c in zip(rail, cfg.channels, strict=True)], saturated.alias("saturation_flag"),
        F.coalesce("saturation_fraction", F.lit(0.0)).alias("saturation_fraction"), nonfinite.alias("nonfinite_flag"), (why != "none").alias("abnormal_flag"), why.alias("abnormal_reason"),
    )


def _epoch_faults(trials: DataFrame, samples: DataFrame, cfg: Settings) -> DataFrame:
    """Rail and finite tests over each epoch, cut to the recording's bounds. Only
    the samples that fail are joined to trials, so what moves is small."""
    low, high = cfg.epoch_offsets
    faulty = samples.where(F.col("channel").isin(*cfg.channels)).where(at_rail(F.col("value"), cfg.rail) | ~is_finite(F.col("value")))
    places = trials.select("file_name", "place", F.greatest(F.lit(0), F.col("start") + low).alias("_from"), F.least(F.col("n_samples"), F.col("start") + high).alias("_to"))
    each = places.withColumn("sample_idx", F.explode(F.sequence("_from", F.col("_to") - 1)))
    hits = each.join(faulty, ["file_name", "sample_idx"])
    railed = at_rail(F.col("value"), cfg.rail)
    cells = F.lit(len(cfg.channels)) * (F.first("_to") - F.first("_from"))
    return hits.groupBy("file_name", "place").agg(*[F.bool_or(railed & (F.col("channel") == c)).alias(f"rail_{c}") for c in cfg.channels], (F.count_if(railed) / cells).alias("saturation_fraction"), F.bool_or(~is_finite(F.col("value"))).alias("nonfinite"))


def behaviour_code(trials: DataFrame) -> DataFrame:
    return trials.withColumn("behavior_correct_inferred", flag_code(F.col("correct_inferred")))


def dataset_summary(trials: DataFrame, samples: DataFrame, recordings: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per recording: counts of trials and events, rail samples, how
    many channels there are, the median time step and whether time steps by
    1 / rate throughout; the ninth channel's label where ``recordings`` have
    ``labels``."""
    per = trials.groupBy("file_name").agg(F.count("*").alias("cue_trials"), F.count_if(F.col("cue_direction") == "L").alias("cue_left"), F.count_if(F.col("cue_direction") == "R").alias("cue_right"), F.count("target_value").alias("target_events"), F.count("response_value").alias("click_events"), F.count_if(F.col("correct_inferred")).alias("inferred_correct"), F.count_if(~F.col("correct_inferred")).alias("inferred_incorrect"), F.count_if("saturation_flag").alias("saturated_trials"))
    finite = samples.groupBy("file_name").agg(F.bool_and(is_finite(F.col("value"))).alias("all_values_finite"), F.count_distinct("channel").alias("channels"), *[F.count_if((F.col("channel") == c) & at_rail(F.col("value"), cfg.rail)).alias(f"rail_{c}_samples") for c in cfg.channels])
    time = samples.where(F.col("channel") == "timestamp")
    steps = step_facts(time, KEY, "sample_idx", "value", 1 / cfg.sample_rate).select("file_name", F.col("continuous").alias("timestamp_continuous"))
    each = time.select("file_name", (F.col("value") - F.lag("value").over(W.partitionBy("file_name").orderBy("sample_idx"))).alias("step"))
    step = quantiles(each, KEY, "step", (0.5,)).select("file_name", F.col("q")[0].alias("timestamp_step_s"))
    out = recordings.join(per, "file_name", "left").join(finite, "file_name", "left").join(steps, "file_name", "left").join(step, "file_name", "left")
    if "labels" in recordings.columns:
        out = out.withColumn("channel9_label", F.get("labels", F.lit(8)))
    return out.withColumn("duration_s", F.col("n_samples") / F.col("sample_rate_hz")).withColumn("duration_min", F.col("duration_s") / 60)
