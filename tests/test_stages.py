"""All stages on planted recordings."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoka.config import Settings
from evoka.functions.columns import flag_of_text
from evoka.operators import model, segments
from evoka.plans import curves, features, parse, preprocess, quality
from evoka.sources import tables

from .synth import experiment

CFG = dataclasses.replace(Settings(), n_permutations=200, n_difference_bootstraps=100, n_curve_bootstraps=10, penalties=(0.1, 1.0), n_selected=(10,))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    samples, facts, n = experiment()
    samples.to_parquet(f"{folder}/samples.parquet")
    samples, facts = spark.read.parquet(f"{folder}/samples.parquet"), spark.createDataFrame(facts)

    def kept(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    trials = kept(parse.parse_trials(samples, facts, CFG), "trials")
    filtered = kept(preprocess.filtered_signals(samples, CFG), "filtered")
    epochs = kept(preprocess.cut_epochs(trials, filtered, facts, CFG), "epochs")
    qc, thresholds = preprocess.reject_artifacts(trials, epochs, CFG)
    qc = kept(qc, "qc")
    taken = kept(curves.with_conditions(epochs, qc), "taken")
    return {"samples": samples, "facts": facts, "n": n, "trials": trials, "epochs": epochs, "qc": qc, "thresholds": kept(thresholds, "thresholds"), "taken": taken, "folder": folder, "kept": kept}


def test_trials(world):
    rows = {(r.file_name, r.trial_id): r for r in world["trials"].collect()}
    assert len(rows) == 4 * world["n"]
    one, two = "CogA_Task-1.mat", "CogA_Task-2.mat"
    assert rows[one, 1].cue_direction == "R" and rows[one, 2].cue_direction == "L"
    assert rows[one, 3].abnormal_reason == "missing_target_event" and rows[one, 3].correct_inferred is None
    assert rows[one, 5].abnormal_reason == "multiple_target_events"
    assert rows[one, 7].abnormal_reason == "task1_cue_channel9_mismatch" and rows[one, 7].correct_inferred is False
    assert rows[two, 3].abnormal_reason == "missing_target_event;missing_click_event"
    assert rows[two, 7].abnormal_reason == "none" and rows[two, 7].cue_target_match is False and rows[two, 7].correct_inferred is True
    assert rows[two, 4].reaction_time_s == pytest.approx(120 / 256) and rows[two, 4].reaction_time_source == "target_onset_to_click_pulse"
    assert rows[one, 4].reaction_time_proxy_s == pytest.approx(40 / 256)
    assert [t for (f, t), r in sorted(rows.items()) if f == one and r.saturation_flag] == [10, 11]
    assert rows[one, 10].rail_F3 and not rows[one, 10].rail_F4
    assert rows[one, 10].saturation_fraction == pytest.approx(6 / (3 * 384))


def test_summary(world):
    facts = world["facts"].withColumn("labels", F.array(*[F.lit(f"c{k}") for k in range(10)]))
    rows = parse.dataset_summary(world["trials"], world["samples"], facts, CFG).collect()
    assert all(r.channels == 6 and r.channel9_label == "c8" and r.timestamp_step_s == pytest.approx(1 / 256) for r in rows)
    assert all(r.timestamp_continuous and r.all_values_finite and r.rail_F3_samples == 12 and r.saturated_trials == 2 and r.target_events == world["n"] - 1 for r in rows)


def test_quality(world):
    power = world["kept"](quality.channel_spectra(world["samples"], CFG, 2048), "power")
    rows = quality.raw_quality(world["samples"], power, world["facts"], CFG).collect()
    assert len(rows) == 12
    assert all(abs(r.dominant_45_70_hz - 60) < 0.2 and r.samples == 256 * 200 for r in rows)
    assert sum(r.rail_samples for r in rows) == 4 * 12
    assert {(r.file_name, r.subject, r.task, r.sample_rate_hz) for r in rows} == {(f"Cog{s}_{t}.mat", s, t, 256.0) for s in "AB" for t in ("Task-1", "Task-2")}
    spectrum = quality.recording_spectrum(power)
    assert spectrum.count() * 3 == power.count() and spectrum.columns == ["file_name", "frequency", "power"]


def test_facts_of_names(spark):
    names = ["StudyCogA_Task-1.mat", "StudyCogA_Task-2.mat", "StudyCogB_Task-1.mat", "CogB_Task-2.mat"]
    rows = tables.with_recording_facts(spark.createDataFrame([(f"/data/{n}",) for n in names], "path string"), F.col("path")).collect()
    assert [(r.file_name, r.subject, r.task) for r in rows] == list(zip(names, "AABB", ["Task-1", "Task-2"] * 2, strict=True))


def test_samples_of_matrix(spark):
    cells = [["F", "z"], ["F3"], ["t"]]
    rows = spark.createDataFrame([("f", cells, [[1.0, 2.0], [3.0, 4.0], [0.0, 0.5]])], "file_name string, cells array<array<string>>, data array<array<double>>").withColumn("labels", tables.labels_of(F.col("cells")))
    found = {(r.channel, r.sample_idx): r.value for r in tables.samples_of_matrix(rows).collect()}
    assert found == {("Fz", 0): 1, ("Fz", 1): 2, ("F3", 0): 3, ("F3", 1): 4, ("t", 0): 0, ("t", 1): 0.5}
    with pytest.raises(Exception, match="as many rows as labels"):
        tables.samples_of_matrix(rows.withColumn("labels", F.slice("labels", 1, 2))).collect()


def test_gaps_need_two_good_samples(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(4)] + [("b", 0, 1.0), ("b", 1, 2.0)], "k string, i int, v double")
    bad = (F.col("k") == "a") & F.col("i").isin(0, 3)
    assert [r.filled for r in segments.fill_gaps(rows, ["k"], "i", "v", bad).orderBy("k", "i").collect()] == [1, 1, 2, 2, 1, 2]
    for column in ((F.col("k") == "b") & (F.col("i") == 1), F.col("k") == "b"):
        with pytest.raises(Exception, match="fewer than two good"):
            segments.fill_gaps(rows, ["k"], "i", "v", column).collect()


def test_merge_by_place(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, a string"), spark.createDataFrame([(2, "v"), (1, "u")], "i int, b string")
    assert sorted(map(tuple, tables.merged_by_place(a, b, ["i"]).collect())) == [(1, "x", "u"), (2, "y", "v")]
    for other in (b.where("i = 1"), b.union(b)):
        with pytest.raises(ValueError, match="don't match"):
            tables.merged_by_place(a, other, ["i"])


def test_rejection(world):
    rows = {(r.file_name, r.trial_id): r for r in world["qc"].collect()}
    one = "CogA_Task-1.mat"
    assert rows[one, 1].edge_flag and rows[one, 1].rejection_reason == "epoch_out_of_bounds"
    assert rows[one, 10].rejection_reason == "raw_saturation_or_nonfinite" and not rows[one, 10].residual_artifact_flag
    assert rows[one, 20].rejection_reason == "extreme_residual_artifact"
    assert world["thresholds"].count() == 4 * 3 * 3
    for r in preprocess.retention(world["qc"]).collect():
        assert r.accepted_trials == r.total_trials - r.rejected_edge - r.rejected_saturation_or_nonfinite - r.rejected_residual_artifact == r.accepted_L + r.accepted_R


def test_epochs_are_kept_in_single_precision(spark, world):
    path = f"{world['folder']}/store"
    tables.write_epochs(world["taken"].select("file_name", "trial_id", "channel", "values", F.col("accepted_for_erp").alias("accepted"), "cue_direction"), path)
    back = tables.read_epochs(spark, path, 384)
    assert back.count() == world["taken"].count()
    with pytest.raises(Exception, match="isn't whole"):
        tables.read_epochs(spark, path, 383).collect()


def test_curves_and_tests(world):
    strict = world["taken"].where("accepted_for_erp")
    fitted = world["kept"](curves.direction_curves(strict, CFG, keep_draws=True), "curves")
    assert fitted.count() == 4 * 2 * 4 and {c.n_trials for c in fitted.collect()} <= set(range(10, 25))
    peak = curves.curve_features(fitted, CFG).where("channel = 'F4' and cue_direction = 'R' and window = 'early_250_500ms'").collect()
    assert all(abs(r.positive_peak_latency_s - 90 / 256) < 0.06 for r in peak)
    by = {(r.file_name, r.cue_direction, r.channel): r for r in fitted.collect()}
    for (name, side, channel), r in by.items():
        assert len(r.draws) == 10 and all(a <= b for a, b in zip(r.ci_low, r.ci_high, strict=True))
        if channel == "F4_minus_F3":
            f4, f3 = by[name, side, "F4"], by[name, side, "F3"]
            assert r.values == pytest.approx([a - b for a, b in zip(f4.values, f3.values, strict=True)])
            assert r.draws[3] == pytest.approx([a - b for a, b in zip(f4.draws[3], f3.draws[3], strict=True)], abs=1e-5)
    apart = {(r.file_name, r.channel): r for r in curves.direction_differences(fitted).collect()}
    assert len(apart) == 16
    for (name, channel), r in apart.items():
        right, left = by[name, "R", channel], by[name, "L", channel]
        low, high = np.quantile(np.array(right.draws) - np.array(left.draws), [0.025, 0.975], axis=0)
        assert r.values == pytest.approx(np.array(right.values) - np.array(left.values)) and r.ci_low == pytest.approx(low, abs=1e-4) and r.ci_high == pytest.approx(high, abs=1e-4)
    preview = curves.preview_curves(world["taken"]).collect()
    assert len(preview) == 24 and all(len(r.values) == 384 for r in preview)
    tests = world["kept"](curves.direction_tests(strict, CFG), "tests")
    assert tests.where("not laterality").count() == 24 and tests.where("laterality").count() == 8
    assert tests.where("channel = 'F4' and window = 'early_250_500ms'").agg(F.min("hedges_g")).first()[0] > 0.8
    assert curves.consistency(tests).count() == 12
    matrix = curves.effect_matrix(tests.where("not laterality"), tuple(w.name for w in CFG.curve_windows[:2]), CFG.channels)
    assert matrix.count() == 4 and len(matrix.columns) == 9 and matrix.na.drop().count() == 4
    assert all(0 < r.p_permutation <= r.p_fdr_bh + 1e-12 for r in tests.collect())


def test_sensitivity(world):
    taken = world["kept"](curves.strategies(world["taken"]), "strategies")
    counts = {r.strategy: r.n for r in curves.trial_counts(world["qc"]).groupBy("strategy").agg(F.sum("n_side").alias("n")).collect()}
    assert counts["all_in_bounds"] == 4 * (world["n"] - 1) and counts["retain_repaired_saturation"] - counts["strict_rejection"] == 8
    fitted = world["kept"](curves.direction_curves(taken, CFG, 0, ("strategy",)), "curves3")
    metrics = world["kept"](curves.sensitivity_of_curves(fitted, CFG), "metrics")
    assert metrics.count() == 4 * 3 * 3 * 2 and metrics.where("channel = 'F4_minus_F3'").count() == 0
    tests = world["kept"](curves.direction_tests(taken, CFG, ("strategy",), ("strategy",)), "tests3")
    rows = curves.sensitivity_summary(metrics, tests, CFG).collect()
    assert len(rows) == 2 and all(r.curve_correlation_median > 0.9 for r in rows)


def test_features_and_model(world):
    strict = world["taken"].where("accepted_for_erp")
    table = world["kept"](features.trial_features(strict, CFG), "features")
    groups = features.feature_groups(table.columns)
    assert [len(g) for g in groups.values()] == [80, 112, 139]
    tables.require_no_leakage(groups["full_multichannel"], ("target", "behavior", "reaction"))
    assert table.count() == strict.select("file_name", "trial_id").distinct().count()
    made = world["kept"](model.cross_subject(table, {"time_only": groups["time_only"]}, CFG), "predictions")
    results = world["kept"](features.directional_results(made, CFG, 200), "results")
    assert results.count() == 6
    assert all(r.n_input_features == 80 and r.n_train + r.n_test == made.where((F.col("scope") == r.scope) & (F.col("kind") == "prediction")).count() and 0 < r.test_permutation_p <= 1 for r in results.collect())
    both = features.bidirectional_summary(made, CFG, 50, 50).collect()
    assert len(both) == 3 and all(r.balanced_accuracy > 0.6 for r in both)
    summed = {(r.scope, r.tp) for r in results.groupBy("scope").agg(F.sum("tp").alias("tp")).collect()}
    assert summed == {(r.scope, r.tp) for r in both}
    assert features.selected_coefficients(made).count() == 60
    effects = features.feature_effects(table, groups["full_multichannel"])
    stable = world["kept"](features.stable_features(effects), "stable")
    assert effects.count() == 556 and stable.count() == 278
    shown = {r.feature for r in features.shown_features(stable).collect()}
    assert 6 <= len(shown) <= 12 and shown <= set(groups["full_multichannel"])
    ten = stable.orderBy(F.desc("mean_abs_g")).limit(30).collect()
    none = {r.feature for r in features.shown_features(stable.withColumn("sign_consistent", F.lit(False))).collect()}
    assert len(none) == 10 and none <= {r.feature for r in ten}
    names, forbidden = groups["full_multichannel"], ("direction", "subject", "task")
    summary = features.bidirectional_summary(made, CFG, 50, 50)
    passed = {r.check: r.passed for r in features.model_checks(table, names, results, summary, forbidden, table.count(), 5, 3).collect()}
    assert len(passed) == 8 and all(passed.values()), passed
    failed = {r.check for r in features.model_checks(table.withColumn(names[0], F.lit(float("nan"))), names, results, summary, ("time",), 1, 5000).collect() if not r.passed}
    assert failed == set(passed) - {"trials_are_unique", "subjects_of_a_split_are_apart", "directions_are_left_and_right"}


def test_trials_through_csv(spark, world, tmp_path):
    """Flags come back from text, the tri-state code tells unknown from wrong."""
    flags = ["saturation_flag", "nonfinite_flag", "abnormal_flag"]
    rows = parse.behaviour_code(world["trials"]).select("file_name", "trial_id", "behavior_correct_inferred", "correct_inferred", *flags)
    assert rows.where("behavior_correct_inferred <> CASE WHEN correct_inferred THEN 1 WHEN NOT correct_inferred THEN 0 ELSE -1 END").count() == 0
    assert {r[0] for r in rows.select("behavior_correct_inferred").distinct().collect()} == {-1, 0, 1}
    tables.write_csv(rows, str(tmp_path / "trials"))
    text = tables.read_csv(spark, str(tmp_path / "trials"), "file_name string, trial_id int, code int, correct string, a string, b string, c string")
    back = text.select("file_name", "trial_id", *[flag_of_text(F.col(c)).alias(f) for c, f in zip("abc", flags, strict=True)])
    assert back.exceptAll(rows.select("file_name", "trial_id", *flags)).count() == 0 and back.where("saturation_flag").count() == 8
    odd = spark.createDataFrame([(" TRUE ",), ("1",), ("yes",), (None,)], "t string").select(flag_of_text(F.col("t")).alias("f"))
    assert [r.f for r in odd.collect()] == [True, True, False, False]


def test_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("﻿subject,x\nA,1.5\nB,\n")
    rows = tables.read_csv(spark, path)
    assert rows.columns == ["subject", "x"] and rows.count() == 2
    tables.write_csv(rows, str(tmp_path / "out"), "%.3g")
    assert tables.read_csv(spark, str(tmp_path / "out")).where("x = 1.5").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.require_files(spark, [path, str(tmp_path / "none")])
