"""Statistics and resampling against brute force and exhaustive counts."""

import itertools
import math
import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evoka.config import Settings
from evoka.functions import kernels
from evoka.functions.columns import keyed_seed
from evoka.operators import effects, evaluate, model, segments, signal, stats
from evoka.sources import tables
from evoka.streaming.quality import windowed_quality


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=1000), "ties": rng.integers(0, 4, 700).astype(float), "rail": np.concatenate([np.full(400, 999.0), rng.normal(size=500)]), "one": np.array([5.0]), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame(pd.DataFrame([(k, float(x)) for k, v in groups.items() for x in v], columns=["k", "v"])).repartition(5)
    rows = rows.unionByName(spark.createDataFrame([("even", None), ("none", None)], "k string, v double"))
    at = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)
    for accuracy in (20, 2000):
        found = {r.k: r.q for r in stats.quantiles(rows, ["k"], "v", at, accuracy).collect()}
        assert set(found) == set(groups)
        for k, v in groups.items():
            assert found[k] == pytest.approx(np.quantile(v, at), abs=1e-12), k
    nameless = rows.where("k in ('even', 'two')").withColumn("k", F.when(F.col("k") == "two", "two"))
    assert {r.k: r.median for r in stats.signal_quality(nameless.na.drop(subset=["v"]), ["k"], "v", 99.0).collect()} == {None: pytest.approx(np.median(groups["even"])), "two": 1.5}
    assert stats.robust_thresholds(nameless, ["k"], "v").where("k is null").first().median == pytest.approx(np.median(groups["even"]))
    whole = stats.quantiles(rows, [], "v", (0.5,)).collect()
    assert whole[0].q[0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_quantiles_gather_no_group(spark):
    """No aggregate of all values of a group is left in the plan."""
    plan = stats.signal_quality(spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")), ["k"], "v", 900.0)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan and "percentile_approx" in plan


def test_roc_auc(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"k": rng.integers(0, 3, 900), "s": rng.normal(size=900).round(1), "y": rng.integers(0, 2, 900)})
    data.loc[data.k == 2, "y"] = 1
    rows = spark.createDataFrame(data).repartition(4)

    def area(d):
        a, b = d.s[d.y == 1].to_numpy(), d.s[d.y == 0].to_numpy()
        return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(b) else None

    found = {r.k: r.roc_auc for r in evaluate.roc_auc(rows, ["k"], "y", "s", pieces=7).collect()}
    assert found[2] is None and all(found[k] == pytest.approx(area(data[data.k == k])) for k in (0, 1))
    assert evaluate.roc_auc(rows, [], "y", "s").first().roc_auc == pytest.approx(area(data))


def test_peak_lag(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    pairs = [(x, np.roll(x, 5)), (np.roll(x, 7), x), (x, -x), (np.ones(60), x), (x[:4], x[1:5]), (x[:2], x[1:3])]
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    found = {r.i: r.p for r in rows.select("i", stats.peak_lag(F.col("a"), F.col("b"), 9).alias("p")).collect()}
    for i, (a, b) in enumerate(pairs):
        u, v, n = a - a.mean(), b - b.mean(), len(a)
        base = np.sqrt((u @ u) * (v @ v))
        c = {k: (u[max(0, k) : n + min(0, k)] @ v[max(0, -k) : n - max(0, k)]) / base if abs(k) < n and base > 1e-12 else 0.0 for k in range(-9, 10)}
        lag = max(c, key=lambda k: (round(abs(c[k]), 12), -k)) if base > 1e-12 else 0
        assert (found[i].lag, found[i].r) == (lag, pytest.approx(c[lag], abs=1e-12))
        assert found[i].zero == pytest.approx(c[0] if n > 2 else 0, abs=1e-12)
    series = rows.where("i < 4").select("i", F.posexplode(F.arrays_zip("a", "b")).alias("t", "z")).select("i", "t", "z.*").repartition(5)
    assert {r.i: (r.max_abs_correlation, r.lag) for r in stats.lag_correlation(series, ["i"], "t", "a", "b", 9).collect()} == {i: (pytest.approx(found[i].r), found[i].lag) for i in range(4)}


def test_resampled_tests_draw_what_the_whole_test_would(spark):
    """In one block or in many, p and interval are near the exhaustive ones."""
    left, right = [0.1, 0.4, 0.4, 0.9, 1.3], [0.8, 1.1, 1.1, 1.9, 2.4, 0.3]
    pooled, observed = np.array(left + right), np.mean(right) - np.mean(left)
    sums = [pooled[list(c)].sum() for c in itertools.combinations(range(11), 5)]
    p = np.mean([abs((pooled.sum() - s) / 6 - s / 5) >= abs(observed) - 1e-12 for s in sums])
    rng = np.random.default_rng(0)
    drawn = [rng.choice(right, 6).mean() - rng.choice(left, 5).mean() for _ in range(40_000)]
    rows = spark.createDataFrame([("t", "L", x) for x in left] + [("t", "R", x) for x in right] + [("one", "L", 1.0)], "k string, side string, v double").repartition(3)
    for block in (4096, 2):
        found = {r.k: r for r in effects.resampled_tests(rows, ["k"], "v", "side", 4000, 4000, 7, block).collect()}
        assert found["one"].p_permutation is None and found["one"].difference_ci95_low is None
        assert found["t"].p_permutation == pytest.approx(p, abs=0.02)
        assert [found["t"].difference_ci95_low, found["t"].difference_ci95_high] == pytest.approx(np.quantile(drawn, [0.025, 0.975]), abs=0.04)
    far = spark.createDataFrame([("t", "L", float(i)) for i in range(60)] + [("t", "R", 1000.0 + i) for i in range(60)], "k string, side string, v double")
    assert effects.resampled_tests(far, ["k"], "v", "side", 999, 10, 7, 16).first().p_permutation == pytest.approx(1 / 1000)


def test_huber_locations_stop_together(spark):
    """As the kernel has it on whole stacks: each group's own number of rounds,
    borrowed scales, a group without any spread, ties and null keys."""
    rng = np.random.default_rng(6)
    stacks = {"a": rng.standard_t(2, (41, 5)), "b": np.round(rng.normal(size=(30, 4)), 1), "c": np.full((5, 3), 2.5), None: rng.normal(size=(12, 2)) ** 3}
    stacks["b"][:, 2] = 7.0
    rows = [(k, j, float(v)) for k, s in stacks.items() for r in s for j, v in enumerate(r)] + [("a", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    for iterations, tolerance in ((30, 1e-7), (4, 0.0), (200, 1e-12)):
        found = {(r.k, r.j): r for r in stats.huber_locations(df, ["k"], ["j"], "v", iterations=iterations, tolerance=tolerance).collect()}
        assert len(found) == sum(s.shape[1] for s in stacks.values())
        for k, stack in stacks.items():
            want = kernels.huber_location(stack, 1.345, iterations, tolerance, 1.4826)
            assert [found[k, j].location for j in range(stack.shape[1])] == pytest.approx(want.tolist(), abs=1e-9)
            assert len({found[k, j].rounds for j in range(stack.shape[1])}) == 1
    assert stats.huber_locations(df.where("false"), ["k"], ["j"], "v").count() == 0
    assert len({found[k, 0].rounds for k in stacks}) > 1


def test_located_curves_are_the_fitted_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(f, t, c, rng.standard_t(3, 64).tolist()) for f in ("x", "y") for t in range(25) for c in ("Fz", "F3", "F4") if (f, t, c) != ("y", 3, "F4")]
    df = spark.createDataFrame(rows, "f string, trial_id int, channel string, values array<double>").repartition(4)
    cfg = Settings(sample_rate=64.0, epoch_s=(0.0, 1.0))
    own, other = ({(r.f, r.channel): r for r in made.collect()} for made in (signal.located_curves(df, ["f"], cfg.channels, cfg), signal.fitted_curves(df, ["f"], cfg.channels, cfg)))
    assert own.keys() == other.keys() and own["y", "Fz"].n_trials == 24
    for k, r in own.items():
        assert r.n_trials == other[k].n_trials and list(r["values"]) == pytest.approx(list(other[k]["values"]), abs=1e-9)


def test_curve_intervals_do_not_depend_on_tasks(spark):
    """Replicates have seeds of their own numbers, in whatever task they are made;
    intervals are near plain draws, those of a contrast from paired ones."""
    rng = np.random.default_rng(2)
    stack = rng.normal(size=(30, 3, 64))
    rows = [("x", t, c, stack[t, j].tolist()) for t in range(30) for j, c in enumerate(("Fz", "F3", "F4"))]
    df = spark.createDataFrame(rows, "f string, trial_id int, channel string, values array<double>").repartition(3)
    cfg = Settings(sample_rate=64.0, epoch_s=(0.0, 1.0))
    found = [{r.channel: r for r in signal.fitted_curves(df, ["f"], cfg.channels, cfg, 40, (("d", "F4", "F3"),), True, per_task).collect()} for per_task in (1, 7, 100)]
    assert found[0] == found[1] == found[2] and set(found[0]) == {*cfg.channels, "d"}
    matrix = kernels.savgol_matrix(64, kernels.smoothing_length(cfg.smooth_s, 64.0, 64, cfg.smooth_order), cfg.smooth_order)
    seed = (zlib.crc32(b"x") + cfg.seed) % (2**32 - 1)
    draws = [kernels.huber_location(stack[np.random.default_rng([seed, r]).integers(0, 30, 30)], cfg.huber_c, cfg.huber_iterations, cfg.huber_tolerance, cfg.mad_scale) @ matrix.T for r in range(40)]
    own = {c: np.array([d[j] for d in draws]) for j, c in enumerate(cfg.channels)}
    own["d"] = own["F4"] - own["F3"]
    for c, d in own.items():
        low, high = np.quantile(d, [0.025, 0.975], axis=0)
        assert found[0][c].ci_low == pytest.approx(low.tolist(), abs=1e-6) and found[0][c].ci_high == pytest.approx(high.tolist(), abs=1e-6)


@pytest.mark.parametrize("block", [1, 3, 10, 10**6])
def test_runs_and_gaps_over_blocks(spark, block):
    """Blocks of any size give what the whole recording gives; null keys, runs and
    gaps over many blocks, groups without a good value."""
    rng = np.random.default_rng(3)
    rows = [(k, i, int(c), float(v)) for k, n in (("a", 80), ("b", 37), (None, 25), ("one", 1)) for i, c, v in zip(np.cumsum(rng.integers(1, 4, n)).tolist(), np.repeat(rng.integers(0, 3, n), rng.integers(1, 12, n))[:n], rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, "k string, i long, c int, v double").repartition(6)
    runs, want = {}, []
    for k, i, c, _ in rows:
        own = runs.setdefault(k, [])
        if own and own[-1][0] == c:
            own[-1][2:] = [i, own[-1][3] + 1]
        else:
            own.append([c, i, i, 1])
    want = [(k, n, *r) for k, own in runs.items() for n, r in enumerate(own, 1)]
    found = segments.run_segments(df, ["k"], "i", "c", block=block)
    assert sorted(map(str, map(tuple, found.select("k", "run", "c", "start", "end", "length").collect()))) == sorted(map(str, want))
    bad = (F.col("c") == 1) | (F.col("k") == "one")
    filled = {(r.k, r.i): r.filled for r in segments.fill_gaps(df, ["k"], "i", "v", F.coalesce(bad, F.col("c") == 1), 0, block).collect()}
    for k in runs:
        own = [r for r in rows if r[0] == k]
        kept = [(i, v) for _, i, c, v in own if c != 1 and k != "one"]
        for _, i, c, v in own:
            want = v if c != 1 and k != "one" else None if not kept else np.interp(i, *zip(*kept, strict=True))
            assert filled[k, i] == (want if want is None else pytest.approx(want, abs=1e-12))
    plan = segments.run_segments(df, ["k"], "i", "c", block=block)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan


def test_bandpass_of_a_recording_in_many_tasks(spark):
    rng = np.random.default_rng(5)
    series = {"long": rng.normal(2, 3, 4001), "short": rng.normal(size=9), "one": np.array([4.0]), None: rng.normal(size=700)}
    df = spark.createDataFrame([(k, 3 * i + 1, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, i long, v double").repartition(7)
    sections = kernels.butterworth_bandpass(4, 0.5, 30, 256.0)
    for block in (10, 1500, 10**6):
        found = {(r.k, r.i): r.filtered for r in signal.bandpass(df, ["k"], "i", "v", block=block).collect()}
        assert len(found) == sum(map(len, series.values()))
        for k, x in series.items():
            want = kernels.zero_phase(x, sections) if len(x) > 1 else [0.0]
            assert [found[k, 3 * i + 1] for i in range(len(x))] == pytest.approx(list(want), abs=1e-9)


def test_bandpass_of_many_short_series(spark):
    """Series by the thousand go through the kernels together: no call into Python
    is a series' or a block's own, and gaps, nulls and lengths stay apart."""
    rng = np.random.default_rng(9)
    series = {k: rng.normal(k % 7, 2, 1 + k % 90) for k in range(1500)}
    df = spark.createDataFrame([(k, 40 * i + k % 5, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k int, i long, v double").repartition(6)
    found = signal.bandpass(df, ["k"], "i", "v", block=1000)
    assert "FlatMap" not in found._jdf.queryExecution().toString()
    rows = {(r.k, r.i): r.filtered for r in found.collect()}
    assert len(rows) == sum(map(len, series.values()))
    sections = kernels.butterworth_bandpass(4, 0.5, 30, 256.0)
    for k, x in series.items():
        want = kernels.zero_phase(x, sections) if len(x) > 1 else [0.0]
        assert [rows[k, 40 * i + k % 5] for i in range(len(x))] == pytest.approx(list(want), abs=1e-8)
    spoilt = df.withColumn("v", F.when((F.col("k") != 89) | (F.col("i") != 44), F.col("v")))
    assert {r.k for r in signal.bandpass(spoilt, ["k"], "i", "v").where("isnan(filtered)").collect()} == {89}
    assert signal.bandpass(df.where("false"), ["k"], "i", "v").count() == 0


@pytest.mark.parametrize("parts", [1, 256])
def test_adjusted_p_of_large_families(spark, parts):
    """Ties, zeros, ones, nulls and null families, in few blocks or in many."""
    rng = np.random.default_rng(7)
    rows = [(k, i, float(x)) for k, n in (("a", 400), (None, 90), ("b", 3), ("c", 1)) for i, x in enumerate(np.where(rng.random(n) < 0.4, rng.integers(0, 6, n) / 5, rng.random(n) ** 6))]
    df = spark.createDataFrame([*rows, ("a", 1000, None)], "k string, i int, p double").repartition(5)

    def adjusted(p):
        order = np.argsort(p, kind="stable")
        q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        out = np.empty(len(p))
        out[order] = np.minimum(1, q)
        return out

    found = {(r.k, r.i): r for r in effects.benjamini_hochberg(df, ["k"], "p", parts=parts).collect()}
    assert len(found) == len(rows)
    for k in ("a", None, "b", "c"):
        own = [r for r in rows if r[0] == k]
        for (_, i, _), q in zip(own, adjusted(np.array([r[2] for r in own])), strict=True):
            assert found[k, i].p_fdr_bh == pytest.approx(q, abs=1e-12) and found[k, i].significant == (found[k, i].p_fdr_bh < 0.05)
    whole = {(r.k, r.i): r.p_fdr_bh for r in effects.benjamini_hochberg(df, [], "p", parts=parts).collect()}
    assert [whole[k, i] for k, i, _ in rows] == pytest.approx(adjusted(np.array([r[2] for r in rows])).tolist(), abs=1e-12)


def test_archives_of_other_facts_are_refused(spark, tmp_path):
    cfg = Settings(sample_rate=64.0, epoch_s=(0.0, 1.0))
    rows = [("x", t, c, [float(t)] * 64, known) for t, known in ((1, True), (2, False), (3, None)) for c in cfg.channels]
    df = spark.createDataFrame(rows, "file_name string, trial_id int, channel string, values array<double>, ok boolean")
    tables.write_archive(df, f"{tmp_path}/a", cfg, "ok")
    back = tables.read_archive(spark, f"{tmp_path}/a", cfg, ("trial_id", "channel", "values", "behavior_code"))
    assert {(r.trial_id, r.behavior_code) for r in back.collect()} == {(1, 1), (2, 0), (3, -1)} and dict(back.dtypes)["behavior_code"] == "tinyint"
    for change, said in (({"sample_rate": 128.0}, "sample_rate_hz"), ({"channels": ("F3", "Fz", "F4")}, "channel_labels"), ({"epoch_s": (0.25, 1.25)}, "time_s"), ({"band_hz": (1.0, 30.0)}, "filter_band_hz")):
        with pytest.raises(ValueError, match=said):
            tables.read_archive(spark, f"{tmp_path}/a", replace(cfg, **change))
    tables.write_archive(df.withColumn("channel", F.lit("Oz")), f"{tmp_path}/b", cfg)
    with pytest.raises(Exception, match="isn't among the labels"):
        tables.read_archive(spark, f"{tmp_path}/b", cfg).collect()


def test_logistic_weights_of_many_tasks(spark):
    """As one task would fit them, for groups of unlike size and width at once."""
    rng = np.random.default_rng(12)
    made = {"a": (rng.normal(size=(300, 4)), 0.3), "b": (rng.normal(size=(40, 7)), 0.5), None: (rng.normal(size=(25, 2)), 0.6)}
    data = {k: (x, (x[:, 0] + rng.normal(size=len(x)) > np.quantile(x[:, 0], q)).astype(int)) for k, (x, q) in made.items()}
    rows = [(k, r.tolist(), int(t)) for k, (x, y) in data.items() for r, t in zip(x, y, strict=True)] + [("a", [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "k string, x array<double>, y int").repartition(8)
    found = model.logistic_weights(df, ["k"], "x", "y", (0.01, 1.0, 10.0))
    assert set(found) == {(k, c) for k in data for c in (0.01, 1.0, 10.0)}
    for (k, c), w in found.items():
        assert w == pytest.approx(kernels.fit_logistic(*data[k], c), abs=1e-8)
    one = model.logistic_weights(df.where("k = 'b'"), [], "x", "y", (1.0,))
    assert one[(1.0,)] == pytest.approx(found["b", 1.0], abs=1e-9)
    assert model.logistic_weights(df.where("false"), ["k"], "x", "y", (1.0,)) == {}


def test_splits_that_cannot_be_fitted_fail(spark):
    rng = np.random.default_rng(1)
    rows = [("Task-1", "f", i, "A" if i % 2 else "B", (i // 2) % 2, *map(float, rng.normal(size=2))) for i in range(40)]
    df = spark.createDataFrame(rows, "task string, file_name string, trial_id int, subject string, target_R int, u double, v double")
    cfg = replace(Settings(), penalties=(1.0,))
    assert model.cross_subject(df, {"g": ["u", "v"]}, cfg).where("kind = 'prediction'").count() == 80
    one_class = df.withColumn("target_R", F.when(F.col("subject") == "B", 1).otherwise(F.col("target_R")))
    for frame, said in ((one_class, "lacks a class"), (df.withColumn("u", F.lit(float("nan"))), "isn't finite"), (df.withColumn("u", F.lit(1.0)), "fewer than two features vary")):
        with pytest.raises(Exception, match=said):
            model.cross_subject(frame, {"g": ["u", "v"]}, cfg).collect()


def test_paths_do_not_grow_with_blocks(spark):
    """A block's path is as long as the number of blocks has binary digits, and
    its sizes are those of the halves; whatever a node deals, all blocks share."""
    rng = np.random.default_rng(4)
    for depth in (0, 1, 5, 9):
        sizes = rng.integers(0, 9, (2**depth, 2))
        dealt = spark.createDataFrame([("t", depth, b, int(l), int(r)) for b, (l, r) in enumerate(sizes) for _ in range(1)], "k string, _depth int, _block long, _l long, _r long")
        paths = {r["_block"]: [tuple(x) for x in r["_path"]] for r in effects.block_paths(dealt, ["k"]).collect()}
        assert len(paths) == (2**depth if depth else 0) and all(len(p) == depth for p in paths.values())
        for b, path in paths.items():
            for down, l0, l1, r0, r1 in path:
                low = (b >> -down) << -down
                mid, high = low + (1 << (-down - 1)), low + (1 << -down)
                assert (l0, l1, r0, r1) == tuple(int(x) for x in (sizes[low:mid, 0].sum(), sizes[mid:high, 0].sum(), sizes[low:mid, 1].sum(), sizes[mid:high, 1].sum()))
        for repeated in (False, True):
            n = rng.integers(0, max(1, sizes[:, 0].sum()) + 1, 50)
            got = [kernels._share(np.array([(-d, l0, l1) for d, l0, l1, _, _ in paths.get(b, [])], np.int64).reshape(-1, 3), b, n, repeated, [5]) for b in range(2**depth)]
            assert (np.sum(got, axis=0) == n).all() and (repeated or (np.array(got) <= sizes[:, :1]).all())


def test_resampled_tests_of_counts_beyond_numpy(spark):
    """Rows that stand for 10^9 rows and more: p and interval as normal draws give."""
    left, right = [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0]
    many = 2_000_000_000
    rows = [("t", "L", x, many) for x in left] + [("t", "R", x, many + (40_000 if x > 1 else 0)) for x in right]
    df = spark.createDataFrame(rows, "k string, side string, v double, n long")
    found = [effects.resampled_tests(df, ["k"], "v", "side", 1500, 1500, 3, block, count="n").first() for block in (4096, 2)]
    v, l, r = np.array(left), np.full(4, float(many)), np.array([x[3] for x in rows[4:]], float)
    spread = np.sqrt(np.cov(np.tile(v, 2), aweights=np.concatenate([l, r])) * (1 / l.sum() + 1 / r.sum()))
    gap = (v @ r) / r.sum() - (v @ l) / l.sum()
    p = math.erfc(gap / spread / math.sqrt(2))
    for x in found:
        assert x.p_permutation == pytest.approx(p, abs=0.05)
        assert [x.difference_ci95_low, x.difference_ci95_high] == pytest.approx([gap - 1.96 * spread, gap + 1.96 * spread], abs=0.4 * spread)
    few = spark.createDataFrame([("t", s, x, 1) for s, own in (("L", [0.1, 0.4, 0.4]), ("R", [0.8, 1.1])) for x in own], "k string, side string, v double, n int")
    a, b = (effects.resampled_tests(few, ["k"], "v", "side", 500, 500, 3, count=c).first() for c in ("n", None))
    assert a == b


def test_draws_of_ties_are_those_of_all_choices(spark):
    """As often as the choices of rows give each sum, without a draw from a
    hypergeometric distribution for each value; in many tasks for one test."""
    rng = np.random.default_rng(3)
    for counts, n in (([1, 2, 1, 3], 3), ([1] * 7, 5), ([6, 1, 5], 9), ([2, 130, 1], 2), ([5, 1], 6), ([1, 2], 0)):
        counts = np.array(counts)
        v = 16.0 ** np.arange(len(counts))
        sums, made = np.unique(kernels._sums_of_some(v, counts, np.full(40_000, n), rng), return_counts=True)
        ways = {sum(np.array(k) * v): math.prod(math.comb(c, x) for c, x in zip(counts.tolist(), k, strict=True)) for k in itertools.product(*(range(min(c, n) + 1) for c in counts)) if sum(k) == n}
        assert set(sums) <= set(ways)
        shares = dict(zip(sums, made / 40_000, strict=True))
        assert [shares.get(k, 0.0) for k in ways] == pytest.approx([w / sum(ways.values()) for w in ways.values()], abs=0.012)

    class Watched:
        asked = 0

        def __getattr__(self, name):
            self.asked += name == "hypergeometric"
            return getattr(rng, name)

    watched, wanted = Watched(), rng.integers(3000, 4000, 300)
    assert kernels._sums_of_some(np.ones(1000), np.full(1000, 7), wanted, watched) == pytest.approx(wanted) and not watched.asked
    rows = spark.range(3000).select(F.lit("t").alias("k"), F.when(F.col("id") % 2 == 0, "L").otherwise("R").alias("side"), F.sqrt("id").alias("v"))
    found = effects.resampled_tests(rows, ["k"], "v", "side", 300, 300, 7)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    one = found.first()
    assert 0.9 < one.p_permutation <= 1 and one.difference_ci95_low < 0.02 < one.difference_ci95_high


def test_stratified_inference_by_counts(spark):
    """p against all exchanges within strata, interval against plain draws."""
    data = [("a", 0, 0), ("a", 0, 0), ("a", 1, 1), ("a", 1, 0), ("b", 0, 0), ("b", 0, 1), ("b", 1, 1), ("b", 1, 1), ("b", 1, 1)]
    s, y, g = (np.array([r[i] for r in data]) for i in range(3))
    accuracy = lambda y, g: np.nanmean([(g[y == k] == k).mean() if (y == k).any() else np.nan for k in (0, 1)])
    exchanges = []
    for a in set(itertools.permutations(y[s == "a"])):
        for b in set(itertools.permutations(y[s == "b"])):
            exchanges.append(accuracy(np.array([*a, *b]), g) >= accuracy(y, g) - 1e-12)
    rng = np.random.default_rng(0)
    drawn = []
    for _ in range(20_000):
        at = np.concatenate([rng.choice(np.flatnonzero(s == k), (s == k).sum()) for k in "ab"])
        drawn.append(accuracy(y[at], g[at]))
    rows = spark.createDataFrame([("all", *r) for r in data], "k string, s string, y int, g int").repartition(4)
    found = evaluate.stratified_inference(rows, ["k"], "s", "y", "g", 5000, 5000, 3).collect()[0]
    assert found.permutation_p == pytest.approx(np.mean(exchanges), abs=0.02)
    assert [found.balanced_accuracy_ci_low, found.balanced_accuracy_ci_high] == pytest.approx(np.quantile(drawn, [0.025, 0.975]), abs=0.02)


def test_keyed_seeds(spark):
    """The seed is that of the key's CRC-32, however rows are dealt."""
    rows = spark.createDataFrame([("a", "Task-1"), ("é", "x|y"), ("", "")], "k string, t string").repartition(3)
    found = {(r.k, r.t): r.s for r in rows.select("k", "t", keyed_seed(20260924, F.col("k"), F.col("t")).alias("s")).collect()}
    assert found == {(k, t): (zlib.crc32(f"{k}|{t}".encode()) + 20260924) % (2**32 - 1) for k, t in found}


def test_array_bands(spark):
    cfg, rng = Settings(), np.random.default_rng(4)
    t = np.arange(230) / cfg.sample_rate
    rows = spark.createDataFrame([(i, (np.sin(2 * np.pi * f * t) + rng.normal(0, 0.01, 230)).tolist()) for i, f in enumerate((2.5, 6, 10, 20))], "i int, v array<double>")
    for r in rows.select("i", signal.array_bands(F.col("v"), 0, 230, cfg).alias("b")).collect():
        assert int(np.argmax(r.b[:4])) == r.i and r.b[4] >= max(r.b[:4])


def test_windowed_quality_on_a_stream(spark, tmp_path):
    """A stream of files gives the rows that the whole table gives."""
    rows = spark.range(400).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"), (F.col("id") % 97).cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed_quality(read, ["user_id"], "ts", "value", 90.0, "1 day")
    job = out.writeStream.outputMode("complete").format("memory").queryName("quality_of_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    own = sorted(map(str, spark.table("quality_of_stream").collect()))
    assert own == sorted(map(str, windowed_quality(rows, ["user_id"], "ts", "value", 90.0, "1 day").collect())) and len(own) > 6
