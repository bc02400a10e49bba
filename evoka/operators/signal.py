"""Signals as arrays by recording and channel, or epochs by trial and channel."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Settings
from ..functions import kernels
from ..functions.columns import keyed_seed
from .segments import BLOCK, block_of
from .stats import huber_locations, joined, peak_lag


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)


def _whole_groups(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, about ``least`` rows or one group, with the places
    where groups begin: at each true ``_first`` of the sorted batches."""
    held, n = [], 0
    begins = lambda own: np.flatnonzero(own.column("_first").to_numpy(zero_copy_only=False))

    def made() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table, np.flatnonzero(table.column("_first").to_numpy())

    for batch in batches:
        if n >= least and len(at := begins(batch)):
            held.append(batch.slice(0, at[-1]))
            yield made()
            held, n, batch = [], 0, batch.slice(at[-1])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield made()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists without nulls."""
    own = column.combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def bandpass(samples: DataFrame, keys: Sequence[str], index: str, value: str, cfg: Settings = Settings(), block: float = BLOCK) -> DataFrame:
    """Zero-phase band-pass of each series. Values must have no gaps; a series of
    one sample is 0.

    A series is worked through in blocks of ``block`` steps of the index. A first
    pass gives what each block adds to the filter's state, forward and backward,
    if it begins from nothing; a scan of these rows, one a block, gives the states
    that blocks really begin from; a second pass filters. Each pass takes many
    blocks of its sorted rows at once, so short series cost little more than their
    samples."""
    sections = kernels.butterworth_bandpass(cfg.filter_order, *cfg.band_hz, cfg.sample_rate)
    most, size = kernels.zero_phase_pad(sections, 10**9) + 1, 2 * len(sections)

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _whole_groups(batches, 200_000):
            x = table.column(value).to_numpy().astype(float)
            n = np.diff(start, append=len(x))
            ahead, behind = kernels.zero_phase_summaries(x, n, sections)
            kept = np.minimum(n, most)
            each = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
            head, tail = (x[np.repeat(own, kept) + each] for own in (start, start + n - kept))
            wide = np.full(len(n), size)
            made = {"_n": pa.array(n), **{c: _as_lists(*own) for c, own in (("_head", (head, kept)), ("_tail", (tail, kept)), ("_ahead", (ahead.ravel(), wide)), ("_behind", (behind.ravel(), wide)))}}
            out = table.select([*keys, "_block"]).take(pa.array(start))
            for name, own in made.items():
                out = out.append_column(name, own)
            yield from out.to_batches()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _whole_groups(batches, 10_000):
            n = table.column("_n").to_numpy()
            # A series of one sample has no state.
            whole = np.add.reduceat(n, start) > 1
            blocks = np.diff(start, append=len(n))
            has = np.repeat(whole, blocks)
            states = np.zeros((len(n), 2 * size))
            if has.any():
                own = table.filter(pa.array(has))
                heads, tails, (ahead, _), (behind, _) = (_lists(own.column(c)) for c in ("_head", "_tail", "_ahead", "_behind"))
                states[has] = np.hstack(kernels.all_zero_phase_states(blocks[whole], n[has], heads, tails, ahead.reshape(-1, size), behind.reshape(-1, size), sections))
            out = table.select([*keys, "_block"]).append_column("_state", _as_lists(states.ravel(), np.full(len(n), 2 * size))).append_column("_alone", pa.array(~has))
            yield from out.to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _whole_groups(batches, 200_000):
            n = np.diff(start, append=table.num_rows) - 1
            at = table.take(pa.array(start))
            states, alone = _lists(at.column("_state"))[0].reshape(-1, 2 * size), at.column("_alone").to_numpy()
            out = table.filter(pa.array(~table.column("_first").to_numpy()))
            x = out.column(value).to_numpy().astype(float)
            y = np.where(np.repeat(alone, n), x - x, kernels.zero_phase_blocks(x, n, sections, states[:, :size], states[:, size:]))
            yield from out.select([*keys, index]).append_column("filtered", pa.array(y)).to_batches()

    def first_of(by: Sequence[str], *order: str | Column) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1

    rows = samples.select(*keys, F.col(index).cast("long").alias(index), F.col(value).cast("double").alias(value), block_of(index, block).alias("_block"))
    own, blocks, along = _key_schema(rows, keys), [*keys, "_block"], F.asc_nulls_last(index)
    parts = rows.withColumn("_first", first_of(blocks, along)).mapInArrow(summaries, f"{own}, _block long, _n long, _head array<double>, _tail array<double>, _ahead array<double>, _behind array<double>")
    states = parts.withColumn("_first", first_of(keys, "_block")).mapInArrow(scan, f"{own}, _block long, _state array<double>, _alone boolean")
    # A block's state comes before its samples.
    both = rows.withColumn("_is_sample", F.lit(True)).unionByName(states.withColumn("_is_sample", F.lit(False)), allowMissingColumns=True)
    return both.withColumn("_first", first_of(blocks, "_is_sample", along)).mapInArrow(run, f"{own}, `{index}` long, filtered double")


def spectra(samples: DataFrame, keys: Sequence[str], index: str, value: str, rate: float, n_segment: int = 8192, n_overlap: int = 4096) -> DataFrame:
    """(keys, frequency, power) of long series; each segment is detrended by a
    line. A segment is a row group of its own, so a recording is spread over
    tasks; samples must be numbered from 0 without gaps."""
    step = n_segment - n_overlap
    rows = samples.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    last, first = F.floor(F.col("_i") / step), F.greatest(F.lit(0), F.floor((F.col("_i") - n_segment) / step) + 1)
    pieces = rows.select(*keys, "_i", "_v", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_piece"))

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        f, p = kernels.welch(table.sort_by("_i").column("_v").to_numpy(), rate, n_segment, 0, detrend="linear") if n == n_segment else (np.empty(0), np.empty(0))
        take = pa.array(np.zeros(len(f), np.int64))
        return pa.table({**{k: table.column(k).combine_chunks().take(take) for k in keys}, "frequency": pa.array(f), "power": pa.array(p)})

    each = pieces.groupBy(*keys, "_piece").applyInArrow(run, f"{_key_schema(rows, keys)}, frequency double, power double")
    return each.groupBy(*keys, "frequency").agg(F.avg("power").alias("power"))


def median_spectrum(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spectra.groupBy(*keys, "frequency").agg(F.median("power").alias("power"))


def array_bands(values: Column, first: int, after: int, cfg: Settings = Settings()) -> Column:
    """Powers of the bands, and last of 1-30 Hz, in ``values[first:after]``: an
    array. Short Welch spectra of 512 bins' resolution; bands are half open and
    0 with fewer than two bins."""
    bands = [*((low, high) for _, low, high in cfg.bands), (1.0, 30.0)]

    @F.pandas_udf("array<double>")
    def powers(series: pd.Series) -> pd.Series:
        out, lengths = pd.Series([None] * len(series), dtype=object), series.map(len)
        if (lengths < 16).any():
            raise ValueError("fewer than 16 samples for a spectrum")
        for length in lengths.unique():
            at = np.flatnonzero(lengths == length)
            n = min(128, int(length))
            f, p = kernels.welch(np.stack(series.iloc[at].to_numpy()).astype(float), cfg.sample_rate, n, n // 2 if length > n else 0, 512)
            parts = [(f >= low) & (f < high) for low, high in bands]
            made = np.stack([np.trapezoid(p[:, m], f[m], axis=1) if m.sum() > 1 else np.zeros(len(at)) for m in parts], axis=1)
            for i, row in zip(at, made, strict=True):
                out.iloc[i] = row
        return out

    return powers(F.slice(values, first + 1, after - first))


def coupling(x: Column, y: Column, cfg: Settings = Settings()) -> Column:
    """struct<zero_lag_correlation, max_abs_cross_correlation, lag_at_max_ms> of
    two arrays."""
    best = peak_lag(x, y, round(cfg.max_lag_s * cfg.sample_rate), cfg.epsilon)
    named = lambda b: F.struct(b["zero"].alias("zero_lag_correlation"), b["r"].alias("max_abs_cross_correlation"), (b["lag"] * 1000.0 / cfg.sample_rate).alias("lag_at_max_ms"))
    return F.get(F.transform(F.array(best), named), F.lit(0))


def smooth(values: Column, n: int, cfg: Settings = Settings()) -> Column:
    """Savitzky-Golay as products with a constant matrix, in SQL."""
    length = kernels.smoothing_length(cfg.smooth_s, cfg.sample_rate, n, cfg.smooth_order)
    matrix = kernels.savgol_matrix(n, length, cfg.smooth_order)
    rows = []
    for i in range(n):
        at = np.flatnonzero(matrix[i])
        weights = F.array(*[F.lit(float(w)) for w in matrix[i, at[0] : at[-1] + 1]])
        rows.append(F.aggregate(F.zip_with(F.slice(values, int(at[0]) + 1, int(at[-1] - at[0]) + 1), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return F.array(*rows)


def _stack(rows: pd.DataFrame, channels: Sequence[str]) -> np.ndarray:
    """(trials, channels, times) of the complete trials, in order of trial."""
    wide = rows.pivot(index="trial_id", columns="channel", values="values").sort_index()
    wide = wide[list(channels)].dropna()
    return np.stack([np.stack([np.asarray(x, float) for x in r]) for r in wide.to_numpy()])


def _interval(draws: str) -> Column:
    """struct<low, high>: the pointwise 95 % interval of drawn curves."""

    @F.pandas_udf("low array<double>, high array<double>")
    def interval(some: pd.Series) -> pd.DataFrame:
        made = [np.quantile(np.stack(d), [0.025, 0.975], axis=0) for d in some]
        return pd.DataFrame({"low": [m[0].tolist() for m in made], "high": [m[1].tolist() for m in made]})

    return interval(draws)


def fitted_curves(epochs: DataFrame, keys: Sequence[str], channels: Sequence[str], cfg: Settings = Settings(), n_bootstraps: int = 0, contrasts: Sequence[tuple[str, str, str]] = (), keep_draws: bool = False, per_task: int = 64) -> DataFrame:
    """(keys, channel, n_trials, values, ci_low, ci_high): robust mean of a
    condition's trials, smoothed; with bootstraps of whole trials also the
    pointwise interval. ``contrasts`` (name, plus, minus) are more rows, each the
    difference of two channels' curves with the interval of the paired draws;
    ``keep_draws`` adds the drawn curves in single precision.

    A task makes ``per_task`` replicates of a condition, each from the seed of its
    own number, so results are the same however many tasks there are. The cells of
    a condition stop together, so a task sees all its trials, one replicate of
    them at a time; ``located_curves`` fits conditions too large for that."""
    names = list(channels)
    pieces = max(1, -(-n_bootstraps // per_task))
    columns = [*names, *(name for name, _, _ in contrasts)]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        stack, piece = _stack(rows, names), int(key[-1])
        n = stack.shape[2]
        matrix = kernels.savgol_matrix(n, kernels.smoothing_length(cfg.smooth_s, cfg.sample_rate, n, cfg.smooth_order), cfg.smooth_order)

        def fit(some: np.ndarray) -> np.ndarray:
            return kernels.huber_location(some, cfg.huber_c, cfg.huber_iterations, cfg.huber_tolerance, cfg.mad_scale) @ matrix.T

        def with_contrasts(own: np.ndarray) -> np.ndarray:
            return np.stack([*own, *(own[names.index(plus)] - own[names.index(minus)] for _, plus, minus in contrasts)])

        curve = with_contrasts(fit(stack)) if piece == 0 else None
        at = list(range(piece, n_bootstraps, pieces))
        drawn = []
        for r in at:
            rng = np.random.default_rng([int(rows["_seed"].iloc[0]), r])
            drawn.append(with_contrasts(fit(stack[rng.integers(0, len(stack), len(stack))]).astype(np.float32)))
        out = [[*key[:-1], name, len(stack), None if curve is None else curve[i].tolist(), at, [d[i].tolist() for d in drawn]] for i, name in enumerate(columns)]
        return pd.DataFrame(out)

    rows = epochs.select(*keys, "trial_id", "channel", "values", keyed_seed(cfg.seed, *[F.col(k).cast("string") for k in keys]).alias("_seed"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_piece"))
    made = rows.groupBy(*keys, "_piece").applyInPandas(run, f"{_key_schema(rows, keys)}, channel string, n_trials long, values array<double>, at array<int>, draws array<array<float>>")
    whole = made.groupBy(*keys, "channel").agg(F.first("n_trials").alias("n_trials"), F.max("values").alias("values"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "draws")))).alias("_d")).withColumn("draws", F.transform("_d", lambda d: d["draws"])).drop("_d")
    none = F.lit(None).cast("array<double>")
    if n_bootstraps:
        whole = whole.withColumn("_ci", _interval("draws"))
    ends = [F.col(f"_ci.{end}") if n_bootstraps else none for end in ("low", "high")]
    kept = [F.col("draws") if n_bootstraps else F.lit(None).cast("array<array<float>>").alias("draws")] if keep_draws else []
    return whole.select(*keys, "channel", "n_trials", "values", ends[0].alias("ci_low"), ends[1].alias("ci_high"), *kept)


def located_curves(epochs: DataFrame, keys: Sequence[str], channels: Sequence[str], cfg: Settings = Settings()) -> DataFrame:
    """(keys, channel, n_trials, values, rounds): what ``fitted_curves`` gives without
    bootstraps, for conditions of any number of trials. Points are rows; no
    task holds a condition or one of its points. A trial without one of the
    channels is left out, as there."""
    wanted = epochs.where(F.col("channel").isin(*channels) & F.col("values").isNotNull()).select(*keys, "trial_id", "channel", "values")
    whole = wanted.groupBy(*keys, "trial_id").agg(F.collect_list(F.struct("channel", "values")).alias("_c")).where(F.size("_c") == len(channels))
    points = whole.select(*keys, "trial_id", F.explode("_c").alias("_c")).select(*keys, "_c.channel", F.posexplode("_c.values").alias("_i", "_v"))
    found = huber_locations(points, keys, ["channel", "_i"], "_v", cfg.huber_c, cfg.huber_iterations, cfg.huber_tolerance, cfg.mad_scale)
    curves = found.groupBy(*keys, "channel").agg(F.array_sort(F.collect_list(F.struct("_i", "location"))).alias("_p"), F.max("rounds").alias("rounds"))
    counts = whole.groupBy(*keys).agg(F.count("*").alias("n_trials"))

    @F.pandas_udf("array<double>")
    def smoothed(curves: pd.Series) -> pd.Series:
        matrices: dict[int, np.ndarray] = {}
        for n in {len(x) for x in curves}:
            matrices[n] = kernels.savgol_matrix(n, kernels.smoothing_length(cfg.smooth_s, cfg.sample_rate, n, cfg.smooth_order), cfg.smooth_order)
        return pd.Series([matrices[len(x)] @ np.asarray(x, float) for x in curves])

    return joined(curves, counts, keys).select(*keys, "channel", "n_trials", smoothed(F.transform("_p", lambda p: p["location"])).alias("values"), "rounds")


def curve_differences(curves: DataFrame, keys: Sequence[str], side: str, plus: str, minus: str) -> DataFrame:
    """(keys, values, ci_low, ci_high): curves of side ``plus`` less those of
    ``minus``, with the pointwise interval of the differences of their draws,
    which ``fitted_curves`` made by themselves and kept. Keys with one side
    alone have no row."""
    of = lambda c, s: F.max_by(c, F.col(side) == s)
    sides = curves.where(F.col(side).isin(plus, minus)).groupBy(*keys).agg(F.count_distinct(side).alias("_n"), *[of(c, s).alias(f"{c}_{k}") for k, s in enumerate((plus, minus)) for c in ("values", "draws")]).where("_n = 2")

    @F.pandas_udf("low array<double>, high array<double>")
    def interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        made = [np.quantile(np.stack(p) - np.stack(q), [0.025, 0.975], axis=0) for p, q in zip(a, b, strict=True)]
        return pd.DataFrame({"low": [m[0].tolist() for m in made], "high": [m[1].tolist() for m in made]})

    out = sides.withColumn("_ci", interval("draws_0", "draws_1"))
    return out.select(*keys, F.zip_with("values_0", "values_1", lambda a, b: a - b).alias("values"), F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"))


def channel_difference(epochs: DataFrame, keys: Sequence[str], channel: str, plus, minus) -> DataFrame:
    """(keys, values): one channel's values less another's; keys that lack
    either have no row."""
    sides = epochs.groupBy(*keys).agg(*[F.max(F.when(F.col(channel) == c, F.col("values"))).alias(n) for n, c in (("_p", plus), ("_m", minus))])
    return sides.where("_p is not null and _m is not null").select(*keys, F.zip_with("_p", "_m", lambda a, b: a - b).alias("values"))


def median_curves(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, channel, n_trials, values): the median of a condition's trials at
    each place."""
    points = epochs.select(*keys, "trial_id", "channel", F.posexplode("values").alias("t_idx", "_v"))
    each = points.groupBy(*keys, "channel", "t_idx").agg(F.median("_v").alias("_v"), F.count("*").alias("n_trials"))
    return each.groupBy(*keys, "channel").agg(F.max("n_trials").alias("n_trials"), F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "_v"))), lambda p: p["_v"]).alias("values"))


def exploded(epochs: DataFrame, keep: Sequence[str], rate: float, first: int, values: str = "values") -> DataFrame:
    """(keep, t_idx, time_s, v) of array rows."""
    return epochs.select(*keep, F.posexplode(values).alias("t_idx", "v")).withColumn("time_s", (F.col("t_idx") + first) / F.lit(float(rate)))
