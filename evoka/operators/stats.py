"""Grouped statistics; exact quantiles, population spreads unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import Window
from ..functions.columns import at_rail, in_window, is_finite
from ..sources.tables import discard, written


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of ``a`` beside those of ``b`` with the same keys, null ones alike;
    without keys, beside the one row of ``b``."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return a.join(b.withColumnsRenamed({k: f"_of_{k}" for k in keys}), on, how).drop(*[f"_of_{k}" for k in keys])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], accuracy: int = 2000) -> DataFrame:
    """(keys, q): exact quantiles of each group, linear between ranks, without a
    task that holds a group. A sketch, whose ranks are off by 1 / ``accuracy``
    at most, brackets each quantile; then only the distinct values inside the
    brackets are counted, and the ranks selected among them. Nulls don't count;
    a group without values has no row."""
    v, e = F.col("_v"), 2.0 / accuracy
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = [min(1.0, max(0.0, x)) for p in at for x in (p - e, p + e)]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy))
    brackets = rows.groupBy(*keys).agg(sketch.alias("_b"), F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # Where a bracket has less than four ranks to spare, that is in groups of under
    # 2 * accuracy rows, it is the whole group.
    brackets = brackets.withColumn("_b", F.when(F.col("_n") * e >= 4, F.col("_b")).otherwise(F.array(*[F.col("_low"), F.col("_high")] * len(at)))).drop("_low", "_high")
    both = joined(rows, brackets, keys)
    ranks = [F.floor(F.lit(float(p)) * (F.col("_n") - 1) + 1e-9) for p in at]
    low = lambda j: F.col("_b")[2 * j]
    high = lambda j: F.col("_b")[2 * j + 1]
    # Rows under a bracket are one cell, null, which comes first in the running sum.
    held = F.array_compact(F.array(*[F.when(v <= high(j), F.struct(F.lit(j).alias("_j"), F.when(v >= low(j), v).alias("_v"))) for j in range(len(at))]))
    cells = both.select(*keys, "_n", F.explode(held).alias("_h")).groupBy(*keys, "_n", "_h._j", "_h._v").agg(F.count("*").alias("_c"))
    by = W.partitionBy(*keys, "_j").orderBy(F.asc_nulls_first("_v"))
    cells = cells.withColumn("_to", F.sum("_c").over(by.rowsBetween(W.unboundedPreceding, 0)))
    rank = F.element_at(F.array(*ranks), F.col("_j") + 1)
    next_rank = F.least(rank + 1, F.col("_n") - 1)
    holds = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_c") <= r)
    found = cells.groupBy(*keys, "_j", "_n").agg(F.max(F.when(holds(rank), v)).alias("_x"), F.max(F.when(holds(next_rank), v)).alias("_y"))
    part = F.element_at(F.array(*[F.lit(float(p)) for p in at]), F.col("_j") + 1) * (F.col("_n") - 1) - F.element_at(F.array(*ranks), F.col("_j") + 1)
    exact = F.when(part < 2e-9, F.col("_x")).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * part)
    exact = F.when(F.col("_x").isNull() | (F.col("_y").isNull() & (part >= 2e-9)), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(exact)
    picked = [F.max(F.when(F.col("_j") == j, F.col("_q"))) for j in range(len(at))]
    return found.withColumn("_q", exact).groupBy(*keys).agg(F.array(*picked).alias("q"))


def signal_quality(df: DataFrame, keys: Sequence[str], value: str, rail: float) -> DataFrame:
    """Location, spread, extreme quantiles and rail share of each group."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.count_if(at_rail(v, rail)).alias("rail_samples"), F.bool_and(is_finite(v)).alias("all_finite"))
    q = quantiles(df, keys, value, (0.001, 0.5, 0.999))
    out = joined(out, q, keys, "left")
    return out.select(*keys, "samples", "mean", "std", "minimum", *[F.col("q")[i].alias(n) for i, n in enumerate(("q001", "median", "q999"))], "maximum", (F.col("maximum") - F.col("minimum")).alias("peak_to_peak"), "rail_samples", (100.0 * F.col("rail_samples") / F.col("samples")).alias("rail_percent"), "all_finite")


def robust_thresholds(df: DataFrame, keys: Sequence[str], value: str, scale: float = 1.4826, multiple: float = 6.0) -> DataFrame:
    """median, scaled_mad and threshold = median + multiple * scaled_mad; a MAD
    of nothing is replaced by max(0.05 * |median|, 1e-9) in the threshold."""
    middle = quantiles(df, keys, value, (0.5,)).select(*keys, F.col("q")[0].alias("median"))
    apart = joined(df, middle, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_apart"))
    out = joined(middle, quantiles(apart, keys, "_apart", (0.5,)), keys).select(*keys, "median", (scale * F.col("q")[0]).alias("scaled_mad"))
    spread = F.when(F.col("scaled_mad") <= 1e-12, F.greatest(0.05 * F.abs("median"), F.lit(1e-9))).otherwise(F.col("scaled_mad"))
    return out.withColumn("threshold", F.col("median") + multiple * spread)


def over_threshold(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], trial: Sequence[str], value: str, eligible: Column) -> DataFrame:
    """One row per trial: ``residual_artifact``, whether any of its values is
    over its key's threshold. Only eligible rows can be. The thresholds are one
    row per key; Spark sees their size and plans the join by it."""
    rows = df.join(thresholds.select(*keys, "threshold"), list(keys), "left")
    over = eligible & F.coalesce(~F.isnan(F.col(value)) & (F.col(value) > F.col("threshold")), F.lit(False))
    return rows.groupBy(*trial).agg(F.bool_or(over).alias("residual_artifact"))


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "area", least_points: int = 1, otherwise: float | None = None) -> DataFrame:
    """Integral by trapezoids; ``otherwise`` with fewer than ``least_points``."""
    by = W.partitionBy(*keys).orderBy(x)
    rows = df.select(*keys, x, y).withColumn("_a", (F.col(y) + F.lag(y).over(by)) / 2 * (F.col(x) - F.lag(x).over(by)))
    return rows.groupBy(*keys).agg(F.when(F.count("*") >= least_points, F.coalesce(F.sum("_a"), F.lit(0.0))).otherwise(F.lit(otherwise).cast("double")).alias(name))


def band_power(spectra: DataFrame, keys: Sequence[str], low: float, high: float, half_open: bool, otherwise: float | None, frequency: str = "frequency", power: str = "power") -> DataFrame:
    """Power of a band; ``otherwise`` where it has fewer than two bins. Groups
    without any bin in the band stay."""
    inside = spectra.where(in_window(F.col(frequency), Window("band", low, high, half_open)))
    found = trapezoid(inside, keys, frequency, power, "band_power", 2, otherwise)
    return spectra.select(*keys).distinct().join(found, list(keys), "left").withColumn("band_power", F.coalesce("band_power", F.lit(otherwise).cast("double")))


def first_peak(value: Column, place: Column) -> Column:
    """Aggregate: the place of the largest value, the earliest of ties."""
    return -F.max(F.struct(value.alias("v"), (-place).alias("p")))["p"]


def first_trough(value: Column, place: Column) -> Column:
    return F.min(F.struct(value.alias("v"), place.alias("p")))["p"]


def dominant(spectra: DataFrame, keys: Sequence[str], low: float, high: float, frequency: str = "frequency", power: str = "power") -> DataFrame:
    """Frequency of the largest power in the closed band; no row without bins."""
    return spectra.where(F.col(frequency).between(low, high)).groupBy(*keys).agg(first_peak(F.col(power), F.col(frequency)).alias("dominant_frequency"))


def window_statistics(df: DataFrame, keys: Sequence[str], time: str, value: str, windows: Sequence[Window], rate: float) -> DataFrame:
    """The ten time statistics of each key and window, in one grouping: mean,
    std, peak to peak, area, positive and negative peak with latency, slope and
    line length. Points and windows meet by an array of the windows that hold a
    point, so no window multiplies the points outside of it."""
    member = F.array_compact(F.array(*[F.when(in_window(F.col(time), w), F.lit(w.name)) for w in windows]))
    rows = df.select(*keys, time, value, F.explode(member).alias("window"))
    by = W.partitionBy(*keys, "window").orderBy(time)
    t, v = F.col(time), F.col(value)
    rows = rows.withColumn("_d", v - F.lag(v).over(by)).withColumn("_a", (v + F.lag(v).over(by)) / 2 * (t - F.lag(t).over(by)))
    return rows.groupBy(*keys, "window").agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.max(v) - F.min(v)).alias("peak_to_peak"),
        F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"),
        F.max(v).alias("positive_peak"),
        first_peak(v, t).alias("positive_peak_latency_s"),
        F.min(v).alias("negative_peak"),
        first_trough(v, t).alias("negative_peak_latency_s"),
        F.when(F.count("*") > 1, F.covar_pop(v, t) / F.greatest(F.var_pop(t), F.lit(1e-12))).otherwise(0.0).alias("slope_per_s"),
        (F.coalesce(F.avg(F.abs("_d")), F.lit(0.0)) * rate).alias("line_length_per_s"),
    )


def compare_curves(df: DataFrame, keys: Sequence[str], primary: str, other: str) -> DataFrame:
    """Correlation, RMSE, RMSE over the primary's peak to peak, and the largest
    absolute change of two aligned curves."""
    d = F.col(other) - F.col(primary)
    out = df.groupBy(*keys).agg(F.corr(primary, other).alias("curve_correlation"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.max(primary) - F.min(primary)).alias("_span"), F.max(F.abs(d)).alias("maximum_absolute_change"))
    return out.withColumn("nrmse", F.col("rmse") / F.greatest("_span", F.lit(1e-9))).drop("_span")


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def peak_lag(x: Column, y: Column, most: int, epsilon: float = 1e-12) -> Column:
    """struct<r, lag, zero> of two arrays of one length: the signed normalised
    cross-correlation of largest size among lags of at most ``most``, its lag
    (of ties the most negative; positive ones delay ``x``), and the correlation
    at lag 0, which is 0 with fewer than three points. All are 0 where either
    array is flat. No row leaves its place."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    mean = lambda a: total(a) / F.when(F.size(a) > 0, F.size(a))
    less = lambda a, m: F.transform(a, lambda v: v - m)

    def measured(s):
        u, v, n = s["u"], s["v"], F.size(s["u"])

        def at(lag):
            length = F.greatest(n - F.abs(lag), F.lit(0))
            value = dot(F.slice(u, F.greatest(lag, F.lit(0)) + 1, length), F.slice(v, F.greatest(-lag, F.lit(0)) + 1, length)) / s["base"]
            return F.struct(F.round(F.abs(value), 12).alias("a"), (-lag).alias("l"), value.alias("r"))

        flat = (n < 3) | (F.sqrt(s["uu"] / n) < epsilon) | (F.sqrt(s["vv"] / n) < epsilon)
        zero = F.when(flat, 0.0).otherwise(dot(u, v) / s["base"])
        best = F.array_max(F.transform(F.sequence(F.lit(-most), F.lit(most)), at))
        found = _bound(best, lambda m: F.struct(m["r"].alias("r"), (-m["l"]).alias("lag"), zero.alias("zero")))
        return F.when(s["base"] > epsilon, found).otherwise(F.struct(F.lit(0.0).alias("r"), F.lit(0).alias("lag"), F.lit(0.0).alias("zero")))

    pair = F.struct(x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my"))
    centred = lambda s: F.struct(less(s["x"], s["mx"]).alias("u"), less(s["y"], s["my"]).alias("v"))
    squares = lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"), dot(s["u"], s["u"]).alias("uu"), dot(s["v"], s["v"]).alias("vv"))
    based = lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"), s["uu"].alias("uu"), s["vv"].alias("vv"), F.sqrt(s["uu"] * s["vv"]).alias("base"))
    return _bound(pair, lambda p: _bound(centred(p), lambda c: _bound(squares(c), lambda q: _bound(based(q), measured))))


def lag_correlation(df: DataFrame, keys: Sequence[str], index: str, x: str, y: str, most: int) -> DataFrame:
    """``peak_lag`` of two columns in order of ``index``, whose steps are of 1:
    keys, max_abs_correlation (signed) and lag. A series is one row on its way
    here, so it should be a window, not a recording."""
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))).alias("_s"))
    best = series.select(*keys, peak_lag(F.transform("_s", lambda s: s["_x"]), F.transform("_s", lambda s: s["_y"]), most).alias("_b"))
    return best.select(*keys, F.col("_b.r").alias("max_abs_correlation"), F.col("_b.lag").alias("lag"))


def _counted(df: DataFrame, keys: Sequence[str], value: str, scale: float) -> tuple[DataFrame, DataFrame]:
    """(value rows with counts ``_c``, median ``_m`` and scaled MAD ``_s`` of each
    group), both written: the source is read once, rounds read the counts."""
    rows = written(df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null"), "values")
    counted = written(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), "counted")
    start = written(robust_thresholds(rows, keys, "_v", scale).select(*keys, F.col("median").alias("_m"), F.col("scaled_mad").alias("_s")), "start")
    discard(rows)
    return counted, start


def _reweighted(counted: DataFrame, state: DataFrame, keys: Sequence[str], c: float) -> DataFrame:
    """(keys, _m, _s, _n, _t): weights and weighted values of each group, summed;
    nothing where a group has no spread."""
    apart = F.abs(F.col("_v") - F.col("_m"))
    weight = F.col("_c") * F.when(F.col("_s") <= 1e-10, 0.0).when(apart <= c * F.col("_s"), 1.0).otherwise(c * F.col("_s") / apart)
    return joined(counted, state, keys).withColumn("_w", weight).groupBy(*keys, "_m", "_s").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_t"))


def huber_means(df: DataFrame, keys: Sequence[str], value: str, c: float = 1.345, rounds: int = 8, scale: float = 1.4826) -> DataFrame:
    """Robust mean of each group by itself with a fixed number of reweighting
    rounds, in SQL; a group without spread keeps its median."""
    counted, start = _counted(df, keys, value, scale)
    state = start
    for _ in range(rounds):
        state = _reweighted(counted, state, keys, c).select(*keys, F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(F.col("_m")).alias("_m"), "_s")
    out = written(state.select(*keys, F.col("_m").alias("huber_mean")), "means")
    discard(counted, start)
    return out


def huber_locations(df: DataFrame, keys: Sequence[str], cells: Sequence[str], value: str, c: float = 1.345, iterations: int = 30, tolerance: float = 1e-7, scale: float = 1.4826) -> DataFrame:
    """(keys, cells, location, rounds): robust mean of each cell, where the cells
    of a group of ``keys`` stop together, at the first round in which none moves by
    ``tolerance``. Cells without spread borrow the median scale of their group's
    others, or 1. Nulls don't count; null keys are a group like others.

    A round is one aggregation of counted values, with partial sums before the
    shuffle, so no task holds a group or a cell; it ends with a row per cell, and
    one row tells whether a group still moves."""
    both = [*keys, *cells]
    counted, start = _counted(df, both, value, scale)
    lent = quantiles(start.where("_s > 1e-10"), keys, "_s", (0.5,)).select(*keys, F.col("q")[0].alias("_lent"))
    scales = F.when(F.col("_s") > 1e-10, F.col("_s")).otherwise(F.coalesce("_lent", F.lit(1.0)))
    state = written(joined(start, lent, keys, "left").select(*both, "_m", scales.alias("_s"), F.lit(True).alias("_open"), F.lit(0).alias("_rounds")), "state")
    discard(start)
    for _ in range(iterations):
        total = _reweighted(counted, state.where("_open").select(*both, "_m", "_s"), both, c).drop("_m", "_s")
        moved = joined(state, total, both, "left").withColumn("_to", F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(F.col("_m")))
        moved = written(moved.select(*both, "_s", F.col("_to").alias("_m"), F.when(F.col("_open"), F.abs(F.col("_to") - F.col("_m"))).alias("_moved"), (F.col("_rounds") + F.col("_open").cast("int")).alias("_rounds")), "state")
        goes_on = moved.groupBy(*keys).agg((F.max("_moved") >= tolerance).alias("_on"))
        discard(state)
        state = written(joined(moved, goes_on, keys).select(*both, "_m", "_s", F.coalesce("_on", F.lit(False)).alias("_open"), "_rounds"), "state")
        discard(moved)
        if state.where("_open").isEmpty():
            break
    discard(counted)
    return state.select(*both, F.col("_m").alias("location"), F.col("_rounds").alias("rounds"))


def scoped(df: DataFrame, task: str, pooled: str = "Pooled", name: str = "scope") -> DataFrame:
    """Every row under its task's scope and under the pooled one."""
    return df.withColumn(name, F.explode(F.array(F.col(task), F.lit(pooled))))


def with_strategies(df: DataFrame, edge: str, residual: str, accepted: str) -> DataFrame:
    """Every trial under each rejection strategy that takes it."""
    taken = F.array_compact(F.array(F.when(F.col(accepted), "strict_rejection"), F.when(~F.col(edge) & ~F.col(residual), "retain_repaired_saturation"), F.when(~F.col(edge), "all_in_bounds")))
    return df.withColumn("strategy", F.explode(taken))
