"""Runs, intervals, slices and gaps of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stats import joined

#: Steps of the order column that make a block.
BLOCK = 1_000_000


def block_of(order: str, block: float) -> Column:
    """The stretch of the order that a row is in; one for orders that aren't numbers."""
    return F.coalesce(F.floor(F.col(order).try_cast("double") / F.lit(float(block))), F.lit(0))


def run_segments(df: DataFrame, keys: Sequence[str], order: str, code: str, background: object = None, block: float = BLOCK) -> DataFrame:
    """Maximal runs of equal codes: keys, run, code, start, end, length.

    Runs of ``background`` are dropped after the numbering. A null code fails,
    and so does a number that isn't whole. Runs are found within blocks of
    ``block`` steps of the order, so a long recording is several tasks'; blocks are
    stitched by a row each, of their first and last code and number of runs."""
    kind = dict(df.dtypes)[code]
    bad = F.col(code).isNull()
    if kind in ("double", "float"):
        bad = bad | F.isnan(code) | (F.col(code) != F.floor(code))
    checked = F.when(bad, F.raise_error(F.lit("a code isn't whole")).cast(kind)).otherwise(F.col(code))
    by = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = df.select(*keys, order, checked.alias(code), block_of(order, block).alias("_block"))
    rows = rows.withColumn("_new", F.coalesce(F.col(code) != F.lag(code).over(by), F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(by))
    parts = rows.groupBy(*keys, "_block", "_part").agg(F.first(code).alias(code), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    seams = parts.groupBy(*keys, "_block").agg(F.min_by(code, "_part").alias("_first"), F.max_by(code, "_part").alias("_last"), F.max("_part").alias("_parts"))
    along = Window.partitionBy(*keys).orderBy("_block")
    seams = seams.withColumn("_goes_on", F.coalesce(F.col("_first") == F.lag("_last").over(along), F.lit(False)).cast("long"))
    before = F.sum(F.col("_parts") - F.col("_goes_on")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_parts")
    numbered = joined(parts, seams.select(*keys, "_block", before.alias("_before")), [*keys, "_block"])
    runs = numbered.groupBy(*keys, (F.col("_before") + F.col("_part")).alias("run")).agg(F.first(code).alias(code), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"))
    return runs if background is None else runs.where(F.col(code) != F.lit(background))


def intervals(starts: DataFrame, keys: Sequence[str], start: str, end_default: Column) -> DataFrame:
    """Adds ``next_start``, the following row's start, and ``place`` from 1."""
    by = Window.partitionBy(*keys).orderBy(start)
    return starts.withColumn("next_start", F.coalesce(F.lead(start).over(by), end_default)).withColumn("place", F.row_number().over(by))


def in_intervals(marks: DataFrame, events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Events with the ``place`` of the mark whose open interval, up to the next
    mark, holds them. One pass over both, so no pairs are made: each event
    takes the last mark before it, and one at a mark's own place has none."""
    own = marks.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.col("place").alias("_place"), F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("_event"))
    other = events.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_place"), F.struct("*").alias("_event"))
    by = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("_mark", F.last(F.when(F.col("_kind") == 0, F.struct("_place", "_at")), ignorenulls=True).over(by))
    found = both.where((F.col("_kind") == 1) & F.col("_mark").isNotNull() & (F.col("_at") > F.col("_mark._at")))
    return found.select(F.col("_mark._place").alias("place"), "_event.*")


def first_matches(marks: DataFrame, matched: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str], name: str, condition: Column | None = None) -> DataFrame:
    """Adds to each mark its earliest matched event, ``name``, a struct that is
    null for none, and ``n_name``, how many there are."""
    rows = matched if condition is None else matched.where(condition)
    best = rows.groupBy(*keys, "place").agg(F.min(F.struct(at, *carry)).alias(name), F.count("*").alias(f"n_{name}"))
    return marks.join(best, [*keys, "place"], "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))


def slices(marks: DataFrame, samples: DataFrame, keys: Sequence[str], mark: str, index: str, first: int, after: int) -> DataFrame:
    """Samples at ``mark + first`` up to before ``mark + after``, joined by place;
    ``t_idx`` counts from 0. Places without a sample give no row."""
    places = marks.select(*marks.columns, F.explode(F.sequence(F.lit(0), F.lit(after - first - 1))).alias("t_idx")).withColumn(index, F.col(mark) + F.lit(first) + F.col("t_idx"))
    return places.join(samples, [*keys, index])


def fill_gaps(df: DataFrame, keys: Sequence[str], order: str, value: str, bad: Column, least_good: int = 2, block: float = BLOCK) -> DataFrame:
    """Adds ``filled``: bad values linearly between their good neighbours, the
    nearest good one beyond the outermost. A group with a bad value and fewer
    than ``least_good`` good ones fails; null without any, if that is allowed.

    Neighbours are sought within blocks of ``block`` steps of the order, so a long
    recording is several tasks'; of each block, one row carries its first and last
    good value to the others."""
    good = F.when(~bad, F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    rows = df.withColumn("_block", block_of(order, block)).withColumn("_g", good)
    x = F.when(F.col("_g").isNotNull(), F.col(order))
    ends = rows.groupBy(*keys, "_block").agg(F.min_by("_g", x).alias("_first"), F.max_by("_g", x).alias("_last"), F.count("_g").alias("_n_good"))
    along, against = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    earlier = Window.unboundedPreceding
    carried = [F.last("_last", ignorenulls=True).over(along.rowsBetween(earlier, -1)).alias("_before"), F.last("_first", ignorenulls=True).over(against.rowsBetween(earlier, -1)).alias("_after"), F.sum("_n_good").over(Window.partitionBy(*keys)).alias("_good")]
    by = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = rows.withColumn("_p", F.last("_g", ignorenulls=True).over(by.rowsBetween(earlier, 0)))
    # Backward by a descending order: a frame that ends with its group is built
    # anew for every row.
    back = Window.partitionBy(*keys, "_block").orderBy(F.desc(order))
    rows = rows.withColumn("_n", F.last("_g", ignorenulls=True).over(back.rowsBetween(earlier, 0)))
    rows = joined(rows, ends.select(*keys, "_block", *carried), [*keys, "_block"])
    p, n, x = F.coalesce("_p", "_before"), F.coalesce("_n", "_after"), F.col(order).cast("double")
    rows = rows.withColumn("_p", p).withColumn("_n", n)
    p, n = F.col("_p"), F.col("_n")
    enough = F.when(F.col("_good") >= least_good, F.lit(True)).otherwise(F.raise_error(F.lit("fewer than two good samples")).cast("boolean"))
    between = p["y"] + (n["y"] - p["y"]) * (x - p["x"]) / F.when(n["x"] == p["x"], 1.0).otherwise(n["x"] - p["x"])
    return rows.withColumn("filled", F.when(~bad, F.col(value).cast("double")).when(~enough, None).when(p.isNull(), n["y"]).when(n.isNull(), p["y"]).otherwise(between)).drop("_block", "_g", "_p", "_n", "_good", "_before", "_after")


def subtract_baseline(df: DataFrame, keys: Sequence[str], value: str, in_baseline: Column) -> DataFrame:
    """Adds ``corrected``: the value less the mean of its group's baseline."""
    mean = F.avg(F.when(in_baseline, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("corrected", F.col(value) - mean)


def step_facts(df: DataFrame, keys: Sequence[str], order: str, value: str, step: float | None = None, tolerance: float = 1e-12) -> DataFrame:
    """keys, max_abs_step and line_length (mean absolute step); with ``step``
    also ``continuous``: all steps positive and within the tolerance of it,
    false with fewer than two rows."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, order, value).withColumn("_d", F.col(value) - F.lag(value).over(by))
    out = [F.max(F.abs("_d")).alias("max_abs_step"), F.avg(F.abs("_d")).alias("line_length")]
    if step is not None:
        out.append(F.coalesce(F.bool_and((F.col("_d") > 0) & (F.abs(F.col("_d") - step) <= tolerance)), F.lit(False)).alias("continuous"))
    return rows.groupBy(*keys).agg(*out)
