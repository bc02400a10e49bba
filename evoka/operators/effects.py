"""Effect sizes, resampling inference and agreement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import kernels
from ..functions.columns import array_quantile, keyed_seed
from .stats import joined


def hedges_g(df: DataFrame, keys: Sequence[str], value: str, is_right: Column, least_variance: float = 1e-12) -> DataFrame:
    """n, mean of both sides, difference right - left and Hedges' g with the
    small-sample correction, in one grouping. g is 0 where the pooled variance
    is nothing, null with fewer than three rows in all."""
    left, right = F.when(~is_right, F.col(value)), F.when(is_right, F.col(value))
    out = df.groupBy(*keys).agg(F.count(left).alias("n_left"), F.count(right).alias("n_right"), F.avg(left).alias("mean_left"), F.avg(right).alias("mean_right"), F.coalesce(F.var_samp(left), F.lit(0.0)).alias("_vl"), F.coalesce(F.var_samp(right), F.lit(0.0)).alias("_vr"))
    n = F.col("n_left") + F.col("n_right")
    free = n - 2
    pooled = ((F.col("n_left") - 1) * F.col("_vl") + (F.col("n_right") - 1) * F.col("_vr")) / F.when(free > 0, free)
    difference = F.col("mean_right") - F.col("mean_left")
    g = F.when(pooled <= least_variance, 0.0).otherwise((1 - F.lit(3.0) / (4 * n - 9)) * difference / F.sqrt(F.when(pooled > 0, pooled)))
    return out.select(*keys, "n_left", "n_right", "mean_left", "mean_right", difference.alias("difference"), F.when(free > 0, g).alias("hedges_g"))


def benjamini_hochberg(df: DataFrame, family: Sequence[str], p: str, unique: Sequence[str] = (), name: str = "p_fdr_bh", parts: int = 256) -> DataFrame:
    """Adds the false-discovery-rate p of each test within its family, and
    whether it is under 0.05. Null p's aren't tests; equal p's have one outcome, so
    ``unique`` isn't needed.

    No task holds a family: its distinct p's are counted, and fall by size into
    blocks, ``parts`` for each halving of p. Ranks run within blocks, upon the
    number of tests in those below; minima within blocks, down from the least of
    those above."""
    tests = df.where(F.col(p).isNotNull())
    block = F.coalesce(F.floor(parts * F.log2(F.when(F.col("_p") > 0, F.col("_p")))), F.lit(-(2**40)))
    cells = tests.groupBy(*family, F.col(p).alias("_p")).agg(F.count("*").alias("_c")).withColumn("_block", block)
    everywhere = list(family) or [F.lit(0)]
    sizes = cells.groupBy(*family, "_block").agg(F.sum("_c").alias("_size"))
    along, against = W.partitionBy(*everywhere).orderBy("_block"), W.partitionBy(*everywhere).orderBy(F.desc("_block"))
    earlier = W.unboundedPreceding
    sizes = sizes.select(*family, "_block", (F.sum("_size").over(along.rowsBetween(earlier, 0)) - F.col("_size")).alias("_below"), F.sum("_size").over(W.partitionBy(*everywhere)).alias("_n"))
    inside = W.partitionBy(*family, "_block")
    ranked = joined(cells, sizes, [*family, "_block"]).withColumn("_rank", F.col("_below") + F.sum("_c").over(inside.orderBy("_p").rowsBetween(earlier, 0)))
    # The last of equal p's has the least ratio.
    ranked = ranked.withColumn("_q", F.col("_p") * F.col("_n") / F.col("_rank"))
    least = ranked.groupBy(*family, "_block").agg(F.min("_q").alias("_own")).select(*family, "_block", F.min("_own").over(against.rowsBetween(earlier, -1)).alias("_above"))
    down = F.min("_q").over(inside.orderBy(F.desc("_p")).rowsBetween(earlier, 0))
    found = joined(ranked.withColumn("_down", down), least, [*family, "_block"]).select(*family, "_p", F.least(F.lit(1.0), "_down", F.coalesce("_above", F.lit(1.0))).alias(name))
    out = joined(tests.withColumn("_p", F.col(p)), found, [*family, "_p"]).drop("_p")
    return out.withColumn("significant", F.col(name) < 0.05)


def subject_consistency(df: DataFrame, keys: Sequence[str], subject: str, names: tuple[str, str], g: str) -> DataFrame:
    """Both subjects' effects, whether their signs agree (0 agrees with 0) and
    their mean."""
    a, b = (F.max(F.when(F.col(subject) == n, F.col(g))) for n in names)
    out = df.groupBy(*keys).agg(a.alias("g_a"), b.alias("g_b"))
    return out.withColumn("same_direction", F.signum("g_a") == F.signum("g_b")).withColumn("mean_g", (F.col("g_a") + F.col("g_b")) / 2)


def stable_effects(df: DataFrame, keys: Sequence[str], subject: str, names: tuple[str, str], g: str) -> DataFrame:
    """As above, but effects of nothing don't agree; the conservative effect is
    the smaller of the two where they agree, else 0."""
    out = subject_consistency(df, keys, subject, names, g)
    agree = F.col("same_direction") & (F.col("g_a") != 0) & (F.col("g_b") != 0)
    size = (F.abs("g_a") + F.abs("g_b")) / 2
    return out.select(*keys, "g_a", "g_b", agree.alias("sign_consistent"), size.alias("mean_abs_g"), F.when(agree, F.least(F.abs("g_a"), F.abs("g_b"))).otherwise(0.0).alias("conservative_abs_g"))


def effect_agreement(df: DataFrame, keys: Sequence[str], primary: str, other: str, primary_flag: str, other_flag: str) -> DataFrame:
    """Correlation, sign agreement, largest change and equal decisions."""
    return df.groupBy(*keys).agg(F.corr(primary, other).alias("effect_size_correlation"), F.avg((F.signum(primary) == F.signum(other)).cast("double")).alias("effect_sign_agreement"), F.max(F.abs(F.col(other) - F.col(primary))).alias("maximum_absolute_change"), F.bool_and(F.col(primary_flag) == F.col(other_flag)).alias("same_decisions"))


def shared_replicates(rows: DataFrame, numbers: Sequence[tuple[str, int]], pieces: int) -> DataFrame:
    """Every row with each ``piece`` of its replicates and, by name, how many of
    each number this piece makes."""
    out = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return out.withColumns({name: F.lit(n // pieces) + (F.col("piece") < n % pieces).cast("int") for name, n in numbers})


def block_paths(dealt: DataFrame, names: Sequence[str]) -> DataFrame:
    """(keys, _block, _path) of the blocks of ``dealt`` (keys, _depth, _block, _l,
    _r). Blocks are the leaves of a binary tree; a path has one struct (level, left
    rows of the low and high half, right rows of both) for each node over the
    block, the root first, so it is as long as the number of blocks has digits."""
    sizes = dealt.groupBy(*names, "_depth", "_block").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    levels = sizes.where("_depth > 0").withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_depth")))).withColumn("_over", F.expr("shiftright(_block, _level)"))
    is_high = F.expr("shiftright(_block, _level - 1) & 1") == 1
    halves = [F.sum(F.when(is_high == high, F.col(c)).otherwise(0)).alias(f"{c}{int(high)}") for c in ("_l", "_r") for high in (False, True)]
    nodes = levels.groupBy(*names, "_level", "_over").agg(*halves)
    node = F.struct((-F.col("_level")).alias("down"), *[F.col(c).cast("long").alias(c) for c in ("_l0", "_l1", "_r0", "_r1")])
    return levels.select(*names, "_block", "_level", "_over").join(nodes, [*names, "_level", "_over"]).groupBy(*names, "_block").agg(F.array_sort(F.collect_list(node)).alias("_path"))


def resampled_tests(df: DataFrame, keys: Sequence[str], value: str, side: str, n_permutations: int, n_bootstraps: int, seed: int, block_values: int = 4096, count: str | None = None) -> DataFrame:
    """Each test by itself: keys, p_permutation (two-sided) and the bootstrap
    interval of right - left (``side`` L or R). Null where a side has no value. A
    row stands for ``count`` rows if a column is named.

    No task holds a test. Its values are counted, and dealt by hash to blocks of
    about ``block_values`` distinct ones, or fewer so that tests of over a thousand
    values have ``LEAST_BLOCKS`` blocks. For each replicate the number of rows
    that a block gives to the left is a hypergeometric draw over the blocks'
    sizes (multinomial for the bootstrap). It is made along the block's path in a
    binary tree of blocks, each node drawing from a seed of its own; the block
    draws that many of its own rows and gives their sum. Sums by replicate add up
    over the blocks to exactly what drawing from the whole test would have given."""
    names = list(keys)
    kinds = dict(df.dtypes)
    # Equal values are one row with a count, so ties cost nothing.
    times = F.lit(1) if count is None else F.col(count)
    on = lambda own: F.sum(F.when(F.col(side) == own, times).otherwise(0)).cast("long")
    cells = df.where(F.col(value).isNotNull() & F.col(side).isin("L", "R")).groupBy(*names, F.col(value).cast("double").alias("_v")).agg(on("L").alias("_l"), on("R").alias("_r")).where("_l + _r > 0")
    wide = cells.groupBy(*names).agg(F.greatest(F.ceil(F.count("*") / F.lit(block_values)), F.least(F.lit(LEAST_BLOCKS), F.ceil(F.count("*") / F.lit(64)))).alias("_blocks"), F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"), F.sum(F.col("_v") * F.col("_l")).alias("_sl"), F.sum(F.col("_v") * F.col("_r")).alias("_sr"))
    both_sides = wide.where("_nl > 0 and _nr > 0")
    dealt = cells.join(both_sides.select(*names, "_blocks"), names).withColumn("_block", F.pmod(F.xxhash64("_v"), F.col("_blocks"))).withColumn("_depth", F.ceil(F.log2("_blocks")).cast("int")).drop("_blocks")
    facts = both_sides.select(*names, "_nl", "_nr", keyed_seed(seed, *[F.col(k).cast("string") for k in names]).alias("_seed"))
    paths = dealt.select(*names, "_block").distinct().join(facts, names).join(block_paths(dealt, names), [*names, "_block"], "left")
    # Names of their own: the cogroup can't tell columns of one origin apart.
    heads = paths.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate([*names, "_block"])], "_nl", "_nr", "_seed", "_path")
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "at array<int>, permuted array<double>, left array<double>, right array<double>"])

    def run(key: tuple, part: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        part, own = part.sort_values("_v"), head.iloc[0]
        nodes = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (own["_path"] if own["_path"] is not None else ())]
        path = np.array(nodes, np.int64).reshape(-1, 5) * [-1, 1, 1, 1, 1]
        v, l, r = part["_v"].to_numpy(), part["_l"].to_numpy(np.int64), part["_r"].to_numpy(np.int64)
        out = []
        for k, start in enumerate(range(0, max(n_permutations, n_bootstraps), CHUNK)):
            n, m = (max(0, min(CHUNK, total - start)) for total in (n_permutations, n_bootstraps))
            sums = kernels.block_sums(v, l, r, int(key[-1]), path, int(own["_nl"]), int(own["_nr"]), n, m, [int(own["_seed"]), k])
            out.append([*key[:-1], list(range(start, start + CHUNK)), *sums])
        return pd.DataFrame(out, columns=[*names, "at", "permuted", "left", "right"])

    # Few bytes are hours of draws, so tasks are as many as partitions, whatever the size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = dealt.select(*names, "_block", "_v", "_l", "_r").repartition(tasks, *names, "_block").groupBy(*names, "_block").cogroup(heads.groupBy(*[f"_of_{k}" for k in range(len(names) + 1)])).applyInPandas(run, schema)
    sums = drawn.select(*names, F.explode(F.arrays_zip("at", "permuted", "left", "right")).alias("z")).groupBy(*names, "z.at").agg(F.sum("z.permuted").alias("_p"), F.sum("z.left").alias("_a"), F.sum("z.right").alias("_b"))
    sums = sums.join(both_sides, names)
    total, observed = F.col("_sl") + F.col("_sr"), F.col("_sr") / F.col("_nr") - F.col("_sl") / F.col("_nl")
    change = (total - F.col("_p")) / F.col("_nr") - F.col("_p") / F.col("_nl")
    hit = F.abs(change) >= F.abs(observed) - 1e-12 * F.greatest(F.lit(1.0), F.abs(observed))
    facts = sums.groupBy(*names).agg(F.count_if(hit & F.col("_p").isNotNull()).alias("_hits"), F.array_sort(F.collect_list(F.col("_b") / F.col("_nr") - F.col("_a") / F.col("_nl"))).alias("_drawn"))
    out = wide.join(facts, names, "left")
    points = [array_quantile(F.col("_drawn"), F.lit(q)).alias(name) for q, name in ((0.025, "difference_ci95_low"), (0.975, "difference_ci95_high"))]
    return out.select(*names, ((F.col("_hits") + 1) / F.lit(n_permutations + 1)).alias("p_permutation"), *points)


#: Replicates that a block draws at once.
CHUNK = 250
#: Blocks of a test, so that its draws are several tasks'.
LEAST_BLOCKS = 16
