"""Classification measures from predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import kernels
from ..functions.columns import array_quantile, keyed_seed, safe_ratio
from .effects import shared_replicates


def confusion_metrics(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Counts and measures; a measure whose denominator is 0 is 0."""
    n = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    c = df.groupBy(*keys).agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    sensitivity, specificity = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*keys, "tn", "fp", "fn", "tp", safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((sensitivity + specificity) / 2).alias("balanced_accuracy"), sensitivity.alias("sensitivity"), specificity.alias("specificity"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_ratio(tp * tn - fp * fn, spread).alias("mcc"))


def roc_auc(df: DataFrame, keys: Sequence[str], truth: str, score: str, pieces: int = 200) -> DataFrame:
    """Area under the ROC curve by ranks, ties at their mean rank; null when a
    class is missing. Rows are summed by score first. A sketch of the distinct
    scores deals them to ``pieces`` ranges of each group; ranks run within a
    range, and on from the totals of the ranges below, of which there are few."""
    cells = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum((F.col(truth) == 1).cast("long")).alias("_p"))
    cells = cells.withColumn("_all", F.lit(0))
    own = [*keys, "_all"]
    marks = F.percentile_approx("_s", F.array(*[F.lit(k / pieces) for k in range(1, pieces)]), F.lit(20 * pieces))
    cells = cells.join(cells.groupBy(*own).agg(marks.alias("_marks")), own).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col("_s")))).drop("_marks")
    before = lambda by: F.coalesce(F.sum("_n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = cells.groupBy(*own, "_range").agg(F.sum("_n").alias("_n")).select(*own, "_range", before(W.partitionBy(*own).orderBy("_range")).alias("_below"))
    ranked = cells.withColumn("_inside", before(W.partitionBy(*own, "_range").orderBy("_s"))).join(totals, [*own, "_range"])
    ranks = ranked.withColumn("_r", F.col("_p") * (F.col("_below") + F.col("_inside") + (F.col("_n") + 1) / 2))
    out = ranks.groupBy(*keys).agg(F.sum("_r").alias("_r"), F.sum("_p").alias("_p"), (F.sum("_n") - F.sum("_p")).alias("_q"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    area = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / F.when(both, F.col("_p") * F.col("_q"))
    return out.select(*keys, F.when(both, area).alias("roc_auc"))


def stratified_inference(df: DataFrame, keys: Sequence[str], stratum: str, truth: str, guess: str, n_permutations: int, n_bootstraps: int, seed: int, pieces: int = 8) -> DataFrame:
    """keys, permutation_p (one-sided, truths exchanged within strata) and the
    stratified bootstrap interval of the balanced accuracy.

    Spark counts the four cells of each stratum; those counts are all that the
    draws depend on. Exchanging truths is a hypergeometric draw of a stratum's
    cells, drawing rows again a multinomial one. The replicates of a key are
    made in ``pieces`` by as many tasks, and only their accuracies are gathered."""
    n = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g)).cast("double")
    strata = df.groupBy(*keys, stratum).agg(F.array(n(0, 0), n(0, 1), n(1, 0), n(1, 1)).alias("cells"))
    tables = strata.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(stratum).alias("s"), "cells"))), lambda x: x["cells"]).alias("tables"))
    each = shared_replicates(tables, [("permutations", n_permutations), ("bootstraps", n_bootstraps)], pieces)
    each = each.withColumn("seed", keyed_seed(seed, *[F.col(k).cast("string") for k in keys], F.col("piece").cast("string"))).repartition(*keys, "piece")

    @F.pandas_udf("hits long, drawn array<double>")
    def draws(tables: pd.Series, n_permuted: pd.Series, n_drawn: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        out = []
        for own, n, m, s in zip(tables, n_permuted, n_drawn, seeds, strict=True):
            cells = np.stack([np.asarray(t, float) for t in own]).astype(np.int64)
            rng = np.random.default_rng(int(s))
            out.append((int((kernels.permuted_accuracies(cells, int(n), rng) >= kernels.cell_accuracy(cells.sum(axis=0)) - 1e-12).sum()), kernels.bootstrapped_accuracies(cells, int(m), rng).tolist()))
        return pd.DataFrame(out, columns=["hits", "drawn"])

    made = each.select(*keys, draws("tables", "permutations", "bootstraps", "seed").alias("d"))
    hits = made.groupBy(*keys).agg(F.sum("d.hits").alias("hits"), F.flatten(F.collect_list("d.drawn")).alias("drawn"))
    points = F.transform(F.array(F.lit(0.025), F.lit(0.975)), lambda q: array_quantile(F.array_sort(F.filter("drawn", lambda x: ~F.isnan(x))), q))
    return hits.select(*keys, ((F.col("hits") + 1) / F.lit(n_permutations + 1)).alias("permutation_p"), points[0].alias("balanced_accuracy_ci_low"), points[1].alias("balanced_accuracy_ci_high"))
