"""Leakage-safe classification across subjects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import Settings
from ..functions import kernels
from ..functions.columns import keyed_seed
from .stats import scoped


def anova_scores(long: DataFrame, keys: Sequence[str], label: str, value: str = "value") -> DataFrame:
    """Two-group F of each feature (keys), from moments alone; null for a
    feature without spread inside the groups."""
    a, b = F.when(F.col(label) == 0, F.col(value)), F.when(F.col(label) == 1, F.col(value))
    m = long.where(F.col(label).isin(0, 1)).groupBy(*keys).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.avg(value).alias("m"))
    between = F.col("na") * (F.col("ma") - F.col("m")) ** 2 + F.col("nb") * (F.col("mb") - F.col("m")) ** 2
    inside = F.col("na") * F.col("va") + F.col("nb") * F.col("vb")
    return m.select(*keys, (between / F.when(inside > 0, inside) * (F.col("na") + F.col("nb") - 2)).alias("f_score"))


def _prepare(x: np.ndarray, y: np.ndarray, k: int):
    """Columns that vary, standardised, the k of highest F: fitted on train."""
    varies = np.flatnonzero(x.var(axis=0) > 1e-12)
    mean, spread = x[:, varies].mean(axis=0), x[:, varies].std(axis=0)
    z = (x[:, varies] - mean) / spread
    chosen = np.sort(np.argsort(-kernels.anova_f(z, y), kind="stable")[:k])
    return varies[chosen], mean[chosen], spread[chosen]


def fit_split(x: np.ndarray, y: np.ndarray, cfg: Settings, rng: np.random.Generator):
    """The best of the grid by cross-validated balanced accuracy, refitted:
    (columns, mean, spread, weights, C, k, accuracy). First of ties."""
    n_folds = int(min(cfg.n_folds, np.bincount(y.astype(int), minlength=2).min()))
    if n_folds < 3:
        raise ValueError("fewer than three rows of a class")
    fold = kernels.stratified_folds(y, n_folds, rng)
    n_varying = int((x.var(axis=0) > 1e-12).sum())
    sizes = sorted({min(k, n_varying) for k in cfg.n_selected if min(k, n_varying) >= 2})
    if not sizes:
        raise ValueError("fewer than two features vary")
    best = (-1.0, None, None)
    for c in cfg.penalties:
        for k in sizes:
            scores = []
            for f in range(n_folds):
                train, test = fold != f, fold == f
                at, mean, spread = _prepare(x[train], y[train], k)
                w = kernels.fit_logistic((x[train][:, at] - mean) / spread, y[train], c)
                z = (x[test][:, at] - mean) / spread @ w[:-1] + w[-1]
                scores.append(kernels.balanced_accuracy(y[test], (z >= 0).astype(int)))
            if np.mean(scores) > best[0] + 1e-12:
                best = (float(np.mean(scores)), c, k)
    score, c, k = best
    at, mean, spread = _prepare(x, y, k)
    return at, mean, spread, kernels.fit_logistic((x[:, at] - mean) / spread, y, c), c, k, score


def logistic_weights(df: DataFrame, keys: Sequence[str], x: str, label: str, penalties: Sequence[float], rounds: int = 50, tolerance: float = 1e-10) -> dict[tuple, np.ndarray]:
    """Weights of ``kernels.fit_logistic`` (intercept last) for each group of
    ``keys`` and penalty, as {(*key, penalty): weights}, of rows with an array ``x``
    and a label 0 or 1, whatever their number.

    Newton's method: a round is one pass in which every task adds up the gradients
    and Gram matrices of its own rows for all models at once, and the tasks' sums
    meet by model. What the driver holds is a matrix a model, so models and
    features should be few; rows may be many. Models that have settled are left
    out of the next round. Null labels don't count; null or ragged arrays fail."""
    names = list(keys)
    rows = df.where(F.col(label).isNotNull()).select(F.struct(*names).alias("key") if names else F.struct(F.lit(0).alias("_none")).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).collect()
    if any(h.least != h.most or h.least < 0 for h in heads):
        raise ValueError("arrays of a group differ in length")
    counts = {tuple(h.key) if names else (): (h.n, h.ones) for h in heads}
    weights = {(*(tuple(h.key) if names else ()), c): np.zeros(h.least + 1) for h in heads for c in penalties}
    open_ = set(weights)
    for _ in range(rounds):
        if not open_:
            break
        models = {m: weights[m] for m in open_}

        def run(batches, models=models):
            sums: dict[tuple, list] = {}
            for batch in batches:
                of = [tuple(k.values()) if names else () for k in batch.column(0).to_pylist()]
                y, values = batch.column(2).to_numpy(), batch.column(1)
                for key in set(of):
                    at = np.array([i for i, k in enumerate(of) if k == key])
                    z = np.column_stack([np.array(values.take(pa.array(at)).to_pylist(), float), np.ones(len(at))])
                    n, ones = counts[key]
                    s = np.where(y[at] == 1, 1.0, -1.0)
                    weight = np.where(s > 0, n / (2 * max(1, ones)), n / (2 * max(1, n - ones)))
                    for model, w in models.items():
                        if model[:-1] == key:
                            p = 1 / (1 + np.exp(np.clip(s * (z @ w), -500, 500)))
                            own = sums.setdefault(model, [np.zeros(len(w)), np.zeros((len(w), len(w)))])
                            own[0] += z.T @ (weight * s * p)
                            own[1] += (z * (weight * p * (1 - p))[:, None]).T @ z
            order = sorted(models, key=str)
            made = [(order.index(m), np.concatenate([g, h.ravel()]).tolist()) for m, (g, h) in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in made], pa.int32()), pa.array([v for _, v in made], pa.list_(pa.float64()))], names=["model", "sums"])

        order = sorted(models, key=str)
        parts = rows.mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
        found = parts.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("sums")).collect()
        for r in found:
            model, total = order[r.model], np.array(r.sums)
            w, c = weights[model], model[-1]
            gradient, hessian = w - c * total[: len(w)], np.eye(len(w)) + c * total[len(w) :].reshape(len(w), len(w))
            step = np.linalg.solve(hessian, gradient)
            weights[model] = w - step
            if np.abs(step).max() < tolerance:
                open_.discard(model)
    return weights


def cross_subject(features: DataFrame, groups: dict[str, list[str]], cfg: Settings = Settings(), label: str = "target_R") -> DataFrame:
    """External predictions and coefficients of every scope (a task or all),
    feature group and direction (learn from one subject, predict the other).

    Rows of kind ``prediction`` hold a trial, its truth, probability and guess;
    those of kind ``coefficient`` a chosen feature and its weight. A group is
    the trials of one scope, a few hundred rows, handed to one task for each
    feature group and direction; the tasks run side by side. A split whose
    training or test side lacks a class, with a feature that isn't finite, with
    fewer than two features that vary or fewer than three rows of a class fails."""
    names = sorted({c for cs in groups.values() for c in cs})
    order = {n: i for i, n in enumerate(names)}
    runs = [(g, a, b) for g in groups for a, b in (("A", "B"), ("B", "A"))]
    spread = F.explode(F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(a).alias("train_subject"), F.lit(b).alias("test_subject")) for g, a, b in runs])).alias("_run")
    rows = scoped(features, "task").select("scope", "file_name", "trial_id", "subject", "task", F.col(label).cast("int").alias(label), F.array(*[F.col(n).cast("double") for n in names]).alias("_x"), spread).select("*", "_run.*").drop("_run")
    keys = ["scope", "feature_group", "train_subject", "test_subject"]
    rows = rows.withColumn("_seed", keyed_seed(cfg.seed, *map(F.col, keys)))
    columns = ["kind", *keys, "file_name", "trial_id", "subject", "task", "truth", "probability", "guess", "feature", "coefficient", "best_c", "n_selected", "inner_balanced_accuracy", "n_train", "n_input"]

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["file_name", "trial_id"])
        at = [order[n] for n in groups[key[1]]]
        x, y = np.stack(part["_x"].to_numpy())[:, at], part[label].to_numpy()
        train, test = (part["subject"] == key[2]).to_numpy(), (part["subject"] == key[3]).to_numpy()
        if any(len(np.unique(y[side])) != 2 for side in (train, test)):
            raise ValueError(f"{key[0]} {key[2]} to {key[3]}: a side lacks a class")
        if not np.isfinite(x[train | test]).all():
            raise ValueError("a feature isn't finite")
        cols, mean, sd, w, c, k, inner = fit_split(x[train], y[train], cfg, np.random.default_rng(int(part["_seed"].iloc[0])))
        p = 1 / (1 + np.exp(-np.clip((x[test][:, cols] - mean) / sd @ w[:-1] + w[-1], -500, 500)))
        told = [c, len(cols), inner, int(train.sum()), len(at)]
        out = [["prediction", *key, r.file_name, r.trial_id, r.subject, r.task, int(t), float(q), int(q >= 0.5), None, None, *told] for r, t, q in zip(part[test].itertuples(), y[test], p, strict=True)]
        out += [["coefficient", *key, None, None, None, None, None, None, None, groups[key[1]][j], float(v), *told] for j, v in zip(cols, w[:-1], strict=True)]
        return pd.DataFrame(out, columns=columns)

    schema = "kind string, scope string, feature_group string, train_subject string, test_subject string, file_name string, trial_id int, subject string, task string, truth int, probability double, guess int, feature string, coefficient double, best_c double, n_selected int, inner_balanced_accuracy double, n_train int, n_input int"
    return rows.groupBy(*keys).applyInPandas(run, schema)
