"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers on hashed words and word beginnings are trained in numpy
from confirmed toxic texts (P) and unlabelled texts (U). The risk of the
negative class can't be measured without clean examples, so it is the risk of
U as negative less the class prior times the risk of P as negative; where that
estimate turns negative, which shows overfitting, the step goes the other way
(the non-negative estimator).

Bounds: at most ``max_positive`` confirmed, ``max_unlabelled`` unlabelled and
``max_calibration`` labelled texts are taken, those with the smallest hash of
their id; only their sparse features reach the driver. Every text is scored,
whole, in one scan without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import combined, texts_of

#: Lower case; everything but ASCII letters and other scripts is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: More occurrences of a feature in a text count as so many, in learning and scoring.
MOST = 30_000


@dataclass(frozen=True)
class ToxicityConfig:
    max_positive: int = 2500
    max_unlabelled: int = 6000
    max_calibration: int = 3000
    hash_bits: int = 18
    #: Beginnings of a word, in bytes, that are features besides the word.
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: Features whose rates in P and U differ by at least so many standard
    #: errors are used, at most ``n_features`` of them.
    least_difference: float = 4.0
    n_features: int = 8192
    n_models: int = 3
    steps: int = 150
    rate: float = 0.05
    l2: float = 1e-4
    #: Scores from here up are predicted toxic.
    threshold: float = 0.7
    #: Share of clean calibration texts that may be predicted toxic.
    max_false_positive: float = 0.002


class WordFeatures:
    """Feature numbers of words; remembers a bounded number of words."""

    def __init__(self, config: ToxicityConfig):
        self.config, self.mask = config, (1 << config.hash_bits) - 1
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            names = {word, *(word[:n] + b"*" for n in self.config.prefixes)}
            found = tuple(zlib.crc32(x) & self.mask for x in names)
            if len(self.known) < 300_000:
                self.known[word] = found
        return found

    def of_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, ascending, and how often each occurs)."""
        words = Counter(text.translate(_LETTERS).split())
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        of = [self.of_word(w) for w in words]
        n = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter((i for x in of for i in x), np.int64, int(n.sum()))
        weight = np.repeat(np.fromiter(words.values(), np.float64, len(of)), n)
        numbers, at = np.unique(flat, return_inverse=True)
        return numbers, np.minimum(np.bincount(at, weight), MOST)


@dataclass(frozen=True)
class ToxicityModel:
    """score = sigmoid(weights . log(1 + counts) + bias)."""

    weights: np.ndarray
    bias: float
    config: ToxicityConfig

    def logit(self, numbers: np.ndarray, counts: np.ndarray) -> float:
        return float(self.weights[numbers] @ np.log1p(counts)) + self.bias


class _Rows:
    """Sparse rows with log-counts."""

    def __init__(self, numbers: list[np.ndarray], counts: list[np.ndarray]):
        n = np.array([len(x) for x in numbers], np.int64)
        self.row = np.repeat(np.arange(len(numbers)), n)
        self.column = np.concatenate([*numbers, np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.log1p(np.concatenate([*counts, np.empty(0)]))
        self.n = len(numbers)

    def columns_kept(self, index: np.ndarray) -> None:
        at = index[self.column]
        keep = at >= 0
        self.row, self.column, self.value = self.row[keep], at[keep], self.value[keep]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.n)

    def transposed_times(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, g[self.row] * self.value, width)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu_gradient(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the logits of P and U of the non-negative risk estimate
    with the logistic loss: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))."""
    p, u = _sigmoid(positive), _sigmoid(unlabelled)
    negative_risk = np.mean(np.logaddexp(0, unlabelled)) - prior * np.mean(np.logaddexp(0, positive))
    of_u, of_p = u / len(u), -prior * p / len(p)
    if negative_risk < 0:
        return -of_p, -of_u
    return of_p - prior * (1 - p) / len(p), of_u


def _trained(p: _Rows, u: _Rows, prior: float, width: int, config: ToxicityConfig) -> tuple[np.ndarray, float]:
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, config.steps + 1):
        gp, gu = nnpu_gradient(p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1], prior)
        g = np.append(p.transposed_times(gp, width) + u.transposed_times(gu, width) + config.l2 * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_rows(positive: tuple[list, list], unlabelled: tuple[list, list], prior: float, config: ToxicityConfig, calibration: tuple[list, list, np.ndarray] | None = None) -> ToxicityModel:
    """Features most unlike between P and U are kept; ``n_models`` classifiers,
    each with its own half of U, are averaged. Then the bias is moved so that
    the threshold falls where the calibration rows are told apart best."""
    size = 1 << config.hash_bits
    p, u = _Rows(*positive), _Rows(*unlabelled)
    if not p.n or not u.n:
        return ToxicityModel(np.zeros(size), -8.0, config)
    rate = lambda r: np.bincount(r.column, minlength=size) / r.n
    a, b = rate(p), rate(u)
    spread = np.sqrt((a * p.n + b * u.n + 1) / (p.n + u.n) * (1 / p.n + 1 / u.n))
    unlike = np.where((a * p.n + b * u.n) >= 5, np.abs(a - b) / spread, 0)
    n_chosen = min(config.n_features, int((unlike >= config.least_difference).sum()))
    chosen = np.sort(np.argsort(-unlike, kind="stable")[:n_chosen])
    index = np.full(size, -1)
    index[chosen] = np.arange(len(chosen))
    weights, bias = np.zeros(size), 0.0
    for k in range(config.n_models):
        part = [i for i in range(u.n) if config.n_models == 1 or u.n < 4 or (i * 7919 + k) % config.n_models != 0]
        own_p, own_u = _Rows(*positive), _Rows([unlabelled[0][i] for i in part], [unlabelled[1][i] for i in part])
        own_p.columns_kept(index)
        own_u.columns_kept(index)
        w, c = _trained(own_p, own_u, prior, len(chosen), config)
        weights[chosen] += w / config.n_models
        bias += c / config.n_models
    model = ToxicityModel(weights, bias, config)
    if calibration and len(calibration[2]):
        cut = _best_cut(np.array([model.logit(n, c) for n, c in zip(calibration[0], calibration[1], strict=True)]), calibration[2], config)
        model = ToxicityModel(weights, bias - cut + float(np.log(config.threshold / (1 - config.threshold))), config)
    return model


def _best_cut(z: np.ndarray, y: np.ndarray, config: ToxicityConfig) -> float:
    """The cut of best F1 among those that few clean rows exceed."""
    order = np.argsort(-z, kind="stable")
    hit, false = np.cumsum(y[order] == 1), np.cumsum(y[order] == 0)
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + max(1, (y == 1).sum()))
    allowed = false <= max(1, config.max_false_positive * (y == 0).sum())
    k = int(np.argmax(np.where(allowed, f1, -1)))
    below = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + below) / 2)


def in_training(doc_id: Column) -> Column:
    """Labels are learned only where this holds: crc32 of the id mod 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on a bounded sample; see the module for the bounds. Null labels,
    ids and texts take no part in learning, an empty sample gives a model that
    calls nothing toxic. Of repeated ids the smallest label and text count."""
    own = labels.where(F.col(label_col).isNotNull() & in_training(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"))
    share = own.agg(F.avg("label")).first()[0]
    prior = min(0.5, max(0.001, float(share or 0)))
    by_hash = F.xxhash64("id")
    spare = F.pmod(F.xxhash64("id", F.lit("spare")), F.lit(4)) == 0
    take = lambda rows, n, kind: rows.orderBy(by_hash, "id").limit(n).select("id", F.lit(kind).alias("kind"))
    ids = docs.where(in_training(F.col(id_col))).select(F.col(id_col).cast("long").alias("id")).distinct()
    chosen = [
        take(own.where((F.col("label") == 1) & ~spare), config.max_positive, 0),
        take(ids, config.max_unlabelled, 1),
        take(own.where((F.col("label") == 1) & spare), config.max_calibration // 2, 2),
        take(own.where((F.col("label") == 0) & spare), config.max_calibration, 3),
    ]
    wanted = chosen[0].union(chosen[1]).union(chosen[2]).union(chosen[3]).distinct()

    def run(batches):
        features = WordFeatures(config)
        for batch in batches:
            rows = [features.of_text(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"kind": batch.column(0), "numbers": pa.array([n.astype(np.int32) for n, _ in rows], pa.list_(pa.int32())), "counts": pa.array([c.astype(np.int16) for _, c in rows], pa.list_(pa.int16()))})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(wanted), "id")
    texts = texts.groupBy("id", "kind").agg(F.min("text").alias("text")).select("kind", "text")
    table = texts.mapInArrow(run, "kind int, numbers array<int>, counts array<smallint>").toArrow()
    kind = table.column("kind").to_numpy()

    def part(*kinds):
        mask = np.isin(kind, kinds)
        rows = table.filter(pa.array(mask))
        split = lambda c: [np.asarray(x.values) for x in rows.column(c)]
        return split("numbers"), split("counts"), kind[mask]

    p, u, c = part(0), part(1), part(2, 3)
    return fit_rows(p[:2], u[:2], prior, config, (c[0], c[1], np.where(c[2] == 2, 1, 0)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each row of ``docs``; nothing but the whole
    text is scored. Null and empty texts get the score of no words."""

    def run(batches):
        features = WordFeatures(model.config)
        for batch in batches:
            z = np.array([model.logit(*features.of_text(t)) for t in texts_of(batch.column(1))])
            score = np.round(_sigmoid(z), 6)
            yield pa.RecordBatch.from_arrays([combined(batch.column(0)), pa.array(score, pa.float64()), pa.array((score >= model.config.threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
