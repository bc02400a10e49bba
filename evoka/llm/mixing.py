"""Mixing to target weights with soft domain membership.

1. A multinomial logistic classifier of numpy is fitted to a bounded sample of
   a labelled table (id, domain) and gives every document its posterior over
   the K domains, in steps of 1 / ``resolution``.
2. A document's expected tokens in a domain are its tokens times its posterior
   there. The fit finds the documents' rates, none negative, whose weighted
   totals come nearest, in least squares, to the target totals; the rates'
   squared distance from 1 counts too, weighted by ``pull``, so that no few
   documents stand for all. Documents are first summed by posterior, on which
   alone a rate depends (at most binomial(resolution + K - 1, K - 1) thin rows
   however large the corpus).
3. Projected gradient steps with momentum, in the metric of the tokens, need no
   step size to be tried: the curvature is at least pull and at most pull plus the
   largest eigenvalue of sum of tokens * posterior * posterior'. A step is one
   distributed aggregation of the thin rows, whose rates follow from the K numbers
   of each step before; K + 1 sums reach the driver.
4. What the totals still lack is added to the aims and the fit repeated, until
   the totals meet the targets or the next fit would leave the corpus with fewer
   effective documents than stated, (sum of rates)^2 / sum of squared rates.
   Where a fit has settled, a rate is max(0, 1 - posterior @ step), so the texts
   get theirs without a join.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import combined, discard, texts_of, written

_LOG = logging.getLogger(__name__)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?-()"])
N_DENSE = 6


@dataclass(frozen=True)
class MixingConfig:
    #: At most so many labelled documents of a domain teach the classifier,
    #: those with the smallest hash of their id.
    max_per_domain: int = 1000
    hash_bits: int = 18
    #: Beginnings of a word, in bytes, that are features besides the word.
    prefixes: tuple[int, ...] = (5, 6)
    #: Features count whose rate in a domain differs from the rest by so many
    #: standard errors, at most ``n_features`` of them.
    least_difference: float = 5.0
    n_features: int = 4096
    steps: int = 300
    rate: float = 0.05
    l2: float = 1e-3
    #: Posteriors are whole multiples of 1 / resolution. Rounding moves a domain's
    #: total by less than 1 / resolution of all tokens, so by less than ``tolerance``.
    resolution: int = 10_000
    #: The fit ends when no domain's total is off its target by more than this
    #: share of all tokens.
    tolerance: float = 1e-3
    #: Weight of the rates' squared distance from 1 against the squared residual, in shares.
    pull: float = 0.05
    #: Aims are raised only as long as this share of the documents stays effective,
    #: and as long as that lowers the residual by a tenth.
    least_effective: float = 0.85
    max_rounds: int = 30
    #: Steps of a round end when the rates' mean squared move falls under the square
    #: of this; more than ``max_steps`` is an error, not a result.
    settled: float = 3e-4
    max_steps: int = 500


def _names(word: bytes, config: MixingConfig) -> set[int]:
    mask = (1 << config.hash_bits) - 1
    return {zlib.crc32(x) & mask for x in {word, *(word[:n] + b"*" for n in config.prefixes if len(word) >= n)}}


class _Slots(dict):
    """Word -> its features' rows; remembers a bounded number of words."""

    def __init__(self, config: MixingConfig, rows: dict[int, int] | None):
        super().__init__()
        self.config, self.rows = config, rows

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        names = _names(word, self.config)
        found = tuple(names) if self.rows is None else tuple(self.rows[x] for x in names if x in self.rows)
        if len(self) < 300_000:
            self[word] = found
        return found


def _features(text: bytes, slots: _Slots) -> tuple[int, dict[int, int], np.ndarray]:
    """(words of the text, how often each feature occurs, facts of the whole)."""
    n = len(text.split())
    words = Counter(text.translate(_LETTERS).split())
    found: dict[int, int] = {}
    for word, times in words.items():
        for k in slots[word]:
            found[k] = found.get(k, 0) + times
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, total = max(1, len(text)), max(1, sum(words.values()))
    facts = np.array([1.0, math.log1p(n) / 8, len(words) / total, 20 * counts[_SYMBOLS].sum() / size, 4 * counts[65:91].sum() / size, 4 * counts[48:58].sum() / size])
    return n, found, facts


@dataclass(frozen=True)
class DomainModel:
    """Posteriors are the softmax of weighted log-counts and facts, rounded."""

    domains: tuple[str, ...]
    rows: dict[int, int]
    words: np.ndarray
    facts: np.ndarray
    config: MixingConfig

    def parts(self, found: dict[int, int], facts: np.ndarray) -> np.ndarray:
        z = facts @ self.facts
        if found:
            z = z + np.log1p(np.fromiter(found.values(), np.float64, len(found))) @ self.words[list(found)]
        p = np.exp(z - z.max())
        return whole_parts(p / p.sum(), self.config.resolution)


def _no_model(config: MixingConfig) -> DomainModel:
    return DomainModel(("all",), {}, np.zeros((0, 1)), np.zeros((N_DENSE, 1)), config)


def whole_parts(p: np.ndarray, resolution: int) -> np.ndarray:
    """Whole numbers near ``p * resolution`` that sum to ``resolution``: the
    largest remainders, first ones of equals, are rounded up."""
    low = np.floor(p * resolution).astype(np.int64)
    order = np.argsort(low - p * resolution, kind="stable")
    low[order[: resolution - int(low.sum())]] += 1
    return low


def fit_domains(docs: DataFrame, labelled: DataFrame, config: MixingConfig = MixingConfig(), id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DomainModel:
    """A classifier of the domains that ``labelled`` (id, domain) knows.

    Null ids, domains and texts teach nothing; of repeated ids the smallest
    domain counts. Domains that no document of the sample has are unknown to
    the model; without any, every posterior is that of one domain ``all``."""
    own = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    by_hash = F.xxhash64("id", F.lit("mix"))
    names = sorted(r[0] for r in own.select("domain").distinct().collect())
    wanted = None
    for name in names:
        some = own.where(F.col("domain") == name).orderBy(by_hash, "id").limit(config.max_per_domain)
        wanted = some if wanted is None else wanted.union(some)
    if wanted is None:
        return _no_model(config)

    def run(batches):
        slots = _Slots(config, None)
        for batch in batches:
            rows = [_features(t, slots) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"domain": batch.column(0), "at": pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())), "times": pa.array([list(r[1].values()) for r in rows], pa.list_(pa.int32())), "facts": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    table = texts.join(F.broadcast(wanted), "id").select("domain", "text").mapInArrow(run, "domain string, at array<int>, times array<int>, facts array<double>").toArrow()
    return _fit(table, config)


def _fit(table: pa.Table, config: MixingConfig) -> DomainModel:
    """Softmax regression by Adam on the most telling features."""
    of = table.column("domain").to_pylist()
    domains = tuple(sorted(set(of)))
    if not domains:
        return _no_model(config)
    n, k, size = len(of), len(domains), 1 << config.hash_bits
    lists = [np.asarray(x.values, np.int64) for x in table.column("at")]
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    column = np.concatenate([np.empty(0, np.int64), *lists])
    value = np.log1p(np.concatenate([np.empty(0), *(np.asarray(x.values, np.float64) for x in table.column("times"))]))
    facts = np.array(table.column("facts").to_pylist())
    y = np.zeros((n, k))
    y[np.arange(n), [domains.index(d) for d in of]] = 1
    unlike = np.zeros(size)
    overall = np.bincount(column, minlength=size)
    for d in range(k):
        inside, m = np.bincount(column, y[row, d], size), y[:, d].sum()
        if 0 < m < n:
            share = (overall + 1) / (n + 1)
            gap = np.abs(inside / m - (overall - inside) / (n - m)) / np.sqrt(share * (1 / m + 1 / (n - m)))
            unlike = np.maximum(unlike, np.where(overall >= 5, gap, 0))
    n_used = min(config.n_features, int((unlike >= config.least_difference).sum()))
    used = np.sort(np.argsort(-unlike, kind="stable")[:n_used])
    index = np.full(size, -1)
    index[used] = np.arange(n_used)
    keep = index[column] >= 0
    row, column, value = row[keep], index[column[keep]], value[keep]
    w = np.zeros((n_used + N_DENSE, k))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, config.steps + 1):
        g = np.empty_like(w)
        z = facts @ w[n_used:]
        for d in range(k):
            z[:, d] += np.bincount(row, w[column, d] * value, n)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) / n
        for d in range(k):
            g[:n_used, d] = np.bincount(column, error[row, d] * value, n_used)
        g[n_used:] = facts.T @ error
        g[:n_used] += config.l2 / max(1, n_used) * w[:n_used]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return DomainModel(domains, {int(x): i for i, x in enumerate(used)}, w[:n_used], w[n_used:], config)


def soft_members(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, parts array<int>) of each row: its words at white space
    and its posterior in parts of the resolution. Null and empty texts have no
    tokens and the posterior of no words. One scan, no shuffle."""

    def run(batches):
        slots = _Slots(model.config, model.rows)
        for batch in batches:
            n, parts = [], []
            for text in texts_of(batch.column(1)):
                words, *rest = _features(text, slots)
                n.append(words)
                parts.append(model.parts(*rest).astype(np.int32))
            yield pa.RecordBatch.from_arrays([combined(batch.column(0)), pa.array(n, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=[id_col, "n_tokens", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, parts array<int>")


@dataclass(frozen=True)
class MixingRates:
    """``steps`` give every posterior its rate; totals are tokens by domain.
    ``effective`` is (sum of rates)^2 / sum of squared rates as a share of the
    documents with tokens, ``largest`` the highest rate of one."""

    domains: tuple[str, ...]
    steps: tuple[tuple[float, ...], ...]
    targets: tuple[float, ...]
    reached: tuple[float, ...]
    resolution: int
    effective: float = 1.0
    largest: float = 1.0

    def of(self, parts: Column) -> Column:
        return _rate(parts, self.steps, self.resolution)

    def of_parts(self, parts: np.ndarray) -> float:
        rate = 1.0
        for step in self.steps:
            down = 0.0
            for p, x in zip(parts, step, strict=True):
                down += float(p) * (float(x) / self.resolution)
            rate = max(0.0, rate - down)
        return rate


def _rate(parts: Column, steps, resolution: int) -> Column:
    """The rate after the steps, each projected to be no less than 0."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(x) / resolution) for x in step]) for step in steps])
    down = lambda u: F.aggregate(F.zip_with(parts, u, lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(taken, F.lit(1.0), lambda r, u: F.greatest(F.lit(0.0), r - down(u)))


def _fold(p: np.ndarray, start: np.ndarray, steps: list[np.ndarray], pull: float, curve: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, rates before the last step, where the next step begins) after the
    steps, for rows of posteriors ``p``; ``curve`` is the largest curvature."""
    root = math.sqrt(pull / curve)
    momentum = (1 - root) / (1 + root)
    before = rate = ahead = np.maximum(0.0, 1.0 - p @ start)
    for u in steps:
        before, rate = rate, np.maximum(0.0, ahead - (p @ u + pull * (ahead - 1.0)) / curve)
        ahead = rate + momentum * (rate - before)
    return rate, before, ahead


def _summed(cells: DataFrame, k: int, resolution: int, work, names: str) -> list[float]:
    """Sums, and the last column's maximum, of ``work(posteriors, tokens, documents)``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = batch.column(0).flatten().to_numpy().reshape(-1, k) / resolution
                found = work(p, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in found], names=names.split())

    *sums, top = names.split()
    rows = cells.select("parts", "mass", "documents").mapInArrow(run, ", ".join(f"{x} double" for x in names.split()))
    return list(rows.agg(*[F.sum(x) for x in sums], F.max(top)).first())


def fit_rates(members: DataFrame, domains: tuple[str, ...], weights: dict[str, float], config: MixingConfig = MixingConfig(), relative: bool = False) -> MixingRates:
    """Rates by projected gradient; ``weights`` are the domains' target shares
    of all tokens or, if ``relative``, multiples of their present shares, scaled
    to sum to 1; domains they don't name aim at none, and weights of domains that
    the model doesn't know count as not given.

    Targets that only a few documents could meet are met in part; ``reached``,
    ``effective`` and ``largest`` say how far, and are logged. No tokens or no
    weights at all: every rate is 1."""
    k, pull = len(domains), config.pull
    cells = written(members.groupBy("parts").agg(F.sum("n_tokens").cast("double").alias("mass"), F.count("*").cast("double").alias("documents")).where("mass > 0"), "mixing-cells")
    pairs = [(d, e) for d in range(k) for e in range(d, k)]
    crossed = [f"c{d}_{e}" for d, e in pairs]
    *first, total, _ = _summed(cells, k, config.resolution, lambda p, m, n: [*((m * p[:, d] * p[:, e]).sum() for d, e in pairs), m.sum(), 0], " ".join([*crossed, "mass", "top"]))
    c = np.zeros((k, k))
    aims = np.array([max(0.0, float(weights.get(d, 0.0))) for d in domains])
    if total:
        for (d, e), x in zip(pairs, first, strict=True):
            c[d, e] = c[e, d] = x / total
        if relative:
            aims = aims * c.sum(axis=1)
    if not total or not aims.sum():
        discard(cells)
        return MixingRates(domains, (), (), (), config.resolution)
    targets = aims / aims.sum()
    curve = pull + float(np.linalg.eigvalsh(c)[-1])
    shares = [f"s{d}" for d in range(k)]

    def fitted(aim: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The step whose rates are the fit to the aim."""
        steps: list[np.ndarray] = []
        while len(steps) <= config.max_steps:

            def work(p, m, n):
                rate, before, ahead = _fold(p, start, steps, pull, curve)
                return [*(m * ahead) @ p, (m * (rate - before) ** 2).sum(), 0]

            *sums, move, _ = _summed(cells, k, config.resolution, work, " ".join([*shares, "move", "top"]))
            steps.append(np.array(sums) / total - aim)
            if len(steps) > 1 and move <= config.settled**2 * total:
                return steps[-1] / pull
        raise RuntimeError(f"no convergence in {config.max_steps} steps")

    def outcome(step: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(reached shares, effective share of the documents, largest rate)."""

        def work(p, m, n):
            rate = np.maximum(0.0, 1.0 - p @ step)
            return [*(m * rate) @ p, (n * rate).sum(), (n * rate**2).sum(), n.sum(), rate.max()]

        *sums, one, two, n, top = _summed(cells, k, config.resolution, work, " ".join([*shares, "rates", "squares", "documents", "top"]))
        return np.array(sums) / total, one * one / (two * n) if two else 0.0, top

    aim, step = targets, fitted(targets, np.zeros(k))
    reached, effective, largest = outcome(step)
    off = lambda x: float((x - targets) @ (x - targets))
    for _ in range(config.max_rounds):
        if np.abs(reached - targets).max() <= config.tolerance:
            break
        aim = aim + targets - reached
        raised = fitted(aim, step)
        found = outcome(raised)
        if found[1] < config.least_effective or off(found[0]) > 0.9 * off(reached):
            break
        step, (reached, effective, largest) = raised, found
    discard(cells)
    rates = MixingRates(domains, (tuple(float(x) for x in step),), tuple((targets * total).tolist()), tuple((reached * total).tolist()), config.resolution, float(effective), float(largest))
    _LOG.info("tokens by domain: %s; effective share of documents %.3f, largest rate %.3f", {d: {"target": t, "reached": x} for d, t, x in zip(domains, rates.targets, rates.reached, strict=True)}, effective, largest)
    return rates


def _copies(draw: Column, rate: Column) -> Column:
    """Whole copies of a document: the rate's floor, and one more with the
    probability of what is left."""
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def _draw(id_col: str) -> Column:
    """A number from 0 to 1 that the id alone decides; null ids share one."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")), F.lit(1 << 32)) / F.lit(float(1 << 32))


def mixing_report(members: DataFrame, rates: MixingRates, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_tokens, its posterior in each domain as
    ``p_<domain>``, rate and copies. Repeated ids are separate rows with the
    same draw; an empty table gives an empty result."""
    own = [(F.col("parts")[d] / F.lit(float(rates.resolution))).alias(f"p_{name}") for d, name in enumerate(rates.domains)]
    rated = members.withColumn("rate", rates.of(F.col("parts")))
    return rated.select(id_col, "n_tokens", *own, F.round("rate", 9).alias("rate"), _copies(_draw(id_col), F.col("rate")).alias("copies"))


def mix_documents(docs: DataFrame, model: DomainModel, rates: MixingRates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with all their
    columns. The texts stay where they are read; nothing is shuffled. Null and
    empty texts have the rate of no words, repeated ids the same draw; columns
    may be called anything; an empty table stays one."""
    columns = docs.columns
    at_text = columns.index(text_col)

    def run(batches):
        slots = _Slots(model.config, model.rows)
        for batch in batches:
            copies = []
            for text, draw in zip(texts_of(batch.column(at_text)), batch.column(len(columns)).to_pylist(), strict=True):
                rate = rates.of_parts(model.parts(*_features(text, slots)[1:]))
                copies.append(int(rate) + (draw < rate - int(rate)))
            at = np.repeat(np.arange(batch.num_rows), copies)
            yield batch.select(list(range(len(columns)))).take(pa.array(at))

    own = "_draw"
    while own in {c.lower() for c in columns}:
        own += "_"
    return docs.withColumn(own, _draw(id_col)).mapInArrow(run, docs.schema)
