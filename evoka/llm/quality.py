"""Quality rules by distribution divergence.

Every document is described by two histograms: its code points over a few
character classes, and its words over a short list of common words of its
language. Both are compared with the reference histograms of the language by
the Jensen-Shannon distance. A document is rejected when a distance exceeds
its limit, or when it breaks one of the base rules. The limit on characters
widens for short texts and ends below a minimum length. The limit on words is
derived from the reference: a share of the distance that a text without any
common word has, or, where that is more, what a text of that many words drawn
from the reference itself would have by chance.

Two scans of the texts and no shuffle of them: the first sums the histograms
by language (one small row per language and task), the second scores. The first
can be of any corpus: where a trusted one exists, fit the references to it, since
a corpus of mostly bad texts would set its own norm.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import combined, texts_of

# Frequent function words of the supported languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux d".split(),
}
POOLED = "*"
N_COMMON = 30
#: Strips punctuation around a common word: "The," counts as "the".
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def _classes() -> np.ndarray:
    """Byte -> character class; continuation bytes of UTF-8 have none (-1)."""
    of = np.full(256, 5)
    of[list(range(97, 123))] = 0
    of[list(range(65, 91))] = 1
    of[list(range(48, 58))] = 2
    of[_SPACES] = 3
    of[[ord(c) for c in ".,;:'\"!?-()"]] = 4
    of[192:] = 6
    of[128:192] = -1
    return of


N_CLASSES = 7


@dataclass(frozen=True)
class QualityLimits:
    """Distances run from 0 (same) to 1 (nothing in common)."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_char_distance: float = 0.20
    #: Below min_chars code points the distance isn't measured; below
    #: short_chars the wider limit holds, since short histograms are noisy.
    min_chars: int = 200
    short_chars: int = 500
    max_char_distance_short: float = 0.30
    #: Limit on words as a share of the distance of a text without common words;
    #: or, if more, the distance that so many deviations of chance explain.
    word_distance_share: float = 0.5
    word_deviations: float = 3.0
    #: The pooled reference mixes languages, so its own limit is no less.
    least_pooled_word_distance: float = 0.45
    #: Documents with more symbols or capitals than this don't shape the references.
    max_reference_symbols: float = 0.02
    max_reference_capitals: float = 0.3


@dataclass(frozen=True)
class References:
    """Mean histograms by language; POOLED serves all other languages."""

    chars: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)


def _language(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else POOLED


def _vocabulary() -> dict[str, dict[bytes, int]]:
    own = {k: {w.encode(): i for i, w in enumerate(v[:N_COMMON])} for k, v in COMMON_WORDS.items()}
    return own | {POOLED: own["en"]}


def _char_histogram(text: bytes, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return counts, matrix @ counts


def _class_matrix() -> np.ndarray:
    of = _classes()
    return np.array([of == k for k in range(N_CLASSES)], dtype=np.int64)


def _word_histogram(words: Counter, common: dict[bytes, int], total: int) -> np.ndarray:
    """Counts of the common words, last the count of all other words."""
    out = np.zeros(N_COMMON + 1)
    for word, n in words.items():
        if (k := common.get(word.strip(_MARKS))) is not None:
            out[k] += n
    out[-1] = total - out.sum()
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence, logarithms to base 2."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def _chance(q: np.ndarray, n: int) -> tuple[float, float]:
    """Mean and deviation of the Jensen-Shannon divergence between ``q`` and the
    histogram of ``n`` words drawn from it: exact for each cell, whose count is
    binomial; cells count as independent."""
    q = q[q > 0][:, None]
    x = np.arange(n + 1)
    ways = math.lgamma(n + 1) - np.array([math.lgamma(k + 1) + math.lgamma(n - k + 1) for k in x])
    weight = np.exp(ways + x * np.log(q) + (n - x) * np.log(np.maximum(1 - q, 1e-300)))
    p = x / n
    m = (p + q) / 2
    value = (p * np.log2(np.where(p > 0, p / m, 1.0)) + q * np.log2(q / m)) / 2
    mean = (weight * value).sum(axis=1)
    return float(mean.sum()), float(np.sqrt(np.maximum(0, (weight * value**2).sum(axis=1) - mean**2).sum()))


def word_limits(refs: References, limits: QualityLimits = QualityLimits()) -> dict[str, np.ndarray]:
    """By language, the limit at 0, 1, 2, ... words; the last holds beyond."""
    out = {}
    for key, words in refs.words.items():
        q = words / words.sum()
        none = np.zeros(len(q))
        none[-1] = 1
        least = limits.word_distance_share * js_distance(none, q)
        if key == POOLED:
            least = max(least, limits.least_pooled_word_distance)
        own = [1.0] * max(1, limits.min_words)
        while len(own) < 5000:
            mean, deviation = _chance(q, len(own))
            own.append(max(least, math.sqrt(max(0.0, mean + limits.word_deviations * deviation))))
            if own[-1] <= least:
                break
        out[key] = np.array(own)
    return out


def _ordinary(counts: np.ndarray, chars: np.ndarray, n_words: int, limits: QualityLimits) -> bool:
    letters = chars[0] + chars[1] + chars[6]
    return n_words >= limits.min_words and counts[_SYMBOLS].sum() <= limits.max_reference_symbols * chars.sum() and chars[1] <= limits.max_reference_capitals * letters


def fit_references(docs: DataFrame, limits: QualityLimits = QualityLimits(), text_col: str = "text", lang_col: str = "lang") -> References:
    """Mean of the documents' own normalised histograms, by language, over all
    ordinary documents: those with ``min_words`` words and few symbols and
    capitals. The result has one small row per supported language.

    Null, empty and too short texts add nothing; an empty table gives no
    references, and then no distance is measured."""

    def sums(batches):
        matrix, vocabulary = _class_matrix(), _vocabulary()
        total: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                counts, chars = _char_histogram(text, matrix)
                if not _ordinary(counts, chars, len(words), limits):
                    continue
                key = _language(lang)
                own = total.setdefault(key, [0, np.zeros(N_CLASSES), np.zeros(N_COMMON + 1)])
                own[0] += 1
                own[1] += chars / max(1, chars.sum())
                own[2] += _word_histogram(Counter(words), vocabulary[key], len(words)) / len(words)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "n": pa.array([v[0] for v in total.values()], pa.int64()), "chars": pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64())), "words": pa.array([v[2].tolist() for v in total.values()], pa.list_(pa.float64()))})

    parts = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(sums, "lang string, n long, chars array<double>, words array<double>")
    at = lambda c, n: [F.sum(F.col(c)[i]).alias(f"{c}{i}") for i in range(n)]
    rows = parts.groupBy("lang").agg(F.sum("n").alias("n"), *at("chars", N_CLASSES), *at("words", N_COMMON + 1)).collect()
    pick = lambda r, c, n: np.array([r[f"{c}{i}"] for i in range(n)]) / r["n"]
    return References({r["lang"]: pick(r, "chars", N_CLASSES) for r in rows}, {r["lang"]: pick(r, "words", N_COMMON + 1) for r in rows})


def count_repeated(words: list[bytes], window: int) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words)
    if n <= window or len(set(words)) == n:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    # The window is named exactly: each step pairs the names of two spans.
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = ids[: len(ids) - step] * n + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        width += step
        if ids.max() + 1 == len(ids):
            return 0
    repeated = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measured(text: bytes, lang: str | None, refs: References, limits: QualityLimits, word_limit: dict, matrix, vocabulary) -> tuple:
    words = text.split()
    counts, chars = _char_histogram(text, matrix)
    points = int(counts[:128].sum() + counts[192:].sum())
    word_chars = points - int(counts[_SPACES].sum())
    lines = [x for x in text.split(b"\n") if x and x.split(None, 1)]
    repeat = count_repeated(words, limits.window)
    n = len(words)
    failed = n < limits.min_words or 100 * repeat > limits.max_repeat_percent * n
    key = _language(lang)
    char_d = word_d = None
    if key in refs.chars and points >= limits.min_chars:
        char_d = js_distance(chars.astype(float), refs.chars[key])
    if key in refs.words and n >= limits.min_words:
        word_d = js_distance(_word_histogram(Counter(text.lower().split()), vocabulary[key], n), refs.words[key])
    char_limit = limits.max_char_distance if points >= limits.short_chars else limits.max_char_distance_short
    kept = not failed and (char_d is None or char_d <= char_limit) and (word_d is None or word_d <= word_limit[key][min(n, len(word_limit[key]) - 1)])
    return n, word_chars, int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat, failed, kept, char_d, word_d


_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "char_distance": pa.float64(), "word_distance": pa.float64()}
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_report(docs: DataFrame, refs: References, limits: QualityLimits = QualityLimits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its id, the measures, ``base_failed`` and ``kept``.

    Null or empty text: all counts 0, ``base_failed``. Null or unknown
    language: the pooled reference. A distance is null where its length guard
    or a missing reference leaves it unmeasured, and then never rejects.
    Repeated rows are judged each by itself; other columns are ignored."""
    word_limit = word_limits(refs, limits)

    def run(batches):
        matrix, vocabulary = _class_matrix(), _vocabulary()
        for batch in batches:
            rows = [_measured(t, g, refs, limits, word_limit, matrix, vocabulary) for t, g in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([combined(batch.column(0)), *(pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True))], names=[id_col, *_FIELDS])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}")


def keep_quality(docs: DataFrame, refs: References, limits: QualityLimits = QualityLimits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no shuffle."""
    at_text, at_lang = docs.columns.index(text_col), docs.columns.index(lang_col)
    word_limit = word_limits(refs, limits)

    def run(batches):
        matrix, vocabulary = _class_matrix(), _vocabulary()
        for batch in batches:
            mask = [_measured(t, g, refs, limits, word_limit, matrix, vocabulary)[6] for t, g in zip(texts_of(batch.column(at_text)), batch.column(at_lang).to_pylist(), strict=True)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
