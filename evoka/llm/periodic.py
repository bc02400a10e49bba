"""Periodic runs of words by a harmonic grid.

A run of period p and at least 2 * p words holds two neighbours j * p and
(j + 1) * p of the grid of p. So for each period p, and each such pair of equal
words, the longest common extensions forward from the pair and backward from
the words before it give the run through both: n * ln(n) pairs for n words.

Extensions are minima over ranges of a table of common prefixes. Suffix arrays
of a block's words and of the same words reversed come from prefix doubling, in
which only words that still share a rank are sorted again; ranks of all lengths
2^k give the common prefixes of neighbours in the array; a sparse table gives the
minima. A text's suffixes have ranks of their own, so copies in a block don't
lengthen the doubling.

One scan, no shuffle: a task works through blocks of whole texts. Its memory
follows ``block_words`` or the longest text, whichever is more, times the binary
digits of the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts_of

LEAST = 12
#: Pairs of the grid that are looked at together.
_PAIRS = 2_000_000


def _suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... words that begin at each place,
    the last of them those of the suffixes. ``first`` ranks the words, each
    equal to the number of places with a smaller word; every text ends with a
    word that no other place has."""
    levels, active, width = [first], None, 1
    while True:
        rank = levels[-1]
        size = np.bincount(rank, minlength=len(rank))
        active = np.flatnonzero(size[rank] > 1) if active is None else active[size[rank[active]] > 1]
        if not len(active):
            return levels
        key = rank[active].astype(np.int64) * len(rank) + rank[active + width]
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = rank[active]
        at = np.arange(len(active))
        begins = lambda values: np.maximum.accumulate(np.where(np.concatenate([[True], values[1:] != values[:-1]]), at, 0))
        new = rank.copy()
        new[active] = old + begins(key) - begins(old)
        levels.append(new)
        width *= 2


class _Extensions:
    """Lengths of the longest common prefix of the suffixes at two places."""

    def __init__(self, first: np.ndarray, longest: int):
        levels = _suffix_ranks(first)
        self.rank = levels[-1]
        order = np.empty(len(first), np.int32)
        order[self.rank] = np.arange(len(first), dtype=np.int32)
        a, b = order[:-1], order[1:]
        # Pairs enter at the last level that holds them equal, the longest first.
        equal = [np.flatnonzero(levels[0][a] == levels[0][b])]
        for level in levels[1:]:
            held = equal[-1]
            equal.append(held[level[a[held]] == level[b[held]]])
        common = np.zeros(len(first), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            held = equal[k]
            done = common[held + 1]
            more = levels[k][a[held] + done] == levels[k][b[held] + done]
            common[held[more] + 1] += np.int32(1 << k)
        self.table = [common]
        while 1 << len(self.table) <= longest:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            low = last.copy()
            np.minimum(last[:-half], last[half:], out=low[:-half])
            self.table.append(low)
        self.flat = np.concatenate(self.table)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places of one text."""
        low, high = np.minimum(self.rank[i], self.rank[j]).astype(np.int64), np.maximum(self.rank[i], self.rank[j]).astype(np.int64)
        k = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        at = k * len(self.rank)
        return np.minimum(self.flat[at + low + 1], self.flat[at + high + 1 - (np.int64(1) << k)])


def _grid(start: np.ndarray, n: np.ndarray):
    """Pairs (place, period) of the grids of texts at ``start`` with ``n`` words."""
    text = np.repeat(np.arange(len(n)), n // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(n // 2) - n // 2, n // 2) + 1
    pairs = (n[text] - 1) // period
    total = np.cumsum(pairs)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        own = pairs[at:end]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        p = np.repeat(period[at:end], own)
        yield np.repeat(start[text[at:end]], own) + step * p, p
        at = end


def runs_of(codes: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, as codes of its words from 0: its maximal runs as rows
    (start, length, smallest period), in order of start, then period. A run has at
    least ``least`` words and two periods."""
    n = np.array([len(c) for c in codes], np.int64)
    found = [np.empty((0, 3), np.int64)] * len(codes)
    if not len(n) or n.max() < max(2, least):
        return found
    # Before each text and after the last stands a mark of its own.
    start = np.cumsum(n + 1) - n
    size = int((n + 1).sum()) + 1
    words, text = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    at = np.arange(size)
    marks = np.concatenate([start - 1, [size - 1]])
    inside = np.ones(size, bool)
    inside[marks] = False
    words[inside], text[inside] = np.concatenate(codes), np.repeat(np.arange(len(n)), n)
    text[marks] = np.arange(len(n) + 1)
    key = text * (int(words.max()) + 2) + words + 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.empty(size, np.int32)
    first[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), at, 0))
    longest = int(n.max())
    forward, backward = _Extensions(first, longest), _Extensions(first[::-1].copy(), longest)
    rows = []
    for i, p in _grid(start, n):
        same = first[i] == first[i + p]
        i, p = i[same], p[same]
        # The pair's own words count in both directions, once too often.
        ahead, behind = forward(i, i + p), backward(size - 1 - i, size - 1 - i - p)
        length = ahead + behind - 1 + p
        fits = length >= np.maximum(least, 2 * p)
        rows.append(np.stack([i[fits] - behind[fits] + 1, length[fits], p[fits]]))
    begin, length, p = np.concatenate(rows, axis=1)
    order = np.lexsort((p, length, begin))
    begin, length, p = begin[order], length[order], p[order]
    # A run is found on each multiple of its period too; the smallest one is its own.
    own = np.ones(len(p), bool)
    own[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, p = begin[own], length[own], p[own]
    of = np.searchsorted(start, begin, "right") - 1
    order = np.lexsort((p, begin))
    out = np.stack([begin - start[of], length, p], axis=1)[order]
    edges = np.searchsorted(of[order], np.arange(len(n) + 1))
    return [out[edges[d] : edges[d + 1]] for d in range(len(n))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words stays: no run holds it after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


@dataclass(frozen=True)
class PeriodicConfig:
    #: Runs have at least so many words.
    least: int = LEAST
    #: A block ends with the text that reaches so many words.
    block_words: int = 150_000


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words in which every tenth document, by the checksum of its id, repeats
    a stretch up to its end. A null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_REPORT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _scanned(docs: DataFrame, row, schema: str, id_col: str, text_col: str, config: PeriodicConfig, change) -> DataFrame:
    """``row(doc_id, words, runs)`` of each row of ``docs``, as columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held, n = [], 0

        def flush():
            index: dict[bytes, int] = {}
            codes = [np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)) for _, words in held]
            rows = [row(i, words, runs) for (i, words), runs in zip(held, runs_of(codes, config.least), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        types = [{"long": pa.int64(), "string": pa.string(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for i, text in zip(piece.column(0).to_pylist(), texts_of(piece.column(1)), strict=True):
                    words = change(i, text.split()) if change else text.split()
                    held.append((i, words))
                    n += len(words)
                    if n >= config.block_words or len(held) >= 5_000:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: PeriodicConfig = PeriodicConfig()) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs as arrays (start,
    length, period) and its text without what repeats a run's first period, words
    joined by single spaces. Words end at ASCII white space.

    Null and empty texts have no words and no runs; null and repeated ids are rows
    of their own; other columns are ignored; an empty table gives an empty result."""

    def row(i, words, runs):
        keep = kept_words(len(words), runs)
        return i, len(words), runs.tolist(), b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()

    return _scanned(docs, row, "doc_id long, n_words long, runs array<array<long>>, collapsed string", id_col, text_col, config, None)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: PeriodicConfig = PeriodicConfig(), change=None) -> DataFrame:
    """One row per row of ``docs``: number of words and runs; start, length, period
    and 1,000 * length / period of the longest run (of equals the first, then that
    of the smallest period; nulls without runs); digests of all runs and of the
    text that ``find_runs`` collapses. ``change(doc_id, words)`` may give other
    words in place of the text's. Rows are treated as in ``find_runs``."""

    def row(i, words, runs):
        if len(runs):
            start, length, period = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
            best = (start, length, period, 1000 * length // period)
            keep = kept_words(len(words), runs)
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n = len(keep)
        else:
            best, n = (None,) * 4, len(words)
        listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs.tolist())
        return i, n, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    return _scanned(docs, row, _REPORT, id_col, text_col, config, change)
