"""Ranked lexical search in a two-level quantised index.

The index is a table of blocks of documents. A block holds its terms with their
postings on two levels: one byte each, the term's impact in the document rounded
up to a multiple of ``STEP``, and the exact occurrences. A search takes two passes
over the blocks, none of which moves postings:

1. Sums of weighted bytes bound each document's score from above, and from
   below, since a byte is less than one step too high. Of each item, a task hands
   on its k highest lower bounds; the k-th of all is the item's threshold.
2. Documents whose upper bound reaches the threshold are scored again from the
   exact level, in whole numbers. No other document can be among the first k.

Items are searched in passes of a bounded number of terms, which is all that the
driver and the tasks hold of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import texts_of, written

#: Impacts are under 1,000,000, so 250 steps cover them.
STEP = 4000
#: A-Z become lower case; bytes that are in no term become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLOCK = "doc_ids array<long>, n binary, terms binary, df binary, slots binary, times binary, impacts binary"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERMS).split()


def impact(times: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """A term's impact, of 1,000,000, in a document of ``n`` terms that has it
    ``times`` times; ``n_documents`` have ``n_terms`` in all."""
    times, n = times.astype(np.int64), n.astype(np.int64)
    scale = 50 + (50 * n * n_documents) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 20 * scale)


def weight(df: int, n_documents: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class LexicalIndex:
    """``blocks`` is a written table; ``n_documents`` have at least one term."""

    blocks: DataFrame
    n_documents: int
    n_terms: int


def _lengths(batches):
    for batch in batches:
        n = np.array([len(terms_of(t)) for t in texts_of(batch.column(0))], np.int64)
        yield pa.RecordBatch.from_pydict({"documents": pa.array([int((n > 0).sum())], pa.int64()), "terms": pa.array([int(n.sum())], pa.int64())})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_terms: int = 1_000_000) -> LexicalIndex:
    """The index of all terms of the whole texts of ``docs``.

    Null texts and texts without terms are in no posting and count nowhere. Null
    and repeated ids are documents of their own; other columns are ignored; an
    empty table gives an empty index. One scan counts, a second one builds blocks
    of ``block_terms`` terms or, if it has more, of one text."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    n_documents, n_terms = int(counted[0] or 0), int(counted[1] or 0)

    def block(doc_ids: list, codes: list[np.ndarray], index: dict[bytes, int]) -> pa.RecordBatch:
        n = np.array([len(c) for c in codes], np.int64)
        keys, times = np.unique(np.concatenate(codes) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        slots = keys % len(n)
        df = np.bincount(keys // len(n), minlength=len(index))
        impacts = -(-impact(times, n[slots], n_documents, n_terms) // STEP)
        binary = lambda x: pa.array([x], pa.binary())
        columns = [pa.array([doc_ids], pa.list_(pa.int64())), *(binary(x) for x in (n.astype("<i4").tobytes(), b"\n".join(index), df.astype("<i4").tobytes(), slots.astype("<i4").tobytes(), times.astype("<i4").tobytes(), impacts.astype(np.uint8).tobytes()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches):
        doc_ids, codes, index, total = [], [], {}, 0
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for i, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    doc_ids.append(i)
                    codes.append(np.fromiter((index.setdefault(t, len(index)) for t in terms), np.int64, len(terms)))
                    total += len(terms)
                    if total >= block_terms:
                        yield block(doc_ids, codes, index)
                        doc_ids, codes, index, total = [], [], {}, 0
        if doc_ids:
            yield block(doc_ids, codes, index)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return LexicalIndex(written(source.mapInArrow(run, _BLOCK), "lexical"), n_documents, n_terms)


def _integers(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), "<i4")


class _Found:
    """The postings of the wanted terms in a block."""

    def __init__(self, batch: pa.RecordBatch, row: int, wanted: dict[bytes, int]):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        df = _integers(column("df"), row)
        self.start = np.cumsum(df, dtype=np.int64) - df
        self.df = df
        self.at = {wanted[t]: i for i, t in enumerate(column("terms")[row].as_py().split(b"\n")) if t in wanted}
        self.slots = _integers(column("slots"), row)
        self.impacts = np.frombuffer(column("impacts")[row].as_buffer(), np.uint8)
        self.size = len(column("doc_ids")[row])

    def range(self, term: int) -> slice | None:
        i = self.at.get(term)
        return None if i is None else slice(int(self.start[i]), int(self.start[i] + self.df[i]))

    def bounds(self, terms: list[int], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bound of every document's score."""
        upper, low = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for term, w in zip(terms, weights, strict=True):
            own = self.range(term)
            if own and w > 0:
                upper[self.slots[own]] += w * self.impacts[own].astype(np.int64)
                low[self.slots[own]] += w * (self.impacts[own] > 0)
        # An impact is under its byte's value by at most STEP - 1.
        return STEP * upper - (STEP - 1) * low, STEP * upper


def _passes(items: DataFrame, id_col: str, text_col: str, max_terms: int) -> Iterator[list[tuple]]:
    """Items as (id, distinct terms), in lists of at most ``max_terms`` terms or one item."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms_of(t))) for t in texts_of(batch.column(1))], pa.list_(pa.binary()))], names=["id", "terms"])

    held, n = [], 0
    kind = items.schema[id_col].dataType.simpleString()
    for row in items.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, terms array<binary>").where("size(terms) > 0").toLocalIterator():
        if held and n + len(row.terms) > max_terms:
            yield held
            held, n = [], 0
        held.append((row.id, [bytes(t) for t in row.terms]))
        n += len(row.terms)
    if held:
        yield held


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by ascending id."""
    if len(scores) > k:
        reach = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        reach = np.arange(len(scores))
    return reach[np.lexsort((ids[reach], -scores[reach]))[:k]]


def _search(index: LexicalIndex, items: list[tuple], k: int, kind: str) -> DataFrame:
    wanted: dict[bytes, int] = {}
    terms = [[wanted.setdefault(t, len(wanted)) for t in own] for _, own in items]

    def count(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                df = _integers(batch.column(1), row)
                found = [(wanted[t], int(df[i])) for i, t in enumerate(batch.column(0)[row].as_py().split(b"\n")) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["term", "df"])

    df = {r.term: r.df for r in index.blocks.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = [[weight(df[t], index.n_documents) if t in df else 0 for t in own] for own in terms]

    def lower(batches):
        best = [np.empty(0, np.int64) for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                found = _Found(batch, row, wanted)
                for q in range(len(items)):
                    low = found.bounds(terms[q], weights[q])[0]
                    low = np.concatenate([best[q], low[low > (best[q].min() if len(best[q]) == k else 0)]])
                    best[q] = np.partition(low, len(low) - k)[len(low) - k :] if len(low) > k else low
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), [len(b) for b in best])), pa.array(np.concatenate([np.empty(0, np.int64), *best]))], names=["item", "low"])

    bounds = index.blocks.select("doc_ids", "terms", "df", "slots", "impacts").mapInArrow(lower, "item long, low long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    thresholds = {r.item: r.low for r in bounds.withColumn("place", place).where(F.col("place") == k).collect()}
    ids = [i for i, _ in items]
    n_documents, n_terms = index.n_documents, index.n_terms

    def exact(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in items]
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            for row in range(batch.num_rows):
                found = _Found(batch, row, wanted)
                n, times = _integers(column("n"), row), _integers(column("times"), row)
                docs = column("doc_ids")[row].values
                named = docs.is_valid().to_numpy(zero_copy_only=False)
                doc_ids = docs.fill_null(0).to_numpy()
                for q in range(len(items)):
                    reach = np.flatnonzero(found.bounds(terms[q], weights[q])[1] >= max(1, thresholds.get(q, 0)))
                    if not len(reach):
                        continue
                    score = np.zeros(len(reach), np.int64)
                    for term, w in zip(terms[q], weights[q], strict=True):
                        own = found.range(term)
                        if own:
                            slots = found.slots[own]
                            at = np.searchsorted(slots, reach)
                            has = slots[np.minimum(at, len(slots) - 1)] == reach
                            score[has] += w * impact(times[own][at[has]], n[reach[has]], n_documents, n_terms)
                    every = [np.concatenate(x) for x in zip(held[q], (score[score > 0], doc_ids[reach[score > 0]], named[reach[score > 0]]), strict=True)]
                    keep = _best(every[0], np.where(every[2], every[1], np.iinfo(np.int64).max), k)
                    held[q] = tuple(x[keep] for x in every)
        count = [len(h[0]) for h in held]
        score, doc_id, named = (np.concatenate([h[j] for h in held]) for j in range(3))
        at = np.repeat(np.arange(len(items)), count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([ids[i] for i in at.tolist()], item_type), pa.array(doc_id, mask=~named), pa.array(score)], names=["item", "item_id", "doc_id", "score"])

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    scored = index.blocks.mapInArrow(exact, f"item long, item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: LexicalIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", max_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents
    with a score above 0, equal scores by ascending id, null ids last.

    Items without terms have no rows; repeated items are ranked each for itself;
    items' ids are whole numbers or strings. Without items or documents the
    result is empty."""
    kind = items.schema[id_col].dataType.simpleString()
    out = None
    for own in _passes(items, id_col, text_col, max_terms) if index.n_documents else ():
        found = _search(index, own, k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
