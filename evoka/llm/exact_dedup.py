"""Exact deduplication by a tree-merge of sorted digest runs.

1. One scan digests every whole text and writes a thin table (document, run,
   digest, two verifiers). A run is what one task read.
2. Every run is sorted by digest and reduced to one entry per digest: the row
   to keep and how many rows the entry stands for.
3. The runs exchange entries in binomial rounds. With lanes numbered in base
   F, round r sends an entry to the lane that differs from its own only in
   digit r, which becomes digit r of the digest. The receiving lane merges the
   up to F sorted runs it gets (a shuffle hands them over interleaved, so the
   merge is that of Spark's external sorter), verifies equal digests and retains
   one entry for each. After the last round a lane holds all of its digest range, so no
   task ever gathers the whole, and a digest that a third of all rows share
   arrives as at most F entries per lane and round.
4. The outcome goes back to the runs (one row per run and digest) and from
   there to the documents by (run, digest): no join key is hotter than one run.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_LOWER, by_keys, join_keys, same_keys, texts_of, written

_ENTRY = "lane int, digest binary, n_bytes long, check binary, keep_id long, keep_row long, group_size long"


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, run, digest, n_bytes, check) of each row: SHA-256 of the
    text with A-Z lower-cased, verified later by length and a BLAKE2b digest."""

    def run(batches):
        task = TaskContext.get().partitionId()
        row = task << 33
        for batch in batches:
            texts = [t.translate(ASCII_LOWER) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "row": pa.array(np.arange(row, row + len(texts)), pa.int64()),
                    "run": pa.array([task] * len(texts), pa.int32()),
                    "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "check": pa.array([hashlib.blake2b(t, digest_size=8).digest() for t in texts], pa.binary()),
                }
            )
            row += len(texts)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, row long, run int, digest binary, n_bytes long, check binary")


_ENTRIES = pa.schema([("lane", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("check", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _merge_runs(batches):
    """Entries in order of digest, best first -> one verified entry for each."""
    held = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_ENTRIES)
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        digest = combined_column(table, "digest")
        new = np.ones(table.num_rows, bool)
        new[1:] = pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
        same = ~new[1:]
        for name in ("check", "n_bytes"):
            column = combined_column(table, name)
            if (pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False) & same).any():
                raise ValueError("two texts have one SHA-256 digest")
        starts = np.flatnonzero(new)
        size = np.add.reduceat(combined_column(table, "group_size").to_numpy(), starts)
        first = table.take(pa.array(starts)).drop_columns("group_size")
        out = first.append_column("group_size", pa.array(size, pa.int64())).cast(_ENTRIES).combine_chunks()
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
        held = out.slice(out.num_rows - 1).to_batches()[0]
    if held is not None:
        yield held


def combined_column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _merged(entries: DataFrame, largest: bool) -> DataFrame:
    best = [F.desc_nulls_last("keep_id"), F.desc("keep_row")] if largest else [F.asc_nulls_last("keep_id"), F.asc("keep_row")]
    return entries.sortWithinPartitions("digest", *best).mapInArrow(_merge_runs, _ENTRY)


def tree_merge(digests: DataFrame, largest: bool = False, fan_in: int = 16) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of each distinct text. Each of
    the rounds merges at most ``fan_in`` runs into one."""
    n = max(2, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rounds = max(2, math.ceil(math.log(n) / math.log(fan_in)))
    base = max(2, math.ceil(n ** (1 / rounds) - 1e-9))
    lanes = base**rounds
    entries = digests.select((F.col("run") % lanes).alias("lane"), "digest", "n_bytes", "check", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    runs = _merged(entries, largest)
    home = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % lanes
    for r in range(rounds):
        unit = base**r
        digit = lambda c: F.floor(c / unit) % base  # noqa: B023, E731
        lane = (F.col("lane") + (digit(home) - digit(F.col("lane"))) * unit).cast("int")
        sent = runs.withColumn("lane", lane).repartitionById(lanes, F.col("lane"))
        runs = _merged(sent, largest)
    return runs.select("digest", "keep_id", "keep_row", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the smallest id stays (the largest if ``largest``);
    null ids lose against others, and of rows that also share the id exactly
    one is kept. Columns besides id and text are ignored. An empty table gives
    an empty result."""
    digests = written(digest_table(docs, id_col, text_col), "digests")
    best = written(tree_merge(digests, largest, fan_in), "runs")
    of_run = digests.select("run", "digest").distinct().join(best, "digest")
    joined = digests.select("doc_id", "row", "run", "digest").join(of_run, ["run", "digest"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The dropped ids
    grow with the corpus, so texts and ids meet in a hash join at every size, and
    in one exchange. Ids that have both kept and dropped rows (repeated or null
    ids) need a closer look, which is planned only where there are any."""
    judged = written(exact_dedup(docs, id_col, text_col, largest), "exact")
    dropped = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("__evoka_mixed"), F.bool_and("kept").alias("all")).where("not all").drop("all")
    dropped = written(dropped, "dropped")
    keyed = docs.select("*", *join_keys(id_col, text_col))
    found = by_keys(dropped).hint("shuffle_hash")
    if dropped.where("__evoka_mixed").isEmpty():
        return keyed.join(found, same_keys(), "left_anti").select(*docs.columns)
    # Both parts read one exchange of the texts.
    met = keyed.join(found, same_keys(), "left_outer")
    stay = met.where(F.col("__evoka_mixed").isNull())
    lowered = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    again = met.where("__evoka_mixed").withColumn("__evoka_hex", F.upper(F.sha2(lowered, 256))).dropDuplicates(["__evoka_id", "__evoka_hex"])
    kept = judged.where("kept").select(F.col("doc_id").alias("__evoka_kept_id"), F.hex("digest").alias("__evoka_kept_hex"))
    again = again.join(kept, F.col("__evoka_id").eqNullSafe(F.col("__evoka_kept_id")) & F.col("__evoka_hex").eqNullSafe(F.col("__evoka_kept_hex")), "left_semi")
    return stay.select(*docs.columns).unionByName(again.select(*docs.columns))
