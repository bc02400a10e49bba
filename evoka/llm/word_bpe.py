"""Encoding and decoding with a table of distinct words.

The tokenizer's words never join across white space, so a text's ids are its
words' ids in order. The corpus is encoded without running the tokenizer over
texts:

1. One scan splits the texts into words and codes blocks of documents: a block
   row holds its documents as positions in the block's word list, most frequent
   word first, and one run row per hash bucket holds the words of that list
   that fall into the bucket. Both are written once, bucketed by block.
2. The runs of a bucket meet in one task, which encodes every distinct word
   of the bucket once and answers each run with the ids of its words, in the
   order of the run. A frequent word costs one entry per block, so no key is
   hot, and a bucket's size follows ``spark.sql.shuffle.partitions``.
3. The answers go back to their blocks; the bucketed table is already placed by
   block, so only they move. Ids are joined to the documents by position.

Decoding joins every id with the id-to-piece table, whose size is that of the
vocabulary, and the pieces as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import new_folder, texts_of
from .word_encoder import ragged, worker_encoder

_CODED = "block long, bucket int, doc_ids array<long>, counts array<int>, data binary, slots binary"


def _squeeze(a: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else a.tobytes())


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """Little-endian bytes of all values, plane by plane, compressed."""
    return _squeeze(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _coded_blocks(buckets: int, block_words: int):
    def flush(block, index, codes, counts, doc_ids):
        codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(index)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        seen = list(index)
        words = [seen[i] for i in order.tolist()]
        slots = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        by_slot = np.argsort(slots, kind="stable")
        edges = np.searchsorted(slots[by_slot], np.arange(buckets + 1))
        rows = [(block, -1, doc_ids, counts, _planes(rank[codes]), _planes(slots))]
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                rows.append((block, b, None, None, _squeeze(b"\n".join(words[i] for i in by_slot[edges[b] : edges[b + 1]].tolist())), None))
        types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "bucket", "doc_ids", "counts", "data", "slots"])

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        index, codes, counts, doc_ids, n = {}, [], [], [], 0
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                doc_ids += piece.column(0).to_pylist()
                for text in texts_of(piece.column(1)):
                    words = text.split()
                    codes.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
                    counts.append(len(words))
                    n += len(words)
                if n >= block_words:
                    yield flush(block, index, codes, counts, doc_ids)
                    index, codes, counts, doc_ids, n, block = {}, [], [], [], 0, block + 1
        if doc_ids:
            yield flush(block, index, codes, counts, doc_ids)

    return run


def _answered(tokenizer_path: str):
    """Runs of a bucket -> ids of each run's words, each distinct word encoded once."""

    def run(table: pa.Table) -> pa.Table:
        encoder = worker_encoder(tokenizer_path)
        index: dict[bytes, int] = {}
        runs = []
        for data in table.column("data").to_pylist():
            words = _expand(data).split(b"\n")
            runs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        flat, length = encoder.encode_words(list(index))
        start = np.cumsum(length) - length
        answers = [ragged(flat, start[r], length[r]) for r in runs]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lengths": pa.array([_planes(n) for _, n in answers], pa.binary()), "ids": pa.array([_planes(x) for x, _ in answers], pa.binary())})

    return run


def _block_ids(left: pa.Table, right: pa.Table):
    """(doc ids, words per document, codes of words, start, length, flat)."""
    row = left.to_pylist()[0]
    slots = _from_planes(row["slots"])
    answers = sorted(right.select(["bucket", "lengths", "ids"]).to_pylist(), key=lambda r: r["bucket"])
    by_slot = np.argsort(slots, kind="stable")
    sent = np.concatenate([np.empty(0, np.int64), *(_from_planes(r["lengths"]).astype(np.int64) for r in answers)])
    if len(sent) != len(slots):
        raise ValueError("a block lacks answers")
    flat = np.concatenate([np.empty(0, np.uint32), *(_from_planes(r["ids"]) for r in answers)])
    start, length = np.empty(len(slots), np.int64), np.empty(len(slots), np.int64)
    start[by_slot], length[by_slot] = np.cumsum(sent) - sent, sent
    return row["doc_ids"], np.array(row["counts"], np.int64), _from_planes(row["data"]), start, length, flat


def _joined(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, block_words: int, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    coded = source.mapInArrow(_coded_blocks(4 * n, block_words), _CODED)
    name = f"evoka_words_{uuid.uuid4().hex}"
    # An external table: its files stay in the shared folder when the entry goes.
    coded.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, "words")).bucketBy(n, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    runs = table.where("bucket >= 0").select("block", "bucket", "data")
    answers = runs.groupBy("bucket").applyInArrow(_answered(tokenizer_path), "block long, bucket int, lengths binary, ids binary")
    blocks = table.where("bucket = -1").select("block", "doc_ids", "counts", "data", "slots")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1_500_000) -> DataFrame:
    """(doc_id, ids array<int>): ids of every whole text, no special tokens added.

    Null texts count as empty and have no ids. Every row of ``docs`` gives one
    row, repeated and null ids too. ``block_words`` bounds a task's memory: a
    block ends with the group of 200 documents that reaches it. Other columns
    are ignored; an empty table gives an empty result."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, counts, codes, start, length, flat = _block_ids(left, right)
        ids, per_word = ragged(flat, start[codes], length[codes])
        edges = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])]
        values = pa.array(ids.astype(np.int32))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)})

    return _joined(docs, tokenizer_path, id_col, text_col, block_words, finish, "doc_id long, ids array<int>")


def pieces_of(tokenizer_path: str) -> list[str]:
    """The id-to-piece table; ids without a piece are empty strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    n = tokenizer.get_vocab_size()
    return [tokenizer.id_to_token(i) or "" for i in range(n)]


def _lists(batch: pa.RecordBatch, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ids, texts) of a batch of (doc_id, ids): each id looked up in the table of
    pieces, which has a row per id and is never larger than the vocabulary."""
    ids = batch.column(1).fill_null([])
    values = ids.flatten()
    if values.null_count:
        raise ValueError("null among the ids")
    looked_up = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), pieces.take(values))
    return ids, pc.binary_join(looked_up, " ")


def _pieces(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            yield batch.slice(i, 200)


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the pieces that an id-to-piece join finds for the ids, in
    order, joined by spaces. A null list decodes to the empty text; null or
    unknown ids fail the job. Other columns are ignored."""
    pieces = pieces_of(tokenizer_path)

    def run(batches):
        table = pa.array(pieces, pa.string())
        for part in _pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(part, table)[1]], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = 1_500_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids that
    ``encode_documents`` gives and of what the id-to-piece join makes of them."""
    pieces = pieces_of(tokenizer_path)

    def run(batches):
        table = pa.array(pieces, pa.string())
        digests = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts_of(texts)], pa.string())
        for part in _pieces(batches):
            ids, decoded = _lists(part, table)
            numbers = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), ids.flatten().cast(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), pc.list_value_length(ids).cast(pa.int64()), digests(pc.binary_join(numbers, " ")), digests(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_documents(docs, tokenizer_path, id_col, text_col, block_words).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
