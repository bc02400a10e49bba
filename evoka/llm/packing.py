"""Token ids in fixed-width bit-packed files.

Layout of a file: magic, header (JSON: bits, ids per block, end id), packed
blocks, footer (Arrow stream: one row per document with its id and number of
ids, block offsets and totals in the schema's metadata), length of the footer,
magic. Every id takes the least number of bits that the vocabulary needs and
every block starts at a byte, so any range of ids is read by seeking to its
blocks, which numpy unpacks as a whole.

Documents lie in ascending order of id over the files: the texts are range
partitioned, every task sorts and encodes its range and writes one file. The
number of ids before a file is the sum over the files before it, of which the
driver holds one small row each.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import texts_of
from .word_encoder import worker_encoder

MAGIC = b"EVPACK01"
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, least significant first. An id that needs more
    bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, bits // 8)
        return out.view("<u4").ravel()
    spread = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Writes one file as a stream; memory is one block and the footer."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        header = json.dumps({"bits": bits, "block_ids": block_ids}).encode()
        sink.write(MAGIC + struct.pack("<I", len(header)) + header)
        self.at = len(MAGIC) + 4 + len(header)
        self.held, self.n_held, self.offsets, self.docs, self.n_docs, self.n_ids = [], 0, [], [], 0, 0

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(pa.record_batch([doc_ids, pa.array(lengths, pa.int64())], names=["doc_id", "n"]))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_docs += len(lengths)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            rest = np.concatenate(self.held)
            full = len(rest) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(rest[k : k + self.block_ids])
            self.held, self.n_held = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        facts = {"offsets": self.offsets, "end": self.at, "n_ids": self.n_ids}
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())], metadata={"facts": json.dumps(facts)})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema) as stream:
            for batch in self.docs:
                stream.write_batch(batch.cast(schema))
        footer = out.getvalue()
        self.sink.write(footer)
        self.sink.write(struct.pack("<Q", footer.size) + MAGIC)
        self.sink.close()


class PackedReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed id file, or cut short")
        (n,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 16 - n)
        table = pa.ipc.open_stream(source.read(n)).read_all()
        facts = json.loads(table.schema.metadata[b"facts"])
        source.seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a packed id file")
        (h,) = struct.unpack("<I", source.read(4))
        header = json.loads(source.read(h))
        self.bits, self.block_ids = header["bits"], header["block_ids"]
        self.offsets, self.n_ids = [*facts["offsets"], facts["end"]], facts["n_ids"]
        self.doc_ids, self.lengths = table.column("doc_id").combine_chunks(), table.column("n").to_numpy()
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` of the file; reads their blocks only."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(self.offsets[first])
        data = self.source.read(self.offsets[last + 1] - self.offsets[first])
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            lo = self.offsets[b] - self.offsets[first]
            parts.append(unpack(data[lo : lo + self.offsets[b + 1] - self.offsets[b]], self.bits, n))
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1))


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Encodes every whole text, appends ``end_id`` and writes the files to
    ``folder``; returns (part, name, documents, ids) of each, in order.

    Null texts count as empty. Null ids come first; rows with equal ids follow
    each other in order of their texts. A task that runs again writes the same
    file under the same name, moved into place when complete. Other columns
    are ignored; an empty table gives no files."""
    bits = bits_for(vocabulary)

    def run(batches):
        encoder, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        files, root = _open(folder)
        writer = name = None
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                if writer is None:
                    name = f"part-{part:06d}.ids"
                    files.create_dir(root, recursive=True)
                    trial = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
                    writer = PackedWriter(files.open_output_stream(trial), bits)
                texts = texts_of(piece.column(1))
                words = [t.split() for t in texts]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                codes = encoder.codes([w for ws in words for w in ws])
                ids, lengths = encoder.ids(codes)
                edge = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
                ids = np.insert(ids, edge[1:], end_id)
                writer.add(piece.column(0), np.diff(edge) + 1, ids)
        if writer:
            writer.close()
            files.move(trial, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows = ordered.mapInArrow(run, "part int, name string, n_docs long, n_ids long").collect()
    return sorted((r.part, r.name, r.n_docs, r.n_ids) for r in rows)


def read_packed(spark, folder: str, parts: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, ids array<int>) of each document in the files."""
    return _scan(spark, folder, parts, "doc_id long, start long, ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def read_packed_digests(spark, folder: str, parts: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""

    def digest(ids):
        crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        return pa.array([len(x) for x in ids], pa.int64()), crc

    return _scan(spark, folder, parts, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _scan(spark, folder, parts, schema, columns) -> DataFrame:
    before, rows = 0, []
    for _, name, _, n in parts:
        rows.append((name, before))
        before += n
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        files, root = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{name}") as source:
                    reader = PackedReader(source)
                    for k in range(0, len(reader.lengths), 500):
                        starts, lengths = reader.starts[k : k + 500], reader.lengths[k : k + 500]
                        ids = reader.ids(int(starts[0]), int(starts[-1] + lengths[-1]))
                        each = np.split(ids, (starts - starts[0])[1:])
                        made = columns(each)
                        yield pa.RecordBatch.from_arrays([reader.doc_ids.slice(k, 500), pa.array(base + starts, pa.int64()), *(made if isinstance(made, tuple) else (made,))], names=names)

    table = spark.createDataFrame(rows, "name string, base long")
    return table.repartition(max(1, len(rows))).mapInArrow(run, schema)
