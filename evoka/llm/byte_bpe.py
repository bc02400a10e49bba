"""Byte-level BPE by recursive SQL over token-position rows.

A task works through blocks of whole texts:

1. A block's code points are one array. Where a match of the splitting pattern
   begins follows from the classes of neighbours (letter, number, white space,
   other), so all matches of the block are found at once, and equal ones are
   told by their code points.
2. Matches that the worker has not met are encoded in its DuckDB: one row for
   each word and position, joined to the merge table. A step of the recursive
   query contracts each word's leftmost pair of least rank; a word ends at its
   fixpoint, where no neighbours can be merged. In long words, where single
   steps would take the square of the length, a step contracts all pairs of least
   rank that single steps would contract one after another.
3. Ids go back to their places in the texts.

Decoding joins the rows (document, position, id) with the vocabulary and
aggregates the pieces in order of position.

Nothing is shuffled. What a task holds follows ``block_bytes`` or the longest
text, and a worker remembers a bounded number of words.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import combined
from .word_encoder import ragged

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Endings that the pattern splits off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the pattern's ``\s`` (fixed values of the Unicode property).
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers that Unicode 16 added, (first, last), where Python's own
#: tables may end before it (fixed values).
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Bytes from which a word counts as long.
_LONG = 96
#: Rows with which a recursive query begins, beyond a single word.
_ROWS = 300_000

#: A row is (key, id): the word's number in the upper half of the key, the
#: position in the lower.
_SHORT_STEP = """
    paired AS (SELECT s.key, s.id, s.next, (m.id::BIGINT << 32) | (s.key & 4294967295) AS rank
        FROM (SELECT key, id, lead(id) OVER w AS next_id, lead(key) OVER w AS next FROM steps WHERE live WINDOW w AS (ORDER BY key)) s
        LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id AND s.next >> 32 = s.key >> 32),
    best AS (SELECT key >> 32 AS word, min(rank) AS rank, arg_min(next, rank) AS gone FROM paired GROUP BY word)
    SELECT p.key, CASE WHEN p.rank = b.rank THEN (b.rank >> 32)::INT ELSE p.id END, b.rank IS NOT NULL
    FROM paired p JOIN best b ON b.word = p.key >> 32 WHERE b.rank IS NULL OR p.key <> b.gone"""

#: Contracts a word's pairs of least rank from the left up to the first that
#: opens a pair of lower rank with a neighbour, which has to come before the rest.
_LONG_STEP = """
    paired AS (SELECT s.key, s.id, m.id AS to_id, row_number() OVER (ORDER BY s.key) AS n
        FROM (SELECT key, id, lead(id) OVER w AS next_id, lead(key) OVER w AS next FROM steps WHERE live WINDOW w AS (ORDER BY key)) s
        LEFT JOIN merges m ON m.left_id = s.id AND m.right_id = s.next_id AND s.next >> 32 = s.key >> 32),
    best AS (SELECT key >> 32 AS word, min(to_id) AS to_id FROM paired GROUP BY word),
    fit AS (SELECT p.key, p.id, p.n, b.to_id, coalesce(p.to_id = b.to_id, false) AS fits FROM paired p JOIN best b ON b.word = p.key >> 32),
    heads AS (SELECT *, fits AND (n - coalesce(max(CASE WHEN NOT fits THEN n END) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS head FROM fit),
    near AS (SELECT key, n, to_id, head, CASE WHEN lag(key) OVER w >> 32 = key >> 32 THEN CASE WHEN lag(head, 2) OVER w THEN to_id ELSE lag(id) OVER w END END AS before,
        CASE WHEN lead(key, 2) OVER w >> 32 = key >> 32 THEN lead(id, 2) OVER w END AS after FROM heads WINDOW w AS (ORDER BY key)),
    opened AS (SELECT key >> 32 AS word, min(n) AS n FROM (
        SELECT a.key, a.n FROM near a JOIN lower l ON l.left_id = a.before AND l.right_id = a.to_id AND l.id < a.to_id WHERE a.head
        UNION ALL SELECT a.key, a.n FROM near a JOIN lower l ON l.left_id = a.to_id AND l.right_id = a.after AND l.id < a.to_id WHERE a.head) GROUP BY word),
    held AS (SELECT h.key, h.id, h.to_id, h.head AND h.n <= coalesce(o.n, h.n) AS head FROM heads h LEFT JOIN opened o ON o.word = h.key >> 32),
    cut AS (SELECT *, coalesce(lag(head) OVER (ORDER BY key), false) AS gone FROM held)
    SELECT key, CASE WHEN head THEN to_id ELSE id END, to_id IS NOT NULL FROM cut WHERE NOT gone"""

_ENCODE = "WITH RECURSIVE steps AS (SELECT key, id, true AS live FROM tokens UNION ALL (WITH {})) SELECT (key >> 32)::INT AS word, id FROM steps WHERE NOT live ORDER BY key"
_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS piece, count(piece) = count(*) AS known FROM tokens LEFT JOIN vocab USING (id) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each piece in a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def _classes() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in ((_LETTER, NEW_LETTERS), (_NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = _SPACE
    return out


def match_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a match of the pattern begins at each of the code points of texts
    that begin at ``first``. Matches cover a text without gaps.

    A run of one class is a match, with a blank before it if there is one; of
    white space before something else, the last character is left for that."""
    kind = classes[points]
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    head, last = head[:-1], head[1:]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == 32
    before[head], blank[head], after[last] = 255, False, _SPACE
    space = kind == _SPACE
    starts = np.where(space, (before != _SPACE) | (after != _SPACE), (before != kind) & ~blank)
    # An apostrophe that begins a match takes one of the endings with it.
    at = np.flatnonzero(starts & (points == 39) & (after == _LETTER))
    if len(at):
        ends = np.concatenate([first[1:], [n]])
        end = ends[np.searchsorted(first, at, "right") - 1]
        for letters in ENDINGS:
            fits = at + len(letters) < end
            for k, letter in enumerate(letters, 1):
                fits &= points[np.minimum(at + k, n - 1)] == ord(letter)
            own, stop = at[fits] + 1, at[fits] + 1 + len(letters)
            starts[own] = False
            starts[stop[stop < end[fits]]] = True
    return starts


def _distinct(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first match of each distinct one, number of each match's distinct one).
    Hashes gather equal matches; code points decide."""
    code = points.astype(np.uint64) + np.uint64(1)
    code = (code ^ (code >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    place = np.arange(len(points)) - np.repeat(start, length)
    steps = np.cumprod(np.full(int(length.max(initial=1)) + 1, 0x94D049BB133111EB, np.uint64))
    value = np.add.reduceat(code * steps[place], start) + length.astype(np.uint64)
    _, best, of = np.unique(value, return_index=True, return_inverse=True)
    if (length[best[of]] == length).all() and (points[np.repeat(start[best[of]], length) + place] == points).all():
        return best, of
    index: dict[bytes, int] = {}
    every = [points[s : s + k].tobytes() for s, k in zip(start.tolist(), length.tolist(), strict=True)]
    of = np.fromiter((index.setdefault(w, len(index)) for w in every), np.int64, len(every))
    return np.unique(of, return_index=True)[1], of


class ByteEncoder:
    """Ids of matches by the ranks of a file, in a DuckDB of the worker's own."""

    def __init__(self, path: str, limit: int = 600_000):
        import duckdb

        self.ranks, self.limit = read_ranks(path), limit
        self.classes = _classes()
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("every byte needs a rank")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        # Bytes are kept as the characters U+0000 to U+00FF.
        self._rows("known", {"piece": pa.array([p.decode("latin-1") for p in self.ranks]), "id": pa.array(list(self.ranks.values()), pa.int32())})
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM known")
        self.db.execute("""CREATE TABLE merges AS WITH cut AS (SELECT piece, id, unnest(range(1, length(piece))) AS k FROM vocab WHERE length(piece) > 1)
            SELECT a.id AS left_id, b.id AS right_id, c.id FROM cut c JOIN vocab a ON a.piece = c.piece[:c.k] JOIN vocab b ON b.piece = c.piece[c.k + 1:]""")
        # Merges that come before one of their own parts.
        self.db.execute("CREATE TABLE lower AS SELECT * FROM merges WHERE id < greatest(left_id, right_id)")
        self._forget()

    def _rows(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _merged(self, words: list[bytes], step: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        n = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), n)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        self._rows("tokens", {"key": word << 32 | pos, "id": self.bytes[np.frombuffer(b"".join(words), np.uint8)]})
        found = self.db.execute(_ENCODE.format(step)).fetchnumpy()
        return np.asarray(found["id"], np.int32), np.bincount(found["word"], minlength=len(words))

    def _learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new words. A word that is a piece of the vocabulary
        is its id."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = len(self.ids)
        order, ids, counts = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]], [np.ones((whole >= 0).sum(), np.int64)]
        for own, step in (((whole < 0) & (size < _LONG), _SHORT_STEP), ((whole < 0) & (size >= _LONG), _LONG_STEP)):
            own = np.flatnonzero(own)
            total = np.cumsum(size[own])
            done = 0
            while done < len(own):
                end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _ROWS, "right")))
                found = self._merged([words[i] for i in own[done:end].tolist()], step)
                order.append(own[done:end])
                ids.append(found[0])
                counts.append(found[1])
                done = end
        order, counts = np.concatenate(order), np.concatenate(counts)
        start, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], count[order] = at + np.cumsum(counts) - counts, counts
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.ids, self.start, self.count = np.concatenate([self.ids, *ids]), np.concatenate([self.start, start]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        chars = np.array([len(t) for t in texts], np.int64)
        if not chars.sum():
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        full = np.flatnonzero(chars)
        first = (np.cumsum(chars) - chars)[full]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = match_starts(points, first, self.classes)
        start = np.flatnonzero(starts)
        length = np.diff(start, append=len(points))
        best, of = _distinct(points, start, length)
        words = [joined[s : s + k].encode() for s, k in zip(start[best].tolist(), length[best].tolist(), strict=True)]
        if len(self.index) > self.limit:
            self._forget()
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        code = np.fromiter((self.index[w] for w in words), np.int64, len(words))[of]
        ids, per_match = ragged(self.ids, self.start[code], self.count[code])
        edges = np.concatenate([[0], np.cumsum(per_match)])
        counts = np.zeros(len(texts), np.int64)
        counts[full] = np.diff(edges[np.append(np.searchsorted(start, first), len(start))])
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text of ``counts`` ids."""
        out = [b""] * len(counts)
        at = 0
        edges = np.cumsum(counts)
        while at < len(counts):
            before = int(edges[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(edges, before + 2 * _ROWS, "right")))
            own = ids[before : int(edges[end - 1])]
            doc = np.repeat(np.arange(at, end, dtype=np.int32), counts[at:end])
            self._rows("tokens", {"doc": doc, "pos": np.arange(len(own), dtype=np.int32), "id": own})
            found = self.db.sql(_DECODE).to_arrow_table()
            if not all(found.column("known").to_pylist()):
                raise ValueError("an id is not in the vocabulary")
            for d, text in zip(found.column("doc").to_pylist(), found.column("piece").to_pylist(), strict=True):
                out[d] = text.encode("latin-1")
            at = end
        return out


def worker_encoder(path: str) -> ByteEncoder:
    """The Python worker's own encoder, kept from task to task."""
    kept = sys.modules.setdefault("_evoka_worker", types.ModuleType("_evoka_worker"))
    held = getattr(kept, "byte_encoders", None)
    if held is None:
        held = kept.byte_encoders = {}
    if path not in held:
        held[path] = ByteEncoder(path)
    return held[path]


def _blocks(batches, size, limit: int):
    """Slices of the batches whose rows reach ``limit`` in all."""
    for batch in batches:
        sizes = np.cumsum(size(batch))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit)) + 1
            yield batch.slice(at, min(end, batch.num_rows) - at)
            at = end


def _lengths(column) -> np.ndarray:
    """Bytes of each text or items of each list; null has none."""
    column = combined(column)
    count = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return count(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(batches, encoder: ByteEncoder, block_bytes: int):
    """(ids of rows, ids, counts) of blocks of texts."""
    for part in _blocks(batches, lambda b: _lengths(b.column(1)), block_bytes):
        yield part.column(0), *encoder.encode([t or "" for t in part.column(1).to_pylist()])


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the ids of its whole text, no
    special tokens. Null texts count as empty and have none; null and repeated
    ids are rows of their own; other columns are ignored; an empty table gives an
    empty result. ``block_bytes`` bounds the texts that a task takes at once, beyond a
    single text."""

    def run(batches):
        for doc_ids, ids, counts in _encoded(batches, worker_encoder(ranks_path), block_bytes):
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", block_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, data binary): the pieces of each row's ids in order of position.
    A null or empty list decodes to no bytes; null or unknown ids fail the job.
    Other columns are ignored."""

    def run(batches):
        encoder = worker_encoder(ranks_path)
        for part in _blocks(batches, lambda b: _lengths(b.column(1)), block_ids):
            ids = part.column(1).flatten()
            if ids.null_count:
                raise ValueError("null among the ids")
            data = encoder.decode(ids.to_numpy(zero_copy_only=False).astype(np.int32), _lengths(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of its
    ids, as little-endian unsigned 32-bit integers, and of what decoding makes of
    them, both in the task that has the text. Rows are treated as in
    ``encode_documents``."""

    def run(batches):
        encoder = worker_encoder(ranks_path)
        for doc_ids, ids, counts in _encoded(batches, encoder, block_bytes):
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            data = memoryview(ids.astype("<u4").tobytes())
            digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]
            decoded = [hashlib.sha256(x).hexdigest() for x in encoder.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
