"""Word-wise encoding with a tokenizer whose words never join across white
space, so that a text's ids are its words' ids one after another."""

from __future__ import annotations

import sys
import types

import numpy as np

#: Words encoded in one call of the library, to share the cost of the call.
_CALL = 512


#: Marks that may end a word; split off where the tokenizer does so too.
_TAILS = b".,;:!?"


class _Index(dict):
    """Word -> code in order of first sight; ``new`` holds words not yet encoded."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordEncoder:
    """Ids of words, each encoded once while it is remembered.

    Conditions on the tokenizer: no word joins across white space, normalising
    and splitting a word don't depend on its neighbours, and if case is folded or
    trailing marks are split for the tried words, they are for all. The packed and
    the digest queries are tested against the library on whole tables.

    Words get codes in order of first sight; ``flat`` holds the ids of all
    words, those of code c at ``start[c]`` to ``start[c] + length[c]``. At
    ``limit`` words the memory starts anew, between two calls of ``codes``."""

    def __init__(self, tokenizer_path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(tokenizer_path)
        t.no_truncation()
        t.no_padding()
        self.limit = limit
        specials = [x for x in t.get_added_tokens_decoder().items() if x[1].special and not (x[1].lstrip or x[1].rstrip or x[1].single_word)]
        #: A special token between words splits them for the library.
        self.mark_id, self.mark = (specials[-1][0], specials[-1][1].content) if specials else (None, None)
        # What the tokenizer does with words, tried out.
        ids = lambda *w: [i for x in w for i in t.encode(x, add_special_tokens=False).ids]
        self.splits = all(ids(x + m) == ids(x, m) for x in ("a", "7", "Ab") for m in (*_TAILS.decode(), "...", "?!"))
        self.lowers = all(ids(w.upper()) == ids(w) for w in ("a", "the", "qxz", "abc1"))
        suffix = getattr(t.model, "end_of_word_suffix", None)
        #: Whether an id ends a piece of text, if every piece's end can be told.
        self.ends = np.array([(t.id_to_token(i) or "").endswith(suffix) for i in range(t.get_vocab_size())]) if suffix else None
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.n_words = self.n_ids = 0

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        parts: dict[bytes, int] = {b"": 0}
        place = np.zeros((len(words), 2), np.int64)
        for k, word in enumerate(words):
            core, tail = word, b""
            if self.splits and word[-1] in _TAILS:
                core = word.rstrip(_TAILS)
                if core and core[-1:].isalnum():
                    tail = word[len(core) :]
                else:
                    core = word
            if self.lowers and core.isascii() and b"<" not in core:
                core = core.lower()
            place[k, 0] = parts.setdefault(core, len(parts))
            if tail:
                place[k, 1] = parts.setdefault(tail, len(parts))
        plain = [p.isascii() and p.isalpha() for p in parts]
        flat, length = [], np.zeros(len(parts), np.int64)
        order: list[int] = []
        for wanted, encode in ((True, self._plain), (False, self._marked)):
            at = [k for k, x in enumerate(plain) if x == wanted and k]
            texts = list(parts)
            for i in range(0, len(at), _CALL):
                some = at[i : i + _CALL]
                ids, n = encode([texts[k].decode("utf-8", "replace") for k in some])
                flat.append(ids)
                length[some] = n
                order += some
        flat = np.concatenate([np.empty(0, np.uint32), *flat])
        start, order = np.zeros(len(parts), np.int64), np.array(order, np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        ids, n = ragged(flat, start[place.ravel()], length[place.ravel()])
        return ids, n.reshape(-1, 2).sum(axis=1)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ASCII letters only: one piece each."""
        if self.ends is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=-1)
        return self._marked(words)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any(self.mark in w for w in words):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found])
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        edges = np.concatenate([[-1], cuts, [len(ids)]])
        return np.delete(ids, cuts), np.diff(edges) - 1

    def codes(self, words: list[bytes]) -> np.ndarray:
        """The code of each word; new words are encoded."""
        if self.n_words > self.limit:
            self._forget()
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._add(*self.encode_words(self.index.new))
            self.index.new = []
        return found

    def _add(self, ids: np.ndarray, length: np.ndarray) -> None:
        n, m = self.n_words + len(length), self.n_ids + len(ids)
        self.start, self.length, self.flat = _room(self.start, n), _room(self.length, n), _room(self.flat, m)
        self.length[self.n_words : n] = length
        self.start[self.n_words : n] = self.n_ids + np.cumsum(length) - length
        self.flat[self.n_ids : m] = ids
        self.n_words, self.n_ids = n, m

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        return ragged(self.flat, self.start[codes], self.length[codes])


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat``, joined, and their lengths."""
    length = length.astype(np.int64)
    total = int(length.sum())
    at = np.repeat(start - (np.cumsum(length) - length), length)
    at += np.arange(total)
    return flat[at], length


def worker_encoder(tokenizer_path: str) -> WordEncoder:
    """The Python worker's own encoder, kept from task to task."""
    kept = sys.modules.setdefault("_evoka_worker", types.ModuleType("_evoka_worker"))
    held = getattr(kept, "encoders", None)
    if held is None:
        held = kept.encoders = {}
    if tokenizer_path not in held:
        held[tokenizer_path] = WordEncoder(tokenizer_path)
    return held[tokenizer_path]
