"""Token ids of whole texts by a word-level BPE vocabulary, each distinct word encoded once per worker.

The vocabulary's splitter never joins text across ASCII white space, and its
normaliser treats each side by itself, so a text's ids are the ids of its words in
order.  A worker keeps the ids of words it has met, by a 64-bit hash, and hands
only new ones to the tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from tidemark.llm import kernels as K

VOCABULARY = "word_bpe_49k.json"
#: Distinct keys that a worker remembers; beyond that it starts anew. A matter of speed alone.
REMEMBERED = 1_500_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SpanCache:
    """64-bit keys to short runs of small integers, in sorted arrays: an old run and a recent one, merged as it grows."""

    def __init__(self, dtype=np.uint16):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.runs = [none, none]
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1024, self.dtype)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a new one."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds sorted new keys; values: their runs one after another. Returns their slots."""
        slots = np.arange(len(self.starts), len(self.starts) + len(keys), dtype=np.int32)
        if self.used + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(len(values), self.used), self.dtype)))
        self.flat[self.used : self.used + len(values)] = values
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes.astype(np.int32)))
        self.used += len(values)

        def merge(a, b):
            k, s = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
            order = np.argsort(k, kind="stable")
            return k[order], s[order]

        self.runs[1] = merge(self.runs[1], (keys, slots))
        if len(self.runs[1][0]) > 0.2 * len(self.runs[0][0]):
            self.runs = [merge(*self.runs), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[slots].astype(np.int64)
        return self.flat[K.ragged(self.starts[slots], sizes)], sizes


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache = SpanCache(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def encode(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents of the chunk, and where each document's begin."""
        w = K.split_words(c)
        if not len(w.starts):
            return np.zeros(0, self.cache.dtype), np.zeros(len(c.offsets), np.int64)
        keys, first, inverse = np.unique(K.hash_spans(c.data, w.starts, w.ends), return_index=True, return_inverse=True)
        if len(self.cache.starts) > REMEMBERED:
            self.cache.clear()
        slots = self.cache.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = c.data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)]
            got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            of = np.array(got.word_ids, np.int64) if got.ids else np.zeros(0, np.int64)
            slots[new] = self.cache.add(keys[new], np.array(got.ids, self.cache.dtype), np.bincount(of, minlength=len(words)))
        ids, sizes = self.cache.gather(slots[inverse])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, ends[w.offsets]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and vocabulary."""
    return WordTokenizer(path)
