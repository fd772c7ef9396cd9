"""Words of a batch of texts as integer codes: each distinct word is looked at once."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a pair of 64-bit hashes, order counts."""
    x = (a * MIX) ^ (b + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def coded(lines: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Lists of words -> distinct words, the code of every word in order, the number of words of each list."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    words = list(chain.from_iterable(lines))
    if words and isinstance(words[0], str) and "\0" in "".join(words):  # pandas ends strings at NUL
        distinct = list(dict.fromkeys(words))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        return distinct, np.fromiter(map(place.__getitem__, words), np.int64, len(words)), sizes
    flat = np.empty(len(words), object)
    flat[:] = words
    codes, distinct = pd.factorize(flat)
    return list(distinct), codes, sizes


def slices(texts, limit: int = 1_000_000):
    """Ranges of a batch of about `limit` characters each: what one step holds in memory; a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(texts, limit: int = 1_000_000) -> Iterator[np.ndarray]:
    """Hashes of each text's words in order: A-Z lower-cased, words are runs without ASCII whitespace, null has none.

    Words are held for about `limit` characters at a time; a longer text is read in pieces that end at whitespace.
    """
    for part in slices(texts, limit):
        lines = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[part]]
        pieces, of = [], []
        for i, line in enumerate(lines):
            at = 0
            while len(line) - at > 2 * limit and (cut := _BREAK.search(line, at + limit)):
                pieces.append(line[at : cut.start()])
                of.append(i)
                at = cut.end()
            pieces.append(line[at:])
            of.append(i)
        found: list[list[np.ndarray]] = [[] for _ in lines]
        for some in slices(pieces, limit):
            distinct, codes, sizes = coded([p.split() for p in pieces[some]])
            flat = hashes(distinct, 42)[codes] if distinct else np.zeros(0, np.uint64)
            for i, h in zip(of[some], np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                found[i].append(h)
        for i in range(len(lines)):
            yield np.concatenate(found[i]) if len(found[i]) > 1 else found[i][0]
            found[i] = []


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, one without words has none."""
    for h in word_hashes(texts):
        n = max(len(h) - width + 1, 1)
        out = h[:n]
        for k in range(1, min(width, len(h))):
            out = mix(out, h[k : k + n])
        yield np.unique(out)


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits for its next task holds its caches alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Remembered:
    """Rows computed for words, kept for the next batches of the same worker; at most `limit` words at a time."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.at, self.rows = limit, {}, None

    def get(self, words: list, compute) -> np.ndarray:
        """compute(words) -> one row a word; words are distinct."""
        if len(words) > self.limit // 2:
            return compute(words)
        if len(self.at) + len(words) > self.limit:
            self.at = {}
        known = self.at.get
        at = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            rows = compute(fresh)
            if self.rows is None:
                self.rows = np.zeros((self.limit, *rows.shape[1:]), rows.dtype)
            at[new] = np.arange(len(self.at), len(self.at) + len(new))
            self.rows[at[new]] = rows
            self.at.update(zip(fresh, at[new].tolist(), strict=True))
        return self.rows[at] if len(words) else compute(words)
