"""Vectorised word and shingle hashing on Arrow text columns (numpy, inside tasks).

A chunk of texts is one UTF-8 byte array with document offsets.  Words are
maximal runs of bytes other than space and \\x09-\\x0D; A-Z are lower-cased.
Every word gets a 64-bit hash from prefix sums of a polynomial over its bytes
(one pass for the whole chunk, no Python loop per word); shingles combine the
hashes of ``k`` consecutive words of one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COEF = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES * 2
    while size < n + 1:
        size *= 2
    if size not in _powers:
        _powers.clear()
        p, q = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        p[0] = q[0] = 1
        _powers[size] = (np.cumprod(p), np.cumprod(q))
    return _powers[size]


@dataclass
class Words:
    """Words of a chunk of documents.

    ``first[d] : first[d + 1]`` are the words of document ``d``; ``start`` and
    ``end`` are byte positions in ``data`` (lower-cased bytes of the chunk).
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes in each [start, end)."""
        inv = _power_table(len(self.data))[1]
        h = (self.prefix[end] - self.prefix[start]) * inv[start]
        return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    """``data``: UTF-8 bytes of all documents, ``offsets``: n + 1 positions in it.

    ``separators``: 256 flags of the bytes that end a word.
    """
    n = len(data)
    low = _LOWER[data]
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~separators[data]
    # a document boundary ends a word even without white space
    edge = np.diff(word)
    begins, ends = edge[:-1] == 1, edge[1:] == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    inside = cut[(word[cut] == 1) & (word[cut + 1] == 1)]
    begins[inside] = True
    ends[inside - 1] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    powers = _power_table(n)[0]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:n], out=prefix[1:])
    return Words(low, offsets, start, end, first, prefix)


def shingles_of(w: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every document and their n + 1 offsets.

    A document with fewer than ``k`` words (but at least one) has one shingle,
    its whole word sequence.  Order follows the text; repeats stay.
    """
    counts = np.diff(first)
    n_sh = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offs = np.concatenate(([0], np.cumsum(n_sh)))
    out = np.empty(offs[-1], np.uint64)
    if len(w) >= k:
        acc = w[: len(w) - k + 1] * _COEF[0]
        for j in range(1, k):
            acc = acc + w[j : len(w) - k + 1 + j] * _COEF[j]
        ok = np.zeros(len(acc), bool)
        long_docs = np.flatnonzero(counts >= k)
        span = counts[long_docs] - k + 1
        idx = np.repeat(first[long_docs] - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
        ok[idx] = True
        place = np.repeat(offs[long_docs] - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
        out[place] = mix64(acc[idx])
    for length in range(1, min(k, int(counts.max(initial=0)) + 1)):
        docs = np.flatnonzero(counts == length)
        if len(docs):
            acc = np.full(len(docs), length * 0xA24BAED4963EE407 % (1 << 64), np.uint64)
            for j in range(length):
                acc = acc + w[first[docs] + j] * _COEF[j]
            out[offs[docs]] = mix64(acc)
    return out, offs


def text_chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of about ``CHUNK_BYTES``; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string()).fill_null("")
    _, off, dat = arr.buffers()
    n = len(arr)
    if n == 0:
        return
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, "right"))
        j = min(max(j - 1, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def split_words(text: str | None) -> list[str]:
    """Lower-cased words of one text (plain helper, the definition the kernel follows)."""
    return [] if text is None else [x.decode() for x in text.encode().lower().split()]
