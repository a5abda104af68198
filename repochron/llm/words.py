"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

The texts of a batch are cut into runs of about ``CHUNK_BYTES`` (a longer text is a run of
its own), so memory follows the run and not the batch.  A word is a maximal run of bytes of
a byte class; both classes in use hold every byte of a multi-byte character or none of it,
so byte runs and character runs are the same.  Words get 64-bit polynomial hashes; where a
hash is only a candidate the callers compare the words themselves afterwards, elsewhere the
chance of a collision is that of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

#: words of ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, taken after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 0x20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * _ORDER[0]
    h ^= h >> np.uint64(27)
    h = h * _ORDER[1]
    return h ^ (h >> np.uint64(31))


@dataclass
class Run:
    """Some texts of a batch; ``rows`` are their positions in it, ``bounds`` their byte offsets in ``data``."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a byte-aligned array in every text."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def prefix_hash(self, table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((table[self.data].astype(np.uint64) + np.uint64(1)) * powers(len(self.data))[0], out=total[1:])
        return total

    def span_hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.data) + 1)[1]
        return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a run: text number, byte span, hash; ``first[i]:first[i + 1]`` are those of text i."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> np.ndarray:
        """Numbers of the words that begin ``k`` consecutive words of one text."""
        n = len(self.text) - k + 1
        return np.flatnonzero(self.text[:n] == self.text[k - 1:]) if n > 0 else np.zeros(0, np.int64)

    def window_hash(self, begin: np.ndarray, k: int) -> np.ndarray:
        """Hash of ``k`` consecutive words from each of ``begin``."""
        h = np.zeros(len(begin), np.uint64)
        for j in range(k):
            h = mixed(h * _ORDER[2] + self.hash[begin + j] * _ORDER[3]) if j else self.hash[begin] * _ORDER[4]
        return h


def runs(column: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[Run]:
    """The texts of an Arrow string column in order, about ``chunk`` bytes at a time; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + chunk, "right")) - 1)
        yield Run(slice(i, j), data[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j


def split_words(run: Run, inside: np.ndarray, table: np.ndarray) -> Words:
    """Words of a run, hashed after each byte went through ``table``."""
    mask = inside[run.data]
    n = len(mask)
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1]
    closes[:-1] &= ~mask[1:]
    edges = run.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    opens[edges] = mask[edges]
    closes[edges - 1] = mask[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, run.bounds)
    text = np.repeat(np.arange(len(run.bounds) - 1), np.diff(first))
    return Words(text, start, end, run.span_hash(run.prefix_hash(table), start, end), first)


def text_number(length: int, first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:length]
