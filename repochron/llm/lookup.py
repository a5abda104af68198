"""A read-only table from 64-bit keys to numbers, for many lookups at once inside tasks."""

from __future__ import annotations

import numpy as np

from repochron.llm.words import mixed


class Lookup:
    """Keys in buckets of their mixed hash; a lookup compares the few keys of one bucket."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        spread = mixed(keys.astype(np.uint64))
        order = np.argsort(spread)
        self.keys, self.values = keys.astype(np.uint64)[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        bucket = (spread[order] >> self.shift).astype(np.int64)
        self.first = np.searchsorted(bucket, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in ``keys``/``values``, or -1."""
        bucket = (mixed(keys) >> self.shift).astype(np.int64)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1].astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.keys[here] == keys[left]
            out[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out
