"""Word hashes and row keys for the duplicate operators.

Words are maximal runs of bytes other than space and 09-0D in the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 2 * n)
        _powers = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE, dtype=np.uint64))))
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word, in order: a polynomial of its bytes, finalised."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    letters = raw[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    value = np.add.reduceat(letters * _power_table(int(lengths.max()))[place], first)
    return mixed(value + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def row_keys(id_: Column, text: Column) -> list[Column]:
    """``k1, k2``: 128 bits that identify a row's id and text (nulls included)."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(1), text, id_).alias("k2")]
