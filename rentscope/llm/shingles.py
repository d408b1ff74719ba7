"""Hashed words and word shingles of whole Arrow batches, in numpy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time (a longer text is hashed alone).
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 0x20 or 9 <= c <= 13 for c in range(256)])
_BYTE = np.where(_SPACE, U(0), stream(256, 1)[_LOWER])
_POWER = [np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, U))]


def _powers(n: int) -> np.ndarray:
    while len(_POWER[0]) < n:
        _POWER[0] = np.cumprod(np.full(2 * len(_POWER[0]), 0xD6E8FEB86659FD93, U))
    return _POWER[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64)
    space = _SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = ~space & (border[:-1] | np.r_[True, space[:-1]])
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty(0, U), np.empty(0, np.int64)
    inside = np.arange(len(data), dtype=np.int64)
    inside[at[0]:] -= np.repeat(at, np.diff(np.r_[at, len(data)]))
    inside[space] = 0
    inside[:at[0]] = 0
    h = mix(np.add.reduceat(_BYTE[data] * _powers(int(inside.max()) + 1)[inside], at))
    return h, np.searchsorted(offsets, at, "right") - 1


def shingle_sets(column: pa.Array, n: int = 4) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles (a shorter text: of its
    whole word sequence); empty for null or for no words."""
    col = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    weights = stream(n, 2)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(col):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
            part = offsets[a:z + 1]
            h, text = _words(data[part[0]:part[-1]], part - part[0])
            every = np.zeros(max(0, len(h) - n + 1), U)
            for k in range(n):
                every += h[k:len(h) - n + 1 + k] * weights[k] if len(every) else U(0)
            every = mix(every)
            first = np.searchsorted(text, np.arange(z - a + 1))
            for i in range(z - a):
                lo, hi = int(first[i]), int(first[i + 1])
                if hi - lo >= n:
                    yield np.unique(every[lo:hi - n + 1])
                elif hi > lo:
                    yield mix(np.array([(h[lo:hi] * weights[:hi - lo]).sum() + U(hi - lo)], U))
                else:
                    yield np.empty(0, U)
            a = z
