"""Elias-Fano coding of ascending 64-bit keys, with vectorised search.

Of n keys below u, the low l = log2(u / n) bits of each are stored as they are
and the high parts as one bit vector, a 1 per key and a 0 per bucket (value of
the high part): about 2 + l bits per key. A key's bucket is found by selecting
zeros, then the key by a successor search among the bucket's low parts. The
arrays are .npy files and may be memory-mapped.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

_U = np.uint64
# position of the r-th set bit of a byte
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _r, _at in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _r] = _at


def encode(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the code; keys are strictly ascending uint64."""
    n = len(keys)
    if not n:
        return {"meta": np.zeros(4, dtype=np.uint64), "low": np.zeros(1, dtype=np.uint64), "high": np.zeros(1, dtype=np.uint64), "zeros": np.zeros(1, dtype=np.uint64)}
    own = keys - keys[0]
    bits = max(0, (int(own[-1]) // n).bit_length() - 1)
    buckets = (int(own[-1]) >> bits) + 1
    high = np.zeros((n + buckets + 63) // 64 * 64, dtype=np.uint8)
    high[(own >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
    words = np.packbits(high, bitorder="little").view(np.uint64)
    zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(words).astype(np.int64))][:-1].astype(np.uint64)
    low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
    if bits:
        part = own & _U((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        np.bitwise_or.at(low, word, part << shift)
        over = shift + _U(bits) > _U(64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
    return {"meta": np.array([n, bits, int(keys[0]), int(keys[-1])], dtype=np.uint64), "low": low, "high": words, "zeros": zeros}


def write(arrays: dict[str, np.ndarray], path: str) -> None:
    """Each array to `path`.name.npy; a file appears whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for name, array in arrays.items():
        own = f"{path}.{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, array)
        os.replace(own, f"{path}.{name}.npy")


def read(path: str, name: str) -> np.ndarray:
    return np.load(f"{path}.{name}.npy", mmap_mode="r")


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        n, bits, self.first, self.last = (int(x) for x in arrays["meta"])
        self.n, self.bits = n, bits
        self._low, self._high, self._zeros = arrays["low"], arrays["high"], arrays["zeros"]

    @classmethod
    def open(cls, path: str) -> EliasFano:
        return cls({name: read(path, name) for name in ("meta", "low", "high", "zeros")})

    def _low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self._low[word] >> shift
        over = np.flatnonzero(shift + _U(self.bits) > _U(64))
        value[over] |= self._low[word[over] + 1] << (_U(64) - shift[over])
        return value & _U((1 << self.bits) - 1)

    def _select_zero(self, j: np.ndarray) -> np.ndarray:
        """Position of the j-th zero (from 0) of the high bits."""
        word = np.searchsorted(self._zeros, j.astype(np.uint64), side="right") - 1
        rest = (j - self._zeros[word].astype(np.int64)).astype(np.uint8)
        octets = (~self._high[word]).reshape(-1, 1).view(np.uint8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        k = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(j))
        rest = rest - np.where(k > 0, upto[row, np.maximum(k - 1, 0)], 0).astype(np.uint8)
        return word * 64 + k * 8 + _SELECT[octets[row, k], rest]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not stored."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not self.n:
            return out
        inside = np.flatnonzero((keys >= _U(self.first)) & (keys <= _U(self.last)))
        own = keys[inside] - _U(self.first)
        bucket = (own >> _U(self.bits)).astype(np.int64)
        low = own & _U((1 << self.bits) - 1)
        end = self._select_zero(bucket) - bucket
        start = np.zeros(len(bucket), dtype=np.int64)
        later = np.flatnonzero(bucket > 0)
        start[later] = self._select_zero(bucket[later] - 1) - (bucket[later] - 1)
        left, right = start, end.copy()
        active = np.flatnonzero(left < right)
        while len(active):  # successor search within the bucket
            middle = (left[active] + right[active]) // 2
            less = self._low_part(middle) < low[active]
            left[active] = np.where(less, middle + 1, left[active])
            right[active] = np.where(less, right[active], middle)
            active = active[left[active] < right[active]]
        at = np.flatnonzero(left < end)
        hit = at[self._low_part(left[at]) == low[at]]
        out[inside[hit]] = left[hit]
        return out

    def keys(self) -> np.ndarray:
        """All keys, decoded."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self._high).view(np.uint8), bitorder="little"))[: self.n]
        at = np.arange(self.n)
        return _U(self.first) + (((ones - at).astype(np.uint64) << _U(self.bits)) | self._low_part(at))
