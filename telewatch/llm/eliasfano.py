"""Elias-Fano lists: sorted integers in about 2 + log2(universe / n) bits each, searched without unpacking them."""

from __future__ import annotations

import numpy as np

WIDEST = 56  # low bits of a value
STEPS = 4  # values of a bucket that are looked at one after the other


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a list of increasing uint64 `values`, all below `universe`."""
    n = len(values)
    low = min(WIDEST, max(0, (universe // max(n, 1)).bit_length() - 1))
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + ((universe - 1) >> low) + 1
    bits = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1  # a one per value; a zero ends each bucket of equal high bits
    bits[size:] = 1
    upper = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64)))).astype(np.uint32)
    packed = np.zeros((-(-n * low // 64) + 2) * 8, np.uint8)
    for at in range(0, n, 1 << 16):  # 65,536 values fill whole bytes
        some = values[at:at + (1 << 16)]
        flat = ((some[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        got = np.packbits(flat, bitorder="little")
        packed[at * low // 8:at * low // 8 + len(got)] = got
    return {"upper": upper, "zeros": zeros, "packed": packed.view("<u8"), "meta": np.array([n, low, (universe - 1) >> low], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low, self.last = (int(x) for x in arrays["meta"])
        self.upper, self.zeros, self.packed = arrays["upper"], arrays["zeros"], arrays["packed"]
        self.mask = np.uint64((1 << self.low) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero with k zeros before it."""
        word = np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1
        rest, w = k - self.zeros[word], ~self.upper[word]
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = w & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            on = rest >= count
            rest, at, w = rest - count * on, at + width * on, np.where(on, w >> np.uint64(width), low)
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each of `x` (uint64) in the list, -1 where it is not there."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> np.uint64(self.low)).astype(np.int64)
        beyond = h > self.last
        if beyond.any():
            out[~beyond] = self.find(x[~beyond])
            return out
        bit = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1, 0)
        j, want, open_ = bit - h, x & self.mask, np.arange(len(x))
        for _ in range(STEPS):  # the successor of x is in its bucket, of which the list has one value in the mean
            inside = (self.upper[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            inside &= j < self.n
            bit, j, want, open_ = bit[inside], j[inside], want[inside], open_[inside]
            got = self._low(j)
            hit = got == want
            out[open_[hit]] = j[hit]
            on = got < want
            bit, j, want, open_ = bit[on] + 1, j[on] + 1, want[on], open_[on]
            if not len(open_):
                return out
        upto = np.minimum(self._zero(h[open_]) - h[open_], self.n)  # where the bucket ends; a crowded one is halved
        while True:
            on = j < upto
            j, upto, want, open_ = j[on], upto[on], want[on], open_[on]
            if not len(open_):
                return out
            middle = (j + upto) >> 1
            got = self._low(middle)
            hit, less = got == want, got < want
            out[open_[hit]] = middle[hit]
            j, upto = np.where(less, middle + 1, j), np.where(less, upto, np.where(hit, j, middle))

    def _low(self, j: np.ndarray) -> np.ndarray:
        """The low bits of the values at the places `j`."""
        pos = j * self.low
        word, shift = pos >> 6, (pos & 63).astype(np.uint64)
        return (self.packed[word] >> shift | self.packed[word + 1] << np.uint64(1) << (np.uint64(63) - shift)) & self.mask
