"""Elias-Fano sequences: sorted integers in about two bits each beyond the logarithm of their mean distance.

A value's low bits are packed; its high bits are in unary, one set bit for each value and a clear one after each bucket of
equal high bits. A directory holds the set bits before each 64-bit word. All look-ups take arrays and work on the arrays
as they lie in a file.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FF, _ONES = _U(0xFF), _U(0x0101010101010101)
#: Position of the r-th set bit of a byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint64)


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit of each word."""
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    ends = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte k: set bits up to and with byte k
    byte = np.zeros(len(x), np.uint64)
    for k in range(7):
        byte += ((ends >> _U(8 * k)) & _FF) <= r
    before = ((ends << _U(8)) >> (byte * _U(8))) & _FF
    return byte * _U(8) + _SELECT[((x >> (byte * _U(8))) & _FF).astype(np.int64), (r - before).astype(np.int64)]


class EliasFano:
    """n values below universe, from three arrays of 64-bit words: low bits, high bits, directory."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, ahead: np.ndarray):
        self.n, self.l = n, low_bits(n, universe)
        self.low, self.high, self.ahead = low, high, ahead
        self.clear = np.arange(len(ahead), dtype=np.int64) * 64 - ahead.astype(np.int64)  # clear bits before each word

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        b = low_bits(n, universe)
        low = np.zeros((n * b + 63) // 64 + 1, np.uint64)
        if b:
            part = values & _U((1 << b) - 1)
            at = np.arange(n, dtype=np.int64) * b
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + b > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        size = n + (universe >> b) + 1
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[(values >> _U(b)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.uint64)
        return [low, high, np.cumsum(counts) - counts]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | upper) & _U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ahead, i.astype(np.uint64), side="right") - 1
        at = word * 64 + _select_in_word(self.high[word], i.astype(np.uint64) - self.ahead[word]).astype(np.int64)
        return ((at - i).astype(np.uint64) << _U(self.l)) | self._low(i)

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((at - i).astype(np.uint64) << _U(self.l)) | self._low(i)

    def _clear_bit(self, j: np.ndarray) -> np.ndarray:
        """Position of the j-th clear bit, which ends bucket j."""
        word = np.searchsorted(self.clear, j, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], (j - self.clear[word]).astype(np.uint64)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values x, or -1: the successor within x's bucket, if it is x itself.

        A bucket mostly holds a value or two and is read in turn; in one that holds more the rest is searched by halves.
        """
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        h = (x >> _U(self.l)).astype(np.int64)
        want = x & _U((1 << self.l) - 1)
        i = np.zeros(len(x), np.int64)
        later = h > 0
        i[later] = self._clear_bit(h[later] - 1) - (h[later] - 1)
        left = np.arange(len(x))
        for _ in range(6):
            if not len(left):
                return out
            k = i[left]
            bit = k + h[left]
            inside = ((self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) & _U(1)).astype(bool)
            left, k = left[inside], k[inside]
            low = self._low(k)
            hit = low == want[left]
            out[left[hit]] = k[hit]
            left = left[low < want[left]]
            i[left] += 1
        if len(left):
            a, b, w = i[left], self._clear_bit(h[left]) - h[left], want[left]
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                less = open_ & (self._low(np.minimum(middle, self.n - 1)) < w)
                a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
            end = self._clear_bit(h[left]) - h[left]
            hit = (a < end) & (self._low(np.minimum(a, self.n - 1)) == w)
            out[left[hit]] = a[hit]
        return out


def low_bits(n: int, universe: int) -> int:
    return max(0, min(57, (universe // max(n, 1)).bit_length() - 1))


def pack(parts: list[np.ndarray]) -> tuple[bytes, list[int]]:
    """Arrays of 64-bit words one after another, and where each ends."""
    return b"".join(p.astype("<u8").tobytes() for p in parts), np.cumsum([len(p) for p in parts]).tolist()


def unpack(words: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    return [np.asarray(words[a:b]) for a, b in zip([0, *ends], ends)]
