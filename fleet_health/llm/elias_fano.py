"""Monotone sequences in Elias-Fano form, with access and successor search for many queries at once.

A value's lower `l` bits are packed one after the other; its upper part is the number of zeros before
the value's one in a bit string. The numbers of ones and of zeros before each word of that string lead
both ways to the word that a value or an upper part is in, whatever the values' distribution. All
parts are flat arrays of 64-bit words and may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class EliasFano:
    """Parts: header (n, l, bits), lower words, upper words, ones and zeros before each upper word."""

    def __init__(self, words: np.ndarray):
        n, low, bits, a, b, c, d = (int(x) for x in words[:7])
        self.n, self.l, self.bits = n, low, bits
        cuts = np.cumsum([7, a, b, c, d])
        self.lower, self.upper, self.one, self.zero = (
            words[x:y] for x, y in zip(cuts, cuts[1:]))

    @staticmethod
    def build(values: np.ndarray) -> np.ndarray:
        """The words of a non-decreasing sequence."""
        values = np.asarray(values, U64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> U64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
        at = high + np.arange(n)
        bits = (int(high[-1]) if n else 0) + n + 1
        upper = np.zeros(-(-bits // 64) + 1, U64)
        np.bitwise_or.at(upper, at >> 6, U64(1) << (at & 63).astype(U64))
        lower = np.zeros(n * low // 64 + 2, U64)
        if low:
            part = values & U64((1 << low) - 1)
            place = np.arange(n, dtype=np.int64) * low
            word, shift = place >> 6, (place & 63).astype(U64)
            np.bitwise_or.at(lower, word, part << shift)
            over = (place & 63) + low > 64
            np.bitwise_or.at(lower, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        counts = np.bitwise_count(upper).astype(U64)
        one = np.cumsum(counts, dtype=U64) - counts
        zero = np.arange(len(upper), dtype=U64) * U64(64) - one
        head = np.array([n, low, bits, len(lower), len(upper), len(one), len(zero)], U64)
        return np.concatenate([head, lower, upper, one, zero])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of the upper part."""
        before, k = self.one if ones else self.zero, k.astype(U64)
        word = np.searchsorted(before, k, "right") - 1
        bits = self.upper[word]
        return (word << 6) + _nth(bits if ones else ~bits, k - before[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        place = i * self.l
        word, shift = place >> 6, (place & 63).astype(U64)
        out = self.lower[word] >> shift
        more = self.lower[word + 1] << ((U64(64) - shift) & U64(63))
        out = np.where(shift > 0, out | more, out)
        return out & U64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, True) - i
        return high.astype(U64) << U64(self.l) | self._low(i)

    def _bucket(self, high: np.ndarray):
        """The places (begin, end) of the values with these upper parts, none above the largest."""
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        word, shift = at >> 6, (at & 63).astype(U64)
        bits = self.upper[word] >> shift
        more = self.upper[word + 1] << ((U64(64) - shift) & U64(63))
        bits = np.where(shift > 0, bits | more, bits)
        size = np.bitwise_count(bits & ~(bits + U64(1))).astype(np.int64)  # the ones before the first zero
        long = np.flatnonzero(size == 64)
        begin, end = at - high, at - high + size
        if len(long):
            end[long] = self._select(high[long], False) - high[long]
        return begin, end

    def _within(self, x, first, last):
        """Which of `x` have an upper part that may occur, and the place of the first of its bucket's
        values, of those between the bounds, that is not below it, and where those values end."""
        high = (x >> U64(self.l)).astype(np.int64)
        inside = np.flatnonzero(high <= self.bits - 1 - self.n)
        first, last = first[inside], last[inside]
        begin, end = (np.clip(p, first, last) for p in self._bucket(high[inside]))
        low = x[inside] & U64((1 << self.l) - 1)
        place, todo = begin, np.flatnonzero(begin < end)
        a, b, want = begin[todo], end[todo], low[todo]
        while len(todo):  # halves the values that share the upper part
            middle = (a + b) >> 1
            below = self._low(middle) < want
            a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
            place[todo] = a
            left = np.flatnonzero(a < b)
            todo, a, b, want = todo[left], a[left], b[left], want[left]
        return inside, place, end, low

    def _bounds(self, x, first, last):
        x = np.asarray(x, U64)
        return x, *(np.broadcast_to(np.asarray(p, np.int64), x.shape)
                    for p in (first, self.n if last is None else last))

    def successor(self, x: np.ndarray, first=0, last=None) -> np.ndarray:
        """The place of the first value that is not below x among places `first` to `last` (exclusive;
        numbers, or one for each x); `last` where there is none. `last` is n if not given."""
        x, first, last = self._bounds(x, first, last)
        out = last.copy()
        if self.n:
            inside, place, _, _ = self._within(x, first, last)
            out[inside] = place
        return out

    def find(self, x: np.ndarray, first=0, last=None) -> np.ndarray:
        """The place of each value among places `first` to `last`, -1 where it is not there."""
        x, first, last = self._bounds(x, first, last)
        out = np.full(len(x), -1)
        if self.n:
            inside, place, end, low = self._within(x, first, last)
            here = np.flatnonzero(place < end)  # of the same upper part
            here = here[self._low(place[here]) == low[here]]
            out[inside[here]] = place[here]
        return out


_TIMES = U64(0x0101010101010101)
_TOPS = U64(0x8080808080808080)
#: The position of the n-th one in each byte.
_IN_BYTE = np.zeros((256, 8), np.int64)
for _n in range(8):
    for _byte in range(256):
        _at = [i for i in range(8) if _byte >> i & 1]
        _IN_BYTE[_byte, _n] = _at[_n] if _n < len(_at) else 0


def _nth(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The position of the n-th (from 0) one inside each word, by sums over its bytes."""
    sums = bits - (bits >> U64(1) & U64(0x5555555555555555))
    sums = (sums & U64(0x3333333333333333)) + (sums >> U64(2) & U64(0x3333333333333333))
    sums = (sums + (sums >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * _TIMES  # ones up to each byte
    byte = np.bitwise_count(((n * _TIMES | _TOPS) - sums) & _TOPS).astype(U64)  # bytes wholly before it
    shift = byte * U64(8)
    before = np.where(shift > 0, sums >> (shift - U64(8) & U64(63)) & U64(255), U64(0))
    return shift.astype(np.int64) + _IN_BYTE[(bits >> shift & U64(255)).astype(np.int64), (n - before).astype(np.int64)]
