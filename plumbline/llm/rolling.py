"""Rolling hashes and window minima over arrays, for the substring operators."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
NONE = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0..n-1 modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        _powers[base] = have = out
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i, from 0, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of values[start:stop], the same wherever the values stand."""
    return mixed((sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start])


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(sums) - k
    return mixed((sums[k:] - sums[:-k]) * powers(INVERSE, len(sums))[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over a[i:i+w] for every i that has w values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        a = op(a[:-step], a[step:]) if len(a) > step else a[:0]
        have += step
    return a


def anchors(h: np.ndarray, w: int, whole: np.ndarray) -> np.ndarray:
    """Positions of h that are a least value of some window of w hashes.

    whole[i]: window i (len(h) - w + 1 of them) lies within one document.  Which positions of a
    window are chosen depends on the window's hashes alone, so equal windows choose alike.  A hash of 0
    counts as 1, as 0 marks windows that aren't whole.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    h = np.maximum(h, np.uint64(1))
    least = np.where(whole, _slide(h, w, np.minimum), np.uint64(0))
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    most = _slide(padded, w, np.maximum)  # over the windows that hold each position
    return np.flatnonzero(most == h)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + size) for some s in starts."""
    edge = np.zeros(n + size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0
