"""Digits of fixed-width byte windows, in numpy, for the radix passes of suffix_dedup.

The windows of a text are ordered by a fixed permutation of their bytes: first the smallest block of ``block``
bytes inside the window (by hash, leftmost on ties), then its place, then the rest. The first digit of such an order
is shared by up to ``width - block + 1`` neighbouring windows, so a run of windows needs one record, not one each.
"""

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240607)
#: Random 64-bit values of the byte values, and odd bases, of two independent polynomial hashes modulo 2**64.
_VALUES = _RNG.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_BASES = [int(x) | 5 for x in _RNG.integers(2**60, 2**63, size=2)]
_INVERSES = [pow(b, -1, 2**64) for b in _BASES]
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 19), base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.cumprod(a)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _C1
    h = (h ^ (h >> _S)) * _C2
    return h ^ (h >> _S)


class Hashes:
    """Hashes of all substrings of a buffer by prefix sums."""

    def __init__(self, buf: np.ndarray, which: int):
        n = len(buf)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[which][buf] * _power(_BASES[which], n), out=self.prefix[1:])
        self.inverse = _power(_INVERSES[which], n + 1)

    def of(self, starts, ends) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]

    def all(self, length: int) -> np.ndarray:
        m = max(0, len(self.prefix) - length)
        return (self.prefix[length:] - self.prefix[:m]) * self.inverse[:m]


@dataclass
class Runs:
    """Runs of windows with one first digit: window starts first..first+count-1 (in the buffer)."""

    first: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    digest: np.ndarray
    anchor: np.ndarray
    rest: Hashes

    def only(self, kept: np.ndarray) -> "Runs":
        return Runs(self.first[kept], self.count[kept], self.lead[kept], self.digest[kept], self.anchor[kept], self.rest)


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return a if span == w else np.minimum(a[: len(a) - (w - span)], a[w - span :])


def window_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, block: int) -> Runs:
    """The runs of all windows of ``width`` bytes inside the texts buf[starts[i]:ends[i]] (ascending, disjoint)."""
    none = np.zeros(0, np.int64)
    rest = Hashes(buf, 1)
    long = ends - starts >= width
    if not long.any():
        u = np.zeros(0, np.uint64)
        return Runs(none, none, u, u, none, rest)
    lead = _mixed(Hashes(buf, 0).all(block))
    key = (lead & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(lead), dtype=np.uint64)
    anchor = (_sliding_min(key, width - block + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[starts[long]] += 1
    edge[ends[long] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    own = anchor[at]
    opens = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    count = np.diff(np.append(opens, len(at)))
    first, own = at[opens], own[opens]
    digest = rest.of(first, first + count - 1 + width)
    digest = _mixed(digest ^ ((own - first).astype(np.uint64) * _C1) ^ (count.astype(np.uint64) * _C2))
    return Runs(first, count, lead[own], digest, own, rest)


def window_hashes(runs: Runs, i: int, width: int) -> np.ndarray:
    """One 64-bit digest for each window of run i; it covers the whole window and the place of its first digit."""
    s = np.arange(runs.first[i], runs.first[i] + runs.count[i])
    return _mixed(runs.rest.of(s, s + width) ^ ((runs.anchor[i] - s).astype(np.uint64) * _C2))
