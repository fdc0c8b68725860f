"""Vectorised 64-bit fingerprints of byte ranges, words and windows.

No sum is taken over letters, which structured texts can bring to the same value
whatever the base: a fingerprint is a tree of non-linear steps. A range is read
eight bytes a step, each step a bijection of the bytes read, so ranges of eight
bytes or less and one length never share a fingerprint. A window of twice the size
comes from its halves; one of another size from the two largest powers of two that
cover it. Unlike content meets with a chance of 2**-64 a pair. Equal content always
gives equal fingerprints, in every task and at every size; ``seed`` gives an
independent family.
"""

from __future__ import annotations

import hashlib

import numpy as np

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
HALF = np.uint64(32)
#: Ranges over so many bytes are digested one by one.
LONG = 128
#: Positions whose windows are made at once: their arrays stay in the cache.
STEP = 1 << 16
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def random_table(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, np.uint64, endpoint=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of fingerprints (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= M1
    h ^= h >> np.uint64(27)
    h *= M2
    h ^= h >> np.uint64(31)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two parts in order; for one ``a`` a bijection of ``b``."""
    h = a * K1
    h += b
    h ^= h >> HALF
    h *= K2
    return h


def eights(raw: np.ndarray) -> np.ndarray:
    """Of each place the eight bytes from it on as one number, zeros past the end: a view."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))


def ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of the byte ranges [start, end)."""
    n, x = end - start, eights(raw)
    lengths = mix(np.arange(LONG + 2, dtype=np.uint64) * M1 + np.uint64((2 * seed + 1) * int(M2) & (1 << 64) - 1))
    h = join(lengths[np.minimum(n, LONG + 1)], x[start] & MASK[np.minimum(n, 8)])
    own, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(own):
        h[own] = join(h[own], x[start[own] + at] & MASK[np.minimum(n[own] - at, 8)])
        at += 8
        own = own[n[own] > at]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return mix(h)


def _doubled(count: int, size: int, have: int, part) -> np.ndarray:
    """Fingerprints of ``count`` windows; part(lo, hi): those of ``have`` places that start in [lo, hi)."""
    out, top = np.empty(count, np.uint64), 1 << (size.bit_length() - 1)
    own = np.uint64(size * int(M2) & (1 << 64) - 1)
    for lo in range(0, count, STEP):
        m = min(STEP, count - lo)
        h, k = part(lo, lo + m + size - have), have
        while k < top:
            h, k = join(h[:-k], h[k:]), 2 * k
        h = h[:m] if k >= size else join(h[:m], h[size - k : size - k + m])
        out[lo : lo + m] = mix(h + own)
    return out


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` of the values, which are fingerprints themselves."""
    return _doubled(max(len(values) - size + 1, 0), size, 1, lambda lo, hi: values[lo:hi])


def byte_windows(raw: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of all strings of ``size`` bytes."""
    x, few = eights(raw), min(size, 8)
    apart = np.uint64(seed * int(M1) & (1 << 64) - 1)

    def part(lo: int, hi: int) -> np.ndarray:
        h = x[lo:hi].astype(np.uint64)
        h &= MASK[few]
        if seed:
            h ^= apart
            h = mix(h)
        h ^= h >> HALF
        h *= K2
        return h

    return _doubled(max(len(raw) - size + 1, 0), size, few, part)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes by pattern: not blank, and ASCII letters and digits or any byte of a longer character.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """Words of a run of texts: byte ranges, text numbers and fingerprints.

    raw, offsets: the texts' bytes and their n+1 bounds. No word crosses a bound.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool, seed: int = 0):
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[raw]
        bound = np.zeros(n + 1, bool)
        bound[offsets] = True
        left, right = inside[:-1], inside[1:]
        self.start = np.flatnonzero(right & (~left | bound))
        self.end = np.flatnonzero(left & (~right | bound))
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = ranges(LOWER[raw] if lower else raw, self.start, self.end, seed)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))  # first word of each text

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the windows that stay in one text."""
        h = windows(self.hash, size)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def check_bits(h: np.ndarray) -> np.ndarray:
    """The upper half of fingerprints of a second family."""
    return (h >> HALF).astype(np.uint32)


def grouped(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of fingerprints by key and check, and where in it an unlike one begins.

    Keys are sorted alone; checks are sorted too only where they differ under one key.
    """
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    k = keys[order]
    new[1:] = k[1:] != k[:-1]
    if checks is not None and len(keys):
        c = checks[order]
        other = c[1:] != c[:-1]
        if (other & ~new[1:]).any():
            order = np.lexsort((checks, keys))
            k, c = keys[order], checks[order]
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


def numbers(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each fingerprint the number of its group, in the order of :func:`grouped`."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
