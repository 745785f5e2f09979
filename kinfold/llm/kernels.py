"""Vectorised byte, word and set kernels over blobs of many documents (no per-row Python in the hot loops)."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Word separators: space and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(chars: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of chars[:i], so that any substring's hash takes constant time."""
    up, _ = powers(len(chars))
    p = np.zeros(len(chars) + 1, U)
    np.cumsum(_TABLE[chars] * up[: len(chars)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), equal wherever in the blob they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one more entry at the end)."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[chars]
    begins = bounds[:-1][bounds[:-1] < n]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = begins[begins > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds)


def shingle_sets(chars: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sets of distinct width-word shingles (A-Z in lower case) as sorted 64-bit hashes: values, bounds per
    document. With fewer words the whole sequence counts as one shingle; without words the set is empty."""
    low = LOWER[chars]
    start, end, at = words(low, bounds)
    counts = np.diff(at)
    if not len(start):
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    h = span_hash(prefix_hash(low), start, end)
    factor = [U(int(x) | 1) for x in _TABLE[:width]]
    whole = np.zeros(max(len(h) - width + 1, 0), U)
    for k in range(width):
        whole += h[k : k + len(whole)] * factor[k]
    whole = mix(whole)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for d, (a, m) in enumerate(zip(at.tolist(), counts.tolist())):
        if m >= width:
            x = np.sort(whole[a : a + m - width + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x
        elif m:
            x = mix(np.array([sum(int(h[a + k]) * int(factor[k]) for k in range(m)) + m * 0x2545F4914F6CDD1D & (1 << 64) - 1], U))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def minhashes(values: np.ndarray, bounds: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """count 32-bit min-wise values a set, as rows; empty sets get all ones."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    sig = np.full((len(sizes), count), 0xFFFFFFFF, np.uint32)
    if not len(full):
        return sig
    step, i = 1 << 17, 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(bounds[full], bounds[full[i]] + step)))
        lo, hi = bounds[full[i]], bounds[full[min(j, len(full)) - 1] + 1]
        part, at = values[lo:hi], bounds[full[i:j]] - lo
        for k in range(count):
            x = part * a[k] + b[k]
            x ^= x >> U(29)
            x *= U(0xBF58476D1CE4E5B9)
            sig[full[i:j], k] = np.minimum.reduceat((x >> U(32)).astype(np.uint32), at)
        i = j
    return sig
