"""Vectorised hashing of characters, words and word sequences for Arrow batches.

A batch of texts is laid end to end as one code point array. The hash of any span comes from prefix sums of
c[i] * B**i modulo 2**64 (B odd, so B has an inverse), which needs no Python loop over characters or words.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_alnum: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) >= n:
        return
    n = max(n, 2 * len(_powers))
    for_base = np.full(n, _BASE, dtype=np.uint64)
    for_base[0] = 1
    _powers = np.cumprod(for_base, dtype=np.uint64)
    for_base[1:] = np.uint64(_INVERSE)
    _inverses = np.cumprod(for_base, dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (points[k] + 1) * B**k over i <= k < j."""
    _grow(len(points) + 1)
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers[: len(points)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span lies."""
    _grow(int(start.max(initial=0)) + 1)
    return mix((prefix[end] - prefix[start]) * _inverses[start] + (end - start).astype(np.uint64))


def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _alnum


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text) over all texts; words are runs of letters and digits in lower case."""
    points = code_points("\n".join((t or "").lower().replace("\n", " ") for t in texts))
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = alnum_table()[points]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(np.flatnonzero(points == 10), start)
    if not len(start):
        return np.zeros(0, np.uint64), of
    return span_hash(prefix_hash(points), start, end), of


def sequence_hashes(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its sequences of `width` words.

    A text of fewer words has no sequence and gets an empty set. Batches of some 100 texts keep the arrays in a core's cache.
    """
    w, of = words(texts)
    n = len(w) - width + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * len(texts)
    h = w[:n].copy()
    for k in range(1, width):
        h = mix(h * np.uint64(_BASE) + w[k : k + n])
    whole = of[:n] == of[width - 1 :]
    h, of = h[whole], of[:n][whole]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        s = np.sort(h[cuts[i] : cuts[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def window_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k code points, in order; what `span_hash` gives for it."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _grow(n)
    return mix((prefix[k:] - prefix[:n]) * _inverses[:n] + np.uint64(k))
