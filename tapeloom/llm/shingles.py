"""Word shingles as 64-bit numbers, in numpy, for texts of any length."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            p = np.full(_SEGMENT + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def _long_word(b: np.ndarray) -> int:
    """The polynomial sum of one word of any length."""
    up, total, factor, jump = _tables()[0], 0, 1, pow(_BASE, _SEGMENT, 1 << 64)
    for i in range(0, len(b), _SEGMENT):
        part = b[i : i + _SEGMENT].astype(np.uint64) + np.uint64(1)
        total += factor * int((part * up[: len(part)]).sum(dtype=np.uint64))
        factor = factor * jump % (1 << 64)
    return total % (1 << 64)


def word_hashes(data: bytes, first: int | None = None) -> np.ndarray:
    """A number for each run of bytes other than the six ASCII white-space characters, or for its first bytes."""
    return placed_words(data, first)[0]


def placed_words(data: bytes, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and where each word starts."""
    b = np.frombuffer(data, np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if first is not None:
        end = np.minimum(end, start + first)
    return run_hashes(b, start, end), start


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each run of bytes; runs ascend and lie apart."""
    up, down = _tables()
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + _SEGMENT, side="right"))
        if j <= i:
            out[i], i = _long_word(b[start[i] : end[i]]), i + 1
            continue
        part = (b[at : end[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: end[j - 1] - at]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(data: bytes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words, ascending, and how often each occurs.  A text of fewer words is one
    shingle; a text without words has none."""
    w = word_hashes(data)
    if not len(w):
        return w, np.empty(0, np.int64)
    return np.unique(_windows(w, min(k, len(w))), return_counts=True)


def _windows(w: np.ndarray, k: int) -> np.ndarray:
    total, factor = np.zeros(len(w) - k + 1, np.uint64), 1
    for j in range(k):
        total = total + w[j : len(w) - k + 1 + j] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return mix(total + np.uint64(k))


def many_shingles(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingles() of up to 65,535 texts at once: owner, shingle and count, by owner."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    w, at = placed_words(b"\n".join(texts))
    owner = np.searchsorted(starts, at, side="right") - 1
    parts = []
    if len(w) >= k:
        whole = owner[k - 1 :] == owner[: len(owner) - k + 1]
        parts.append((owner[: len(whole)][whole], _windows(w, k)[whole]))
    n = np.bincount(owner, minlength=len(texts)) if len(w) else np.zeros(len(texts), np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    for i in np.flatnonzero((n > 0) & (n < k)):
        parts.append((np.array([i]), _windows(w[first[i] : first[i + 1]], int(n[i]))))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    own, sh = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(sh)
    order = order[np.argsort(own[order].astype(np.uint16), kind="stable")]
    own, sh = own[order], sh[order]
    new = np.flatnonzero(np.concatenate(([True], (sh[1:] != sh[:-1]) | (own[1:] != own[:-1]))))
    return own[new], sh[new], np.diff(np.append(new, len(sh)))


def overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of ascending distinct numbers."""
    if len(a) > len(b):
        a, na, b, nb = b, nb, a, na
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    both = int(np.minimum(na[same], nb[at[same]]).sum())
    return both / (int(na.sum()) + int(nb.sum()) - both)
