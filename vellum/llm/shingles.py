"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept for the longest text so far."""
    if len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + n // 4, base, np.uint64)]))
    return _powers[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of each text's shingles of ``words`` words, SIZE at most.

    A-Z are lower-cased; words are runs of anything but space and the ASCII controls 9 to 13. A text of fewer
    words has its whole sequence as one shingle; null and wordless texts have none.
    """
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    begins = np.cumsum([1] + [len(x) + 1 for x in raw])  # where each text begins, and where one more would
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, len(data)))])
        word = _mixed((sums[stop] - sums[start]) * _power(_BASE_INVERSE, len(data))[start] + (stop - start).astype(np.uint64))
        bounds = np.searchsorted(start, begins)
        full = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for j in range(words):
            full += word[j : j + len(full)] * _PLACE[j]
        full = _mixed(full)
        found = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                found.append(np.unique(full[a : b - words + 1]))
            elif b > a:
                found.append(_mixed(np.array([(word[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
            else:
                found.append(np.empty(0, np.uint64))
    return found


def text_groups(texts: list[str | None], most: int = 1_000_000):
    """Consecutive parts of a list of texts of about ``most`` characters each, or one text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part
