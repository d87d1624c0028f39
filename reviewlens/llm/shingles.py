"""Word shingles of a text as sorted 64-bit hashes, by NumPy on its bytes."""

from __future__ import annotations

import numpy as np

WIDTH = 5

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * _STEP
    values = values ^ (values >> np.uint64(29))
    values = values * _STEP
    return values ^ (values >> np.uint64(32))


#: One random number per byte; A-Z have those of a-z.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTES[65:91] = _BYTES[97:123]
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    if len(_POWERS["up"]) < size:
        size = max(size, 1 << 16)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, with A-Z as a-z; words stand between ASCII white space."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    space = np.concatenate(([True], _SPACES[data], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle of all its words, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    span = min(width, len(words))
    count = len(words) - span + 1
    value = np.full(count, span, np.uint64)
    for at in range(span):
        value = mix(value + words[at : at + count])
    return np.unique(value)


def set_key(values: np.ndarray) -> int:
    """64 bits that name a set (0 for the empty one)."""
    if not len(values):
        return 0
    return int(mix(np.array([mix(values).sum() + np.uint64(len(values))]))[0].astype(np.int64))
