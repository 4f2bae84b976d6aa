"""Anchors of windows: the first, cheap level of the operators that look for repeated passages.

Each window of `window` symbols has one anchor: the run of `level` symbols in it with the least hash. Equal windows have
equal anchors at equal places, so a window can only repeat if its anchor does. So the first level looks at anchors alone.
"""

from __future__ import annotations

import numpy as np

from .hashing import U, between, prefix, sliding_least


def anchors(symbols: np.ndarray, first: np.ndarray, window: int, level: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each whole window, its anchor's place, hashes of all runs of `level` symbols by place)."""
    if len(symbols) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    sums = prefix(symbols, base)
    at = np.arange(len(symbols) - level + 1)
    hashes = between(sums, at, at + level, base)
    place = sliding_least(hashes, window - level + 1)
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths) - np.arange(len(symbols))  # symbols from here to the row's end
    starts = np.flatnonzero(left[: len(place)] >= window)
    return starts, place[starts], hashes
