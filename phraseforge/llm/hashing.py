"""Vectorised hashing of words and windows over Arrow text columns (numpy, used inside tasks).

A block is a run of rows whose texts lie side by side in one byte buffer. Words are hashed by folding and mixing eight bytes at
a time. Hashes of short windows are polynomials modulo 2**64 over such symbols, taken from prefix sums, so a window of any length costs
the same; results are mixed at the end. (Over hundreds of symbols such polynomials collide for structured sequences.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
P_BYTE, P_WORD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)) | U(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64 (base is odd)."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < n:
        inverse = U(pow(int(base), -1, 1 << 64))
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, inverse, U)
        up[0] = down[0] = 1
        kept = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 23:
            _powers[int(base)] = kept
    return kept[0][:n], kept[1][:n]


def prefix(symbols: np.ndarray, base: np.uint64) -> np.ndarray:
    up, _ = powers(base, len(symbols))
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up, out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of symbols[start:end], wherever it lies."""
    _, down = powers(base, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


class Block:
    """Rows of a batch: data (uint8), bounds of each row's bytes, and the batch itself."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray):
        self.batch, self.data, self.bounds = batch, data, bounds

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): byte bounds of the words [^\\x20\\x09-\\x0D]+ of all rows; first[r]:first[r+1] are row r's."""
        solid = ~SPACE[self.data]
        after = np.zeros(len(solid) + 1, bool)
        after[1:] = solid
        cut = np.zeros(len(solid) + 1, bool)
        cut[self.bounds] = True
        starts = np.flatnonzero(solid & (~after[:-1] | cut[:-1]))
        follows = np.zeros(len(solid) + 1, bool)
        follows[:-1] = solid
        ends = np.flatnonzero(after & (~follows | cut))
        return starts, ends, np.searchsorted(starts, self.bounds)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[Block]:
    """Slices of the batches with about `size` bytes of text each (one row at least; a row is never cut)."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield Block(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLY, SEEDS = U(0xD6E8FEB86659FD93), (U(0x243F6A8885A308D3), U(0x13198A2E03707344))
#: Longer words are hashed by blake2b.
LONG_WORD = 64


def word_hashes(block: Block, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, starts, ends, first). lower: A-Z as a-z. Another seed (0 or 1) gives an independent hash.

    Eight bytes at a time are folded in and mixed, so that words of like structure have unlike hashes whatever their length."""
    starts, ends, first = block.words()
    data = LOWER[block.data] if lower else block.data
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    out = mix(length.astype(U) + SEEDS[seed])
    left = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        left = left[length[left] > k] if k else left
        if not len(left):
            break
        chunk = np.ascontiguousarray(eight[starts[left] + k]).view(U).ravel()
        short = U(8) * (U(8) - np.minimum(length[left] - k, 8).astype(U))
        out[left] = mix(out[left] * MULTIPLY + ((chunk << short) >> short))
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return out, starts, ends, first


def sequence_hashes(symbols: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each row's whole sequence of symbols: the sum of symbols mixed with their places (0 for no symbols)."""
    at = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(mix(symbols ^ mix(at.astype(U) + SEEDS[seed])), out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def windows(symbols: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all runs of `length` symbols that lie in one row; positions ascend."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(symbols))
    at = at[at + length <= first[1:][rows]] if len(at) else at
    sums = prefix(symbols, P_WORD)
    return at, between(sums, at, at + length, P_WORD)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of values[i:i+width] for each i (the leftmost of equal ones), for whole windows only.

    Values are compared by their upper 40 bits; equal ones by place, so the choice hangs on the window's content alone."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n >= 1 << 24:  # a very long row: in overlapping pieces, as 24 bits hold the place
        step = (1 << 23) - width
        return np.concatenate([sliding_least(values[a : a + step + width - 1], width) + a for a in range(0, n - width + 1, step)])
    packed = (values & U(0xFFFFFFFFFF000000)) | np.arange(n, dtype=U)
    full = -(-n // width) * width
    grid = np.full(full, U(0xFFFFFFFFFFFFFFFF))
    grid[:n] = packed
    grid = grid.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - width + 1], left[width - 1 : n]) & U(0xFFFFFF)).astype(np.int64)
