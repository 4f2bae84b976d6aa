"""A Bloom filter of bounded size over 64-bit hashes: it may let extra keys pass and never loses one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
MAX_BITS = 1 << 28


def bits_for(n_keys: int, most: int = MAX_BITS) -> int:
    """A power of two, about 16 bits a key, `most` at most: beyond that more keys pass by chance, none is lost."""
    return min(most, max(1 << 12, 1 << int(np.ceil(np.log2(max(1, n_keys) * 16)))))


def _places(keys: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice of each key, and two places in it."""
    mask = np.uint64(n_bits // SLICES - 1)
    return (keys % np.uint64(SLICES)).astype(np.int64), (keys >> np.uint64(8)) & mask, (keys >> np.uint64(36)) & mask


def build(packed: DataFrame, n_bits: int) -> np.ndarray:
    """packed: rows with `keys`, binary of uint64. One slice of the filter is made in each group; n_bits / 8 bytes reach the driver."""

    def split(batches):
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                k = np.frombuffer(keys, np.uint64)
                s = _places(k, n_bits)[0]
                order = np.argsort(s, kind="stable")
                cuts = np.searchsorted(s[order], np.arange(SLICES + 1))
                got = [i for i in range(SLICES) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_pydict({"slice": pa.array(got, pa.int32()), "keys": pa.array([k[order[cuts[i] : cuts[i + 1]]].tobytes() for i in got], pa.binary())})

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, keys in zip(batch.column("slice").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                bits = held.setdefault(s, np.zeros(n_bits // SLICES, bool))
                _, a, b = _places(np.frombuffer(keys, np.uint64), n_bits)
                bits[a] = bits[b] = True
        for s, bits in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    made = packed.select("keys").mapInArrow(split, "slice int, keys binary").repartition(SLICES, "slice").mapInArrow(fill, "slice int, bits binary")
    whole = np.zeros((SLICES, n_bits // SLICES // 8), np.uint8)
    for row in made.collect():
        whole[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return whole


def passes(keys: np.ndarray, whole: np.ndarray) -> np.ndarray:
    s, a, b = _places(keys, whole.size * 8)
    seen = lambda at: (whole[s, (at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
    return (seen(a) & seen(b)).astype(bool)
