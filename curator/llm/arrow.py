"""Whole-batch views of Arrow string columns as NumPy arrays, and 64-bit hashes of words.

Everything here works on the concatenated UTF-8 bytes of a slice of rows, so that the cost of a row is a few
array operations rather than a Python loop over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time. One longer text forms a slice of its own.
SLICE_BYTES = 2_000_000

U64 = np.uint64
#: Odd multipliers and the finalizer constants of splitmix64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
S30, S27, S31 = U64(30), U64(27), U64(31)

#: The white space of the contracts: x20 and x09-x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> S30)
    x = x * MIX_1
    x = x ^ (x >> S27)
    x = x * MIX_2
    return x ^ (x >> S31)


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, U64(base))
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BYTE_BASE), Powers(WORD_BASE)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` has about ``most`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // most + np.arange(len(sizes)) // 20_000
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and each row's offset into them (one more than rows). Nulls are empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | border[1:n]
    end[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the first word's index of each row (one more)."""
    start, end = runs_of(~SPACE[raw], off)
    return start, end, np.searchsorted(start, off)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = BYTE_POWERS.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
