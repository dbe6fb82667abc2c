"""Array helpers over the UTF-8 bytes of a batch of texts.

Every function here is a pure function of one batch; the operators call them
inside ``mapInArrow`` / ``applyInArrow`` tasks.  A batch is cut into slices
of a bounded number of text bytes, so the arrays of a task do not grow with
its partition (one single text longer than the bound forms its own slice).

Hashes are polynomial (Rabin-Karp): the hash of bytes ``s..e`` is
``sum(T[byte[i]] * b**(i - s))`` modulo 2**64 with an odd base, taken from
one running sum by a subtraction and a multiplication, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_TABLE = SLICE_BYTES + 4096  # powers for a slice; a longer text gets its own


@lru_cache(maxsize=4)
def _table(base: int) -> np.ndarray:
    """base**0 .. base**(_TABLE-1) modulo 2**64 (8 MB; at most four are kept)."""
    steps = np.full(_TABLE, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _table(base)
    if n <= _TABLE:
        return table[:n]
    rows = np.full(-(-n // _TABLE), pow(base, _TABLE, 1 << 64), dtype=np.uint64)
    rows[0] = 1
    return (np.multiply.accumulate(rows)[:, None] * table).reshape(-1)[:n]


class Rolling:
    """Position-free hashes of ranges of one array of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self._back = powers(pow(base, -1, 1 << 64), n + 1)
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, n), out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hash of values[start:end], elementwise."""
        return (self._sum[end] - self._sum[start]) * self._back[start]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


@lru_cache(maxsize=1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release_memory() -> None:
    """Give what arrays and batches have freed back to the system: a worker is
    reused, and others of its executor need the room."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def slices(batches, text_col: str = "text", max_bytes: int = SLICE_BYTES, length=pc.binary_length):
    """Record batches cut so that each holds at most ``max_bytes`` of text
    (or one row); ``length`` gives the bytes of every value."""
    release_memory()  # of the worker's task before
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        size = pc.fill_null(length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release_memory()  # a reused worker keeps nothing of a task


def ids_of(batch: pa.RecordBatch, col: str = "doc_id") -> np.ndarray:
    """Ids as int64; they must not be null (numpy would make them doubles)."""
    ids = batch.column(batch.schema.get_field_index(col))
    if ids.null_count:
        raise ValueError(f"null in {col}")
    return ids.cast(pa.int64()).to_numpy()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: (start, end, bounds);
    the words of text d are bounds[d]:bounds[d+1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    filled = offs[:-1][offs[1:] > offs[:-1]]
    first[filled] = solid[filled]
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = solid[ends]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    raw = Rolling(byte_values(data)).of(start, end)
    return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owner(bounds: np.ndarray) -> np.ndarray:
    """Row number of every item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
