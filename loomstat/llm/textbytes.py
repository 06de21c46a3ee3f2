"""Vectorised work on the UTF-8 bytes of an Arrow string column: slices of bounded size, hashes of spans."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Spans of more bytes are hashed one by one.
LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and shift)."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


#: What worker processes keep between tasks, by operator.
CACHES: dict[str, dict] = {}


def let_go(owner: str) -> None:
    """Drop what other operators have left in this worker: a worker serves one stage of a pipeline after the other."""
    left = [c for name, c in CACHES.items() if name != owner and c]
    for c in left:
        c.clear()
    if left:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: reused workers would hold the most that any of their tasks has needed."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the spans data[start:end] of bytes: eight bytes at a time, each step a bijection of the hash so far
    and of those bytes, so that spans of one length of up to eight bytes never share one. Spans beyond LONG bytes are
    hashed by BLAKE2b. Two seeds give two hashes that have nothing to do with each other."""
    size = end - start
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    h = mix(size.astype(U64) + U64((2 * seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (words[at] & _LOW[np.minimum(left, 8)]))
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[data]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i], start[i] + 1, ... of every range, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
