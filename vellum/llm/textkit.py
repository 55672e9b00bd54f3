"""Vectorised helpers over the UTF-8 bytes of whole Arrow batches.

Texts are handled in windows of about a megabyte, so memory is bounded by the
window and not by the longest text.  A text longer than a window is cut at a
space (or, failing that, at a character boundary) and its parts are summed.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
#: Rows of a slice where what is derived from texts is larger than they are.
SLICE = 2048

#: Freed memory goes back to the system where the C library offers it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_K = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def each(batches, rows: int | None = None):
    """The batches, in slices of so many rows if given; what Arrow and the allocator hold back is returned before each, as workers of several stages share a machine."""
    gc.collect()  # what tasks before have left in the worker
    _give_back()
    for batch in batches:
        step = rows or max(1, batch.num_rows)
        for at in range(0, max(1, batch.num_rows), step):
            part = batch.slice(at, step)
            yield part
            del part
            _give_back()


def lowered(column) -> pa.Array:
    """A string column with null as empty, in lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _cut(view: memoryview, start: int, limit: int) -> int:
    """Where a part that begins at start ends: after the last space within limit bytes."""
    end = start + limit
    if end >= len(view):
        return len(view)
    at = bytes(view[start:end]).rfind(b" ")
    if at > 0:
        return start + at + 1
    while end > start + 1 and view[end] & 0xC0 == 0x80:
        end -= 1
    return end


def windows(array: pa.Array, limit: int = WINDOW):
    """Yield (rows, bytes objects): parts of the array's texts of about limit bytes together."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = memoryview(array.buffers()[2] or b"")
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for row in range(len(array)):
        a, b = int(offsets[row]), int(offsets[row + 1])
        view = data[a:b]
        start = 0
        while True:
            end = len(view) if len(view) - start <= limit else _cut(view, start, limit)
            rows.append(row)
            parts.append(bytes(view[start:end]))
            size += end - start + 1
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
            start = end
            if start >= len(view):
                break
    if rows:
        yield rows, parts


def joined(parts: list[bytes], table: np.ndarray, gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all parts through a lookup table, a gap byte before each and after the last; where each part's gap is."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    raw = np.frombuffer(gap + gap.join(parts) + gap, np.uint8)
    return table[raw], starts


def letter_table(sentence_ends: bool = False, digits: bool = False) -> np.ndarray:
    """Keeps letters (a-z and every byte of a longer character); the rest becomes a space, sentence ends a newline."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    if digits:
        table[48:58] = np.arange(48, 58)
    if sentence_ends:
        for c in b".!?\n":
            table[c] = 10
    return table


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _K), ("down", pow(_K, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
            _powers[name] = out
    return _powers["up"], _powers["down"]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes above a space."""
    inside = buf > 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(buf)]))
    return edge[::2], edge[1::2]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run codes[start:end], by one prefix sum over all codes."""
    up, down = _power(len(codes) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h
