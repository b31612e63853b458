"""Vectorised word splitting and hashing over Arrow text columns.

Works on the UTF-8 bytes of a whole Arrow column with numpy, so that no Python object is made for a
word. Texts are taken in blocks of a few megabytes (a longer text is a block by itself); nothing is
cut off. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK_BYTES = 4 << 20
#: Bytes hashed at once; bounds the 64-bit temporaries.
HASH_BYTES = 1 << 19

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
    _LIBC.mallopt(-3, 8 << 20)  # arrays above this are mapped one by one, so that freeing them gives memory back
except (OSError, AttributeError):  # not glibc
    _LIBC = None

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def released(run):
    """The function of a mapInArrow, giving freed memory back once a partition is done."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over the 256 bytes, true inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: What separates the words [^\x20\x09-\x0D]+
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
#: What separates the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text in lower case
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) of consecutive rows with about ``limit`` bytes together."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return (starts, ends, text index) of the words; a word never spans two texts."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    gap = separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= gap[:-1] | gap[1:]
    # An edge lies before a byte where a text begins or where either side is a separator.
    starts = np.flatnonzero(~gap & edge[:-1])
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _R), ("down", _R_INV)):
            steps = np.full(max(n, HASH_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = ends[last - 1]
        up, down = _power_tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * down[s]
        if high - low > 8 * HASH_BYTES:
            _powers.clear()
        first = last
    return _mix(out)


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two word sequences of given hashes."""
    return _mix(left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(0x632BE59BD9B4E019))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words, by doubling; len(h) - size + 1 of them."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n, out, done, power, length = len(h) - size + 1, None, 0, h, 1
    while True:
        if size & length:
            part = power[done : done + n]
            out = part.copy() if out is None else join_hashes(out, part)
            done += length
        if done == size:
            return out
        power = join_hashes(power[:-length], power[length:]) if len(power) > length else power[:0]
        length *= 2


def sliding(values: np.ndarray, size: int, reduce=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each ``size`` consecutive values."""
    if len(values) < size:
        return values[:0]
    power, length = values, 1
    while 2 * length <= size:
        power = reduce(power[:-length], power[length:])
        length *= 2
    rest = size - length
    return reduce(power[: len(values) - size + 1], power[rest:]) if rest else power


#: Bytes of a text split into words at once.
SLICE_BYTES = 1 << 20


def lists_of_words(text: str | None, table: bytes, slice_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``slice_bytes`` of text; ``table`` maps each separator to a space."""
    data, at = (text or "").encode().translate(table), 0
    while at < len(data):
        end = data.find(b" ", at + slice_bytes)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_table(separators: np.ndarray) -> bytes:
    """For ``lists_of_words``: A-Z to a-z, separators to spaces."""
    return np.where(separators[LOWER], 32, LOWER).astype(np.uint8).tobytes()
