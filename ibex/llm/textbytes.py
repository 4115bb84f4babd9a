"""NumPy views of Arrow string columns: words, rolling hashes, windows.

Every function works on the UTF-8 bytes of a whole batch at once.  Word
separators are the six ASCII white-space bytes, which never occur inside a
multi-byte UTF-8 sequence, so words can be cut on bytes.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

_U = np.uint64
_LIBC = ctypes.CDLL(None)
#: Bytes handled at a time where a temporary needs eight bytes per byte.
CHUNK = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Gives memory that was freed back to the system.  A worker that is used
    again for the next stage would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def trimmed(work):
    """``work``, a function of Arrow batches, giving its memory back at the
    end of the task."""
    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        trim()

    return run


def _odd_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(n, dtype=_U)
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * _U(pow(base, filled, 1 << 64))
        filled += take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Roller:
    """Hash of any slice of a sequence from one running sum.

    ``sum(value[i] * base**i)`` modulo 2**64; a slice's sum is divided by
    ``base**start`` (odd bases have an inverse), so equal slices have equal
    hashes wherever they start.
    """

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=_U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            self._up = _odd_powers(self.base, 2 * n)
            self._down = _odd_powers(self.inverse, 2 * n)
        return self._up, self._down

    def running(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        out = np.empty(len(values) + 1, dtype=_U)
        out[0] = 0
        np.cumsum(values * up[:len(values)], out=out[1:])
        return out

    def slices(self, running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(running))
        return mix((running[end] - running[start]) * down[start])

    def windows(self, running: np.ndarray, width: int) -> np.ndarray:
        """Hash of every slice of ``width`` values."""
        n = len(running) - width
        if n <= 0:
            return np.empty(0, dtype=_U)
        _, down = self.powers(len(running))
        return mix((running[width:] - running[:-width]) * down[:n])


#: Fixed bases and byte values of the rolling hashes (any odd 64-bit numbers).
BYTES, WORDS, WORDS2, GRAMS2 = (Roller(b) for b in (
    0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
BYTE_VALUE2 = mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text.  Offsets
    start at 0 and have one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of a huge column
        column = pa.concat_arrays(column.chunks)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    data = column.buffers()[2]
    data = np.empty(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices_of(batch: pa.RecordBatch, column: str | int, limit: int):
    """Slices of a batch whose texts have about ``limit`` bytes (a longer text
    is a slice of its own)."""
    if not batch.num_rows:
        return
    offsets, _ = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def word_spans(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and for each text the index of its first
    word (one entry more than there are texts)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    begins[cut] = inside[cut]
    ends = inside.copy()  # the last byte of a word
    ends[:-1] &= ~inside[1:]
    cut = cut[cut > 0]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def string_codes(keep: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Equal numbers (from 0) for equal byte strings: the kept bytes between
    each two of ``bounds``, which are positions in ``data``."""
    before = np.append(0, np.cumsum(keep, dtype=np.int64))
    strings = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(before[bounds]), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(start), dtype=_U)
    at = 0
    while at < len(start):
        base = int(start[at])
        upto = int(np.searchsorted(end, base + CHUNK, "right"))
        upto = max(upto, at + 1)  # one span longer than a chunk is taken whole
        s, e = start[at:upto] - base, end[at:upto] - base
        running = BYTES.running(values[data[base:int(end[upto - 1])]])
        out[at:upto] = BYTES.slices(running, s, e) + mix((e - s).astype(_U))
        at = upto
    return mix(out)


def word_hashes(offsets: np.ndarray, data: np.ndarray,
                space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word spans of :func:`word_spans` and the words' hashes."""
    start, end, first = word_spans(offsets, data, space)
    return start, end, first, hash_spans(data, start, end)


def window_owner(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Whether the ``width`` items from each of the first ``n`` starts lie in
    one group; ``first`` holds where each group begins, and the end."""
    ok = np.ones(max(n, 0), dtype=bool)
    for_each = first[1:-1]
    # a start within width-1 items before a boundary crosses it
    diff = np.zeros(max(n, 0) + 1, dtype=np.int32)
    lo, hi = np.clip(for_each - width + 1, 0, max(n, 0)), np.clip(for_each, 0, max(n, 0))
    np.add.at(diff, lo, 1)
    np.add.at(diff, hi, -1)
    if n > 0:
        ok &= np.cumsum(diff[:-1], dtype=np.int32) == 0
    return ok


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``width`` items from one of the
    (sorted, distinct) starts."""
    diff = np.zeros(n + 1, dtype=np.int32)
    diff[starts] += 1
    np.add.at(diff, np.minimum(starts + width, n), -1)
    return np.cumsum(diff[:-1], dtype=np.int32) > 0


def varint(gaps: np.ndarray) -> bytes:
    """Variable-length bytes of non-negative integers below 2**35."""
    gaps = gaps.astype(_U)
    size = np.ones(len(gaps), dtype=np.int64)
    for k in (7, 14, 21, 28):
        size += gaps >= _U(1 << k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(5):
        has = size > k
        part = (gaps[has] >> _U(7 * k)) & _U(127)
        out[at[has] + k] = part | ((size[has] > k + 1).astype(_U) << _U(7))
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) == 0:
        return np.empty(0, dtype=_U)
    last = raw < 128
    begin = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    size = np.diff(np.concatenate((begin, [len(raw)])))
    out = np.zeros(len(begin), dtype=_U)
    for k in range(int(size.max())):
        has = size > k
        out[has] |= (raw[begin[has] + k].astype(_U) & _U(127)) << _U(7 * k)
    return out


def scale(x: np.ndarray, n: int) -> np.ndarray:
    """Maps 64-bit hashes to 0 .. n-1, in the order of the hashes (n < 2**31)."""
    return (((x >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)
