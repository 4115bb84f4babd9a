"""Cutting texts where no token can span, and looking at each distinct chunk
once per batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LETTER = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _LETTER[_a:_b] = True
#: Bytes that start a character which is not white space (leads of two- to
#: four-byte characters that include Unicode white space are left out).
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True
#: ASCII punctuation that never joins a letter's token (the apostrophe does).
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"]] = True


def at_word_starts(data: np.ndarray) -> np.ndarray:
    """Cuts before a space with a solid character after it, and between an
    ASCII letter or digit and ASCII punctuation: both are token boundaries of
    byte-level BPE."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        cut[:-1] = (data[:-1] == 32) & _SOLID[data[1:]]
        cut[1:] |= _LETTER[data[:-1]] & _POINT[data[1:]]
    return cut


def at_space_runs(data: np.ndarray) -> np.ndarray:
    """Cuts before each run of spaces.  None after byte 0x81, with which the
    vocabulary's own space mark ends."""
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (data[1:] == 32) & (data[:-1] != 32) & (data[:-1] != 0x81)
    return cut


def distinct_chunks(offsets: np.ndarray, data: np.ndarray, cut: np.ndarray):
    """Distinct chunks (Arrow strings), each chunk's place among them, and
    where every text's chunks begin (one entry more than there are texts)."""
    cut = cut.copy()
    inner = offsets[:-1]
    cut[inner[inner < len(data)]] = True
    start = np.flatnonzero(cut)
    ends = np.append(start, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(start, offsets)


class Memory:
    """What is known of chunks, in two generations of a bounded number of
    bytes: when the younger is full it becomes the older, so chunks in use
    stay known.  Long chunks are not remembered; texts without spaces have
    them, and they don't come again."""

    LONGEST = 64
    #: Bytes of an entry with its chunk and its value, about (256 at most).
    ENTRY = 200

    def __init__(self, limit: int = 24 << 20):
        self.limit, self.size = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def rest(self) -> None:
        """Between tasks the younger generation is enough."""
        self.old = {}

    def of(self, distinct: list[str], solve) -> list:
        """The value of each chunk; ``solve`` gives those of a list of unknown
        ones.  Chunks and values are strings, bytes or small tuples."""
        young, old = self.young, self.old
        unknown = [c for c in distinct if c not in young]
        if old and unknown:
            young.update((c, old[c]) for c in unknown if c in old)
            unknown = [c for c in unknown if c not in young]
        long = [c for c in unknown if len(c) > self.LONGEST]
        if long:
            unknown = [c for c in unknown if len(c) <= self.LONGEST]
        young.update(zip(unknown, solve(unknown)))
        loose = dict(zip(long, solve(long))) if long else {}
        out = [loose[c] if c in loose else young[c] for c in distinct] if loose else [young[c] for c in distinct]
        self.size = self.ENTRY * len(young)
        if self.size > self.limit:
            self.young, self.old = {}, young
        return out
