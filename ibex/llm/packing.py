"""Packing documents into training sequences by best-fit decreasing.

A document's ids are first cut into full windows; each is a sequence of its
own.  The remainders, one per document at most, are packed longest first: a
segment tree indexed by remaining capacity finds the tightest open window
that has room, and a new window is opened if there is none.

Documents are dealt into groups of about ``group_docs`` by a hash of the id,
and each group is packed by one task; a group leaves one or two windows
partly filled, so padding does not grow with the number of documents.

Token ids never leave the task that makes them: a piece travels as its
length and checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import chunks, textbytes as tb
from ibex.llm.frames import parts, text_of

#: Chunks whose ids are laid out together.
GATHER = 1 << 17

_ENCODERS: dict[str, "Encoder"] = {}

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE file; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memory = chunks.Memory()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, distinct: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit numbers."""
        out = []
        for i in range(0, len(distinct), 4096):
            for found in self.tokenizer.encode_batch_fast(distinct[i:i + 4096], add_special_tokens=False):
                out.append(struct.pack(f"<{len(found.ids)}I", *found.ids))
        return out

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text column, one after the other, and where each text's
        begin (one entry more than there are texts)."""
        offsets, data = tb.buffers(column)
        distinct, place, first = chunks.distinct_chunks(offsets, data, chunks.at_word_starts(data))
        pool = self.memory.of(distinct.to_pylist(), self.encode)
        size = np.array([len(x) // 4 for x in pool], dtype=np.int32)
        flat = np.frombuffer(b"".join(pool), dtype="<u4")
        begin = np.cumsum(size, dtype=np.int64) - size
        upto = np.zeros(len(place) + 1, dtype=np.int64)
        np.cumsum(size[place], out=upto[1:])
        out = np.empty(int(upto[-1]), dtype="<u4")
        for lo in range(0, len(place), GATHER):  # indices take more room than ids
            some = place[lo:lo + GATHER]
            a, z = int(upto[lo]), int(upto[lo + len(some)])
            out[a:z] = flat[np.repeat(begin[some] - upto[lo:lo + len(some)], size[some]) + np.arange(a, z)]
        return out, upto[first]


def _parts(batch: pa.RecordBatch, size: int = 8 << 20):
    """Runs of rows with about ``size`` bytes of text: long enough that most
    chunks repeat, short enough to bound the ids held at a time."""
    offsets, _ = tb.buffers(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def cut_pieces(docs: DataFrame, tokenizer: str, window: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """Full windows and remainders of every document, as ``PIECES``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in _parts(batch):
                ids, first = encoder.ids(part.column("text"))
                rows, start, length, crc, total = [], [], [], [], []
                end = np.array([end_id], dtype="<u4").tobytes()
                for i in range(part.num_rows):
                    a, b = int(first[i]), int(first[i + 1])
                    n = b - a + 1
                    body = memoryview(ids[a:b].tobytes() + end)
                    for s in range(0, n, window):
                        rows.append(i)
                        start.append(s)
                        length.append(min(window, n - s))
                        crc.append(zlib.crc32(body[4 * s:4 * (s + window)]))
                        total.append(n)
                ids_out = part.column("id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_out, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                     part.column("salt").take(pa.array(rows, pa.int64()))],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        encoder.memory.rest()

    frame = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # rows of one id are told apart by their text
    frame = frame.withColumn("salt", F.xxhash64("id", "text"))
    return frame.mapInArrow(tb.trimmed(cut), PIECES)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that knows
    which capacities have one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, c: int, has: bool) -> None:
        i = c + self.size
        self.tree[i] = has
        while i > 1:
            i >>= 1
            now = self.tree[2 * i] or self.tree[2 * i + 1]
            if self.tree[i] == now:
                break
            self.tree[i] = now

    def put(self, c: int, window: int) -> None:
        self.at[c].append(window)
        if len(self.at[c]) == 1:
            self._mark(c, True)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity of at least ``need``,
        taken out; None if there is none."""
        i = need + self.size
        if not self.tree[i]:
            while True:  # up until a right neighbour has an open window
                if i == 1:
                    return None
                if i % 2 == 0 and self.tree[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:  # down to its smallest capacity
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        c = i - self.size
        window = self.at[c].pop()
        if not self.at[c]:
            self._mark(c, False)
        return c, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece, taken in the given (decreasing) order."""
    window, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_windows, opened = OpenWindows(capacity), 0
    for i, need in enumerate(lengths.tolist()):
        found = open_windows.tightest(need)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        left, at = found
        window[i], offset[i] = at, capacity - left
        if left > need:
            open_windows.put(left - need, at)
    return window, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = 1024,
         group_docs: int = 50_000) -> DataFrame:
    """One row per piece, as ``PACKED``: the document, the piece's ``start``
    and ``length`` in it, the checksum of its ids, the document's ids, and the
    place in a sequence (``sequence_id``, gapless ``offset`` from 0).

    Every document ends with id 0, so a null or empty text is the one piece
    ``[0]``.  Rows with equal or null ids are documents of their own, with
    equal ids in the output; copies in every column are packed one by one.
    Other columns are ignored, whatever their names.  An empty table gives an
    empty result.
    """
    n_groups = parts(docs.count(), group_docs)
    pieces = cut_pieces(docs, tokenizer, window, id_col, text_col)
    pieces = pieces.withColumn("part", F.pmod(F.col("salt"), F.lit(n_groups)).cast("int"))

    def place(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        length, start, salt = (group.column(c).to_numpy() for c in ("length", "start", "salt"))
        order = np.lexsort((start, salt, -length))  # the same in every attempt
        at, offset = best_fit_decreasing(length[order], window)
        group = group.take(pa.array(order))
        return pa.table([group.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
                        + [pa.array(at + (key[0].as_py() << 40)), pa.array(offset)],
                        names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.groupBy("part").applyInArrow(place, PACKED)
