"""Quality rules by compression bands.

A text is judged by how far zstandard compresses it: as a whole and in chunks
of a fixed number of bytes.  Each length has its own limits (a short text
compresses badly because the frame has a cost, a long one well because words
come again).  Below its band a text repeats itself, above it it is noise.
Counted rules (too few words, too many repeated five-word windows) come first.

Everything is decided where the row is read: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import textbytes as tb
from ibex.llm.frames import text_of

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes that start a character (all but the continuation bytes).
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed share by length in bytes: the last entry whose
    length is not above the text's holds.

    ``whole`` and ``chunk`` list (from this length, lowest, highest); a text
    shorter than the first entry is not judged, for the frame outweighs it.
    A document fails if more than ``bad_chunks`` of its judged chunks do.
    """

    whole: tuple = ((128, 0.36, 1.10), (512, 0.30, 0.85), (2048, 0.24, 0.75), (16384, 0.20, 0.70), (262144, 0.12, 0.70))
    chunk: tuple = ((1024, 0.24, 0.85), (2048, 0.20, 0.80))
    chunk_bytes: int = 4096
    bad_chunks: float = 0.2
    level: int = 3

    def __post_init__(self):
        for limits in (self.whole, self.chunk):
            if list(limits) != sorted(limits) or not limits:
                raise ValueError("bands are listed by length")
        if self.chunk_bytes < 1:
            raise ValueError("chunk_bytes must be positive")


def _limits(bands: tuple, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each length is judged, its lowest and its highest share."""
    at = np.searchsorted([b[0] for b in bands], n, "right") - 1
    low, high = (np.array([b[k] for b in bands], dtype=float)[np.maximum(at, 0)] for k in (1, 2))
    return at >= 0, low, high


def _share(pack: zstandard.ZstdCompressor, data: memoryview) -> float:
    return len(pack.compress(data)) / len(data) if len(data) else 0.0


def compression(offsets: np.ndarray, data: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    """Per text: share of the whole, judged chunks, chunks below and above
    their band, and the verdict: null, ``repetitive`` or ``incompressible``."""
    pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    raw, step, n = memoryview(np.ascontiguousarray(data)), bands.chunk_bytes, len(offsets) - 1
    whole = np.empty(n)
    text, size, share = [], [], []
    for t in range(n):
        a, b = int(offsets[t]), int(offsets[t + 1])
        whole[t] = _share(pack, raw[a:b])
        for at in range(a, b, step):
            upto = min(at + step, b)
            if upto - at >= bands.chunk[0][0]:
                text.append(t)
                size.append(upto - at)
                share.append(whole[t] if upto - at == b - a else _share(pack, raw[at:upto]))
    text, share = np.array(text, dtype=np.int64), np.array(share)
    judged, low, high = _limits(bands.whole, np.diff(offsets))
    _, chunk_low, chunk_high = _limits(bands.chunk, np.array(size, dtype=np.int64))
    chunks = np.bincount(text, minlength=n)
    below = np.bincount(text[share < chunk_low], minlength=n)
    above = np.bincount(text[share > chunk_high], minlength=n)
    repeats = judged & (whole < low) | (below > bands.bad_chunks * chunks)
    noise = judged & (whole > high) | (above > bands.bad_chunks * chunks) | (below + above > bands.bad_chunks * chunks)
    return {"ratio": whole, "n_chunks": chunks, "n_low_chunks": below, "n_high_chunks": above,
            "verdict": np.where(repeats, "repetitive", np.where(noise, "incompressible", None))}


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, numbered from 0 (both are below 2**31)."""
    return pa.array((a << 32) | b).dictionary_encode().indices.to_numpy().astype(np.int64)


def counts(offsets: np.ndarray, data: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counted statistics of every text.  Words and lines are compared as
    they are, not by hash."""
    n = len(offsets) - 1
    start, end, first = tb.word_spans(offsets, data)
    inside = ~tb.SPACE[data]

    def per_text(mask):
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return total[offsets[1:]] - total[offsets[:-1]]

    # windows: pairs of pairs until the width is reached
    word = tb.string_codes(inside, data, np.append(start, len(data)))
    have, code = 1, word
    while have < window and len(code):
        step = min(have, window - have)
        code, have = _pairs(code[:-step], code[step:]), have + step
    text = np.repeat(np.arange(n), np.diff(first))
    repeated = np.zeros(len(word), dtype=bool)
    valid = np.flatnonzero(tb.window_owner(first, window, len(word) - window + 1))
    if len(valid):
        mine = _pairs(code[valid], text[valid])
        again = np.bincount(mine)[mine] > 1
        repeated = tb.covered(valid[again], window, len(word)) if again.any() else repeated

    # lines: cut at each text's start and after each newline
    newline = data == 10
    line_start = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1]))
    line_text = np.repeat(np.arange(n), 1 + per_text(newline))
    bounds = np.append(line_start, len(data))
    solid = np.append(0, np.cumsum(inside, dtype=np.int64))
    has_word = solid[bounds[1:]] > solid[bounds[:-1]]
    line = _pairs(tb.string_codes(~newline, data, bounds)[has_word], line_text[has_word])
    new = np.zeros(len(line), dtype=bool)
    new[np.unique(line, return_index=True)[1]] = True
    return {"n_words": np.diff(first), "word_chars": per_text(inside & _LEAD[data]), "n_symbols": per_text(_SYMBOL[data]),
            "n_dup_lines": np.bincount(line_text[has_word][~new], minlength=n),
            "n_repeat_words": np.bincount(text[repeated], minlength=n)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CHUNKS = ("n_chunks", "n_low_chunks", "n_high_chunks")
SCHEMA = ("id long, " + ", ".join(f"{c} long" for c in COUNTS)
          + ", base_failed boolean, kept boolean, ratio double, " + ", ".join(f"{c} long" for c in CHUNKS) + ", reason string")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bands: Bands | None = None,
                  min_words: int = 10, max_repeat_percent: int = 20, window: int = 5, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: the counts, ``base_failed`` (under ``min_words``
    words, or over ``max_repeat_percent`` of the words in windows that the
    text has twice), ``ratio`` (compressed share of the whole text, 0 for an
    empty one), the chunk counts, ``reason`` (null, ``words``, ``repeats``,
    ``repetitive`` or ``incompressible``) and ``kept``.

    A null text is an empty one (no words, so it fails); texts of any length
    are judged whole; rows with equal or null ids are judged one by one; other
    columns are ignored, whatever their names; an empty table gives an empty
    result.  Memory follows ``batch_bytes`` or the longest text.
    """
    bands = bands or Bands()
    frame = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices_of(batch, "text", batch_bytes):
                offsets, data = tb.buffers(part.column("text"))
                got = counts(offsets, data, window)
                got |= compression(offsets, data, bands)
                few = got["n_words"] < min_words
                many = 100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"]
                reason = np.where(few, "words", np.where(many, "repeats", got["verdict"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(got[c], pa.int64()) for c in COUNTS), pa.array(few | many),
                     pa.array(np.equal(reason, None).astype(bool)), pa.array(got["ratio"]),
                     *(pa.array(got[c], pa.int64()) for c in CHUNKS), pa.array(reason.tolist(), pa.string())],
                    names=["id", *COUNTS, "base_failed", "kept", "ratio", *CHUNKS, "reason"])

    return frame.mapInArrow(judge, SCHEMA)
