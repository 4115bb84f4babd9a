"""Periodic runs of words, found in tiles of each scale.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) of at least ``max(6, 4 * q)`` words that cannot be extended.  Periods
are taken by octave: those from ``P`` to ``2 * P - 1`` together, for each
power of two ``P``.

1. *Explode.*  Every octave has boundaries at multiples of ``P`` and tiles of
   neighbouring boundaries, which overlap by what the longest comparison at a
   boundary may reach.  Each run has, for its period, a boundary after which
   ``core`` words equal those a period further on; rolling hashes find all
   boundaries where that may hold, and tiles without any are not written.
2. *Solve.*  A tile is solved by itself, wherever it lands: the Z-function
   from each such boundary gives how far every period of the octave holds to
   the right, that of the words before it how far to the left.
3. *Stitch.*  The fragments, in the document's word numbers, are shuffled by
   document and period; those that touch become one.  A run that also has a
   multiple of its period is the same stretch, so of equal stretches the
   smallest period stays.

A text is read once.  What is shuffled are tiles with a periodic place, the
texts that have one, and fragments: a text without repetition costs a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ibex.llm import textbytes as tb
from ibex.llm.frames import checkpointed, parts, text_of

#: A run has at least this many words, and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words from the first to the last boundary of a tile, at least.
TILE_WORDS = 4096

_U = np.uint64
_CUT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("octave", pa.int32()), ("at", pa.int64()),
                  ("words", pa.binary()), ("picks", pa.binary()), ("text", pa.string()), ("sha", pa.string())])
CUT = "key long, id long, n long, octave int, at long, words binary, picks binary, text string, sha string"


def least(p: int) -> int:
    """Words that a run of period ``p`` has at least."""
    return max(MIN_WORDS, MIN_PERIODS * p)


def core(base: int) -> int:
    """Equal words after the first boundary in the run, for the octave from
    ``base``: what is left of the shortest run when the boundary lies as late
    as it can."""
    return min(least(p) - p for p in (base, min(base + 1, 2 * base - 1))) - base + 1


def joined(text: bytes) -> bytes:
    """The words, joined by one space (``split`` cuts at the six ASCII white
    spaces)."""
    return b" ".join(text.split())


def _hits(base: int, running: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Boundaries (word numbers in the batch, in order) after which ``core``
    words may equal those one period of the octave further on."""
    width = core(base)
    room = np.diff(first) - base - width  # a text's last boundary, at most
    n = np.where(room >= 0, room // base + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    b = first[text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * base
    if not len(b):
        return b
    hashes = tb.WORDS.windows(running, width)
    stop = first[text + 1] - width  # the last place where the words a period on may start
    hit = np.zeros(len(b), dtype=bool)
    mine = hashes[b]
    if len(b) < base:
        for k in range(len(b)):
            hit[k] = (hashes[b[k] + base:min(b[k] + 2 * base, stop[k] + 1)] == mine[k]).any()
        return b[hit]
    for p in range(base, 2 * base):
        at = b + p
        hit |= (hashes[np.minimum(at, len(hashes) - 1)] == mine) & (at <= stop)
    return b[hit]


def _tiles(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, octave, word number of the tile's start, words, boundaries in
    the tile) of every tile that has a boundary to solve."""
    text = np.arange(len(first) - 1)
    octave, base = 0, 1
    running = None
    while True:
        size = np.diff(first)
        able = size >= least(base)
        if not able.any():
            return
        if running is None or size[able].sum() < 0.5 * size.sum():  # go on with the longer texts alone
            codes = codes[np.repeat(able, size)]
            text, first = text[able], np.append(0, np.cumsum(size[able]))
            running = tb.WORDS.running(tb.mix((codes + 1).astype(_U)))
        hits = _hits(base, running, first)
        if len(hits):
            owner = np.searchsorted(first, hits, "right") - 1
            tile = (hits - first[owner]) // max(TILE_WORDS, 4 * base)
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(tile) != 0)) + 1
            reach = base + core(base) - 1 + 2 * base
            for picks in np.split(hits, cut):
                t = int(np.searchsorted(first, picks[0], "right")) - 1
                lo = max(int(picks[0]) - base, int(first[t]))
                hi = min(int(picks[-1]) + reach, int(first[t + 1]))
                yield int(text[t]), octave, lo - int(first[t]), codes[lo:hi], picks - lo
        octave, base = octave + 1, 2 * base


def _cut(batches: Iterator[pa.RecordBatch], batch_bytes: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each tile to be solved."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in tb.slices_of(batch, "text", batch_bytes):
            offsets, data = tb.buffers(part.column("text"))
            start, _, first = tb.word_spans(offsets, data)
            codes = tb.string_codes(~tb.SPACE[data], data, np.append(start, len(data)))
            keys, ids = part.column("key").to_pylist(), part.column("id").to_pylist()
            rows, found = [], set()
            for t, octave, at, words, picks in _tiles(codes, first):
                found.add(t)
                rows.append((keys[t], None, None, octave, at, pack.compress(words.astype(np.int32).tobytes()),
                             picks.astype(np.int32).tobytes(), None, None))
            for t, (key, i) in enumerate(zip(keys, ids)):
                raw = data[offsets[t]:offsets[t + 1]].tobytes()
                n = int(first[t + 1] - first[t])
                if t in found or keep_text:
                    rows.append((key, i, n, None, None, None, None, raw.decode(), None))
                else:
                    rows.append((key, i, n, None, None, None, None, None, hashlib.sha256(joined(raw)).hexdigest()))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)


def z_function(s: list) -> list[int]:
    """For each place, how many items from there equal those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve(octave: int, words: list[int], picks: list[int]) -> list[tuple[int, int, int]]:
    """(period, from, to) of the stretches of a tile in which each word equals
    the one a period further on (``to`` excluded, the period's last words not
    counted); stretches of one period that touch are one."""
    base, width = 1 << octave, core(1 << octave)
    reach = base + width - 1  # to the next boundary's core, or the run's end
    open_, out = {}, []
    for b in picks:
        right = z_function(words[b:b + reach + 2 * base])
        before = words[max(b - base, 0):b][::-1]
        after = words[b:b + 2 * base - 1][::-1]
        left = z_function([*before, None, *after])[len(before) + 1:]
        for p in range(base, min(2 * base, len(right))):
            more = min(right[p], reach)
            if more < width:
                continue
            back = left[len(after) - p]  # the word before the period's first word after b
            a, z = b - back, b + more
            if p in open_ and a <= open_[p][1]:
                open_[p][1] = max(open_[p][1], z)
            else:
                if p in open_:
                    out.append((p, *open_[p]))
                open_[p] = [a, z]
    out += [(p, *span) for p, span in open_.items()]
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in range(batch.num_rows):
            key, octave, at, words, picks = (batch.column(c)[row].as_py() for c in ("key", "octave", "at", "words", "picks"))
            spans = solve(octave, np.frombuffer(unpack.decompress(words), dtype=np.int32).tolist(),
                          np.frombuffer(picks, dtype=np.int32).tolist())
            if spans:
                p, a, z = np.array(spans, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), key)), pa.array(p), pa.array(a + at), pa.array(z + at)],
                                                 names=["key", "period", "a", "z"])


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) from fragments (key, period, a, z)."""
    from pyspark.sql import Window

    line = Window.partitionBy("key", "period").orderBy("a", "z")
    before = F.max("z").over(line.rowsBetween(Window.unboundedPreceding, -1))
    pieces = fragments.withColumn("fresh", F.coalesce((F.col("a") > before).cast("long"), F.lit(1)))
    pieces = pieces.withColumn("piece", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("key", "period", "piece").agg(F.min("a").alias("start"), F.max("z").alias("z"))
    whole = whole.select("key", "start", (F.col("z") + F.col("period") - F.col("start")).alias("length"), "period")
    whole = whole.where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), F.lit(MIN_PERIODS) * F.col("period")))
    return whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def _collapse(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Drops the words that a run repeats, of texts that have runs."""
    for batch in batches:
        sha, kept = batch.column("sha").to_pylist(), [None] * batch.num_rows
        for row in range(batch.num_rows):
            if sha[row] is not None:
                continue
            raw, runs = batch.column("text")[row].as_py().encode(), batch.column("runs")[row].as_py() or []
            if runs:
                words = raw.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs:
                    gone[r["start"] + r["period"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                raw = b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g)
            else:
                raw = joined(raw)
            sha[row], kept[row] = hashlib.sha256(raw).hexdigest(), raw.decode() if keep_text else None
        columns = [batch.column("id"), batch.column("n"), batch.column("runs"), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if keep_text else columns,
                                         names=["id", "n_words", "runs", "collapsed_sha256", "collapsed"][:5 if keep_text else 4])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = True,
                  batch_bytes: int = 4 << 20, tiles_per_task: int = 2000) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``runs`` (an array of
    start, length and period, by start, then period), ``collapsed_sha256`` of
    the text without what runs repeat after their first period, its words
    joined by one space, and that text, ``collapsed`` (not with
    ``keep_text=False``).

    A null, empty or white text has no words and no runs.  Rows with equal or
    null ids are different texts.  Other columns are ignored, whatever their
    names.  An empty table gives an empty result.
    """
    frame = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"),
                        text_of(text_col).alias("text"))
    cut = checkpointed(frame.mapInArrow(lambda batches: _cut(batches, batch_bytes, keep_text), CUT))
    tiles = cut.where("octave IS NOT NULL").select("key", "octave", "at", "words", "picks")
    # a tile is small but may take long: dealt by number, not by bytes
    dealt = tiles.repartition(parts(tiles.count(), tiles_per_task), "key", "octave", "at")
    fragments = dealt.mapInArrow(_solve, "key long, period long, a long, z long")
    runs = (stitch(fragments).groupBy("key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
            .select("key", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"),
                                                                  r["period"].alias("period"))).alias("runs")))
    texts = cut.where("octave IS NULL").select("key", "id", "n", "text", "sha")
    out = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"
    return (texts.join(runs, "key", "left").withColumn("runs", F.coalesce("runs", F.array().cast(runs.schema["runs"].dataType)))
            .mapInArrow(lambda batches: _collapse(batches, keep_text), out + ", collapsed string" * keep_text))


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period (compared exactly; of ties
    the first); null if there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def digest(runs: Column) -> Column:
    """SHA-256 of every run's ``start,length,period`` and a line feed."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                             r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
