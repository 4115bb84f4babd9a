"""Substring dedup with a count-min prefilter.

A window is ``width`` consecutive words of one document.  Every word that a
repeated window covers is removed.

1. Each bucket of documents sketches its windows; the partial sketches are
   merged shard by shard.  The merged counts never underestimate, so a window
   whose estimate is one is unique and is dropped for good.
2. The windows estimated repeated are grouped exactly, by a 96-bit
   fingerprint next to the shard; windows that the sketch overestimated drop
   out here.  None is lost: the estimate of a repeated window is at least two.
3. Each bucket covers its words with the windows found repeated.

The text is shuffled once, by a hash of the document id; what is exchanged
between the steps is a packed list per bucket and shard (``repeats``).  The
sketch has about ``cells_per_window`` cells for each window at every size of
the input, split into shards of ``2**cell_bits`` cells.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ibex.llm import repeats, textbytes as tb
from ibex.llm.frames import bucketed, parts, text_bytes

_U = np.uint64
_EXACT = 9  # kind of the exact lists; the sketch rows are kinds 0, 1, ..

RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _windows(docs: pa.Table, width: int):
    offsets, data = tb.buffers(docs.column("text"))
    start, end, first, hashes = tb.word_hashes(offsets, data)
    n = len(hashes) - width + 1
    at = np.flatnonzero(tb.window_owner(first, width, n)) if n > 0 else np.empty(0, dtype=np.int64)
    key = tb.WORDS.windows(tb.WORDS.running(hashes), width)[at] if n > 0 else np.empty(0, dtype=_U)
    return offsets, data, start, end, first, hashes, at, key


def _exact_groups(hashes: np.ndarray, at: np.ndarray, key: np.ndarray, width: int, hit: np.ndarray):
    """The estimated repeated windows: distinct (key, second hash), sorted by
    key, with a way back to the windows."""
    second = (tb.WORDS2.windows(tb.WORDS2.running(hashes), width)[at[hit]] >> _U(32)).astype(np.uint32)
    key = key[hit]
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    begin = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, k[begin], s[begin], np.diff(np.append(begin, len(order)))


def _merge_exact(sent: pa.Table) -> pa.Table:
    """Exact counts over all buckets of one shard; a bit per entry sent."""
    payload, flags = sent.column("payload"), sent.column("flags")
    n = [len(payload[i].as_py()) // 12 for i in range(len(sent))]
    key = np.concatenate([np.frombuffer(payload[i].as_py()[:8 * m], dtype=_U) for i, m in enumerate(n)])
    second = np.concatenate([np.frombuffer(payload[i].as_py()[8 * m:], dtype=np.uint32) for i, m in enumerate(n)])
    many = np.concatenate([repeats.unbits(flags[i].as_py(), m) for i, m in enumerate(n)])
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    same = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    found = many[order]
    found[1:] |= same
    found[:-1] |= same
    # a flag of one entry holds for the others, which ``same`` marks anyway
    out = np.empty(len(order), dtype=bool)
    out[order] = found
    ends = np.cumsum(n)
    return repeats.table([(int(b), int(sh), _EXACT, b"", repeats.bits(out[e - m:e])) for b, sh, e, m in zip(
        sent.column("bucket").to_numpy(), sent.column("shard").to_numpy(), ends, n)], repeats.REPLY_SCHEMA)


def _results(docs: pa.Table, parsed, gone: np.ndarray, keep_text: bool) -> pa.Table:
    """One row per document: kept words joined by one space."""
    offsets, data, start, end, first, *_ = parsed
    kept = ~gone
    # bytes of the kept words, each with the byte after it turned into a space
    diff = np.zeros(len(data) + 2, dtype=np.int8)
    diff[start[kept]] += 1
    diff[end[kept] + 1] -= 1  # words are at least a byte apart, or at a text's end
    removed = np.concatenate(([0], np.cumsum(gone)))
    rows = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        mine = np.flatnonzero(kept[a:b]) + a
        if len(mine) == b - a and b > a:
            body = data[start[a]:end[b - 1]]
            inside = ~tb.SPACE[body]
            glued = inside.copy()
            glued[1:] |= inside[:-1]
            text = np.where(inside, body, 32).astype(np.uint8)[glued].tobytes()
        elif len(mine):
            text = b" ".join(data[start[j]:end[j]].tobytes() for j in mine)
        else:
            text = b""
        rows.append((b - a, removed[b] - removed[a], hashlib.sha256(text).hexdigest(),
                     text.decode("utf-8", "replace") if keep_text else None))
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([docs.column("id"), pa.array([int(x) for x in columns[0]], pa.int64()),
                     pa.array([int(x) for x in columns[1]], pa.int64()), pa.array(columns[2], pa.string()),
                     pa.array(columns[3], pa.string())],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 35,
                    depth: int = 2, cells_per_window: int = 8, cell_bits: int = 24, bucket_bytes: int = 8 << 20,
                    exact_per_shard: int = 1 << 20, keep_text: bool = True) -> DataFrame:
    """Removes each word covered by a window that also starts anywhere else.

    Returns one row per input row: ``id``, ``n_words``, ``n_removed``,
    ``kept_sha256`` and ``kept_text`` (null with ``keep_text=False``).  Words
    are runs of anything but the six ASCII white-space bytes, unchanged.
    Windows are judged on the input, not on what is left.

    Null, empty and white-space texts have no words and an empty kept text;
    a text of fewer than ``width`` words has no window and stays whole.  Rows
    with equal ids (or a null id) are separate documents: repeated rows
    remove one another's windows.  Other columns are ignored, whatever their
    names.  An empty table gives an empty result.

    ``bucket_bytes`` is the text one task holds, ``cell_bits`` the size of a
    sketch shard (one byte a cell in the merging task); both can be raised on
    larger executors to lower the number of lists exchanged.
    """
    total = text_bytes(docs, text_col)
    n_buckets = parts(total, bucket_bytes)
    # a word takes two bytes at least, and about six in prose
    windows = total // 6
    n_shards = parts(windows * cells_per_window, 1 << cell_bits)
    x_shards = parts(windows, 4 * exact_per_shard)
    frame = bucketed(docs, id_col, text_col, n_buckets)

    def sketch(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys = _windows(group, width)[-1]
        return repeats.table(repeats.sketch_send(keys, key[0].as_py(), depth, n_shards, cell_bits), repeats.SEND_SCHEMA)

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return repeats.sketch_merge(group, cell_bits)

    def estimated(group: pa.Table, reply: pa.Table):
        parsed = _windows(group, width)
        found = repeats.replies_of(reply, tuple(range(depth)))
        return parsed, np.flatnonzero(repeats.sketch_repeated(parsed[-1], found, depth, n_shards, cell_bits))

    def send_exact(key: tuple[pa.Scalar, ...], group: pa.Table, reply: pa.Table) -> pa.Table:
        parsed, hit = estimated(group, reply)
        *_, hashes, at, window = parsed
        rows = []
        if len(hit):
            _, _, keys, second, count = _exact_groups(hashes, at, window, width, hit)
            for shard, a, b in repeats.shard_ranges(tb.scale(keys, x_shards)):
                rows.append((shard, key[0].as_py(), _EXACT, keys[a:b].tobytes() + second[a:b].tobytes(),
                             repeats.bits(count[a:b] > 1)))
        return repeats.table(rows, repeats.SEND_SCHEMA)

    def merge_exact(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _merge_exact(group)

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table, reply: pa.Table) -> pa.Table:
        parsed, hit = estimated(group, reply)
        *_, start, end, first, hashes, at, window = parsed
        gone = np.zeros(len(hashes), dtype=bool)
        if len(hit):
            order, back, keys, *_ = _exact_groups(hashes, at, window, width, hit)
            found = repeats.replies_of(reply, (_EXACT,))
            many = np.zeros(len(keys), dtype=bool)
            for shard, a, b in repeats.shard_ranges(tb.scale(keys, x_shards)):
                many[a:b] = repeats.unbits(found[_EXACT, shard][1], b - a)
            starts = np.sort(at[hit[order[many[back]]]])
            gone = tb.covered(starts, width, len(hashes))
        return _results(group, parsed, gone, keep_text)

    by_bucket = frame.groupBy("bucket")
    estimate = by_bucket.applyInArrow(sketch, repeats.SEND).groupBy("shard").applyInArrow(merge, repeats.REPLY)
    exact = (by_bucket.cogroup(estimate.groupBy("bucket")).applyInArrow(send_exact, repeats.SEND)
             .groupBy("shard").applyInArrow(merge_exact, repeats.REPLY))
    return by_bucket.cogroup(estimate.unionByName(exact).groupBy("bucket")).applyInArrow(finish, RESULT)
