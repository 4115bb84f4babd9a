"""Repeated byte strings by bucket-pointer refinement.

Every byte covered by a ``width``-byte string that also starts earlier
(smaller id, or same document and smaller start) is removed.

Sorting all suffixes would move every byte position several times.  Two equal
``width``-byte strings contain the same *anchor*: the q-gram with the smallest
hash among those that start in the string (leftmost on ties).  So each string
belongs to one anchor, and a sorted list of anchors, about one in thirty
positions, decides for all of them:

1. **Initial buckets** by the anchor's q-gram.  Buckets of one member (by a
   sketch that never underestimates) are finished: nothing in them repeats.
2. **Refinement** of the others by the identifier of the bytes at the later
   and earlier offsets that the anchor's strings span.  Members of one refined
   bucket have the same strings; all but the first are repeats, and the
   bucket's pointer is its first member.
3. Where a q-gram bucket fell into several refined buckets, their first
   members only (the updated pointers) are refined again, by the identifier of
   each string itself; a string is a repeat where its bucket has an earlier
   member.

Each step shuffles packed lists (``repeats``), one entry per distinct
identifier and bucket of documents; the text is shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ibex.llm import repeats, textbytes as tb
from ibex.llm.frames import bucketed, parts, text_bytes

_U = np.uint64
_GRAM, _REGION, _STRING = 0, 5, 6  # kinds of the lists exchanged
_NO_ID = -(1 << 63)

RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _ordered(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents by id (null first), rows of one id by text."""
    docs = docs.sort_by([("id", "ascending"), ("text", "ascending")]) if len(docs) > 1 else docs
    ids = docs.column("id").fill_null(_NO_ID).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")  # sort_by puts nulls last
    return docs.take(pa.array(order)), ids[order]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    block = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(block, axis=1).ravel()
    suffix = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - w + 1], prefix[w - 1:n])


def _anchors(offsets: np.ndarray, data: np.ndarray, width: int, gram: int):
    """The anchors of all strings: position, first and last string start that
    it stands for, identifier of its q-gram and of the bytes spanned."""
    n = len(data) - width + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, np.empty(0, dtype=_U), np.empty(0, dtype=_U)
    valid = tb.window_owner(offsets, width, n)
    spread, low = width - gram + 1, _U((1 << 24) - 1)
    found = []
    for a in range(0, n, tb.CHUNK):
        b = min(a + tb.CHUNK, n)
        starts = np.flatnonzero(valid[a:b])
        if not len(starts):
            continue
        running = tb.BYTES.running(tb.BYTE_VALUE[data[a:b + width - 1]])
        ids = tb.BYTES.windows(running, gram)
        smallest = _sliding_min((ids & ~low) | np.arange(len(ids), dtype=_U), spread)
        at = (smallest[starts] & low).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(new)
        p, s0, s1 = at[begin], starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
        region = tb.BYTES.slices(running, s0, s1 + width)
        region = tb.mix(region ^ (((p - s0).astype(_U) << _U(32)) | (s1 - s0).astype(_U)))
        # anchors have small hashes: mixed again, they spread evenly over shards
        found.append((p + a, s0 + a, s1 + a, tb.mix(ids[p] + _U(1)), region))
    if not found:
        return _anchors(offsets, data[:0], width, gram)
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(payload: bytes, kinds: tuple) -> list[np.ndarray]:
    n = len(payload) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(payload[at:at + size], dtype=k))
        at += size
    return out


#: Per kind: two identifiers, id, position in the document.
_ENTRY = {_REGION: (_U, _U, np.int64, np.uint32), _STRING: (_U, np.uint32, np.int64, np.uint32)}


def _merge_first(sent: pa.Table) -> pa.Table:
    """Per entry of one shard: is there an earlier member of its refined
    bucket (payload), and did its first bucket fall into several (flags)?"""
    payload = [x.as_py() for x in sent.column("payload")]
    lists = [_unpack(x, _ENTRY[kind]) for x, kind in zip(payload, sent.column("kind").to_pylist())]
    first, second, ids, at = (np.concatenate(c) for c in zip(*lists))
    order = np.lexsort((at, ids, second, first))
    f, s = first[order], second[order]
    new_first = np.ones(len(order), dtype=bool)
    new_first[1:] = f[1:] != f[:-1]
    new = new_first.copy()
    new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new_first) - 1
    several = np.bincount(group, weights=new) > 1
    repeat, split = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
    repeat[order] = ~new
    split[order] = several[group]
    rows, end = [], 0
    for bucket, shard, kind, entries in zip(*(sent.column(c).to_pylist() for c in ("bucket", "shard", "kind")), lists):
        begin, end = end, end + len(entries[0])
        rows.append((bucket, shard, kind, repeats.bits(repeat[begin:end]), repeats.bits(split[begin:end])))
    return repeats.table(rows, repeats.REPLY_SCHEMA)


class _Firsts:
    """Distinct pairs of identifiers among entries in document order, with the
    first entry of each."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.order = np.lexsort((second, first))  # stable: document order within a pair
        f, s = first[self.order], second[self.order]
        new = np.ones(len(f), dtype=bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        self.group = np.cumsum(new, dtype=np.int32) - 1
        self.lead = self.order[np.flatnonzero(new)]
        self.is_lead = np.zeros(len(f), dtype=bool)
        self.is_lead[self.lead] = True
        self.first, self.second = first[self.lead], second[self.lead]

    def send(self, bucket: int, kind: int, n_shards: int, ids: np.ndarray, at: np.ndarray) -> list[tuple]:
        return [(shard, bucket, kind, _pack(self.first[a:b], self.second[a:b], ids[self.lead[a:b]],
                                            at[self.lead[a:b]].astype(np.uint32)), b"")
                for shard, a, b in repeats.shard_ranges(tb.scale(self.first, n_shards))]

    def answers(self, replies: dict, kind: int, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Per entry: it has an earlier equal; it leads a pair whose first
        bucket fell into several."""
        repeat, split = (np.zeros(len(self.lead), dtype=bool) for _ in range(2))
        for shard, a, b in repeats.shard_ranges(tb.scale(self.first, n_shards)):
            payload, flags = replies[kind, shard]
            repeat[a:b], split[a:b] = repeats.unbits(payload, b - a), repeats.unbits(flags, b - a)
        out = np.empty(len(self.order), dtype=bool)
        out[self.order] = repeat[self.group]
        ambiguous = np.zeros(len(self.order), dtype=bool)
        ambiguous[self.lead] = split & ~repeat
        return out | ~self.is_lead, ambiguous


class _Plan:
    """What the steps share: sizes, and the state that a bucket's task
    rebuilds from its text and the answers so far."""

    def __init__(self, width: int, gram: int, cell_bits: int, gram_shards: int, shards: int,
                 string_shards: int):
        self.width, self.gram, self.cell_bits = width, gram, cell_bits
        self.gram_shards, self.shards, self.string_shards = gram_shards, shards, string_shards

    def load(self, docs: pa.Table):
        docs, ids = _ordered(docs)
        offsets, data = tb.buffers(docs.column("text"))
        return docs, ids, offsets, data, _anchors(offsets, data, self.width, self.gram)

    def where(self, ids, offsets, position):
        """(id, start in the document) of byte positions of the bucket."""
        row = np.searchsorted(offsets, position, "right") - 1
        return ids[row], position - offsets[row]

    def survivors(self, anchors, replies: dict):
        keep = np.flatnonzero(repeats.sketch_repeated(anchors[3], replies, 1, self.gram_shards, self.cell_bits))
        return [x[keep] for x in anchors]

    def strings(self, data, s0, s1, gram):
        """(start, identifier, identifier of the q-gram) of each string that
        starts in one of the ranges."""
        starts, keys, grams = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=_U)], [np.empty(0, dtype=np.uint32)]
        step = 1 << 12  # ranges hashed at a time
        for i in range(0, len(s0), step):
            a, b = s0[i:i + step], s1[i:i + step]
            size = b - a + self.width
            bounds = np.append(0, np.cumsum(size))
            region = np.repeat(a - bounds[:-1], size) + np.arange(bounds[-1])
            key = tb.BYTES.windows(tb.BYTES.running(tb.BYTE_VALUE[data[region]]), self.width)
            ok = np.flatnonzero(tb.window_owner(bounds, self.width, len(key)))
            starts.append(region[ok].astype(np.int32))
            keys.append(key[ok])
            grams.append(np.repeat((gram[i:i + step] >> _U(32)).astype(np.uint32), b - a + 1))
        return np.concatenate(starts), np.concatenate(keys), np.concatenate(grams)

    def refined(self, data, anchors, replies: dict):
        """Step 2 answered: starts known to repeat as ranges, and the pairs
        (string, its q-gram) still open with their starts."""
        p, s0, s1, gram, region = self.survivors(anchors, replies)
        pairs = _Firsts(gram, region)
        repeat, ambiguous = pairs.answers(replies, _REGION, self.shards)
        start, key, open_gram = self.strings(data, s0[ambiguous], s1[ambiguous], gram[ambiguous])
        return s0[repeat], s1[repeat], start, _Firsts(key, open_gram)


def _results(docs: pa.Table, offsets, data, gone: np.ndarray, keep_bytes: bool) -> pa.Table:
    total = np.zeros(len(gone) + 1, dtype=np.int32)  # a bucket is far below 2**31 bytes
    np.cumsum(gone, out=total[1:])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = gone[edge]
    spans = np.zeros(len(gone) + 1, dtype=np.int32)
    np.cumsum(begin, out=spans[1:])
    kept = [data[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else data[a:b].tobytes()
            for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.table([docs.column("id"), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()),
                     pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                     pa.array(kept if keep_bytes else [None] * len(kept), pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 100,
                 gram: int = 40, cells_per_anchor: int = 32, cell_bits: int = 24, bucket_bytes: int = 4 << 20,
                 entries_per_shard: int = 1 << 19, keep_bytes: bool = True) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts
    earlier; strings are judged on the input and never cross documents.

    Returns one row per input row: ``id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (the
    remaining bytes, which may cut a character; null with
    ``keep_bytes=False``).

    A null text counts as empty; a text under ``width`` bytes stays whole.  A
    null id comes before every id.  Rows of one id are separate documents,
    ordered by text, so of repeated rows the first stays.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    if not 0 < gram <= width:
        raise ValueError("gram must be between 1 and width")
    total = text_bytes(docs, text_col)
    anchors = 2 * total // (width - gram + 2) + 1
    plan = _Plan(width, gram, cell_bits, parts(anchors * cells_per_anchor, 1 << cell_bits),
                 parts(anchors, 2 * entries_per_shard), parts(total, 2 * entries_per_shard))
    frame = bucketed(docs, id_col, text_col, parts(total, bucket_bytes))

    def initial(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        grams = plan.load(group)[-1][3]
        return repeats.table(repeats.sketch_send(grams, key[0].as_py(), 1, plan.gram_shards, cell_bits), repeats.SEND_SCHEMA)

    def merge_initial(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return repeats.sketch_merge(group, cell_bits)

    def refine(key: tuple[pa.Scalar, ...], group: pa.Table, reply: pa.Table) -> pa.Table:
        _, ids, offsets, data, found = plan.load(group)
        rows = []
        if len(found[0]):
            p, _, _, grams, region = plan.survivors(found, repeats.replies_of(reply, (_GRAM,)))
            doc, at = plan.where(ids, offsets, p)
            rows = _Firsts(grams, region).send(key[0].as_py(), _REGION, plan.shards, doc, at)
        return repeats.table(rows, repeats.SEND_SCHEMA)

    def refine_again(key: tuple[pa.Scalar, ...], group: pa.Table, reply: pa.Table) -> pa.Table:
        _, ids, offsets, data, found = plan.load(group)
        rows = []
        if len(found[0]):
            *_, start, pairs = plan.refined(data, found, repeats.replies_of(reply, (_GRAM, _REGION)))
            doc, at = plan.where(ids, offsets, start)
            rows = pairs.send(key[0].as_py(), _STRING, plan.string_shards, doc, at)
        return repeats.table(rows, repeats.SEND_SCHEMA)

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return _merge_first(group)

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table, reply: pa.Table) -> pa.Table:
        docs, _, offsets, data, found = plan.load(group)
        gone = np.zeros(len(data), dtype=bool)
        if len(found[0]):
            replies = repeats.replies_of(reply, (_GRAM, _REGION, _STRING))
            s0, s1, start, pairs = plan.refined(data, found, replies)
            repeat, _ = pairs.answers(replies, _STRING, plan.string_shards)
            cover = np.zeros(len(data) + 1, dtype=np.int32)
            for first, last in ((s0, s1), (start[repeat], start[repeat])):
                np.add.at(cover, first, 1)
                np.add.at(cover, last + width, -1)
            gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        return _results(docs, offsets, data, gone, keep_bytes)

    by_bucket = frame.groupBy("bucket")
    first = by_bucket.applyInArrow(initial, repeats.SEND).groupBy("shard").applyInArrow(merge_initial, repeats.REPLY)
    second = (by_bucket.cogroup(first.groupBy("bucket")).applyInArrow(refine, repeats.SEND)
              .groupBy("shard").applyInArrow(merge, repeats.REPLY))
    so_far = first.unionByName(second)
    third = (by_bucket.cogroup(so_far.groupBy("bucket")).applyInArrow(refine_again, repeats.SEND)
             .groupBy("shard").applyInArrow(merge, repeats.REPLY))
    return by_bucket.cogroup(so_far.unionByName(third).groupBy("bucket")).applyInArrow(finish, RESULT)
