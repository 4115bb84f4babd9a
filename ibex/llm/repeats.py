"""Which keys occur more than once, without shuffling the keys one by one.

Documents are dealt into buckets by a hash of their id.  A bucket's task
turns its keys (64-bit hashes of windows) into one packed list per *shard*
(a range of hash values); one task per shard merges the lists of all
buckets and answers each with one bit per entry, in the order sent.  The
bucket's next task recomputes its list and reads the bits.  A key that
occurs in a third of all documents reaches its shard once per bucket, so no
shard grows with a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ibex.llm import textbytes as tb

_U = np.uint64

SEND = "shard int, bucket int, kind int, payload binary, flags binary"
REPLY = "bucket int, shard int, kind int, payload binary, flags binary"

SEND_SCHEMA = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()),
                         ("payload", pa.binary()), ("flags", pa.binary())])
REPLY_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()),
                          ("payload", pa.binary()), ("flags", pa.binary())])


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


class Groups:
    """Equal keys of one bucket: sorted distinct keys, how often each occurs,
    and the way back to the positions."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        ordered = keys[self.order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.begin = np.flatnonzero(new)
        self.keys = ordered[self.begin]
        self.group = np.cumsum(new) - 1
        self.count = np.diff(np.append(self.begin, len(keys)))

    def spread(self, per_key: np.ndarray) -> np.ndarray:
        """A value per distinct key, given to every position of the key."""
        out = np.empty(len(self.order), dtype=per_key.dtype)
        out[self.order] = per_key[self.group]
        return out


def shard_ranges(shards: np.ndarray):
    """(shard, from, to) of each run in a sorted array of shard numbers."""
    if len(shards) == 0:
        return
    at = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    for a, b in zip(at, np.append(at[1:], len(shards))):
        yield int(shards[a]), int(a), int(b)


# --- count-min sketch ---------------------------------------------------------

#: Multipliers that derive the cell rows from one hash (any odd numbers).
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def cells(keys: np.ndarray, row: int, n_shards: int, cell_bits: int) -> np.ndarray:
    """Cell of each key in one row of the sketch: shard above, cell below."""
    shard = tb.scale(keys, n_shards).astype(_U)
    return (shard << _U(cell_bits)) | (tb.mix(keys * _U(_ROWS[row])) >> _U(64 - cell_bits))


def sketch_send(keys: np.ndarray, bucket: int, depth: int, n_shards: int, cell_bits: int) -> list[tuple]:
    """One bucket's partial sketch: for each shard and row the touched cells
    as gaps, and a bit for those with a count over one."""
    rows = []
    for row in range(depth):
        groups = Groups(cells(keys, row, n_shards, cell_bits))
        many = groups.count > 1
        for shard, a, b in shard_ranges((groups.keys >> _U(cell_bits)).astype(np.int64)):
            cell = groups.keys[a:b] & _U((1 << cell_bits) - 1)
            gaps = np.diff(cell, prepend=_U(0))
            rows.append((shard, bucket, row, tb.varint(gaps), bits(many[a:b])))
    return rows


def sketch_merge(sent: pa.Table, cell_bits: int) -> pa.Table:
    """Adds the partial sketches of one shard (counts saturate at two) and
    answers every bucket: a bit per touched cell, set where the sum is over
    one."""
    out = []
    kinds = sent.column("kind").to_numpy()
    buckets, shards = sent.column("bucket").to_numpy(), sent.column("shard").to_numpy()
    payload, flags = sent.column("payload"), sent.column("flags")
    for kind in np.unique(kinds):
        total = np.zeros(1 << cell_bits, dtype=np.uint8)
        rows = np.flatnonzero(kinds == kind)
        for i in rows:
            cell = np.cumsum(tb.unvarint(payload[i].as_py())).astype(np.int64)
            more = 1 + unbits(flags[i].as_py(), len(cell))
            total[cell] = np.minimum(total[cell] + more, 2)
        for i in rows:
            cell = np.cumsum(tb.unvarint(payload[i].as_py())).astype(np.int64)
            out.append((int(buckets[i]), int(shards[i]), int(kind), b"", bits(total[cell] > 1)))
    return table(out, REPLY_SCHEMA)


def sketch_repeated(keys: np.ndarray, replies: dict, depth: int, n_shards: int, cell_bits: int) -> np.ndarray:
    """Which keys the merged sketch estimates at two or more: a superset of
    the repeated ones.  ``replies`` maps (kind, shard) to (payload, flags)."""
    out = np.ones(len(keys), dtype=bool)
    for row in range(depth):
        groups = Groups(cells(keys, row, n_shards, cell_bits))
        many = np.zeros(len(groups.keys), dtype=bool)
        for shard, a, b in shard_ranges((groups.keys >> _U(cell_bits)).astype(np.int64)):
            many[a:b] = unbits(replies[row, shard][1], b - a)
        out &= groups.spread(many)
    return out


def replies_of(reply: pa.Table, kinds: tuple[int, ...]) -> dict:
    """(kind, shard) -> (payload, flags), of the kinds asked for."""
    out = {}
    for shard, kind, payload, flags in zip(*(reply.column(c).to_pylist() for c in ("shard", "kind", "payload", "flags"))):
        if kind in kinds:
            out[kind, shard] = (payload, flags)
    return out
