"""A trie of conversation prefixes, as double arrays over sorted shards.

Conversations become paths of turn digests; equal ones are counted first, so a
conversation that many share is one path.  The paths are range-partitioned in
their own order: a partition holds a contiguous piece of the trie, and a very
common first turn is cut over as many partitions as its paths need.  Every
partition is worked off in blocks of a bounded number of turns.  In a block
the turns get dense ids, the trie is packed into BASE and CHECK arrays (the
child of state ``s`` by turn ``c`` is ``t = BASE[s] + c``, where ``CHECK[t]``
must be ``s``), and all paths are walked through the arrays for the nodes.

Only prefixes of a block's first and last path can also lie in other blocks.
Each block counts a shared node only if no earlier block has it, which the
length of the prefix shared with the path before the block tells.  So all
numbers of shared nodes add up, and one small aggregation merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ibex.llm.frames import checkpointed

#: Ids of conversations that end at one node, in one row (see ``_ends``).
IDS_PER_CHUNK = 4096
#: Shared nodes that are broadcast to their children (about 100 bytes each).
BROADCAST_NODES = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``conv`` and ``path``, an array of (turn, digest, size) in order of the
    turn (null first; equal turns by digest).  A null role or text is empty; a
    null conversation id belongs to no conversation.  Texts stay where they
    are read: a turn is shuffled as 32 characters and the number of its text's
    code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return (turns.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("long").alias("conv"),
                    F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("turn"))
            .groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("path")))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct path from its chunks, which come one after the
    other in order of the ids: the digest is fed chunk by chunk."""
    open_ = None
    for batch in batches:
        rows = []
        for key, ids, n, least, path, sizes in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "n", "least", "path", "sizes"))):
            if open_ and open_[0] == key:
                open_[1].update(b",")
                open_[2] += n
                open_[3] = min(open_[3], least)
            else:
                if open_:
                    rows.append(open_)
                open_ = [key, hashlib.sha256(), n, least, path, sizes]
            open_[1].update(ids.encode())
        yield _paths(rows)
    yield _paths([open_] if open_ else [])


def _paths(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[4] for r in rows], pa.list_(pa.string())), pa.array([r[5] for r in rows], pa.list_(pa.int64())),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
         pa.array([r[1].hexdigest() for r in rows], pa.string())], names=["path", "sizes", "n", "least", "ends"])


def distinct_paths(paths: DataFrame) -> DataFrame:
    """``path`` (digests), ``sizes``, ``n`` conversations, the ``least`` id and
    ``ends``, the digest of all ids.  Ids are gathered in chunks of at most
    ``IDS_PER_CHUNK`` and fed to the digest as a stream, so a path that a third
    of all conversations share costs a stream of chunks, not a list."""
    rows = paths.select("conv", F.col("path.digest").alias("path"), F.col("path.size").alias("sizes"))
    rows = rows.withColumn("key", F.sha2(F.array_join("path", ","), 256))
    chunks = rows.groupBy("key", F.floor(F.col("conv") / IDS_PER_CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv")).alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"),
        F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    chunks = chunks.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    return (chunks.repartition("key").sortWithinPartitions("key", "chunk")
            .mapInArrow(_ends, "path array<string>, sizes array<long>, n long, least long, ends string"))


class DoubleArray:
    """BASE and CHECK over paths of dense ids (``cells``, path ``i`` from
    ``begin[i]`` to ``begin[i + 1]``).  State 0 is the root; a base may be
    negative."""

    def __init__(self, cells: np.ndarray, begin: np.ndarray):
        room = 2 * len(cells) + 16
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0
        self._low = self._top = 1  # no free slot below; no used slot from here on
        state = np.zeros(len(begin) - 1, dtype=np.int64)
        length = np.diff(begin)
        alive = np.flatnonzero(length > 0)
        depth = 0
        while len(alive):
            turn = cells[begin[alive] + depth]
            pair, which = np.unique(np.column_stack([state[alive], turn]), axis=0, return_inverse=True)
            self._place(pair[:, 0], pair[:, 1])
            state[alive] = self.base[pair[:, 0]][which.ravel()] + turn
            depth += 1
            alive = alive[length[alive] > depth]

    def _reserve(self, upto: int):
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))

    def _place(self, parent: np.ndarray, turn: np.ndarray):
        """Slots for a level's children (sorted by parent, then turn)."""
        new = np.append(True, parent[1:] != parent[:-1])
        begin = np.append(np.flatnonzero(new), len(parent))
        count = np.diff(begin)
        for k in np.flatnonzero(count > 1):  # families first, only children fill what is left
            self._family(int(parent[begin[k]]), turn[begin[k]:begin[k + 1]])
        alone = begin[:-1][count == 1]
        if len(alone):
            self._reserve(self._top + len(alone))
            free = self._low + np.flatnonzero(self.check[self._low:self._top + len(alone)] < 0)[:len(alone)]
            self.base[parent[alone]] = free - turn[alone]
            self.check[free] = parent[alone]
            self._low, self._top = int(free[-1]) + 1, max(self._top, int(free[-1]) + 1)

    def _family(self, parent: int, turn: np.ndarray, tries: int = 16):
        """The lowest place where all children fit, among a few free slots,
        else above all used slots."""
        offsets = turn - turn[0]
        self._reserve(self._top + int(offsets[-1]) + 1)
        free = self._low + np.flatnonzero(self.check[self._low:min(self._low + 8 * tries, self._top)] < 0)[:tries]
        at = next((f for f in free.tolist() if f + offsets[-1] < len(self.check) and (self.check[f + offsets] < 0).all()), self._top)
        self.base[parent] = at - turn[0]
        self.check[at + offsets] = parent
        self._top = max(self._top, at + int(offsets[-1]) + 1)

    def walk(self, cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The state after each turn of each path; -1 from where a path leaves
        the trie."""
        out = np.full(len(cells), -1, dtype=np.int64)
        state = np.zeros(len(begin) - 1, dtype=np.int64)
        length = np.diff(begin)
        alive, depth = np.flatnonzero(length > 0), 0
        while len(alive):
            to = self.base[state[alive]] + cells[begin[alive] + depth]
            inside = (to > 0) & (to < len(self.check))
            inside &= self.check[np.where(inside, to, 0)] == state[alive]
            alive, to = alive[inside], to[inside]
            state[alive] = out[begin[alive] + depth] = to
            depth += 1
            alive = alive[length[alive] > depth]
        return out


_NODE = pa.schema([("shared", pa.string()), ("parent_shared", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved_tokens", pa.int64()), ("ends", pa.string())])
NODE = ("shared string, parent_shared string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends string")


def common(a: list, b: list) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def prefix_keys(path: list[str], upto: int) -> list[str]:
    """Names of the path's prefixes of 0 to ``upto`` turns."""
    out = [NOTHING]
    for digest in path[:upto]:
        out.append(hashlib.sha256((out[-1] + digest).encode()).hexdigest())
    return out


def block_nodes(paths: list[tuple], before: int, after: int) -> pa.RecordBatch:
    """All nodes of a block of sorted distinct paths (digests, sizes, n, least,
    ends).  ``before`` and ``after`` are the lengths of the prefixes that the
    first and the last path share with their neighbours outside (-1: none).

    A node in several blocks has its name in ``shared``, and this block's part
    of each number; the others are complete, but for the parent's id where the
    parent is shared (``parent_shared``)."""
    begin = np.append(0, np.cumsum([len(p[0]) for p in paths])).astype(np.int64)
    turns = pa.array([d for p in paths for d in p[0]], pa.string()).dictionary_encode()
    cells = turns.indices.to_numpy().astype(np.int64)
    trie = DoubleArray(cells, begin)
    at = trie.walk(cells, begin)
    length, room = np.diff(begin), len(trie.check)
    n, least = (np.array([p[k] for p in paths], dtype=np.int64) for k in (2, 3))
    top = np.iinfo(np.int64).max

    members, smallest, depth, size = (np.full(room, v, dtype=np.int64) for v in (0, top, 0, 0))
    members[0], smallest[0] = n.sum(), least.min()
    np.add.at(members, at, np.repeat(n, length))
    np.minimum.at(smallest, at, np.repeat(least, length))
    depth[at] = np.arange(len(cells)) - np.repeat(begin[:-1], length) + 1
    size[at] = np.array([s for p in paths for s in p[1]], dtype=np.int64)
    nodes = np.flatnonzero(trie.check >= 0)
    parent = trie.check

    def along(k: int, upto: int) -> list[int]:
        """States of the prefixes of path ``k`` with at most ``upto`` turns."""
        return [0, *at[begin[k]:begin[k] + upto].tolist()] if upto >= 0 else []

    first, last = along(0, before), along(len(paths) - 1, after)
    mine = np.ones(room, dtype=bool)
    mine[first] = False  # an earlier block counts them
    inner = nodes[1:]
    children = np.bincount(parent[inner], minlength=room)
    owned = np.bincount(parent[inner[mine[inner]]], minlength=room)
    leaves = np.zeros(room, dtype=np.int64)
    leaves[nodes[children[nodes] == 0]] = 1
    if after == length[-1]:  # the last path goes on in the next block
        leaves[last[-1]] = 0
    saved = members * size - np.where(mine, size, 0)
    for d in range(int(depth.max()), 0, -1):
        level = inner[depth[inner] == d] if d < 64 else np.flatnonzero((trie.check >= 0) & (depth == d))
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    ends = [NOTHING] * room
    for k, path in enumerate(paths):
        ends[at[begin[k + 1] - 1] if length[k] else 0] = path[4]
    name = dict(zip(first, prefix_keys(paths[0][0], before)))
    name |= dict(zip(last, prefix_keys(paths[-1][0], after)))
    order = nodes.tolist()
    up = parent[nodes].tolist()
    root = pa.array(nodes == 0)
    whose = pa.array([None if v == 0 or u in name else int(smallest[u]) for v, u in zip(order, up)], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([name.get(v) for v in order], pa.string()),
         pa.array([name.get(u) if v else None for v, u in zip(order, up)], pa.string()),
         pa.array(smallest[nodes]), pa.array(depth[nodes]), whose, pa.array(members[nodes]), pa.array(owned[nodes]),
         pa.array(leaves[nodes]), pa.array(saved[nodes]), pa.array([ends[v] for v in order], pa.string())], schema=_NODE)


def _blocks(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[int, int]], block_turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition of sorted paths, block by block."""
    block, turns, before, after = [], 0, -1, -1
    for batch in batches:
        for shard, *path in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "n", "least", "ends"))):
            if not block:
                before, after = edges[shard]
            elif turns + len(path[0]) > block_turns:
                shared = common(block[-1][0], path[0])
                yield block_nodes(block, before, shared)
                block, turns, before = [], 0, shared
            block.append(path)
            turns += len(path[0]) + 1
    if block:
        yield block_nodes(block, before, after)


def _edges(paths: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the lengths of the prefixes that its first and last path
    share with the neighbouring shards' (two numbers a partition)."""
    line = Window.orderBy("shard")
    ends = paths.groupBy("shard").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))

    def shared(a, b):
        return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1, F.lit(-1)).cast("int")

    rows = (ends.select("shard", "lo", "hi", F.lag("hi").over(line).alias("past"), F.lead("lo").over(line).alias("next"))
            .select("shard", shared(F.col("past"), F.col("lo")).alias("before"), shared(F.col("hi"), F.col("next")).alias("after")))
    return {r.shard: (r.before, r.after) for r in rows.collect()}


def trie_nodes(paths: DataFrame, *, block_turns: int = 200_000, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """The nodes of all prefixes of ``paths`` (``conv``, ``path``, one row per
    conversation, the path possibly empty), from the root (depth 0) down:
    ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  (conv_id, depth) names a
    node.  No conversation, no node."""
    ordered = distinct_paths(paths).repartitionByRange("path").sortWithinPartitions("path")
    ordered = checkpointed(ordered.withColumn("shard", F.spark_partition_id()))
    edges = _edges(ordered)
    nodes = checkpointed(ordered.select("shard", "path", "sizes", "n", "least", "ends")
                         .mapInArrow(lambda batches: _blocks(batches, edges, block_turns), NODE))
    merged = nodes.where("shared IS NOT NULL").groupBy("shared").agg(
        F.max("parent_shared").alias("parent_shared"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max(F.when(F.col("ends") != NOTHING, F.col("ends"))).alias("ends"))
    merged = checkpointed(merged.withColumn("ends", F.coalesce("ends", F.lit(NOTHING))))
    above = merged.select(F.col("shared").alias("parent_shared"), F.col("conv_id").alias("found"))
    if merged.count() <= broadcast_nodes:
        above = F.broadcast(above)
    every = nodes.where("shared IS NULL").unionByName(merged)
    below = every.where("parent_shared IS NOT NULL").join(above, "parent_shared").withColumn("parent_conv_id", F.col("found"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return every.where("parent_shared IS NULL").select(*out).unionByName(below.select(*out))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", **options) -> DataFrame:
    """The prefix trie of all conversations of a table of turns.

    Nulls, ties and clashes: see :func:`turn_paths`; repeated rows are turns of
    their own; other columns are ignored.  A conversation is the unit of work:
    its digests (about 60 bytes a turn) lie in one task, its texts don't.  An
    empty table gives an empty result.
    """
    return trie_nodes(turn_paths(turns, conv_col, turn_col, role_col, text_col), **options)
