"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct ``shingle``-word shingles.  Documents
with equal sets form a class, and one signature per class (``coordinates``
minwise tokens) goes on.  Several independent trees branch the classes: at
its root a tree chooses one coordinate of its own, at each node below
``branches`` of them, and a class goes to the child named by the minwise token
it has there.  Two sets of similarity 0.75 share each chosen token with that
probability, so every tree keeps most pairs together; eight roots together
miss such a pair with probability 2 in 10**5, and more similar pairs less.

1. In the nodes of a few roots every class is paired with the class most like
   it, and with the class most like all (the original, in a group of copies).
   These few pairs already connect most groups of copies, however large.
2. Nodes whose classes are all connected are finished.  Other nodes of up to
   ``node_limit`` classes are compared exhaustively; pairs that are connected
   already, or that another exhaustive node compares, are skipped.  Larger
   nodes branch again, down to ``max_depth``.  What is still large there is
   one group of copies, or many classes with a shared passage: its rows are
   dealt to blocks of about ``block_rows``, and a task compares two blocks, so
   that each pair of blocks is compared once.  (Branching on would cost more:
   two children with a part s of the node each have 2 s**2 of its pairs, and
   more than all of them if s is over 0.71.)  The largest component has blocks
   of its own, which are not compared among themselves.  Pairs whose signatures agree are
   looked at once more through sketches of their sets (the ``sketch`` smallest
   32-bit hashes: the whole set, for most documents), so that few pairs leave a
   node that are no links.

Every link is confirmed on the full sets.  Sets and sketches of the documents
involved are made where the texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import textbytes as tb
from ibex.llm.components import connected_components
from ibex.llm.frames import checkpointed, parts, text_of, tidy, without_rows

_U = np.uint64
#: Bits of the filter that spares documents of no candidate pair (2 MB).
_FILTER_BITS = 1 << 24
_SALT = _U(0x51ED270B7A1F39D3)


def shingle_sets(column, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased).  A text
    with fewer words has one shingle, its whole sequence; one without words
    has none."""
    offsets, data = tb.buffers(column)
    _, _, first, hashes = tb.word_hashes(offsets, tb.LOWER[data])
    running = tb.WORDS.running(hashes)
    window = tb.WORDS.windows(running, shingle) ^ tb.mix(np.array([shingle], dtype=_U))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(window[a:b - shingle + 1]))
        elif b > a:
            out.append(tb.WORDS.slices(running, np.array([a]), np.array([b])) ^ tb.mix(np.array([b - a], dtype=_U)))
        else:
            out.append(np.empty(0, dtype=_U))
    return out


#: Bytes of text whose sets are made together.
BATCH_BYTES = 1 << 19


def _multipliers(n: int) -> np.ndarray:
    return tb.mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


#: A pair with a smaller share of the first coordinates in common is ruled out
#: (over five standard deviations under 0.75), and how many coordinates those are.
_QUICK, _QUICK_SHARE = 64, 0.45
#: Roots whose nodes give the first pairs; the exhaustive step looks at all.
_FIRST_ROOTS = 3


def minwise(sets: list[np.ndarray], coordinates: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens of each set (none is empty): the first ``whole`` as 32
    bits, the others as the low byte of the token."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    begin = np.cumsum(size) - size
    first = np.empty((len(sets), whole), dtype=np.uint32)
    rest = np.empty((len(sets), coordinates - whole), dtype=np.uint8)
    for i, m in enumerate(_multipliers(coordinates)):
        token = np.minimum.reduceat((flat * m) >> _U(32), begin)
        if i < whole:
            first[:, i] = token
        else:
            rest[:, i - whole] = tb.mix(token) & _U(255)
    return first, rest


def _children(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(node ^ (coordinate.astype(_U) * _SALT)) + token.astype(_U) * _U(0x9E3779B97F4A7C15))


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many columns each row of ``a`` equals each row of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for c in range(a.shape[1]):
        out += a[:, c][:, None] == b[:, c][None, :]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Sketches:
    """A column of sketches in another order, each read when it is asked for."""

    def __init__(self, column: pa.ChunkedArray, order: np.ndarray):
        self.column, self.order = column, order

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Sketches(self.column, self.order[at])
        return self.column[int(self.order[at])].as_buffer()


class NearDedup:
    """The join's parameters; see :func:`near_dedup`."""

    def __init__(self, shingle=5, percent=75, coordinates=256, trees=8, branches=2, node_limit=2048, max_depth=6,
                 estimate=0.63, sketch=512, sketch_estimate=0.665, pairs_per_set=64, block_rows=None):
        if trees + _QUICK > coordinates:
            raise ValueError(f"coordinates is at least trees + {_QUICK}")
        self.shingle, self.percent, self.coordinates = shingle, percent, coordinates
        self.roots, self.branches, self.node_limit, self.max_depth = trees, branches, node_limit, max_depth
        self.least_equal = int(np.ceil(estimate * coordinates))
        self.sketch, self.sketch_estimate, self.pairs_per_set = sketch, sketch_estimate, pairs_per_set
        self.block_rows = 2 * node_limit if block_rows is None else block_rows

    def tokens(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a binary column: 32-bit tokens, one-byte tokens."""
        raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
        whole = 4 * self.roots
        return np.ascontiguousarray(raw[:, :whole]).view(np.uint32), np.ascontiguousarray(raw[:, whole:])

    # --- signatures and classes ---

    def signatures(self, docs: DataFrame) -> DataFrame:
        """Per document (id, text): set size, 128-bit fingerprint of the set,
        signature and root nodes; the last three null for an empty set."""
        shingle, coordinates, n_roots = self.shingle, self.coordinates, self.roots

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.arange(n_roots)
            tree = tb.mix((at + 1).astype(_U))
            for batch in batches:
                for part in tb.slices_of(batch, "text", BATCH_BYTES):
                    sets = shingle_sets(part.column("text"), shingle)
                    size = np.array([len(s) for s in sets], dtype=np.int64)
                    some = np.flatnonzero(size)
                    hi, low, sig, roots = ([None] * len(sets) for _ in range(4))
                    if len(some):
                        first, rest = minwise([sets[i] for i in some], coordinates, n_roots)
                        root = _children(tree[None, :], at[None, :], first).view(np.int64)
                        for row, i in enumerate(some.tolist()):
                            hi[i] = int(tb.mix(sets[i]).sum(dtype=_U).view(np.int64))
                            low[i] = int(tb.mix(sets[i] ^ _SALT).sum(dtype=_U).view(np.int64))
                            sig[i] = first[row].tobytes() + rest[row].tobytes()
                            roots[i] = root[row].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(size), pa.array(hi, pa.int64()), pa.array(low, pa.int64()),
                         pa.array(sig, pa.binary()), pa.array(roots, pa.list_(pa.int64()))],
                        names=["id", "n", "hi", "low", "sig", "roots"])

        return docs.mapInArrow(tb.trimmed(sign), "id long, n long, hi long, low long, sig binary, roots array<long>")

    # --- candidate pairs ---

    def _branch(self, members: DataFrame, signs: DataFrame) -> DataFrame:
        """Members (node, root, id) of large nodes, moved to the nodes'
        children."""
        branches = self.branches

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                node = batch.column("node").to_numpy().view(_U)
                _, rest = self.tokens(batch.column("sig"))
                for j in range(branches):
                    at = (tb.mix(node + _U(j + 1)) % _U(rest.shape[1])).astype(np.int64)
                    child = _children(node + _U(j + 1), at, rest[np.arange(len(at)), at])
                    yield pa.RecordBatch.from_arrays([_signed(child), batch.column("root"), batch.column("id")], names=["node", "root", "id"])

        return (members.join(signs, "id").select("node", "root", "id", "sig")
                .mapInArrow(move, "node long, root int, id long"))

    def _each_node(self, rows: DataFrame, signs: DataFrame, work, rows_per_task: int = 1 << 12) -> DataFrame:
        """Pairs (a, b) from ``work(columns, first, rest)`` on the rows of each
        (node, salt); small nodes share a task.  ``signs`` has the signatures,
        and the sketches if ``work`` looks at them."""
        n_tasks = parts(rows.count(), rows_per_task)
        rows = rows.withColumn("task", F.pmod(F.xxhash64("node", "salt"), F.lit(n_tasks)).cast("int")).join(signs, "id")

        def run(group: pa.Table) -> pa.Table:
            order = pc.sort_indices(group.select(["node", "salt", "id"]), [(c, "ascending") for c in ("node", "salt", "id")]).to_numpy()
            columns = {c: group.column(c).to_numpy(zero_copy_only=False)[order] for c in group.column_names
                       if c not in ("sig", "task", "sketch")}
            if "sketch" in group.column_names:
                columns["sketch"] = Sketches(group.column("sketch"), order)
            first, rest = (v[order] for v in self.tokens(group.column("sig")))
            node, salt = columns["node"], columns["salt"]
            begin = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])))
            out = [np.empty((0, 2), dtype=np.int64)]
            for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(node)).tolist()):
                if hi - lo > 1:
                    out.append(work({c: v[lo:hi] for c, v in columns.items()}, first[lo:hi], rest[lo:hi]))
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            del columns, first, rest, group
            tb.trim()
            return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        return rows.groupBy("task").applyInArrow(run, "a long, b long").distinct()

    def _closest(self, columns: dict, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Each class with the one most like it and the one most like all."""
        ids, quick, n = columns["id"], rest[:, :_QUICK], len(rest)
        best, likeness = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for lo in range(0, n, 256):
            same = _equal(quick[lo:lo + 256], quick)
            same[np.arange(len(same)), np.arange(lo, lo + len(same))] = 0
            best[lo:lo + 256], likeness[lo:lo + 256] = same.argmax(axis=1), same.sum(axis=1, dtype=np.int64)
        own, centre = np.arange(n), np.full(n, likeness.argmax())
        x, y = np.append(own, own), np.append(best, centre)
        ok = (x != y) & (self._agreement(x, y, first, rest) >= self.least_equal)
        return np.column_stack([ids[x[ok]], ids[y[ok]]])

    def _agreement(self, x, y, first, rest) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int64)
        for lo in range(0, len(x), 1 << 14):
            i, j = x[lo:lo + (1 << 14)], y[lo:lo + (1 << 14)]
            out[lo:lo + len(i)] = (first[i] == first[j]).sum(axis=1) + (rest[i] == rest[j]).sum(axis=1)
        return out

    def _across(self, columns: dict, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """All pairs of different components that agree enough: ``wide`` rows
        against all, or against the others only (``apart``).  A pair that an exhaustive root node (a bit in
        ``compared``) compares as well is left to the first such node."""
        ids, comp, quick = columns["id"], columns["component"], rest[:, :_QUICK]
        root, deep, compared = int(columns["root"][0]), bool(columns["deep"][0]), columns["compared"]
        earlier = np.arange(self.roots) if deep else np.arange(root)
        wide, out = np.flatnonzero(columns["wide"]), [np.empty((0, 2), dtype=np.int64)]
        other = np.flatnonzero(~columns["wide"]) if columns["apart"][0] else np.arange(len(ids))
        step = max(1, (1 << 22) // max(len(other), 1))
        for lo in range(0, len(wide), step):
            some = wide[lo:lo + step]
            x, y = np.nonzero((_equal(quick[some], quick[other]) >= int(_QUICK_SHARE * _QUICK)) & (comp[some][:, None] != comp[other][None, :]))
            x, y = some[x], other[y]
            ok = ~(columns["wide"][y] & (x > y))  # once, where both are wide
            x, y = x[ok], y[ok]
            if len(earlier) and len(x):
                again = np.zeros(len(x), dtype=bool)
                for c in earlier.tolist():
                    again |= (first[x, c] == first[y, c]) & ((compared[x] >> c) & 1 == 1)
                x, y = x[~again], y[~again]
            ok = self._agreement(x, y, first, rest) >= self.least_equal
            x, y = x[ok], y[ok]
            ok = np.array([self._similar(columns["sketch"][i], columns["sketch"][j]) for i, j in zip(x, y)], dtype=bool)
            out.append(np.column_stack([ids[x[ok]], ids[y[ok]]]))
        return np.concatenate(out)

    def _similar(self, a: bytes, b: bytes) -> bool:
        """Whether two sketches may belong to linked sets.  A sketch that is
        not full is its whole set, and the similarity is then exact but for
        equal 32-bit hashes, for which one percent is allowed."""
        a, b = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
        if len(a) < self.sketch and len(b) < self.sketch:
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            return 100 * both >= (self.percent - 1) * (len(a) + len(b) - both)
        union = np.union1d(a, b)[:self.sketch]
        return len(np.intersect1d(np.intersect1d(union, a), b)) >= self.sketch_estimate * len(union)

    def _mixed(self, members: DataFrame, component: DataFrame) -> DataFrame:
        """Members (node, root, id, component, size) of nodes that hold more
        than one component."""
        named = members.join(component, "id", "left").select("node", "root", "id", F.coalesce("component", "id").alias("component"))
        sizes = (named.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
                 .where("lo < hi").select("node", "size"))
        return checkpointed(named.join(sizes, "node"))

    # --- confirmation ---

    def _made(self, docs: DataFrame, reps: DataFrame, ids: DataFrame, sketch: bool) -> DataFrame:
        """(id, members): the set of each id, or its sketch, made in a scan of
        the texts.  A bit filter of fixed size spares most other documents."""
        shingle, size = self.shingle, self.sketch
        wanted = checkpointed(ids.join(reps.select("id", "hi"), "id"))
        bit = F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS))
        bucket, first = F.bitmap_bucket_number(bit), F.bitmap_bucket_number(F.lit(0).cast("long"))
        marks = (wanted.groupBy((bucket - first).alias("k"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())  # 2 MB at most
        filled = np.zeros(_FILTER_BITS // 8 + 4096, dtype=np.uint8)
        for r in marks:
            filled[4096 * r.k:4096 * (r.k + 1)] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(filled)
        position = F.bitmap_bit_position(bit) + (bucket - first) * 32768

        def packed(members: np.ndarray) -> bytes:
            if not sketch:
                return members.tobytes()
            return np.unique((tb.mix(members ^ _SALT) >> _U(32)).astype(np.uint32))[:size].tobytes()

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked = shared.value
            for batch in batches:
                at = batch.column("position").to_numpy()
                batch = batch.filter(pa.array((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
                for part in tb.slices_of(batch, "text", BATCH_BYTES):
                    sets = shingle_sets(part.column("text"), shingle)
                    hi = [int(tb.mix(s).sum(dtype=_U).view(np.int64)) for s in sets]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(hi, pa.int64()),
                                                      pa.array([packed(s) for s in sets], pa.binary())], names=["id", "hi", "members"])

        return (docs.where(F.col("id").isNotNull()).select("id", "text", position.cast("long").alias("position"))
                .mapInArrow(tb.trimmed(make), "id long, hi long, members binary")
                .join(wanted, ["id", "hi"]).select("id", "members").dropDuplicates(["id"]))

    def _confirmed(self, pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough.  A set with
        many partners is copied once for every ``pairs_per_set`` of them."""
        percent = self.percent
        pairs = checkpointed(pairs)
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = self._made(docs, reps, ids, False)
        counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / self.pairs_per_set).alias("salts"))
        salted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
        left = salted.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        right = (salted.select("a", "salt").distinct()
                 .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a"))

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("ma"), batch.column("mb")):
                    x, y = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        return left.join(right, ["a", "salt"]).select("a", "b", "ma", "mb").mapInArrow(tb.trimmed(confirm), "a long, b long")

    # --- the join ---

    def run(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        docs = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        signed = checkpointed(self.signatures(docs))
        classes = checkpointed(signed.where("n > 0").groupBy("hi", "low")
                               .agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("roots").alias("roots")))
        reps = classes.where("id IS NOT NULL")
        placed = reps.select(F.posexplode("roots").alias("root", "node"), "id")
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = checkpointed(placed.join(sizes, "node"))

        # each class with those most like it; a large node is dealt over tasks
        signs = reps.select("id", "sig")
        dealt = members.where(F.col("root") < _FIRST_ROOTS).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / self.node_limit)))
        near = self._each_node(dealt.select("node", "salt", "id"), signs, self._closest)
        links = self._confirmed(near, docs, reps)
        links = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        component = checkpointed(connected_components(links))
        del near, dealt, placed, sizes
        tidy(docs.sparkSession)

        # the other pairs of nodes that hold more than one component
        small = members.where(F.col("size") <= self.node_limit)
        compared = checkpointed(small.groupBy("id").agg(F.sum(F.expr("shiftleft(1L, root)")).alias("compared")))
        members, depth, found = members.select("node", "root", "id"), 1, []
        while True:
            mixed = self._mixed(members, component)
            now = mixed if depth >= self.max_depth else mixed.where(F.col("size") <= self.node_limit)
            rows = self._grouped(now, depth).withColumn("deep", F.lit(depth > 1)).join(compared, "id", "left")
            rows = checkpointed(rows.fillna({"compared": 0}))
            sketches = self._made(docs, reps, rows.select("id").distinct(), True).withColumnRenamed("members", "sketch")
            found.append(checkpointed(self._each_node(rows, signs.join(sketches, "id"), self._across)))
            large = mixed.where(F.col("size") > self.node_limit).select("node", "root", "id")
            if depth >= self.max_depth or large.isEmpty():
                break
            members, depth = checkpointed(self._branch(large, signs)), depth + 1
            del mixed, now, rows, sketches, large
            tidy(docs.sparkSession)
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        more = self._confirmed(pairs.distinct(), docs, reps)
        links = links.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        component = connected_components(links)

        named = (classes.join(component, "id", "left")
                 .select("hi", "low", F.coalesce("component", "id").alias("component")))
        return (signed.select("id", "n", "hi", "low").join(named, ["hi", "low"], "left")
                .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
                .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))

    def _grouped(self, mixed: DataFrame, depth: int) -> DataFrame:
        """Rows (node, root, salt, id, component, wide, apart) to compare: one
        salt for small nodes.  The rows of large ones are dealt to blocks, those
        of the largest component to the last blocks; a salt is a pair of blocks
        (the first one ``wide``) or a block with itself."""
        columns = ["node", "root", "salt", "id", "component", "wide", "apart"]
        if depth < self.max_depth:
            return mixed.select("*", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("wide"), F.lit(False).alias("apart")).select(*columns)
        per = (mixed.where(F.col("size") > self.node_limit).groupBy("node", "component")
               .agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")))
        most = (per.groupBy("node").agg(F.max(F.struct("n", "component")).alias("most"), F.first("size").alias("all"))
                .select("node", F.col("most.component").alias("largest"), F.ceil(F.col("most.n") / self.block_rows).alias("inner"),
                        F.ceil((F.col("all") - F.col("most.n")) / self.block_rows).alias("outer")))
        inside = F.col("component").eqNullSafe(F.col("largest"))
        block = F.when(F.col("outer").isNull(), F.lit(0).cast("long")).when(inside, F.col("outer") + F.pmod(F.xxhash64("id"), "inner"))
        block = block.otherwise(F.pmod(F.xxhash64("id"), "outer"))
        blocks = F.coalesce(F.col("outer") + F.col("inner"), F.lit(1).cast("long"))
        # blocks inside the largest component meet the others only
        partners = F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("outer")).otherwise(blocks) - 1)
        return (mixed.join(most, "node", "left").select("*", block.alias("block"), blocks.alias("blocks"), F.explode(partners).alias("partner"))
                .withColumn("salt", F.least("block", "partner") * F.col("blocks") + F.greatest("block", "partner"))
                .withColumn("wide", F.col("block") <= F.col("partner")).withColumn("apart", F.col("block") != F.col("partner")).select(*columns))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles`` (distinct shingles),
    ``component_id`` (smallest id reachable over links) and ``kept`` (the id
    is its component's).

    Documents are linked if ``100 * intersection >= percent * union`` of their
    shingle sets; every link is confirmed on the full sets.  Texts without
    words (null, empty, white space) have an empty set and are linked with
    nothing.  Rows with equal texts are linked.  Ids are expected to be
    distinct: each row of a repeated id gets its own text's component, and
    texts whose smallest id is the same count as linked.  A row with a null id
    gets the component of its text's other rows, or null.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    return NearDedup(**options).run(docs, id_col, text_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, also where ids repeat
    or are null."""
    return without_rows(docs, id_col, text_col,
                        lambda rows: near_dedup(rows, id_col, text_col, **options).where(~F.col("kept")).select("id"))
