"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the corpus counts in how many documents each feature (a
   hashed word) occurs; the counts give the IDF weights.
2. The benchmark's TF-IDF passages are factored by a randomised SVD whose
   products run as Spark jobs: a random range finder, one power iteration, and
   a rotation to the leading ``rank`` directions.
3. Every passage of every document is projected into that latent space; its
   cosine with each benchmark passage (over the full TF-IDF norm) selects
   candidates.  A benchmark passage keeps only part of its norm in ``rank``
   directions and a short item is diluted by the passage's other words, so the
   cosine alone misses copies.
4. Every other candidate that could pass step 5 comes from counting words: a
   common subsequence of ``need`` of an item's n words has at least h of its
   n - need + h rarest ones, so the documents are searched for h of these in
   one region.  No pair is lost by this, whatever the size of the benchmark.
5. A candidate is verified on the words themselves: the longest common
   subsequence of the benchmark text and the document around the passage, and,
   for looser paraphrases, the benchmark's answer (its answer column, or its
   last sentence).

The benchmark is taken in blocks of ``block_items``, which bounds what is
shipped to the workers; each block is a query set run against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import textbytes as tb
from ibex.llm.frames import checkpointed, text_of, without_rows

_U = np.uint64
#: Hashed features whose document frequency is counted (1 MB of counts).
FEATURES = 1 << 18
_BLOCK = 1 << 14
#: Bytes of text, and half passages, that are looked at together.
BATCH_BYTES = 1 << 19
BATCH_BLOCKS = 2048

#: Words here are runs of anything but ASCII white space and punctuation.
_SEPARATOR = tb.SPACE.copy()
_SEPARATOR[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _words(column):
    """Where each text's words begin, and the hashes of the lower-case words."""
    _, _, first, hashes = tb.word_hashes(*tb.buffers(pc.utf8_lower(column)), _SEPARATOR)
    return first, hashes


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(FEATURES - 1)).astype(np.int64)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that contain each feature, and documents in all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for part in tb.slices_of(batch, "text", BATCH_BYTES):
                first, hashes = _words(part.column("text"))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pairs = np.sort(row * FEATURES + _feature(hashes))
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
                total += np.bincount(pairs % FEATURES, minlength=FEATURES)
                n += len(first) - 1
        if n:
            parts = [total[i:i + _BLOCK].astype("<i8").tobytes() for i in range(0, FEATURES, _BLOCK)] + [np.array([n], "<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in group.column("counts"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    got = {r.block: np.frombuffer(bytes(r.counts), "<i8") for r in
           docs.select("text").mapInArrow(tb.trimmed(count), schema).groupBy("block").applyInArrow(add, schema).collect()}  # 2 MB
    if not got:
        return np.zeros(FEATURES, dtype=np.int64), 0
    last = max(got)
    return np.concatenate([got[i] for i in range(last)]), int(got[last][0])


def _weighted(first, hashes, idf):
    """Unit TF-IDF rows of whole texts: (text, feature, weight), sorted."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, tf = np.unique(row * FEATURES + _feature(hashes), return_counts=True)
    row, feature = pairs // FEATURES, pairs % FEATURES
    weight = tf * idf[feature]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(first) - 1))
    return row, feature, weight / np.maximum(norm[row], 1e-12)


@dataclass(frozen=True)
class Latent:
    """Features with a place, their latent vectors times IDF, and each
    benchmark passage's unit latent vector with its item."""

    features: np.ndarray
    vectors: np.ndarray
    passages: np.ndarray
    item_of: np.ndarray


def _fit(items: DataFrame, idf: np.ndarray, rank: int, oversample: int, seed: int) -> Latent:
    """Randomised SVD of the items' passages (item, text)."""
    spark = items.sparkSession
    weights = spark.sparkContext.broadcast(idf)

    def matrix_parts(batch):
        first, hashes = _words(batch.column("text"))
        return _weighted(first, hashes, weights.value)

    def used(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(matrix_parts(batch)[1]))], names=["feature"])

    # bounded by the words of one block of the benchmark
    features = np.array(sorted(r.feature for r in items.mapInArrow(used, "feature long").distinct().collect()), dtype=np.int64)
    width = min(rank + oversample, max(len(features), 1))

    def multiply(basis: np.ndarray, gram: bool) -> np.ndarray:
        """A' A B, or B' A' A B, summed over the rows of A in Spark tasks."""
        shipped = spark.sparkContext.broadcast(basis)

        def partial(batches):
            b = shipped.value
            out = np.zeros((b.shape[1], b.shape[1]) if gram else b.shape)
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, feature, weight = matrix_parts(batch)
                place = np.searchsorted(features, feature)
                y = np.zeros((batch.num_rows, b.shape[1]))
                np.add.at(y, row, weight[:, None] * b[place])
                if gram:
                    out += y.T @ y
                else:
                    np.add.at(out, place, weight[:, None] * y[row])
            rows = [(i // 1024, out[i:i + 1024].tobytes()) for i in range(0, len(out), 1024)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["block", "sums"])

        def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums"))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

        schema = "block int, sums binary"
        got = {r.block: bytes(r.sums) for r in items.mapInArrow(partial, schema).groupBy("block").applyInArrow(add, schema).collect()}
        shipped.unpersist()
        return np.frombuffer(b"".join(got[k] for k in sorted(got)), np.float64).reshape(-1, basis.shape[1])

    start = np.random.default_rng(seed).standard_normal((len(features), width))
    basis = np.linalg.qr(multiply(start, False))[0]
    basis = np.linalg.qr(multiply(basis, False))[0]
    values, turn = np.linalg.eigh(multiply(basis, True))
    basis = basis @ turn[:, np.argsort(-values)[:rank]]
    shipped = spark.sparkContext.broadcast(basis)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                row, feature, weight = matrix_parts(batch)
                y = np.zeros((batch.num_rows, shipped.value.shape[1]))
                np.add.at(y, row, weight[:, None] * shipped.value[np.searchsorted(features, feature)])
                yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([r.tobytes() for r in y], pa.binary())], names=["item", "y"])

    got = sorted(items.mapInArrow(project, "item int, y binary").collect(), key=lambda r: r.item)  # one block of the benchmark
    passages = np.array([np.frombuffer(bytes(r.y), np.float64) for r in got]).reshape(len(got), basis.shape[1])
    passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)
    return Latent(features, (basis * idf[features][:, None]).astype(np.float32), passages.astype(np.float32),
                  np.array([r.item for r in got], dtype=np.int64))


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and the sequence
    of ``n`` words whose positions ``masks`` holds as bits."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


@dataclass(frozen=True)
class Item:
    key: int
    text: str
    words: np.ndarray
    need: int
    masks: dict
    answer: list
    answer_masks: dict


def _last_sentence(text: str) -> str:
    body = text.rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").replace("\n", ".")
    return body.rpartition(".")[2]


def _least(n: int, share: float) -> int:
    """The fewest of ``n`` words (one at least) that reach ``share``."""
    return next((k for k in range(1, n) if k / n >= share), n)


def _items(rows, min_answer: int, share: float, paraphrase_share: float) -> list[Item]:
    out = []
    for r in rows:
        words = _words(pa.array([r.text or ""]))[1]
        answer = _words(pa.array([r.answer if r.answer is not None else _last_sentence(r.text or "")]))[1].tolist()
        if len(answer) < min_answer:
            answer = []
        need = _least(len(words), min(share, paraphrase_share) if answer else share)
        out.append(Item(r.key, r.text, words, need, _masks(words.tolist()), answer, _masks(answer)))
    return out


@dataclass(frozen=True)
class Postings:
    """For each of the rare words (sorted hashes), from ``first`` on, the items
    that have it; for each item how many of its rare words a match has, and its
    length in words."""

    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    hits: np.ndarray
    size: np.ndarray


#: Rare words of an item that a match has to have (fewer in short items): more
#: give fewer false candidates, but count more frequent words.
_HITS = 4


def _postings(items: list[Item], idf: np.ndarray) -> Postings:
    hits = np.array([min(_HITS, item.need) for item in items], dtype=np.int64)
    of, rare = [], []
    for k, item in enumerate(items):
        rarest = np.argsort(-idf[_feature(item.words)], kind="stable")
        some = np.unique(item.words[rarest[:len(item.words) - item.need + hits[k]]])
        of.append(np.full(len(some), k))
        rare.append(some)
    of, rare = np.concatenate(of), np.concatenate(rare)
    order = np.argsort(rare, kind="stable")
    words, first = np.unique(rare[order], return_index=True)
    return Postings(words, np.append(first, len(rare)), of[order], hits, np.array([len(item.words) for item in items]))


def _counted(postings: Postings, hashes: np.ndarray, first: np.ndarray, maybe: np.ndarray, passage: int):
    """(first hit, last hit, item) of every run of enough rare words of an item
    that fits the region of a passage; ``maybe`` are the words to look at."""
    empty = np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(postings.words, hashes[maybe]), len(postings.words) - 1)
    found = postings.words[at] == hashes[maybe]
    word, at = maybe[found], at[found]
    if not len(word):
        return empty, empty, empty
    n = postings.first[at + 1] - postings.first[at]
    item = postings.items[np.repeat(postings.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    key = np.sort(item * len(hashes) + np.repeat(word, n))
    item, word = key // len(hashes), key % len(hashes)
    last = np.arange(len(key)) + postings.hits[item] - 1
    ok = np.flatnonzero(last < len(key))
    ok = ok[item[last[ok]] == item[ok]]
    a, b, item = word[ok], word[last[ok]], item[ok]
    text = np.searchsorted(first, a, "right")
    ok = (b - a < passage + 2 * postings.size[item]) & (b < first[text])
    return a[ok], b[ok], item[ok]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, *,
                       passage: int = 48, rank: int = 192, oversample: int = 16, cosine: float = 0.3, share: float = 0.75,
                       paraphrase_share: float = 0.6, min_answer: int = 5, block_items: int = 1024, seed: int = 7) -> DataFrame:
    """(id, item_id, cosine, share, answer): the benchmark items found in each
    document.  ``share`` is the part of the item's words in the longest common
    subsequence with the document around the passage; an item counts as found
    if it reaches ``share``, or ``paraphrase_share`` with the item's whole
    answer there as well (answers of at least ``min_answer`` words).

    Null and empty texts and items have no words and are in no pair.  Rows
    with equal or null ids are searched one by one and give equal pairs once.
    Items with equal texts and answers are searched once and found together;
    items with equal or null ids are each searched by their own text and give
    one pair of that id (or null).  Other columns are ignored, whatever their names.  An empty table on either side
    gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    named = (benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), text_of(item_text_col).alias("text"), answer.alias("answer"))
             .where(F.length(F.trim("text")) > 0).distinct())
    # equal items are one, found by its key; the key's ids are joined to what is found
    asked = checkpointed(named.select("text", "answer").distinct().withColumn("key", F.monotonically_increasing_id()))
    n_items = asked.count()
    schema = "id long, item_id long, cosine double, share double, answer boolean"
    if not n_items:
        return docs.sparkSession.createDataFrame([], schema)
    frequency, n_docs = document_frequency(docs)
    idf = np.log((n_docs + 1.0) / (frequency + 1.0)) + 1e-3
    n_blocks = -(-n_items // block_items)
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("text", "answer"), F.lit(n_blocks)))
    found = None
    for block in range(n_blocks):
        rows = blocked.where(F.col("block") == block).collect()  # about block_items rows
        items = [x for x in _items(sorted(rows, key=lambda r: (r.text, r.answer is not None, r.answer or "")), min_answer, share, paraphrase_share) if len(x.words)]
        if not items:
            continue
        latent = _fit(_item_passages(docs.sparkSession, items, passage), idf, rank, oversample, seed)
        one = _search(docs, items, latent, idf, passage, cosine, share, paraphrase_share)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    same = named["text"].eqNullSafe(asked["text"]) & named["answer"].eqNullSafe(asked["answer"])
    ids = named.join(asked, same).select("key", "item_id")
    # items of one id that a document has give one pair
    found = found.groupBy("id", "key").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"), F.max("answer").alias("answer"))
    return found.join(ids, "key").groupBy("id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"), F.max("answer").alias("answer"))


def _item_passages(spark, items: list[Item], passage: int) -> DataFrame:
    """(item, text) of the items' passages: long items in overlapping cuts."""
    out = []
    for k, item in enumerate(items):
        words = bytes(_SEPARATOR.astype(np.uint8))
        parts = item.text.encode().translate(bytes(32 if words[c] else c for c in range(256))).split()
        for at in range(0, max(1, len(parts) - passage // 2), passage):
            # the last cut takes what would be less than half a passage
            end = len(parts) if len(parts) - at < passage + passage // 2 + 1 else at + passage
            out.append((k, b" ".join(parts[at:end]).decode()))
    return spark.createDataFrame(out, "item int, text string").repartition(max(1, len(out) // 256))


def _search(docs, items, latent, idf, passage, cosine, share, paraphrase_share) -> DataFrame:
    stride = passage // 2
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[latent.features] = np.arange(len(latent.features))
    shipped = docs.sparkSession.sparkContext.broadcast((items, latent, idf.astype(np.float32), place, _postings(items, idf)))

    def candidates(first, hashes):
        """(text, passage's first word, item, cosine): over the threshold, or
        with enough of the item's words."""
        _, latent, idf, place, postings = shipped.value
        n_blocks = -(-np.diff(first) // stride)
        block_first = np.append(0, np.cumsum(n_blocks))
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        block = block_first[row] + (np.arange(len(hashes)) - first[row]) // stride
        feature = _feature(hashes)
        at = place[feature]
        known = np.flatnonzero(at >= 0)
        if not len(known):
            return
        text = np.repeat(np.arange(len(n_blocks)), n_blocks)
        span = np.searchsorted(latent.item_of, np.arange(len(postings.size) + 1))
        # the passages in whose region a run of rare words lies
        a, z, item = _counted(postings, hashes, first, known, passage)
        of = np.searchsorted(first, a, "right") - 1
        a, z, n = a - first[of], z - first[of], postings.size[item]
        lo = np.maximum(-(-(z - passage - n + 1) // stride), 0)
        hi = np.minimum((a + n) // stride, n_blocks[of] - 1)
        many = np.maximum(hi - lo + 1, 0)
        b = np.repeat(block_first[of] + lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        counted, counted_item = np.divmod(np.unique(b * len(postings.size) + np.repeat(item, many)), len(postings.size))

        def similar(c0: int, c1: int) -> np.ndarray:
            """Cosine of the passages from the blocks ``c0`` to ``c1`` (a
            passage is a block and the next one of the same text) with all
            passages of the benchmark."""
            upto = min(c1 + 1, len(text))
            w = slice(*np.searchsorted(block, [c0, upto]))
            pairs = np.sort((block[w] - c0) * FEATURES + feature[w])
            begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, dtype=np.int64)
            weight = np.diff(np.append(begin, len(pairs))) * idf[pairs[begin] % FEATURES]
            square = np.bincount(pairs[begin] // FEATURES, weights=weight * weight, minlength=upto - c0)
            vector = np.zeros((upto - c0, latent.vectors.shape[1]), dtype=np.float32)
            have = known[slice(*np.searchsorted(known, [w.start, w.stop]))]
            if len(have):
                edge = np.flatnonzero(np.append(True, block[have][1:] != block[have][:-1]))
                vector[block[have[edge]] - c0] = np.add.reduceat(latent.vectors[at[have]], edge, axis=0)
            more = np.flatnonzero(text[c0 + 1:upto] == text[c0:upto - 1])
            vector[more] += vector[more + 1]
            square[more] += square[more + 1]
            vector, square = vector[:c1 - c0], square[:c1 - c0]
            return (vector @ latent.passages.T) / np.sqrt(np.maximum(square, 1e-12))[:, None].astype(np.float32)

        best = {}
        for c0 in range(0, len(text), BATCH_BLOCKS):
            c1 = min(c0 + BATCH_BLOCKS, len(text))
            close = similar(c0, c1)
            x, y = np.nonzero(close >= cosine)
            for b, k, c in zip((x + c0).tolist(), latent.item_of[y].tolist(), close[x, y].tolist()):
                if c > best.get((b, k), -1.0):
                    best[b, k] = c
            some = slice(*np.searchsorted(counted, [c0, c1]))
            b, k = counted[some], counted_item[some]
            highest = np.full(len(b), -1.0)
            for j in range(int(np.diff(span).max())):
                highest = np.maximum(highest, close[b - c0, np.minimum(span[k] + j, span[k + 1] - 1)])
            for b, k, c in zip(b.tolist(), k.tolist(), highest.tolist()):
                best.setdefault((b, k), c)
        for (b, k), c in best.items():
            yield int(text[b]), int(first[text[b]] + (b - block_first[text[b]]) * stride), k, c

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shipped.value[0]
        for batch in batches:
            for part in tb.slices_of(batch, "text", BATCH_BYTES):
                ids = part.column("id")
                first, hashes = _words(part.column("text"))
                got = []
                for row, at, k, c in candidates(first, hashes):
                    item = items[k]
                    n = len(item.words)
                    near = hashes[max(first[row], at - n):min(first[row + 1], at + passage + n)].tolist()
                    if sum(item.masks[w].bit_count() for w in item.masks.keys() & set(near)) < item.need:
                        continue  # at least the length of any common subsequence
                    part_of = common_subsequence(item.masks, n, near) / n
                    answered = bool(item.answer) and common_subsequence(item.answer_masks, len(item.answer), near) == len(item.answer)
                    if part_of >= share or (part_of >= paraphrase_share and answered):
                        got.append((ids[row].as_py(), item.key, c, part_of, answered))
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))],
                        names=["id", "key", "cosine", "share", "answer"])

    return docs.mapInArrow(tb.trimmed(search), "id long, key long, cosine double, share double, answer boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, also where
    ids repeat or are null."""
    return without_rows(docs, id_col, text_col,
                        lambda rows: contaminated_pairs(rows, benchmark, id_col, text_col, **options).select("id"))
