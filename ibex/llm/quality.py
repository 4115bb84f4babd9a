"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics (shares, repetition,
lengths).  Per class the mean and the covariance are summed over all labelled
training rows; the covariance is shrunk towards the pooled one and that
towards a scaled identity.  A document's score is the logistic of the
difference of the classes' log densities (half squared Mahalanobis distance,
log determinant, log prior); the Cholesky factors are computed once and
shipped with the model, which is a few kilobytes at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import textbytes as tb
from ibex.llm.frames import checkpointed, text_of

FEATURES = (
    "log_words", "mean_word", "spread_word", "upper", "symbol", "exclaim", "bar", "digit", "stop",
    "adjacent", "distinct", "line_words", "ends_symbol", "caps_words",
)

#: Bytes of text whose statistics are made together.
BATCH_BYTES = 1 << 19

_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mask, dtype=np.int64))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log of a smoothed share: spreads small shares, tames large ones."""
    return np.log((part + 0.1) / (whole + 10.0))


def statistics(column) -> np.ndarray:
    """One row of ``FEATURES`` per text.  All are defined for empty texts."""
    offsets, data = tb.buffers(column)
    start, end, first, hashes = tb.word_hashes(offsets, data)
    n_bytes = np.diff(offsets).astype(np.float64)
    words = np.diff(first).astype(np.float64)
    size = (end - start).astype(np.float64)
    text = np.repeat(np.arange(len(words)), np.diff(first))

    def of_words(values):
        return np.bincount(text, weights=values, minlength=len(words))

    upper, lower = _per_text(_UPPER[data], offsets), _per_text(_LOWER[data], offsets)
    mean = (of_words(size) + 5.0) / (words + 1.0)
    spread = np.sqrt((of_words((size - mean[text]) ** 2) + 5.0) / (words + 1.0))
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order], weights=new, minlength=len(words))
    last = data[end - 1] if len(end) else np.empty(0, dtype=np.uint8)
    caps = np.zeros(len(hashes))
    if len(hashes):
        run = np.append(0, np.cumsum(_LOWER[data], dtype=np.int64))
        big = np.append(0, np.cumsum(_UPPER[data], dtype=np.int64))
        caps = ((run[end] - run[start]) == 0) & ((big[end] - big[start]) > 1)
    return np.column_stack([
        np.log1p(words), np.log(mean), np.log(spread), _share(upper, upper + lower),
        _share(_per_text(_SYMBOL[data], offsets), n_bytes), _share(_per_text(data == 33, offsets), n_bytes),
        _share(_per_text(data == 124, offsets), n_bytes), _share(_per_text(_DIGIT[data], offsets), n_bytes),
        _share(_per_text(data == 46, offsets), words), _share(of_words(same), words),
        np.log((distinct + 1.0) / (words + 1.0)), np.log((words + 1.0) / (_per_text(data == 10, offsets) + 1.0)),
        _share(of_words(_SYMBOL[last] | (last == 33)), words), _share(of_words(caps), words),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Class 0 and class 1: log prior, mean, inverse Cholesky factor of the
    covariance and half its log determinant; ``constant`` if there was too
    little to learn from."""

    prior: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray] | None
    factor: tuple[np.ndarray, np.ndarray] | None
    half_log_det: tuple[float, float] | None
    constant: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.mean is None:
            return np.full(len(x), self.constant)
        log = [p - h - 0.5 * np.square((x - m) @ f.T).sum(axis=1)
               for p, m, f, h in zip(self.prior, self.mean, self.factor, self.half_log_det)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700.0, 700.0)))


def discriminant(count, total, outer, *, pooling: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Fits from each class's row count, sum and sum of outer products."""
    count = np.asarray(count, dtype=float)
    if count.min() < 2:
        return Discriminant((0.0, 0.0), None, None, None, float(count[1] / count.sum()) if count.sum() else 1.0)
    mean = [t / n for t, n in zip(total, count)]
    cov = [o / n - np.outer(m, m) for o, m, n in zip(outer, mean, count)]
    pooled = sum(c * n for c, n in zip(cov, count)) / count.sum()
    scale = max(float(np.trace(pooled)) / len(pooled), 1e-6)
    factor, half = [], []
    for c in cov:
        shrunk = (1 - ridge) * ((1 - pooling) * c + pooling * pooled) + ridge * scale * np.eye(len(c))
        lower = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        factor.append(np.linalg.inv(lower))
        half.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(np.log(count / count.sum())), tuple(mean), tuple(factor), tuple(half))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``x``, the statistics of the whole text; null is empty."""
    frame = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices_of(batch, "text", BATCH_BYTES):
                x = statistics(part.column("text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), values], names=["id", "x"])

    return frame.mapInArrow(tb.trimmed(describe), "id long, x array<double>")


def held_out(col: str):
    """Rows never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(vectors: DataFrame, labels: DataFrame, *, label_col: str = "quality", label_id_col: str = "doc_id",
        pooling: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Learns from every labelled row of ``vectors`` that is not held out.

    Labels other than 0 and 1 are ignored; a document labelled both ways
    counts as 0; a null id matches no label."""
    told = (labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
            .where(F.col("y").isin(0, 1)).groupBy("id").agg(F.min("y").alias("y")))
    rows = vectors.where(~held_out("id")).join(told, "id").select("y", "x")
    width = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            for c in (0, 1):
                mine = x[y == c]
                total[c] += np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["y", "total"])

    summed = (rows.mapInArrow(moments, "y int, total array<double>").select("y", F.posexplode("total"))
              .groupBy("y", "pos").agg(F.sum("col").alias("v")).collect())  # a few hundred numbers
    total = np.zeros((2, 1 + width + width * width))
    for r in summed:
        total[r.y, r.pos] = r.v
    return discriminant(total[:, 0], total[:, 1:1 + width], total[:, 1 + width:].reshape(2, width, width),
                        pooling=pooling, ridge=ridge)


def apply_model(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """``id`` and ``score`` of every row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return vectors.mapInArrow(score, "id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id``, ``held_out``, ``score`` (0 to 1, higher:
    label 1 likelier) and ``predicted`` (1 if the score is at least 0.5).

    Only the text enters a score; null counts as empty.  Rows with equal or
    null ids are scored one by one; a null id is never held out.  Other
    columns are ignored, whatever their names.  With fewer than two training
    rows of a class every score is the share of label 1 (1 without labels).
    An empty table gives an empty result.
    """
    vectors = checkpointed(document_statistics(docs, id_col, text_col))
    model = fit(vectors, labels, **options)
    return (apply_model(vectors, model)
            .select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their
    columns.  The rows are read twice: once to learn, once to be scored where
    they are read, so no text is shuffled."""
    model = fit(checkpointed(document_statistics(docs, id_col, text_col)), labels, **options)
    schema = docs.schema
    text_at = docs.columns.index(text_col)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices_of(batch, text_at, BATCH_BYTES):
                good = model.score(statistics(part.column(text_at))) >= 0.5
                yield part.filter(pa.array(good))

    return docs.mapInArrow(tb.trimmed(accept), schema)
