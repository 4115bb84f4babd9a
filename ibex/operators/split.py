"""Train/test splits and mini-batch assignment.

All assignments are functions of ``(seed, key)`` through MD5, so they do
not change when data is repartitioned or a task is retried, and a plain SQL
engine can reproduce them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ibex.functions.hashing import hash32, uniform

DEFAULT_TEST_FRACTION = 0.2
# Histogram resolution of the exact split: top 16 of the 32 hash bits, then
# (for a large boundary bucket) the low 16 bits.
_BUCKET_BITS = 16
# A boundary bucket up to this many rows is ranked directly (one task).
_RANK_MAX_ROWS = 1 << 20


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_hash(df: DataFrame, key: str | Sequence[str], test_fraction: float = DEFAULT_TEST_FRACTION,
               seed: int = 0, out: str = "is_train") -> DataFrame:
    """Bernoulli split: a row is in the test part when its key's uniform
    hash is below ``test_fraction``.  No shuffle, no global order."""
    return df.withColumn(out, uniform(seed, *_keys(key)) >= F.lit(test_fraction))


def n_test_rows(n: int, test_fraction: float) -> int:
    """Size of the test part for ``n`` rows: ``ceil(fraction * n)``."""
    return int(math.ceil(test_fraction * n))


def _lex_le(cols: list[Column], vals: list) -> Column:
    """``(c1, c2, ...) <= (v1, v2, ...)`` in lexicographic order."""
    c, v = cols[0], F.lit(vals[0])
    if len(cols) == 1:
        return c <= v
    return (c < v) | ((c == v) & _lex_le(cols[1:], vals[1:]))


def _crossing(hist: list, need: int) -> tuple[int, int, int]:
    """``(bucket, rows still needed inside it, bucket count)`` for the
    bucket where the cumulative count first reaches ``need``."""
    cum = 0
    for r in hist:
        if cum + r["count"] >= need:
            return r["_b"], need - cum, r["count"]
        cum += r["count"]
    raise ValueError("histogram holds fewer rows than needed")


#: What the one pass of the exact split keeps of a task's rows: rows whose hash
#: lies this close to the boundary's expected place, while the task has no more
#: rows than that.  A level is of use if all tasks kept it, and each spans over
#: six standard deviations of the boundary at the number of rows it then has.
_KEPT = ((1.0, 1 << 12), (0.05, 1 << 20), (0.004, None))


def _one_pass(hashed: DataFrame, keys: list[str], test_fraction: float) -> tuple[int, int, DataFrame | None]:
    """``(rows, rank, rows to rank among)``: one scan of the keys counts the
    rows and puts those near the boundary aside; the boundary row has that
    rank among them.  None where the boundary lies outside (no scan of usual
    hashes gives that)."""
    import numpy as np
    import pyarrow as pa

    from ibex.session import ensure_checkpoint_dir

    ends = [(max(int((test_fraction - w) * 2**32), 0), min(int((test_fraction + w) * 2**32) + 1, 2**32)) for w, _ in _KEPT]
    slim = hashed.select("_h", *keys)
    summary = [T.StructField("_level", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_below", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in slim.schema], *summary])

    def pick(batches):
        n, below, level, held = 0, np.zeros(len(ends), dtype=np.int64), 0, []

        def inside(batch):
            h = batch.column("_h").to_numpy()
            return batch.filter(pa.array((h >= ends[level][0]) & (h < ends[level][1])))

        def rows(batch):
            k = batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([None] * k, pa.int32()), pa.array([None] * k, pa.int64()),
                                               pa.array([None] * k, pa.list_(pa.int64()))], names=schema.fieldNames())

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            h = batch.column("_h").to_numpy()
            n += len(h)
            below += [(h < lo).sum() for lo, _ in ends]
            while _KEPT[level][1] is not None and n > _KEPT[level][1]:
                level += 1
                held = [inside(x) for x in held]
            held.append(inside(batch))
            if _KEPT[level][1] is None:  # nothing is narrowed any more
                yield from (rows(x) for x in held)
                held = []
        if n:
            yield from (rows(x) for x in held)
            yield pa.RecordBatch.from_arrays([*[pa.array([None], t) for t in kinds], pa.array([level], pa.int32()), pa.array([n]),
                                              pa.array([below.tolist()], pa.list_(pa.int64()))], names=schema.fieldNames())

    ensure_checkpoint_dir(hashed.sparkSession)
    kept = slim.mapInArrow(pick, schema).checkpoint()
    told = kept.where("_level IS NOT NULL")
    total = told.agg(F.sum("_n"), F.max("_level"), *[F.sum(F.col("_below")[i]) for i in range(len(ends))]).first()
    if not total[0]:
        return 0, 0, None
    n, level = int(total[0]), int(total[1])
    need = n_test_rows(n, test_fraction) - int(total[2 + level])
    near = kept.where(F.col("_level").isNull() & (F.col("_h") >= ends[level][0]) & (F.col("_h") < ends[level][1])).select(*slim.columns)
    return n, need, near if 0 < need <= near.count() else None


def split_exact(df: DataFrame, key: str | Sequence[str], test_fraction: float = DEFAULT_TEST_FRACTION,
                seed: int = 0, out: str = "is_train") -> DataFrame:
    """Exact-size split: the ``ceil(fraction * n)`` rows with the smallest
    ``(hash, key)`` form the test part.

    The boundary row comes from one scan of the keys: hashes are uniform, so
    it lies within a few standard deviations of ``fraction * 2**32``, and the
    scan counts the rows and puts those near that place aside (see
    ``_KEPT``; under one row in a hundred of a large table).  The boundary is
    then found among these: a histogram of their hashes, and a rank within
    one of its buckets.  Every row is labelled by comparing ``(hash, key)``
    with the boundary - a projection, no global window.
    """
    keys = _keys(key)
    hashed = df.withColumn("_h", hash32(seed, *keys))
    n, need, near = _one_pass(hashed, keys, test_fraction)
    n_test = n_test_rows(n, test_fraction)
    if n_test <= 0:
        return df.withColumn(out, F.lit(True))
    order_cols = ["_h"] + keys
    bound_vals = _ranked(near, order_cols, need) if near is not None else _ranked(hashed, order_cols, n_test)
    is_test = _lex_le([F.col(c) for c in order_cols], bound_vals)
    return hashed.withColumn(out, ~is_test).drop("_h")


def _ranked(hashed: DataFrame, order_cols: list[str], rank: int) -> list:
    """The values of the row of that rank: a histogram of the top hash bits
    (at most 65,536 rows reach the driver) finds its bucket; in a bucket of
    over a million rows one of the low bits finds its hash; what is left is
    ranked."""
    bucket = F.shiftrightunsigned(F.col("_h"), 32 - _BUCKET_BITS)
    boundary, need, count = _crossing(_histogram(hashed, _BUCKET_BITS), rank)
    edge_rows = bucket == F.lit(boundary)
    if count > _RANK_MAX_ROWS:
        low = F.col("_h").bitwiseAND(F.lit((1 << (32 - _BUCKET_BITS)) - 1))
        sub = hashed.where(edge_rows).groupBy(low.alias("_b")).count().orderBy("_b").collect()
        low_b, need, _ = _crossing(sub, need)
        edge_rows = F.col("_h") == F.lit((boundary << (32 - _BUCKET_BITS)) | low_b)
    w = Window.orderBy(*[F.col(c) for c in order_cols])
    edge = (hashed.where(edge_rows).select(*order_cols).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == F.lit(need)).first())
    return [edge[c] for c in order_cols]


def _histogram(hashed: DataFrame, bits: int) -> list:
    """Row counts per bucket of the top ``bits`` bits of ``_h`` (a partial +
    final aggregate; at most 2^bits rows reach the driver)."""
    b = F.shiftrightunsigned(F.col("_h"), 32 - bits)
    return hashed.groupBy(b.alias("_b")).count().orderBy("_b").collect()


def minibatch_exact(df: DataFrame, key: str | Sequence[str], batch_size: int, seed: int = 0,
                    out: str = "batch") -> tuple[DataFrame, int]:
    """Contiguous mini-batches in one fixed shuffled order: rows ordered by
    ``(hash, key)`` (a random permutation that does not depend on the
    partitioning) are cut into ``n // batch_size`` slices of exactly
    ``batch_size`` rows; the last ``n % batch_size`` rows are dropped, as
    contiguous slicing does.  Returns the kept rows with an int ``batch``
    column, and the number of batches.

    Ranks without a global window: rows are dealt out by ranges of ``(hash,
    key)`` and sorted inside each partition; a row's rank is its place in the
    partition plus the sizes of the partitions before it.  One number per
    partition reaches the driver.  The laid-out rows are checkpointed, so that
    places and sizes belong to the same ranges.
    """
    from ibex.session import ensure_checkpoint_dir

    keys = _keys(key)
    ensure_checkpoint_dir(df.sparkSession)
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))  # monotonically_increasing_id: partition above, row below
    laid = (df.withColumn("_h", hash32(seed + 7919, *keys)).repartitionByRange("_h", *keys)
            .sortWithinPartitions("_h", *keys).drop("_h").withColumn("_m", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("_m", 33)
    sizes = laid.groupBy(part.alias("_p")).count().orderBy("_p").collect()
    n = sum(r["count"] for r in sizes)
    n_batches = n // batch_size
    if n_batches == 0:
        return df.where(F.lit(False)).withColumn(out, F.lit(None).cast("int")), 0
    offsets, cum = [], 0
    for r in sizes:
        offsets.append((int(r["_p"]), cum))
        cum += r["count"]
    off = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p bigint, _off bigint"))  # a row per partition
    ranked = laid.withColumn("_p", part).join(off, "_p").withColumn("_r", F.col("_off") + place)
    kept = ranked.where(F.col("_r") < F.lit(n_batches * batch_size))
    return (kept.withColumn(out, F.floor(F.col("_r") / F.lit(batch_size)).cast("int"))
            .drop("_m", "_p", "_off", "_r")), n_batches


def split_trials(df: DataFrame, key: str | Sequence[str], n_trials: int,
                 test_fraction: float = DEFAULT_TEST_FRACTION,
                 out: str = "is_train_trials") -> DataFrame:
    """One independent hash split per trial (seed = trial number), as an
    ``array<boolean>`` column: a single pass, no row replication."""
    keys = _keys(key)
    key_str = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])

    def flag(t: Column) -> Column:
        digest = F.md5(F.concat_ws(":", t.cast("string"), key_str))
        u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
        return u >= F.lit(test_fraction)

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_trials - 1)), flag))


def minibatch_ids(df: DataFrame, key: str | Sequence[str], batch_size: int, n_rows: int,
                  seed: int = 0, out: str = "batch") -> tuple[DataFrame, int]:
    """Hash-balanced mini-batch assignment.

    ``n_batches = n_rows // batch_size`` (the remainder is not dropped: rows
    are spread over the batches, so each batch holds about ``batch_size``
    rows).  Returns the frame with an int ``batch`` column and the number of
    batches.
    """
    n_batches = max(1, n_rows // batch_size)
    b = F.pmod(hash32(seed + 7919, *_keys(key)), F.lit(n_batches)).cast("int")
    return df.withColumn(out, b), n_batches
