"""Vocabulary fit, id encoding, truncation and padding.

Plan shape at scale: tokenising is a projection; counting is one shuffle
with map-side partial aggregation (a token holding a third of all rows is
pre-summed in every map task, so no reducer sees more than one row per map
task for it); the top-k cut is ``TakeOrderedAndProject`` (each task keeps
its k best, one task merges ``partitions x k`` rows); encoding is an
Arrow-batched lookup against the k-row vocabulary shipped as a broadcast
variable - no shuffle to rebuild sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pyarrow as pa
import pyarrow.compute as pc

from ibex.functions.text import OOV_ID, PAD_ID, tokenize

DEFAULT_NUM_WORDS = 1000
DEFAULT_MAXLEN = 500
# Hard ceiling for a vocabulary that is shipped to every task.
MAX_BROADCAST_VOCAB = 5_000_000


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokenize(text))


def token_counts(tokenized: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, n)`` over all rows of ``tokenized``.

    ``explode_outer`` + a null filter rather than ``explode``: for a plain
    explode the optimizer infers ``size(tokens) > 0`` and pushes it below
    the projection, which would run the whole clean/tokenise chain twice.
    """
    return (
        tokenized.select(F.explode_outer(tokens).alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(tokenized: DataFrame, num_words: int = DEFAULT_NUM_WORDS,
               tokens: str = "tokens") -> DataFrame:
    """Capped vocabulary: id 0 is padding, id 1 out-of-vocabulary, then the
    ``num_words - 2`` most frequent tokens get ids 2, 3, ... by descending
    count, ties by token (binary order).  Output ``(token, n, id)``.

    The ranking window runs after the top-k cut, so its single partition
    holds at most ``num_words - 2`` rows.
    """
    k = num_words - 2
    if k <= 0:
        raise ValueError("num_words must be at least 3")
    top = token_counts(tokenized, tokens).orderBy(F.desc("n"), F.asc("token")).limit(k)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", "n", (F.row_number().over(w) + F.lit(1)).cast("int").alias("id"))


def trial_vocabularies(tokenized: DataFrame, key: list[str], trials, test_fraction: float = 0.2,
                       num_words: int = DEFAULT_NUM_WORDS, tokens: str = "tokens") -> DataFrame:
    """One vocabulary per trial, each fitted on that trial's own hash split
    (train part: ``uniform(trial, key) >= test_fraction``, as
    :func:`ibex.operators.split.split_hash` with ``seed = trial``).  Output
    ``(trial, token, n, id)`` with at most ``trials x (num_words - 2)`` rows.

    One shuffle for all trials: every token occurrence is counted once per
    trial whose train part holds its row (a conditional sum per trial in
    the same partial + final hash aggregate).  The counts are kept while each
    trial's top-k is cut from them (``TakeOrderedAndProject``, bounded by k
    per task); the bounded result is returned as a small local table.
    """
    from ibex.functions.hashing import uniform

    k = num_words - 2
    if k <= 0:
        raise ValueError("num_words must be at least 3")
    trials = list(trials)
    flags = [uniform(t, *key) >= F.lit(test_fraction) for t in trials]
    # flags per row, then the explode: the split hashes are not recomputed per token
    flagged = tokenized.select(*[f.cast("int").alias(f"_f{i}") for i, f in enumerate(flags)], tokens)
    exploded = (flagged.select(*[f"_f{i}" for i in range(len(trials))], F.explode_outer(tokens).alias("token"))
                .where(F.col("token").isNotNull()))
    counts = exploded.groupBy("token").agg(
        *[F.sum(f"_f{i}").cast("bigint").alias(f"n{i}") for i in range(len(trials))]).persist()
    rows = []
    try:
        for i, t in enumerate(trials):
            top = (counts.where(F.col(f"n{i}") > 0).orderBy(F.desc(f"n{i}"), F.asc("token")).limit(k)
                   .select("token", f"n{i}").collect())
            rows += [(int(t), r["token"], int(r[f"n{i}"]), j + 2) for j, r in enumerate(top)]
    finally:
        counts.unpersist()
    return tokenized.sparkSession.createDataFrame(rows, "trial bigint, token string, n bigint, id int")


def collect_vocabulary(vocab: DataFrame) -> list[str] | None:
    """Tokens ordered by id (id = index + 2), or ``None`` when the
    vocabulary has more than ``MAX_BROADCAST_VOCAB`` rows (at most that many
    plus one are fetched to find out).  The vocabulary is bounded by
    ``num_words`` by construction; the bound is re-checked here before
    anything is shipped."""
    rows = vocab.select("token", "id").limit(MAX_BROADCAST_VOCAB + 1).collect()
    if len(rows) > MAX_BROADCAST_VOCAB:
        return None
    rows.sort(key=lambda r: r["id"])
    out = [r["token"] for r in rows]
    for i, r in enumerate(rows):
        if r["id"] != i + 2:
            raise ValueError("vocabulary ids must be 2..k+1 without gaps")
    return out


def _make_encoder(bc_tokens):
    state = {}

    def encode(tokens: pa.Array) -> pa.Array:
        if "vs" not in state:
            state["vs"] = pa.array(bc_tokens.value, type=pa.string())
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        if tokens.type != pa.list_(pa.string()):
            tokens = tokens.cast(pa.list_(pa.string()))
        flat = pc.list_flatten(tokens)
        idx = pc.index_in(flat, value_set=state["vs"])
        ids = pc.fill_null(pc.add(idx, pa.scalar(2, pa.int32())), pa.scalar(OOV_ID, pa.int32()))
        ids = ids.cast(pa.int32())
        offsets = pc.subtract(tokens.offsets, tokens.offsets[0])
        return pa.ListArray.from_arrays(offsets, ids, mask=tokens.is_null())

    return encode


def encode_tokens(tokenized: DataFrame, vocab: DataFrame, maxlen: int | None = DEFAULT_MAXLEN,
                  tokens: str = "tokens", out: str = "ids", key: list[str] | None = None) -> DataFrame:
    """Map tokens to ids (misses -> OOV id 1), truncating to the first
    ``maxlen`` tokens *before* the lookup (valid because every token yields
    exactly one id).  ``maxlen=None`` keeps whole sequences.

    The vocabulary is shipped to the tasks when its size check passes;
    beyond the bound the rows are encoded by :func:`encode_tokens_join` on
    their unique ``key`` (rows without one are numbered and written first)."""
    spark = tokenized.sparkSession
    words = collect_vocabulary(vocab)
    if words is None:
        if key is not None:
            return encode_tokens_join(tokenized, vocab, key, maxlen, tokens, out)
        from ibex.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        numbered = tokenized.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
        return encode_tokens_join(numbered, vocab, ["__row"], maxlen, tokens, out).drop("__row")
    bc = spark.sparkContext.broadcast(words)
    udf = F.arrow_udf(_make_encoder(bc), T.ArrayType(T.IntegerType()))
    src = F.col(tokens) if maxlen is None else F.slice(tokens, 1, maxlen)
    return tokenized.withColumn(out, udf(src))


def hot_tokens(occurrences: DataFrame, partitions: int) -> DataFrame:
    """Tokens that alone would fill a quarter of one of ``partitions`` shuffle
    partitions or more: at most ``4 * partitions`` of them, whatever the data
    (counted with map-side sums)."""
    counts = occurrences.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = occurrences.agg(F.count("token")).first()[0]
    return counts.where(F.col("n") * F.lit(4 * partitions) >= F.lit(max(total, 1))).select("token")


def encode_tokens_join(tokenized: DataFrame, vocab: DataFrame, key: list[str],
                       maxlen: int | None = DEFAULT_MAXLEN, tokens: str = "tokens",
                       out: str = "ids") -> DataFrame:
    """Pure-DataFrame variant of :func:`encode_tokens` for vocabularies too
    large to ship.  The tokens are exploded and split in two: the few hot ones
    (see :func:`hot_tokens`) get their id from a broadcast, the others by a
    shuffle join in which no token fills a partition; then the rows are
    regrouped by key in position order."""
    src = F.col(tokens) if maxlen is None else F.slice(tokens, 1, maxlen)
    exploded = tokenized.select(*key, F.posexplode(src).alias("_p", "token"))
    words = vocab.select("token", "id")
    partitions = int(tokenized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_tokens(exploded, partitions).join(words, "token", "left").withColumnRenamed("id", "_hot_id").withColumn("_hot", F.lit(True))
    told = exploded.join(F.broadcast(hot), "token", "left")
    by_broadcast = told.where("_hot").withColumnRenamed("_hot_id", "id").drop("_hot")
    by_shuffle = told.where("_hot IS NULL").drop("_hot", "_hot_id").join(words, "token", "left")
    regrouped = by_broadcast.unionByName(by_shuffle).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_p", F.coalesce("id", F.lit(OOV_ID)).alias("id")))).alias("_s")
    )
    ids = regrouped.select(*key, F.transform("_s", lambda s: s["id"]).alias(out))
    return tokenized.drop(out).join(ids, key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<int>"))
    )


def pad_sequences(ids: Column | str, maxlen: int = DEFAULT_MAXLEN) -> Column:
    """Keep the first ``maxlen`` ids and pad after the end with 0."""
    c = F.col(ids) if isinstance(ids, str) else ids
    head = F.slice(c, 1, maxlen)
    pad = F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(maxlen) - F.size(head), F.lit(0)))
    return F.concat(head, pad)


def normalize_ids(ids: Column | str, num_tokens: int = DEFAULT_NUM_WORDS) -> Column:
    """Ids divided by the vocabulary size (``array<double>``)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda v: v.cast("double") / F.lit(float(num_tokens)))


def attention_mask(ids: Column | str) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda v: F.when(v != F.lit(PAD_ID), F.lit(1)).otherwise(F.lit(0)))


def oov_rate(encoded: DataFrame, ids: str = "ids", by: list[str] | None = None) -> DataFrame:
    """Share of token ids that are the OOV id (padding excluded).  Counted
    per row with array filters, then summed: no explode."""
    by = by or []
    per_row = encoded.select(
        *by,
        F.size(F.filter(ids, lambda v: v != F.lit(PAD_ID))).alias("_n"),
        F.size(F.filter(ids, lambda v: v == F.lit(OOV_ID))).alias("_o"),
    )
    return per_row.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("n_tokens"),
        F.sum("_o").cast("bigint").alias("n_oov"),
    ).withColumn("oov_share", F.col("n_oov") / F.col("n_tokens"))
