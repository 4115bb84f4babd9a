"""Subword (greedy longest-match-first) encoding.

The piece vocabulary is a table ``(piece string, id int)``: special
markers, whole words, single characters and ``##``-prefixed continuation
characters.  :func:`subword_vocab` derives one from the training words;
any user table with the same columns works (a pretrained file loaded with
``spark.read``).

Plan: splitting on spaces is a JVM projection; the piece lookup is an
Arrow UDF that matches the *distinct* words of each Arrow batch (a word
holding a third of all rows is matched once per batch) in a trie of the piece
table, all words in one step (``piece_trie``), and scatters the results back
with vectorised gathers; truncation, begin/end markers and padding are JVM
expressions again.  No shuffle.  :func:`wordpiece` is the rule for one word.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pyarrow as pa

from ibex.operators.broadcast import broadcast_if_small
from ibex.operators.piece_trie import CONTINUATION, MAX_CHARS_PER_WORD, PieceTrie, encode_lists
from ibex.operators.vocab import token_counts

# ---------------------------------------------------------------------------
# Fixed values of the common uncased subword convention (with the ASCII
# punctuation ranges of ``_is_punct``: 33-47, 58-64, 91-96, 123-126).
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
DEFAULT_MAX_LENGTH = 512
# ---------------------------------------------------------------------------
MAX_VOCAB = 5_000_000


def subword_vocab(tokenized_train: DataFrame, n_words: int = 2000, n_chars: int | None = None,
                  tokens: str = "tokens") -> DataFrame:
    """Specials (ids 0..4), then every character (or the ``n_chars`` most
    frequent), their ``##`` continuation forms, then the ``n_words`` most
    frequent words; ties by string.  All characters are kept by default, so
    no script turns into unknown words; their number is bounded by the
    character set.

    Eager: the token counts (one aggregation over the corpus) are kept
    while both top-k cuts are taken from them, so the corpus is tokenised and
    counted once; the bounded result is returned as a small local table.
    """
    spark = tokenized_train.sparkSession
    counts = token_counts(tokenized_train, tokens).persist()
    try:
        words = counts.orderBy(F.desc("n"), F.asc("token")).limit(n_words).collect()
        chars = (
            counts.select(F.explode(F.split(F.lower("token"), "")).alias("c"), "n")
            .where(F.col("c") != "")
            .groupBy("c").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), F.asc("c"))
        )
        chars = (chars if n_chars is None else chars.limit(n_chars)).collect()
    finally:
        counts.unpersist()
    pieces: dict[str, int] = {}
    for s in SPECIALS:
        pieces.setdefault(s, len(pieces))
    for r in chars:
        pieces.setdefault(r["c"], len(pieces))
    for r in chars:
        pieces.setdefault(CONTINUATION + r["c"], len(pieces))
    for r in words:  # a word equal to a character keeps the character's id
        pieces.setdefault(r["token"], len(pieces))
    return spark.createDataFrame(list(pieces.items()), "piece string, id int")


def basic_word(word: str, lower: bool = True) -> list[str]:
    """Uncased basic tokenisation of one whitespace-free word: lower-case,
    strip accents (NFD without combining marks), split off punctuation."""
    if word.isascii() and word.isalnum():  # common case: nothing to strip or split
        return [word.lower() if lower else word]
    if lower:
        word = word.lower()
        word = "".join(ch for ch in unicodedata.normalize("NFD", word) if unicodedata.category(ch) != "Mn")
    out, cur = [], []
    for ch in word:
        if _is_punct(ch):
            if cur:
                out.append("".join(cur))
                cur = []
            out.append(ch)
        else:
            cur.append(ch)
    if cur:
        out.append("".join(cur))
    return out


def _is_punct(ch: str) -> bool:
    cp = ord(ch)
    if 33 <= cp <= 47 or 58 <= cp <= 64 or 91 <= cp <= 96 or 123 <= cp <= 126:
        return True
    return unicodedata.category(ch).startswith("P")


def wordpiece(word: str, vocab: dict, unk_id: int) -> list[int]:
    """Greedy longest-match-first pieces of one word."""
    if len(word) > MAX_CHARS_PER_WORD:
        return [unk_id]
    out, start, n = [], 0, len(word)
    while start < n:
        prefix = CONTINUATION if start else ""
        end = next((e for e in range(n, start, -1) if prefix + word[start:e] in vocab), None)
        if end is None:
            return [unk_id]
        out.append(vocab[prefix + word[start:end]])
        start = end
    return out


def encode_word(word: str, vocab: dict, unk_id: int, lower: bool = True) -> list[int]:
    return [i for w in basic_word(word, lower) for i in wordpiece(w, vocab, unk_id)]


def _make_encoder(bc_vocab, lower: bool):
    trie = None  # of one worker

    def encode(words: pa.Array) -> pa.Array:
        nonlocal trie
        if trie is None:
            trie = PieceTrie(bc_vocab.value, bc_vocab.value.get("[UNK]", 1))
        return encode_lists(trie, words, lower)

    return encode


def collect_pieces(vocab: DataFrame) -> dict:
    """Piece -> id dict; the vocabulary size is checked before it is
    collected and shipped."""
    rows = vocab.select("piece", "id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError("piece vocabulary too large to ship")
    return {r["piece"]: int(r["id"]) for r in rows}


def subword_encode(df: DataFrame, vocab: DataFrame, text: str = "text", max_length: int = DEFAULT_MAX_LENGTH,
                   lower: bool = True, out: str = "input_ids") -> DataFrame:
    """``[CLS] pieces... [SEP]`` ids, pieces truncated so the row has at most
    ``max_length`` ids."""
    pieces = collect_pieces(vocab)
    bc = df.sparkSession.sparkContext.broadcast(pieces)
    udf = F.arrow_udf(_make_encoder(bc, lower), T.ArrayType(T.IntegerType()))
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != F.lit(""))
    raw = udf(words)
    cls_id, sep_id = pieces["[CLS]"], pieces["[SEP]"]
    body = F.slice(raw, 1, max_length - 2)
    return df.withColumn(out, F.concat(F.array(F.lit(cls_id)), body, F.array(F.lit(sep_id))))


def pad_to_longest(df: DataFrame, ids: str = "input_ids", by: str | None = "is_train",
                   max_length: int = DEFAULT_MAX_LENGTH, pad_id: int = 0, materialize: bool = True) -> DataFrame:
    """Pad every row to the longest row of its group (capped at
    ``max_length``).  The widths are one aggregate with one row per group,
    broadcast after a size check (a shuffle join on a few-valued key would
    send each group to a single task).  With ``materialize`` the unpadded
    rows are checkpointed first, so the Python encoder runs once, not once
    for the widths and once for the output."""
    if materialize:
        from ibex.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    width = F.least(F.lit(max_length), F.max(F.size(ids))).alias("_w")
    if by is None:
        w = df.agg(width).first()["_w"] or 0
        joined = df.withColumn("_w", F.lit(w))
    else:
        joined = df.join(broadcast_if_small(df.groupBy(by).agg(width)), by)
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.col("_w") - F.size(ids), F.lit(0)))
    return joined.withColumn(ids, F.concat(F.col(ids), pad)).drop("_w")
