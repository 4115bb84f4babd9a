"""End-to-end text plans: corpus -> paragraphs -> labels -> split ->
vocabulary -> encoded, padded model inputs.

Each stage returns a lazy DataFrame; only the vocabulary (bounded by
``num_words``) and the exact-split boundary reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.functions.text import clean_text
from ibex.operators import labels as L
from ibex.operators import split as S
from ibex.operators import vocab as V
from ibex.operators.paragraphs import paragraphs
from ibex.sources import corpus as C

TOKENIZERS = ("word", "subword")
# The original scripts' tokenizer names.
TOKENIZER_ALIASES = {"tf": "word", "bert": "subword"}


@dataclass(frozen=True)
class TextConfig:
    delimiter: str = "\n\n"
    min_chars: int = 300
    cutoff: int = 1800
    test_fraction: float = 0.2
    seed: int = 0
    exact_split: bool = False
    num_words: int = 1000
    maxlen: int = 500
    pad: bool = True
    normalize: bool = False
    tokenizer: str = "word"

    def with_(self, **kw) -> "TextConfig":
        return replace(self, **kw)


def check_tokenizer(name: str) -> str:
    """Explicit tokenizer choice (``word``/``tf`` or ``subword``/``bert``);
    unknown names are an error."""
    key = TOKENIZER_ALIASES.get(name.lower(), name.lower())
    if key not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; expected one of {TOKENIZERS}")
    return key


def labelled_paragraphs(corpus: DataFrame, manifest: DataFrame, cfg: TextConfig = TextConfig()) -> DataFrame:
    """``doc_id, pos, source, text, label`` for the pieces of listed books.
    The manifest join runs on the books, before the explode: pieces of
    unlisted books are never cut or cleaned, and the join sees one row per
    book instead of one per piece."""
    books = L.label_by_manifest(corpus, manifest, cfg.cutoff)
    paras = paragraphs(books, cfg.delimiter, cfg.min_chars, keep=("source", "label"))
    return paras.select("doc_id", "pos", "source", "text", "label")


def split_rows(rows: DataFrame, key: list[str], cfg: TextConfig = TextConfig()) -> DataFrame:
    fn = S.split_exact if cfg.exact_split else S.split_hash
    return fn(rows, key, cfg.test_fraction, cfg.seed)


def encoded(split_df: DataFrame, cfg: TextConfig = TextConfig(), vocab: DataFrame | None = None,
            text: str = "text", key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenise, fit the vocabulary on the train part, encode, pad.

    Returns ``(encoded frame, vocabulary)``.  Word tokens: ``ids
    array<int>`` of length ``maxlen`` when padding is on.  Subword tokens
    (``cfg.tokenizer``): begin/end-marked piece ids of the whole text,
    truncated at ``maxlen`` and, when padding is on, padded to the longest
    row of each part; the vocabulary is a ``(piece, id)`` table fitted on the
    train part unless given.
    """
    tok = V.with_tokens(split_df, text)
    if check_tokenizer(cfg.tokenizer) == "subword":
        from ibex.operators import subword as SWD

        if vocab is None:
            vocab = SWD.subword_vocab(tok.where("is_train"))
        enc = SWD.subword_encode(tok.drop("tokens"), vocab, text, max_length=cfg.maxlen, out="ids")
        if cfg.pad:
            enc = SWD.pad_to_longest(enc, "ids", "is_train", cfg.maxlen)
        return enc, vocab
    if vocab is None:
        vocab = V.vocabulary(tok.where("is_train"), cfg.num_words)
    enc = V.encode_tokens(tok, vocab, cfg.maxlen if cfg.pad else None, key=key).drop("tokens")
    if cfg.pad:
        enc = enc.withColumn("ids", V.pad_sequences("ids", cfg.maxlen))
    return enc, vocab


def trial_encoded(rows: DataFrame, key: list[str], trials, cfg: TextConfig = TextConfig(),
                  text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with one padded ids column ``ids_t{trial}`` per trial, each
    encoded with the vocabulary fitted on that trial's own train split (a
    fresh split and tokenizer per trial), plus the vocabularies
    ``(trial, token, n, id)``.  Counting is one shuffle for all trials;
    encoding is one Arrow lookup per trial in the same projection."""
    tok = V.with_tokens(rows, text)
    vocabs = V.trial_vocabularies(tok, key, trials, cfg.test_fraction, cfg.num_words)
    out = tok
    for t in trials:
        col = f"ids_t{t}"
        out = V.encode_tokens(out, vocabs.where(F.col("trial") == F.lit(t)), cfg.maxlen, out=col, key=key)
        out = out.withColumn(col, V.pad_sequences(col, cfg.maxlen))
    return out.drop("tokens"), vocabs


def corpus_pipeline(spark: SparkSession, sf_dir: str, cfg: TextConfig = TextConfig()) -> tuple[DataFrame, DataFrame]:
    """The book-paragraph pipeline over the ``documents`` table with the
    manifest derived from source names."""
    corpus = C.read_documents(spark, sf_dir)
    manifest = L.manifest_by_source_number(corpus)
    rows = labelled_paragraphs(corpus, manifest, cfg)
    return encoded(split_rows(rows, ["doc_id", "pos"], cfg), cfg, key=["doc_id", "pos"])


def message_rows(spark: SparkSession, sf_dir: str, negative: str = "user",
                 cfg: TextConfig = TextConfig(maxlen=50)) -> DataFrame:
    """Message pipeline front half: clean, label by category, split."""
    msgs = C.read_conversations(spark, sf_dir)
    cleaned = msgs.select("msg_id", "category", clean_text("text").alias("text"))
    labelled = L.label_by_category(cleaned, negative)
    return split_rows(labelled, ["msg_id"], cfg)


def message_pipeline(spark: SparkSession, sf_dir: str, negative: str = "user",
                     cfg: TextConfig = TextConfig(maxlen=50, normalize=True)) -> tuple[DataFrame, DataFrame]:
    enc, vocab = encoded(message_rows(spark, sf_dir, negative, cfg), cfg, key=["msg_id"])
    if cfg.normalize:
        enc = enc.withColumn("x", V.normalize_ids("ids", cfg.num_words))
    return enc, vocab
