"""Paragraph explode, length filter and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.functions.text import char_length_over, clean_text

DEFAULT_DELIMITER = "\n\n"
DEFAULT_MIN_CHARS = 300


def literal_pattern(s: str) -> str:
    """Java regex matching ``s`` literally."""
    if "\\E" in s:
        return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)
    return "\\Q" + s + "\\E"


def paragraphs(corpus: DataFrame, delimiter: str = DEFAULT_DELIMITER,
               min_chars: int = DEFAULT_MIN_CHARS, clean: bool = True,
               keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """Split every text on the literal ``delimiter`` (non-overlapping, left to
    right, trailing empty pieces kept), keep pieces strictly longer than
    ``min_chars`` code points (tested on the raw piece), then clean them.

    Output: ``doc_id, pos (0-based piece index), *keep, text``.  A pure
    generator + filter: no shuffle, partitioning of the input is kept.
    """
    pieces = corpus.select(
        "doc_id", *keep,
        F.posexplode(F.split(F.col("text"), literal_pattern(delimiter), -1)).alias("pos", "piece"),
    )
    kept = pieces.where(char_length_over("piece", min_chars))
    text = clean_text("piece") if clean else F.col("piece")
    return kept.select("doc_id", F.col("pos").cast("int").alias("pos"), *keep, text.alias("text"))
