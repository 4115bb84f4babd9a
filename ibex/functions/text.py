"""Text column expressions (all JVM-side, codegen friendly).

Every function takes and returns a ``Column`` so it can be used inside
``select``/``withColumn`` on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the original pipeline for identical results.
#
# Characters the word-sequence tokeniser turns into separators (its default
# filter set: ASCII punctuation, underscore, tab and newline), in natural order.
TOKEN_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
# Token id reserved for padding and for out-of-vocabulary words.
PAD_ID = 0
OOV_ID = 1
# ---------------------------------------------------------------------------

# A "word character" is a letter, a number or the underscore (Unicode-aware
# like Python's ``\w`` on str); everything else becomes a space.
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_newlines(c: Column | str) -> Column:
    """Universal newlines: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def clean_text(c: Column | str) -> Column:
    """Non-word characters to one space each, runs of spaces collapsed, trimmed:
    a run of non-word characters, spaces among them, is one space.

    After the replacement the only whitespace left is U+0020, so ``trim`` is an
    exact stand-in for ``strip``.
    """
    return F.trim(F.regexp_replace(_col(c), NON_WORD_PATTERN + "+", " "))


def tokenize(c: Column | str, lower: bool = True,
             filters: str = TOKEN_FILTERS) -> Column:
    """Word-sequence tokeniser: lower-case, filter characters to spaces,
    split on a single space, drop empty pieces.  Returns ``array<string>``."""
    col = _col(c)
    if lower:
        col = F.lower(col)
    # splitting at runs of filter characters and spaces is one pass
    between = "[ " + "".join(ch if ch.isspace() else "\\" + ch for ch in filters) + "]+"
    return F.array_remove(F.split(col, between), "")


def char_length_over(c: Column | str, min_chars: int) -> Column:
    """Strict length predicate in code points (``len(x) > min_chars``)."""
    return F.length(_col(c)) > F.lit(min_chars)
