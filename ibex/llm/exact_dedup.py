"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after every run of ASCII white space
became one space.  Groups are refined from cheap keys to the full one:

1. by length of the normalised text,
2. by length and a hash of its first ``prefix`` characters, among rows whose
   length occurs more than once,
3. by length, prefix hash and the SHA-256 of the whole normalised text, among
   rows whose second key occurs more than once.

Each row's keys are computed where the row is read, so the text itself is
never shuffled: rows of about 60 bytes are.  The full hash of a row enters a
shuffle only if its group survived step 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ibex.llm.frames import checkpointed, text_of, without_rows

#: One run of ASCII white space that is not a single space already.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(col: str) -> Column:
    """The text with every run of ASCII white space replaced by one space;
    null counts as empty."""
    return F.regexp_replace(text_of(col), _RUNS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = 256) -> DataFrame:
    """One row per input row: ``id``, ``keep_id`` (smallest id among the rows
    with an equal text), ``group_size``, ``kept`` and ``text_sha256``
    (lowercase hex, normalised text in UTF-8).

    A null text equals an empty one.  A null id is larger than any other, so
    such a row stays only if no equal text has an id; then ``keep_id`` is null
    and every such row is kept.  Rows that repeat an id count one by one in
    ``group_size`` and share ``kept``.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.

    The joins back to the groups are on keys that a third of all rows may
    hold; the group side has one row per key, so adaptive execution splits
    the row side of such a partition.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("t"))
    rows = checkpointed(text.select(
        "id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("p"),
        F.sha2(F.col("t").cast("binary"), 256).alias("h")))

    def repeated(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")

    same_length = rows.select("n", "p").join(repeated(rows, "n"), "n", "left_semi")
    same_prefix = repeated(same_length, "n", "p")
    groups = (rows.join(same_prefix, ["n", "p"], "left_semi").groupBy("n", "p", "h")
              .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    return (rows.join(groups, ["n", "p", "h"], "left")
            .select("id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
                    F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
                    F.when(F.col("c").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("first_id"))).alias("kept"),
                    F.col("h").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns:
    one row of each group of equal texts, also where ids repeat or are null."""
    return without_rows(docs, id_col, text_col, lambda rows: exact_dedup(rows, id_col, text_col).where(~F.col("kept")).select("id"))
