"""Size-checked broadcast.

A side is broadcast only when its row count is proven small: either by
construction (a ``limit``-bounded table such as the vocabulary) or by an
explicit bounded count here.  Otherwise the frame is returned unchanged and
Spark plans a shuffle join (AQE may still convert it at run time when the
materialised side turns out small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def bounded_rows(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows``, else ``None``.

    Fetches at most ``max_rows + 1`` rows (one job), so the check costs no
    more than the bound even when the frame is large.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Hint a broadcast when the frame has at most ``max_rows`` rows.

    The small side is materialised once (by the check itself) and turned
    into a local relation, so the join does not compute it again.
    """
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
