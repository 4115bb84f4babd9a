"""Labelling: by a source -> year manifest, by category, one-hot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.functions.numeric import one_hot
from ibex.operators.broadcast import broadcast_if_small

DEFAULT_CUTOFF = 1800
MANIFEST_MAX_ROWS = 100_000


def manifest_frame(spark: SparkSession, mapping: Mapping[str, int]) -> DataFrame:
    """A user manifest ``{source: year}`` as a DataFrame ``(source, year)``."""
    return spark.createDataFrame(
        [(k, int(v)) for k, v in mapping.items()], "source string, year int"
    )


def manifest_by_source_number(corpus: DataFrame, base_year: int = 1700,
                              years_per_step: int = 10) -> DataFrame:
    """Derive a manifest from the corpus' own ``source`` names: a source
    whose name ends in the number N gets year ``base_year + step * N``.
    Grouping is a partial + final hash aggregate on one small column."""
    n = F.regexp_extract("source", r"(\d+)$", 1)
    return (
        corpus.select("source").distinct()
        .where(n != "")
        .select("source", (F.lit(base_year) + F.lit(years_per_step) * n.cast("int")).cast("int").alias("year"))
    )


def label_by_manifest(rows: DataFrame, manifest: DataFrame, cutoff: int = DEFAULT_CUTOFF,
                      key: str = "source") -> DataFrame:
    """Inner join on ``key`` with the manifest; ``label = 0`` when the year is
    before ``cutoff`` else 1.  Rows of sources missing from the manifest are
    dropped (only listed books are read).  The manifest is broadcast when its
    size check passes, else Spark shuffles both sides."""
    m = broadcast_if_small(manifest.select(key, "year"), MANIFEST_MAX_ROWS)
    joined = rows.join(m, on=key, how="inner")
    return joined.withColumn(
        "label", F.when(F.col("year") < F.lit(cutoff), F.lit(0)).otherwise(F.lit(1))
    ).drop("year")


def label_by_table(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label_col: str = "quality",
                   max_broadcast_rows: int = MANIFEST_MAX_ROWS) -> DataFrame:
    """Ready-made labels from a table keyed like the rows (inner join: rows
    without a label are dropped).  A small label table is broadcast after a
    size check; a large one is joined by shuffle on the (unique) key, which
    cannot be skewed."""
    lab = labels.select(key, F.col(label_col).cast("int").alias("label"))
    return rows.drop("label").join(broadcast_if_small(lab, max_broadcast_rows), key, "inner")


def label_by_category(rows: DataFrame, negative: str = "ham",
                      column: str = "category") -> DataFrame:
    """``label = 0`` when ``column`` equals the negative class, else 1
    (null categories get 1)."""
    return rows.withColumn(
        "label",
        F.when(F.col(column) == F.lit(negative), F.lit(0)).otherwise(F.lit(1)),
    )


def with_one_hot(rows: DataFrame, k: int, label: str = "label",
                 out: str = "label_one_hot") -> DataFrame:
    return rows.withColumn(out, one_hot(label, k))
