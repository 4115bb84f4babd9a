"""Model-ready column set for a sequence classifier: ids, mask, one-hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.functions.numeric import one_hot
from ibex.operators.vocab import attention_mask, pad_sequences


def model_inputs(encoded: DataFrame, maxlen: int | None = 500, k: int = 2,
                 ids: str = "ids", label: str = "label") -> DataFrame:
    """Adds ``input_ids`` (padded to ``maxlen`` when given), ``attention_mask``
    (1 where the id is not padding) and ``labels`` (one-hot doubles)."""
    seq = pad_sequences(ids, maxlen) if maxlen is not None else F.col(ids)
    return (
        encoded.withColumn("input_ids", seq)
        .withColumn("attention_mask", attention_mask("input_ids"))
        .withColumn("labels", one_hot(label, k))
    )


def write_model_inputs(df: DataFrame, path: str) -> None:
    df.select("input_ids", "attention_mask", "labels").write.mode("overwrite").parquet(path)
