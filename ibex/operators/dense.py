"""A single dense layer as an Arrow-batched projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def dense_layer(df: DataFrame, key: str, x: str, W: np.ndarray, b: np.ndarray, relu: bool = True,
                center: bool = False, out: str = "h") -> DataFrame:
    """``act((2x - 1 if center else x) W + b)`` per row; ``W`` and ``b``
    are shipped once as a broadcast variable.  Output ``key, out``."""
    from ibex.operators.vib import _list_array, _to_matrix

    bc = df.sparkSession.sparkContext.broadcast((np.asarray(W, float), np.asarray(b, float)))
    width = W.shape[0]
    src = df.select(key, x)
    schema = T.StructType([src.schema[key], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        w, bias = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            xm = _to_matrix(batch.column(x), width, np.float64)
            if center:
                xm = 2.0 * xm - 1.0
            h = xm @ w + bias
            if relu:
                h = np.maximum(h, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(key), _list_array(h, pa.float64())], names=[key, out])

    return src.mapInArrow(run, schema)
