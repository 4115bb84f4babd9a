"""Deterministic, partition-independent pseudo-random values.

``rand``/``randn`` depend on partitioning, so a rerun after an executor
loss or a repartition would draw different values.  Instead every value is a
function of ``(seed, key...)`` through MD5, which Spark and plain SQL engines
both provide, so results are reproducible and checkable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key_string(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts
    ]
    return F.concat_ws(":", *cols)


def hash32(seed, *parts) -> Column:
    """First 32 bits of ``md5('seed:part1:part2...')`` as a bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(_key_string(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from :func:`hash32`."""
    return hash32(seed, *parts) / F.lit(TWO_32)


def _hex_to_unit_open(hex8: Column) -> Column:
    # (h + 0.5) / 2^32 lies strictly inside (0, 1): safe for log().
    return (F.conv(hex8, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO_32)


def gaussian_array(seed, key: Column | str, n: int) -> Column:
    """``array<double>`` of ``n`` normal draws for one row; draw ``i`` is
    a Box-Muller transform of ``md5('seed:key:i')``."""
    key_col = F.col(key) if isinstance(key, str) else key
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: _gaussian_expr(seed, key_col, i),
    )


def _gaussian_expr(seed, key_col: Column, i: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key_col.cast("string"), i.cast("string")))
    u1 = _hex_to_unit_open(F.substring(digest, 1, 8))
    u2 = _hex_to_unit_open(F.substring(digest, 9, 8))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
