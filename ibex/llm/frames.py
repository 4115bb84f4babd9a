"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.session import ensure_checkpoint_dir


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder named in spark.checkpoint.dir."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a long job: shuffle files and checkpoints of
    frames that are gone are deleted once the driver's collector has seen
    that; a job of many small stages may not make it run by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0]
    return int(total or 0)


def bucketed(docs: DataFrame, id_col: str, text_col: str, n_buckets: int) -> DataFrame:
    """(bucket, id, text), the bucket a hash of the id and the text: a hot
    source, a run of copies and the rows of a null or repeated id are spread
    over all buckets."""
    key = F.col(id_col).cast("long")
    return docs.select(F.pmod(F.xxhash64(key, F.col(text_col).cast("string")), F.lit(n_buckets)).cast("int").alias("bucket"),
                       key.alias("id"), F.col(text_col).cast("string").alias("text"))


def parts(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Ids up to which a set of them is broadcast (about 20 MB); see ``without``.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, id_col: str, gone: DataFrame, *, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (one column of ids);
    rows with a null id stay.  The ids are counted first: up to
    ``broadcast_ids`` are broadcast, so that no text is shuffled; more are
    joined by a shuffle."""
    gone = checkpointed(gone.toDF("__gone").where("__gone IS NOT NULL").distinct())
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")


def without_rows(docs: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``find`` doesn't name: given a table, it
    returns one column of the ids that go.

    Ids that are distinct and not null (a count of the id column tells) are
    used as they are.  Otherwise every row first gets a number of its own, in
    the order of the ids (null last), and ``find`` sees that in ``id_col``: each
    decision then hits one row, and no other row of the same id.
    """
    key = F.col(id_col).cast("long")
    if docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").isEmpty():
        return without(docs, id_col, find(docs))
    number = "__row"
    while number in docs.columns:
        number += "_"
    # the row's place spreads even rows that agree in id and text
    placed = docs.withColumn(number, F.monotonically_increasing_id())
    numbered = checkpointed(placed.repartitionByRange(key.asc_nulls_last(), F.xxhash64(F.col(text_col).cast("string")), number)
                            .sortWithinPartitions(key.asc_nulls_last()).withColumn(number, F.monotonically_increasing_id()))
    return without(numbered, number, find(numbered.withColumn(id_col, F.col(number)))).drop(number)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
