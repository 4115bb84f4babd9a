"""Corpus, message and vector sources.

All readers return lazy DataFrames; nothing is collected.  Column names of
the returned frames are the library's canonical ones:

* corpus:   ``doc_id bigint, source string, text string``
* messages: ``msg_id string, category string, text string``
* vectors:  ``vec_id bigint, features array<float>, label int``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ibex.functions.text import normalize_newlines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, e.g. ``documents`` or ``embeddings``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly by a hash of their unique key where the input has
    fewer files than there are cores: a file of one row group is scanned by
    one task, however many splits its bytes make.  An input of many files is
    left as it is scanned.  ``partitions`` sets the number of partitions (and
    always deals).  Results never depend on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions is None:
        if len(df.inputFiles()) >= cores:
            return df
        partitions = max(cores, df.rdd.getNumPartitions())
    return df.repartition(partitions, key)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document table as a corpus: one row per book-like text, newlines
    normalised."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", "source", normalize_newlines("text").alias("text"))


def read_text_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Whole UTF-8 text files, one row per file (``source`` = file name).

    ``doc_id`` is a signed 64-bit hash of the path, so it does not depend on
    listing order or partitioning; a corpus of billions of files should join
    on ``source`` instead, because hashes may then coincide.
    """
    if isinstance(paths, str):
        paths = [paths]
    raw = spark.read.text(list(paths), wholetext=True)
    path = F.input_file_name()
    files = raw.select(
        F.xxhash64(path).alias("doc_id"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("source"),
        F.col("value").alias("text"),
    )
    # many small files are packed into few splits: spread them over the cores
    return spread(files, "doc_id").select("doc_id", "source", normalize_newlines("text").alias("text"))


MAX_LISTED_FILES = 1_000_000


def read_listed_files(spark: SparkSession, base_dir: str, manifest: DataFrame,
                      file_col: str = "source") -> DataFrame:
    """Read only the files a manifest lists (file names relative to
    ``base_dir``): the path list goes to the reader, so unlisted files are
    never opened.  The manifest size is checked before it is collected."""
    from ibex.operators.broadcast import bounded_rows

    rows = bounded_rows(manifest.select(file_col).distinct(), MAX_LISTED_FILES)
    if rows is None:
        raise ValueError(f"manifest lists more than {MAX_LISTED_FILES} files")
    paths = [f"{base_dir.rstrip('/')}/{r[0]}" for r in rows]
    return read_text_files(spark, paths)


MESSAGE_SCHEMA = T.StructType([
    T.StructField("Category", T.StringType()),
    T.StructField("Message", T.StringType()),
])


def read_messages_csv(spark: SparkSession, path: str, multi_line: bool = True, split: bool = True) -> DataFrame:
    """Category/message CSV with header.

    Files whose quoted fields span lines are read split by split
    (``split_csv``); ``split=False`` takes Spark's reader, one task a file,
    which also reads stray quotes.  ``multi_line=False`` is right where no
    quoted field spans lines.  ``msg_id`` is a SHA-256 of the row's
    content, and a row number among equal rows (which are interchangeable), so
    it depends on neither file layout nor scheduling."""
    if multi_line and split:
        from ibex.sources.split_csv import read_csv_split

        raw = read_csv_split(spark, path, "Category string, Message string")
    else:
        raw = (
            spark.read.schema(MESSAGE_SCHEMA)
            .option("header", "true").option("multiLine", str(multi_line).lower())
            .option("quote", '"').option("escape", '"')
            .csv(path)
        )
    content = F.sha2(F.concat_ws("\u0001", F.coalesce("Category", F.lit("\u0000")), F.coalesce("Message", F.lit("\u0000"))), 256)
    counted = (raw.groupBy(F.col("Category").alias("category"), F.col("Message").alias("text"), content.alias("_c"))
               .agg(F.count(F.lit(1)).alias("_n")))
    return (counted.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
            .select(F.concat_ws(":", "_c", "_i").alias("msg_id"), "category", "text"))


def read_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a message table: ``role`` is the category."""
    msgs = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("msg_id"),
        F.col("role").alias("category"),
        F.col("text"),
    )
    return spread(msgs, "msg_id")


def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense labelled vectors (the image-like dataset)."""
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    return spread(vec, "vec_id")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union of corpora with the canonical ``(doc_id, source, text)``
    columns; rows are appended, duplicates kept."""
    out = frames[0].select("doc_id", "source", "text")
    for f in frames[1:]:
        out = out.unionByName(f.select("doc_id", "source", "text"))
    return out


def read_benchmark_as_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "benchmark"), "item_id").select(
        F.col("item_id").alias("doc_id"),
        F.lit("benchmark").alias("source"),
        normalize_newlines("text").alias("text"),
    )
