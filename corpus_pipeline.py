"""A training-data pipeline over ``documents``: five stages, each calling one
operator of ``ibex.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` applies them in order; each result is written as
Parquet in the shared checkpoint folder and read again as the next stage's
input, so a lost executor costs the running stage only.  Every stage but the
last returns the columns it was given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ibex.llm.decontaminate import drop_contaminated
from ibex.llm.exact_dedup import drop_copies
from ibex.llm.near_dedup import drop_near_copies
from ibex.llm.packing import pack
from ibex.llm.quality import drop_low_quality
from ibex.llm.queries import bpe_file
from ibex.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (learnt from the labelled
    rows among ``docs``)."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group with equal normalised texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed into sequences."""
    return pack(docs, bpe_file()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near),
          ("decontamination", decontaminate), ("packing", packing)]

#: Model fitting, set similarity and tokenizing are beyond SQL; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
