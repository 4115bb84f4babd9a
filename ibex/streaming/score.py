"""Streaming scoring: new documents arriving as parquet files are cut into
paragraphs, encoded with a fitted vocabulary and scored by a fitted model.

Every stage is stateless (projections, a generator, an Arrow UDF and
``mapInArrow``), so the same operators run unchanged on a streaming
DataFrame; progress and exactly-once file output come from the checkpoint,
which lives in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ibex.functions.text import normalize_newlines
from ibex.operators import vib as VIB
from ibex.operators import vocab as V
from ibex.operators.paragraphs import paragraphs
from ibex.operators.vib_math import VibSpec
from ibex.plans.text import TextConfig
from ibex.session import ensure_checkpoint_dir

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_document_stream(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.parquet(path)
    return raw.select("doc_id", "source", normalize_newlines("text").alias("text"))


def score_documents(corpus: DataFrame, vocab: DataFrame, spec: VibSpec, params: np.ndarray,
                    cfg: TextConfig = TextConfig(), seed=0, n_draws: int = VIB.DEFAULT_DRAWS) -> DataFrame:
    """Batch or streaming: ``doc_id, pos, source, pred, probs`` per paragraph."""
    paras = paragraphs(corpus, cfg.delimiter, cfg.min_chars)
    tok = V.with_tokens(paras)
    enc = V.encode_tokens(tok, vocab, cfg.maxlen).withColumn("ids", V.pad_sequences("ids", cfg.maxlen))
    scored = VIB.predict(enc.select("doc_id", "pos", "source", "ids"), spec, params, ["doc_id", "pos"], "ids",
                         seed=seed, n_draws=n_draws)
    return scored.select("doc_id", "pos", "pred", "probs")


def start_scoring(stream: DataFrame, sink_path: str, name: str = "ibex_scoring",
                  available_now: bool = True) -> StreamingQuery:
    """Append scored paragraphs to parquet; the query checkpoint is a
    sub-folder of the session's shared checkpoint folder."""
    # one checkpoint per sink: a restart against the same sink resumes, other sinks start fresh
    tag = hashlib.md5(sink_path.encode()).hexdigest()[:12]
    ckpt = ensure_checkpoint_dir(stream.sparkSession).rstrip("/") + f"/streams/{name}-{tag}"
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", ckpt).queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def score_stream_once(spark: SparkSession, source: str, sink_path: str, vocab: DataFrame, spec: VibSpec,
                      params: np.ndarray, cfg: TextConfig = TextConfig()) -> DataFrame:
    """Process everything currently in the ``source`` folder and return the
    sink."""
    q = start_scoring(score_documents(read_document_stream(spark, source), vocab, spec, params, cfg), sink_path)
    q.awaitTermination()
    return spark.read.parquet(sink_path).select("doc_id", "pos", "pred", F.col("probs"))
