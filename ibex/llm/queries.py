"""Registered queries of the operators in this package, and their SQL.

Each ``opN_`` query applies its operator, with production parameters, to its
whole table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.llm.frames import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.substring_dedup import substring_dedup

    out = substring_dedup(read_table(spark, sf_dir, "documents"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(read_table(spark, sf_dir, "documents"), keep_bytes=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.exact_dedup import exact_dedup

    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


ORACLE["op1_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.url_filter import filter_urls

    out = filter_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "page_id")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.secret_scan import BASE, secret_scan, span_text

    base = [r.kind for r in BASE]
    out = secret_scan(read_table(spark, sf_dir, "documents"))
    counts = (F.size(F.filter(F.transform("spans", lambda s: s["kind"]), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}")
              for k in base)
    return out.select(
        F.col("id").alias("doc_id"), *counts,
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    from ibex.llm.token_counts import read_vocabulary, token_counts

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    pieces, byte_fallback = read_vocabulary(vocabulary)
    out = token_counts(read_table(spark, sf_dir, "documents"), pieces, byte_fallback)
    return out.withColumnRenamed("id", "doc_id")


def bpe_file(path: str | None = None) -> str:
    """The public byte-level BPE file (or the one given)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


@query
def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from ibex.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), bpe_file(tokenizer)).withColumnRenamed("id", "doc_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.quality import quality_scores

    out = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.near_dedup import near_dedup

    return near_dedup(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which benchmark items were found, one row per pair."""
    from ibex.llm.decontaminate import contaminated_pairs

    out = contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op11_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.compression_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which every tenth text (by the checksum of
    its id) repeats a stretch of its words from some place to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    cycle = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    rebuilt = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), cycle), F.lit(1), F.greatest(n, F.lit(1)).cast("int"))
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(rebuilt, " "))
                       .otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.periodic_runs import digest, periodic_runs, strongest

    out = periodic_runs(planted_periods(read_table(spark, sf_dir, "documents")), keep_text=False)
    best = strongest(F.col("runs"))
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        digest(F.col("runs")).alias("runs_sha256"), "collapsed_sha256")


def branched(paths: DataFrame) -> DataFrame:
    """Every conversation rebuilt: the first turns of its hundred's first
    conversation, as many as its id's checksum says, then its own after as
    many."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6)).cast("int")
    base = paths.where(F.col("conv") % 100 == 0).select(F.col("conv").alias("base"), F.slice("path", 1, 5).alias("lead"))
    rows = paths.withColumn("base", F.col("conv") - F.col("conv") % 100).withColumn("h", h).join(base, "base", "left")
    own = F.slice("path", F.col("h") + 1, F.greatest(F.size("path"), F.lit(1)))
    return rows.select("conv", F.when(F.col("lead").isNull(), own).otherwise(F.concat(F.slice("lead", F.lit(1), F.col("h")), own)).alias("path"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ibex.llm.conversation_trie import trie_nodes, turn_paths

    return trie_nodes(branched(turn_paths(read_table(spark, sf_dir, "conversations"))))


# the checksum is computed bit by bit; a prefix is compared as the list of its turns
ORACLE["op13_conversation_trie"] = r"""
WITH RECURSIVE shifted(v, n, k) AS (
  SELECT i, i, 0 FROM range(256) AS r(i)
  UNION ALL
  SELECT v, CASE WHEN n % 2 = 1 THEN xor(n >> 1, 3988292384::BIGINT) ELSE n >> 1 END, k + 1 FROM shifted WHERE k < 8),
steps AS (SELECT v, n FROM shifted WHERE k = 8),
convs AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, k, x) AS (
  SELECT c, s, 0, 4294967295::BIGINT FROM convs
  UNION ALL
  SELECT c, s, k + 1, xor(x >> 8, steps.n) FROM crc JOIN steps ON steps.v = xor(x & 255, ascii(substr(s, k + 1, 1))::BIGINT)
  WHERE k < length(s)),
heads AS (SELECT c, c - c % 100 AS base, xor(x, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = length(s)),
turns AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT heads.c, pos, turn FROM heads JOIN turns ON turns.c = heads.base AND pos <= h
  UNION ALL
  SELECT heads.c, 1000000 + pos, turn FROM heads JOIN turns ON turns.c = heads.c AND pos > h),
paths AS (
  SELECT heads.c, coalesce(list(turn ORDER BY pos) FILTER (WHERE turn IS NOT NULL), []) AS path
  FROM heads LEFT JOIN rebuilt ON rebuilt.c = heads.c GROUP BY heads.c),
cut AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths),
nodes AS (
  SELECT path[1:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends_sha256
  FROM cut GROUP BY path[1:d], d),
linked AS (
  SELECT a.node, a.d, a.conv_id, a.n_convs, a.ends_sha256, b.conv_id AS parent_conv_id,
         CASE WHEN a.d > 0 THEN (a.n_convs - 1) * length(a.node[a.d].text) ELSE 0 END AS saved
  FROM nodes a LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.node = a.node[1:a.d - 1]),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY node[1:d - 1], d - 1),
full_nodes AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.d = l.d AND k.node = l.node),
upward AS (SELECT node, d, saved, n_children, unnest(range(0, d + 1)) AS k FROM full_nodes),
sums AS (
  SELECT node[1:k] AS node, k AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM upward GROUP BY node[1:k], k)
SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.d = f.d AND s.node = f.node
"""


def _state() -> None:
    """Statements kept in a module of their own."""
    from ibex.llm import oracle
    from ibex.llm.secret_scan import BASE, FURTHER

    ORACLE["op2_substring_dedup"] = oracle.substring_sql()
    ORACLE["op5_secret_scan"] = oracle.secret_sql(BASE + FURTHER, BASE)
    ORACLE["op9_near_dedup"] = oracle.near_sql()


_state()
