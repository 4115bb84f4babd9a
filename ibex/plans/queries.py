"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and the
matching plain-SQL oracle statements.

Arrays leave a query as scalar strings (ints joined by a space, doubles as
``%.6f``), doubles are rounded to 6 places and integers are bigint, so the
Spark result and the SQL result compare column by column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.functions.numeric import one_hot
from ibex.functions.text import clean_text, tokenize
from ibex.operators import labels as L
from ibex.operators import split as S
from ibex.operators import vectors as VEC
from ibex.operators import vocab as V
from ibex.operators.paragraphs import paragraphs
from ibex.plans import oracle as O
from ibex.plans.text import TextConfig, labelled_paragraphs, split_rows
from ibex.sources import corpus as C
from ibex.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def join_ints(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda v: v.cast("string")), " ")


def join_doubles(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda v: F.format_string("%.6f", v)), " ")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # + 0.0 turns a rounded -0.0 into 0.0 so signs of zero compare equal
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# ---------------------------------------------------------------- stages ---

# lines are the pieces of these books: blank lines hardly occur in the tables
CFG = TextConfig(delimiter="\n")


def _labelled(spark, sf_dir, cfg: TextConfig = CFG) -> DataFrame:
    corpus = C.read_documents(spark, sf_dir)
    return labelled_paragraphs(corpus, L.manifest_by_source_number(corpus), cfg)


def _split(spark, sf_dir, cfg: TextConfig = CFG) -> DataFrame:
    return split_rows(_labelled(spark, sf_dir, cfg), ["doc_id", "pos"], cfg)


def _tokens(spark, sf_dir, cfg: TextConfig = CFG) -> DataFrame:
    return V.with_tokens(_split(spark, sf_dir, cfg))


def _vocab(spark, sf_dir, cfg: TextConfig = CFG) -> tuple[DataFrame, DataFrame]:
    tok = _tokens(spark, sf_dir, cfg)
    return tok, V.vocabulary(tok.where("is_train"), cfg.num_words)


def _encoded(spark, sf_dir, cfg: TextConfig = CFG) -> DataFrame:
    """Ids of every token; only padding truncates."""
    tok, vocab = _vocab(spark, sf_dir, cfg)
    return V.encode_tokens(tok, vocab, None, key=["doc_id", "pos"])


# ------------------------------------------------------- sources (S1-S4) ---

@register("read_corpus", f"WITH {O.docs_cte()} SELECT doc_id, source, text, "
          "CAST(length(text) AS BIGINT) AS n_chars FROM docs")
def q_read_corpus(spark, sf_dir):
    d = C.read_documents(spark, sf_dir)
    return d.select("doc_id", "source", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("union_sources",
          "SELECT doc_id, source, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM ("
          "SELECT doc_id, source, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents "
          "UNION ALL SELECT item_id AS doc_id, 'benchmark' AS source, "
          "regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM benchmark)")
def q_union_sources(spark, sf_dir):
    u = C.union_sources(C.read_documents(spark, sf_dir), C.read_benchmark_as_corpus(spark, sf_dir))
    return u.select("doc_id", "source", F.md5("text").alias("text_md5"),
                    F.length("text").cast("bigint").alias("n_chars"))


# ------------------------------------------- projections / filters (P) ---

@register("paragraphs", f"WITH {O.paragraphs_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, source, text FROM paras")
def q_paragraphs(spark, sf_dir):
    p = paragraphs(C.read_documents(spark, sf_dir))
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "source", "text")


@register("paragraphs_lines",
          f"WITH {O.paragraphs_cte(chr(10), 300)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, source, text FROM paras")
def q_paragraphs_lines(spark, sf_dir):
    p = paragraphs(C.read_documents(spark, sf_dir), delimiter="\n", min_chars=300)
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "source", "text")


@register("clean_text", f"SELECT doc_id, {O.clean_sql('text')} AS clean FROM documents")
def q_clean_text(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("clean"))


@register("label_by_manifest",
          f"WITH {O.labelled_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, source, "
          "CAST(label AS BIGINT) AS label FROM labelled")
def q_label_by_manifest(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "source", F.col("label").cast("bigint").alias("label"))


@register("label_by_table",
          f"WITH {O.paragraphs_cte(chr(10))} SELECT p.doc_id, CAST(p.pos AS BIGINT) AS pos, "
          "CAST(l.quality AS BIGINT) AS label FROM paras p JOIN labels l ON p.doc_id = l.doc_id")
def q_label_by_table(spark, sf_dir):
    p = paragraphs(C.read_documents(spark, sf_dir), delimiter=CFG.delimiter)
    lab = L.label_by_table(p, C.table(spark, sf_dir, "labels"), "doc_id", "quality")
    return lab.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("label").cast("bigint").alias("label"))


@register("label_by_category",
          "SELECT concat_ws(':', conv_id, turn) AS msg_id, role AS category, "
          "CAST(CASE WHEN role = 'user' THEN 0 ELSE 1 END AS BIGINT) AS label FROM conversations")
def q_label_by_category(spark, sf_dir):
    m = L.label_by_category(C.read_conversations(spark, sf_dir), negative="user")
    return m.select("msg_id", "category", F.col("label").cast("bigint").alias("label"))


@register("one_hot",
          f"WITH {O.labelled_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, "
          "CASE WHEN label = 0 THEN '1 0' WHEN label = 1 THEN '0 1' ELSE '0 0' END AS one_hot FROM labelled")
def q_one_hot(spark, sf_dir):
    oh = one_hot("label", 2)
    return _labelled(spark, sf_dir).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        join_ints(F.transform(oh, lambda v: v.cast("int"))).alias("one_hot"))


@register("tokenize",
          f"WITH {O.tokens_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, "
          "CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tok")
def q_tokenize(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


# --------------------------------------------------------- splits (X) ---

@register("split_hash",
          f"WITH {O.split_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, is_train FROM split")
def q_split_hash(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "is_train")


@register("split_exact",
          f"WITH {O.split_cte(exact=True)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, is_train FROM split")
def q_split_exact(spark, sf_dir):
    s = split_rows(_labelled(spark, sf_dir), ["doc_id", "pos"], CFG.with_(exact_split=True))
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "is_train")


_N_TRIALS = 5


@register("split_trials",
          f"WITH {O.labelled_cte()}, trials AS (SELECT CAST(range AS INTEGER) AS trial FROM range({_N_TRIALS})) "
          "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(trial AS BIGINT) AS trial, "
          f"{O.uniform_sql(None, 'doc_id', 'pos', seed_sql='CAST(trial AS VARCHAR)')}"
          " >= 0.2 AS is_train FROM labelled, trials")
def q_split_trials(spark, sf_dir):
    t = S.split_trials(_labelled(spark, sf_dir), ["doc_id", "pos"], _N_TRIALS)
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.posexplode("is_train_trials").alias("trial", "is_train")) \
        .withColumn("trial", F.col("trial").cast("bigint"))


_BATCH = 50


@register("minibatch_ids",
          f"WITH {O.split_cte()}, tr AS (SELECT * FROM split WHERE is_train), "
          "nb AS (SELECT greatest(count(*) // 50, 1) AS n FROM tr) "
          "SELECT doc_id, CAST(pos AS BIGINT) AS pos, "
          f"CAST({O.hash32_sql(7919, 'doc_id', 'pos')} % (SELECT n FROM nb) AS BIGINT) AS batch FROM tr")
def q_minibatch_ids(spark, sf_dir):
    tr = _split(spark, sf_dir).where("is_train")
    n = tr.count()
    b, _ = S.minibatch_ids(tr, ["doc_id", "pos"], _BATCH, n)
    return b.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("batch").cast("bigint").alias("batch"))


@register("minibatch_exact",
          f"WITH {O.split_cte()}, tr AS (SELECT * FROM split WHERE is_train), "
          f"r AS (SELECT doc_id, pos, row_number() OVER (ORDER BY {O.hash32_sql(7919, 'doc_id', 'pos')}, "
          "doc_id, pos) - 1 AS rn, count(*) OVER () AS n FROM tr) "
          "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(rn // 50 AS BIGINT) AS batch FROM r "
          "WHERE rn < (n // 50) * 50")
def q_minibatch_exact(spark, sf_dir):
    """Contiguous batches of exactly 50 train rows in a fixed shuffled
    order, the remainder dropped."""
    tr = _split(spark, sf_dir).where("is_train")
    b, _ = S.minibatch_exact(tr, ["doc_id", "pos"], _BATCH)
    return b.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("batch").cast("bigint").alias("batch"))


# ----------------------------------------------- vocabulary / encoding ---

@register("token_counts",
          f"WITH {O.vocab_cte()} SELECT token, CAST(n AS BIGINT) AS n FROM counts")
def q_token_counts(spark, sf_dir):
    return V.token_counts(_tokens(spark, sf_dir).where("is_train")).select("token", F.col("n").cast("bigint").alias("n"))


@register("vocabulary",
          f"WITH {O.vocab_cte()} SELECT token, CAST(n AS BIGINT) AS n, CAST(id AS BIGINT) AS id FROM vocab")
def q_vocabulary(spark, sf_dir):
    _, vocab = _vocab(spark, sf_dir)
    return vocab.select("token", F.col("n").cast("bigint").alias("n"), F.col("id").cast("bigint").alias("id"))


@register("encode_tokens",
          f"WITH {O.encoded_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, "
          f"CAST(len(ids) AS BIGINT) AS n_ids, {O.join_ints('ids')} AS ids FROM enc")
def q_encode_tokens(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.size("ids").cast("bigint").alias("n_ids"), join_ints("ids").alias("ids"))


@register("pad_sequences",
          f"WITH {O.encoded_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, "
          f"{O.join_ints(O.padded_sql('ids', 500))} AS ids FROM enc")
def q_pad_sequences(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    join_ints(V.pad_sequences("ids", CFG.maxlen)).alias("ids"))


@register("oov_rate",
          f"WITH {O.encoded_cte()}, per AS (SELECT is_train, len(list_filter(ids, lambda v: v <> 0)) AS n, "
          "len(list_filter(ids, lambda v: v = 1)) AS o FROM enc) "
          "SELECT is_train, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(o) AS BIGINT) AS n_oov, "
          "round(sum(o) / sum(n), 6) + 0.0 AS oov_share FROM per GROUP BY is_train")
def q_oov_rate(spark, sf_dir):
    r = V.oov_rate(_encoded(spark, sf_dir), by=["is_train"])
    return r.select("is_train", "n_tokens", "n_oov", r6("oov_share").alias("oov_share"))


@register("class_counts",
          f"WITH {O.split_cte()} SELECT is_train, CAST(label AS BIGINT) AS label, count(*) AS n "
          "FROM split GROUP BY is_train, label")
def q_class_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("is_train", F.col("label").cast("bigint").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("trial_vocabulary",
          f"WITH {O.labelled_cte()}, tok AS (SELECT doc_id, pos, {O.tokens_sql('text')} AS tokens FROM labelled), "
          "tr AS (SELECT range AS trial FROM range(5)), "
          "ex AS (SELECT tr.trial, unnest(tok.tokens) AS token FROM tok, tr "
          f"WHERE {O.uniform_sql(None, 'doc_id', 'pos', seed_sql='CAST(trial AS VARCHAR)')} >= 0.2), "
          "counts AS (SELECT trial, token, count(*) AS n FROM ex GROUP BY trial, token), "
          "ranked AS (SELECT trial, token, n, row_number() OVER (PARTITION BY trial ORDER BY n DESC, token) AS r "
          "FROM counts) "
          "SELECT CAST(trial AS BIGINT) AS trial, token, CAST(n AS BIGINT) AS n, CAST(r + 1 AS BIGINT) AS id "
          "FROM ranked WHERE r <= 998")
def q_trial_vocabulary(spark, sf_dir):
    """A fresh split and vocabulary per trial (trials 0-4): every trial's
    998 most frequent train tokens with ids from 2, one counting shuffle."""
    tok = V.with_tokens(_labelled(spark, sf_dir))
    v = V.trial_vocabularies(tok, ["doc_id", "pos"], range(5), CFG.test_fraction, CFG.num_words)
    return v.select("trial", "token", "n", F.col("id").cast("bigint").alias("id"))


_MSG_CFG = TextConfig(maxlen=50, normalize=True)


def _msg_sql_encoded() -> str:
    """Message pipeline in SQL: clean, label, split, vocabulary, ids (maxlen 50)."""
    return (
        "msgs AS (SELECT concat_ws(':', conv_id, turn) AS msg_id, role AS category, "
        f"{O.clean_sql('text')} AS text FROM conversations), "
        "lab AS (SELECT *, CASE WHEN category = 'user' THEN 0 ELSE 1 END AS label FROM msgs), "
        f"split AS (SELECT *, {O.uniform_sql(0, 'msg_id')} >= 0.2 AS is_train FROM lab), "
        f"tok AS (SELECT *, {O.tokens_sql('text')} AS tokens FROM split), "
        "counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tok WHERE is_train) "
        "GROUP BY token), "
        "vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id "
        "FROM counts ORDER BY n DESC, token LIMIT 998), "
        "ex AS (SELECT msg_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tok), "
        "exid AS (SELECT ex.msg_id, ex.i, coalesce(v.id, 1) AS id FROM ex LEFT JOIN vocab v "
        "ON ex.token = v.token WHERE i <= 50), "
        "agg AS (SELECT msg_id, list(id ORDER BY i) AS ids FROM exid GROUP BY msg_id), "
        "enc AS (SELECT t.msg_id, t.label, t.is_train, coalesce(a.ids, []::INTEGER[]) AS ids "
        "FROM tok t LEFT JOIN agg a ON t.msg_id = a.msg_id)"
    )


@register("normalize_ids",
          f"WITH {_msg_sql_encoded()} SELECT msg_id, "
          f"{O.join_doubles('list_transform(' + O.padded_sql('ids', 50) + ', lambda v: v / 1000.0)')} AS x "
          "FROM enc")
def q_normalize_ids(spark, sf_dir):
    from ibex.plans.text import message_pipeline
    enc, _ = message_pipeline(spark, sf_dir, "user", _MSG_CFG)
    return enc.select("msg_id", join_doubles("x").alias("x"))


@register("model_inputs",
          f"WITH {O.encoded_cte()}, p AS (SELECT doc_id, pos, label, {O.padded_sql('ids', 500)} AS ids FROM enc) "
          f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {O.join_ints('ids')} AS input_ids, "
          f"{O.join_ints('list_transform(ids, lambda v: CASE WHEN v <> 0 THEN 1 ELSE 0 END)')} AS attention_mask, "
          "CASE WHEN label = 0 THEN '1 0' WHEN label = 1 THEN '0 1' ELSE '0 0' END AS labels FROM p")
def q_model_inputs(spark, sf_dir):
    from ibex.operators.model_inputs import model_inputs
    m = model_inputs(_encoded(spark, sf_dir), maxlen=CFG.maxlen, k=2)
    return m.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    join_ints("input_ids").alias("input_ids"),
                    join_ints("attention_mask").alias("attention_mask"),
                    join_ints(F.transform("labels", lambda v: v.cast("int"))).alias("labels"))


# ------------------------------------------------------ vector inputs ---

@register("scale_vector",
          "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(v AS DOUBLE) / 255.0, 6) + 0.0 AS value FROM "
          "(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def q_scale_vector(spark, sf_dir):
    from ibex.operators.vectors import scale_vector
    v = C.read_vectors(spark, sf_dir).select("vec_id", scale_vector("features", 255.0).alias("x"))
    return v.select("vec_id", F.posexplode("x").alias("i", "value")) \
        .select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), r6("value").alias("value"))


@register("center_vector",
          "SELECT vec_id, CAST(i AS BIGINT) AS i, round(2.0 * CAST(v AS DOUBLE) - 1.0, 6) + 0.0 AS value FROM "
          "(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def q_center_vector(spark, sf_dir):
    from ibex.operators.vectors import center_vector
    v = C.read_vectors(spark, sf_dir).select("vec_id", center_vector("features").alias("x"))
    return v.select("vec_id", F.posexplode("x").alias("i", "value")) \
        .select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), r6("value").alias("value"))


@register("flatten_matrix",
          "SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(v AS DOUBLE) / 255.0, 6) + 0.0 AS value FROM "
          "(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def q_flatten_matrix(spark, sf_dir):
    """Image inputs: 8 x 8 matrices flattened row by row and scaled."""
    from ibex.operators.vectors import flatten_matrix, scale_vector
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("features", r * 8 + 1, 8))
    images = C.read_vectors(spark, sf_dir).select("vec_id", rows.alias("image"))
    v = images.select("vec_id", scale_vector(flatten_matrix("image"), 255.0).alias("x"))
    return v.select("vec_id", F.posexplode("x").alias("i", "value")) \
        .select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), r6("value").alias("value"))


@register("csv_messages",
          "SELECT role AS category, md5(text) AS text_md5, count(*) AS n FROM conversations GROUP BY 1, 2")
def q_csv_messages(spark, sf_dir):
    """The message table written as CSV in the shared folder and read back
    (quoted fields span lines)."""
    from uuid import uuid4

    from ibex.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/messages-{uuid4().hex}"
    (C.table(spark, sf_dir, "conversations").select(F.col("role").alias("Category"), F.col("text").alias("Message"))
     .write.option("header", "true").option("quote", '"').option("escape", '"').csv(path))
    m = C.read_messages_csv(spark, path)
    return m.groupBy("category", F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------- model operators, fixed weights (M) ---

from ibex.operators import vib as VIB  # noqa: E402
from ibex.operators import vib_math as VM  # noqa: E402
from ibex.operators.divergence import closed_forms, renyi_sampled  # noqa: E402
from ibex.plans import oracle_model as OM  # noqa: E402

VEC_SPEC = VM.dense_spec(64, units=(OM.HIDDEN,), out_dim=OM.CLASSES, latent_dim=OM.LATENT, transform="center")
VEC_BETA = 1e-3


def _vec_scored(spark, sf_dir, n_draws: int = OM.DRAWS) -> DataFrame:
    vec = S.split_hash(C.read_vectors(spark, sf_dir), "vec_id")
    params = VM.init_params(VEC_SPEC, scheme="formula")
    return VIB.score(vec, VEC_SPEC, params, "vec_id", "features", "label", ["is_train"], seed=0,
                     n_draws=n_draws)


def _explode_r6(df, arr, name_i, name_v):
    return df.select("vec_id", F.posexplode(arr).alias(name_i, name_v)) \
        .select("vec_id", F.col(name_i).cast("bigint").alias(name_i), r6(name_v).alias(name_v))


@register("dense_forward", OM.with_forward(
    "SELECT vec_id, CAST(j AS BIGINT) AS j, round(h, 6) + 0.0 AS h FROM h0"))
def q_dense_forward(spark, sf_dir):
    """First hidden layer: ``relu((2x - 1) W + b)`` for every vector."""
    from ibex.operators.dense import dense_layer
    vec = C.read_vectors(spark, sf_dir)
    params = VM.Layout(VEC_SPEC).views(VM.init_params(VEC_SPEC, scheme="formula"))
    h = dense_layer(vec, "vec_id", "features", params["enc0.W"], params["enc0.b"], relu=True, center=True)
    return _explode_r6(h, "h", "j", "h")


@register("encode_latent", OM.with_forward(
    "SELECT vec_id, CAST(k AS BIGINT) AS k, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma FROM lat"))
def q_encode_latent(spark, sf_dir):
    s = _vec_scored(spark, sf_dir)
    z = s.select("vec_id", F.posexplode(F.arrays_zip("mu", "sigma")).alias("k", "p"))
    return z.select("vec_id", F.col("k").cast("bigint").alias("k"), r6("p.mu").alias("mu"), r6("p.sigma").alias("sigma"))


@register("sample_latent", OM.with_forward(
    "SELECT vec_id, CAST(k AS BIGINT) AS k, round(z, 6) + 0.0 AS z FROM z"))
def q_sample_latent(spark, sf_dir):
    return _explode_r6(_vec_scored(spark, sf_dir), "z", "k", "z")


@register("decode_logits", OM.with_forward(
    "SELECT vec_id, CAST(c AS BIGINT) AS c, round(logit, 6) + 0.0 AS logit FROM lg"))
def q_decode_logits(spark, sf_dir):
    return _explode_r6(_vec_scored(spark, sf_dir), "logits", "c", "logit")


@register("predict_class", OM.with_forward("SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM pred"))
def q_predict_class(spark, sf_dir):
    return _vec_scored(spark, sf_dir).select("vec_id", F.col("pred").cast("bigint").alias("pred"))


@register("predict", OM.with_forward(
    "SELECT vec_id, CAST(mc_pred AS BIGINT) AS pred, round(max_prob, 6) + 0.0 AS prob FROM mcpred"))
def q_predict(spark, sf_dir):
    vec = C.read_vectors(spark, sf_dir).drop("label")
    params = VM.init_params(VEC_SPEC, scheme="formula")
    p = VIB.predict(vec, VEC_SPEC, params, "vec_id", "features", seed=0, n_draws=OM.DRAWS, tag="eval")
    # same noise tag as evaluation so the SQL statement can share its CTEs
    return p.select("vec_id", F.col("pred").cast("bigint").alias("pred"), r6(F.array_max("probs")).alias("prob"))


EMB_SPEC = VM.text_spec(num_words=1000, maxlen=500, units=(OM.HIDDEN,), latent_dim=OM.LATENT, embed_dim=OM.EMBED)


@register("embedding_forward",
          f"WITH {O.encoded_cte()}, {OM.embedding_ctes(O.padded_sql('ids', 500))} "
          "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(k AS BIGINT) AS k, round(mu, 6) + 0.0 AS mu, "
          "round(sigma, 6) + 0.0 AS sigma FROM elat")
def q_embedding_forward(spark, sf_dir):
    """The embedding encoder with formula weights on padded ids: embedding,
    flatten, hidden layer, mean and scale of the latent code."""
    data = _text_model_frame(spark, sf_dir)
    s = VIB.score(data, EMB_SPEC, VM.init_params(EMB_SPEC, scheme="formula"), ["doc_id", "pos"], "ids", n_draws=0)
    z = s.select("doc_id", "pos", F.posexplode(F.arrays_zip("mu", "sigma")).alias("k", "p"))
    return z.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("k").cast("bigint").alias("k"),
                    r6("p.mu").alias("mu"), r6("p.sigma").alias("sigma"))


@register("kl_divergence", OM.with_forward(
    "SELECT vec_id, CAST(k AS BIGINT) AS k, round(-ln(sigma) + (sigma * sigma + mu * mu - 1.0) / 2.0, 6) + 0.0 "
    "AS kl FROM lat"))
def q_kl_divergence(spark, sf_dir):
    from ibex.functions.numeric import kl_std_normal
    s = _vec_scored(spark, sf_dir)
    z = s.select("vec_id", F.posexplode(F.arrays_zip("mu", "sigma")).alias("k", "p"))
    return z.select("vec_id", F.col("k").cast("bigint").alias("k"), r6(kl_std_normal("p.mu", "p.sigma")).alias("kl"))


_RENYI_ALPHAS = (0.1, 0.5, 2.0, 5.0, float("inf"))


@register("renyi_closed", OM.renyi_closed_sql(_RENYI_ALPHAS))
def q_renyi_closed(spark, sf_dir):
    """Closed forms of all orders from one forward pass; null where the form
    does not exist."""
    s = _vec_scored(spark, sf_dir, n_draws=0)
    d = closed_forms(s, _RENYI_ALPHAS, ["vec_id"])
    value = F.when(F.col("div_nats") < F.lit(float("inf")), F.col("div_nats"))
    return d.select("vec_id", F.col("alpha").cast("string").alias("alpha"), r6(value).alias("div_nats"))


_MC_ALPHAS = (0.5, 2.0, "inf", "mc2.0")


@register("renyi_mc", OM.renyi_mc_sql(_MC_ALPHAS))
def q_renyi_mc(spark, sf_dir):
    s = _vec_scored(spark, sf_dir)
    # both estimators from the same two passes over the scored rows
    r = renyi_sampled(s, [0.5, 2.0, float("inf")], ["vec_id"], ["is_train"], seed=0, tag="eval",
                      estimator=["reference", "mc"])
    is_mc = F.col("estimator") == F.lit("mc")
    r = r.where(~is_mc | (F.col("alpha") == F.lit(2.0)))
    label = (F.when(is_mc, F.lit("mc2.0")).when(F.col("alpha") == float("inf"), F.lit("inf"))
             .otherwise(F.col("alpha").cast("string")))
    return r.select("is_train", label.alias("alpha"), r6("value").alias("value"))


def _vec_metrics(spark, sf_dir):
    return VIB.metrics_by(_vec_scored(spark, sf_dir), VEC_SPEC.out_dim, ["is_train"], VEC_BETA)


_LOG2_10 = "log2(10.0)"


@register("loss_bits", OM.with_forward(
    "SELECT is_train, round(avg(ce_bits), 6) + 0.0 AS ce_bits, round(avg(div_bits), 6) + 0.0 AS div_bits, "
    f"round(avg(ce_bits) + {VEC_BETA} * avg(div_bits), 6) + 0.0 AS loss_bits FROM per GROUP BY is_train"))
def q_loss_bits(spark, sf_dir):
    m = _vec_metrics(spark, sf_dir)
    return m.select("is_train", r6("ce_bits").alias("ce_bits"), r6("izx").alias("div_bits"),
                    r6("loss_bits").alias("loss_bits"))


@register("accuracy", OM.with_forward(
    "SELECT is_train, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc "
    "FROM per GROUP BY is_train"))
def q_accuracy(spark, sf_dir):
    return _vec_metrics(spark, sf_dir).select("is_train", r6("acc").alias("acc"))


@register("mc_accuracy", OM.with_forward(
    "SELECT is_train, round(avg(CASE WHEN mc_pred = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS avg_acc "
    "FROM per GROUP BY is_train"))
def q_mc_accuracy(spark, sf_dir):
    return _vec_metrics(spark, sf_dir).select("is_train", r6("avg_acc").alias("avg_acc"))


@register("information_plane", OM.with_forward(
    f"SELECT is_train, round({_LOG2_10} - avg(ce_bits), 6) + 0.0 AS izy, round(avg(div_bits), 6) + 0.0 AS izx "
    "FROM per GROUP BY is_train"))
def q_information_plane(spark, sf_dir):
    return _vec_metrics(spark, sf_dir).select("is_train", r6("izy").alias("izy"), r6("izx").alias("izx"))


@register("evaluate", OM.with_forward(
    f"SELECT is_train, count(*) AS n, round({_LOG2_10} - avg(ce_bits), 6) + 0.0 AS izy, "
    "round(avg(div_bits), 6) + 0.0 AS izx, "
    "round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acc, "
    "round(avg(CASE WHEN mc_pred = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS avg_acc FROM per GROUP BY is_train"))
def q_evaluate(spark, sf_dir):
    m = _vec_metrics(spark, sf_dir)
    return m.select("is_train", F.col("n").cast("bigint").alias("n"), r6("izy").alias("izy"), r6("izx").alias("izx"),
                    r6("acc").alias("acc"), r6("avg_acc").alias("avg_acc"))


# ------------------------------------------------ sweeps and histories ---

from ibex.operators import sweep as SW  # noqa: E402


def _runs_sql() -> str:
    return ("runs AS (SELECT config, trial, epoch, is_train, avg(value) AS metric FROM ("
            "SELECT event_type AS config, user_id AS trial, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, "
            f"{O.uniform_sql(0, 'event_id')} >= 0.2 AS is_train, value FROM events) "
            "GROUP BY config, trial, epoch, is_train)")


def _runs(spark, sf_dir):
    return SW.runs_from_events(C.table(spark, sf_dir, "events"))


@register("runs_table", f"WITH {_runs_sql()} SELECT config, trial, epoch, is_train, "
          "round(metric, 6) + 0.0 AS metric FROM runs")
def q_runs_table(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return r.select("config", "trial", "epoch", "is_train", r6("metric").alias("metric"))


@register("history_wide", f"WITH {_runs_sql()} SELECT config, trial, epoch, "
          "round(max(CASE WHEN is_train THEN metric END), 6) + 0.0 AS train_metric, "
          "round(max(CASE WHEN NOT is_train THEN metric END), 6) + 0.0 AS test_metric "
          "FROM runs GROUP BY config, trial, epoch")
def q_history_wide(spark, sf_dir):
    w = SW.history_wide(_runs(spark, sf_dir))
    return w.select("config", "trial", "epoch", r6("train_metric").alias("train_metric"),
                    r6("test_metric").alias("test_metric"))


_LAST_SQL = ("last AS (SELECT config, trial, is_train, max(epoch) AS last_epoch, "
             "arg_max(metric, epoch) AS last_metric, count(*) AS n_epochs FROM runs "
             "GROUP BY config, trial, is_train)")


@register("last_epoch", f"WITH {_runs_sql()}, {_LAST_SQL} SELECT config, trial, is_train, last_epoch, "
          "round(last_metric, 6) + 0.0 AS last_metric, n_epochs FROM last")
def q_last_epoch(spark, sf_dir):
    r = SW.last_epoch(_runs(spark, sf_dir))
    return r.select("config", "trial", "is_train", "last_epoch", r6("last_metric").alias("last_metric"),
                    F.col("n_epochs").cast("bigint").alias("n_epochs"))


@register("sweep_alpha_summary", f"WITH {_runs_sql()}, {_LAST_SQL} SELECT config, "
          "round(avg(last_metric), 6) + 0.0 AS avg_metric, round(stddev_pop(last_metric), 6) + 0.0 AS std_metric, "
          "count(*) AS n_trials FROM last WHERE NOT is_train GROUP BY config")
def q_sweep_alpha_summary(spark, sf_dir):
    s = SW.summary_mean_std(_runs(spark, sf_dir), is_train=False)
    return s.select("config", r6("avg_metric").alias("avg_metric"), r6("std_metric").alias("std_metric"),
                    F.col("n_trials").cast("bigint").alias("n_trials"))


@register("sweep_beta_summary", f"WITH {_runs_sql()}, {_LAST_SQL} SELECT config, "
          "round(avg(CASE WHEN is_train THEN last_metric END), 6) + 0.0 AS train_metric, "
          "round(avg(CASE WHEN NOT is_train THEN last_metric END), 6) + 0.0 AS test_metric "
          "FROM last GROUP BY config")
def q_sweep_beta_summary(spark, sf_dir):
    s = SW.summary_train_test(_runs(spark, sf_dir))
    return s.select("config", r6("train_metric").alias("train_metric"), r6("test_metric").alias("test_metric"))


@register("alpha_results", f"WITH {_runs_sql()}, {_LAST_SQL} SELECT config AS alpha, "
          "round(avg(last_metric), 6) + 0.0 AS avg_acc, round(stddev_pop(last_metric), 6) + 0.0 AS std_acc "
          "FROM last WHERE NOT is_train GROUP BY config")
def q_alpha_results(spark, sf_dir):
    """The alpha sweep's result file."""
    s = sinks.result_table(SW.summary_mean_std(_runs(spark, sf_dir), is_train=False), sinks.ALPHA_COLUMNS)
    return s.select("alpha", r6("avg_acc").alias("avg_acc"), r6("std_acc").alias("std_acc"))


@register("beta_results", f"WITH {_runs_sql()}, {_LAST_SQL} SELECT config AS beta, "
          "round(avg(CASE WHEN is_train THEN last_metric END), 6) + 0.0 AS \"train accuracy\", "
          "round(avg(CASE WHEN NOT is_train THEN last_metric END), 6) + 0.0 AS \"test accuracy\" "
          "FROM last GROUP BY config")
def q_beta_results(spark, sf_dir):
    """The beta sweep's result file."""
    s = sinks.result_table(SW.summary_train_test(_runs(spark, sf_dir)), sinks.BETA_COLUMNS)
    return s.select("beta", *[r6(F.col(c)).alias(c) for c in ("train accuracy", "test accuracy")])


# ------------------------------------- training (rows-only: no SQL form) ---

FIT_VEC_SPEC = VM.dense_spec(64, units=(32, 32), out_dim=10, latent_dim=2, transform="center")


@register("fit_history")
def q_fit_history(spark, sf_dir, epochs=50):
    """Local-SGD training on the vector table over a fixed number of workers:
    per-epoch information-plane bounds and accuracies for both parts."""
    vec = S.split_hash(C.read_vectors(spark, sf_dir), "vec_id")
    cfg = VIB.FitConfig(epochs=epochs, batch_size=50, beta=10 ** -0.5, alpha=1.0, lr=1e-3, mode="average")
    _, hist = VIB.fit(vec, FIT_VEC_SPEC, cfg, "vec_id", "features")
    return VIB.history_frame(spark, hist)


@register("fit_history_blocks")
def q_fit_history_blocks(spark, sf_dir):
    """Local-SGD training with the model as a table of blocks: parameters and
    optimizer state never reach the driver."""
    from ibex.operators import block_model as BM
    vec = S.split_hash(C.read_vectors(spark, sf_dir), "vec_id")
    cfg = VIB.FitConfig(epochs=5, batch_size=50, beta=10 ** -0.5, alpha=1.0, lr=1e-3, mode="average")
    _, hist = BM.fit(vec, FIT_VEC_SPEC, cfg, "vec_id", "features")
    return VIB.history_frame(spark, hist)


# The digit-image script's model and settings.
IMAGE_SPEC = VM.dense_spec(784, units=(1024, 1024), out_dim=10, latent_dim=2, transform="center", dtype="float32")
IMAGE_EPOCHS, IMAGE_BATCH, IMAGE_BETA = 50, 100, 10 ** -0.5


def _images(spark, sf_dir):
    vec = C.read_vectors(spark, sf_dir)
    return vec.select("vec_id", "label", VEC.scale_vector(VEC.flatten_matrix(VEC.outer_image("features"))).alias("image"))


@register("fit_image_history")
def q_fit_image_history(spark, sf_dir):
    """The image classifier at its full size (784-1024-1024, batches of 100,
    50 epochs) on images made of the vectors: matrix, flatten, scale, one whole
    run of sequential steps in a task, on any number of images."""
    from ibex.operators import resident as R
    grid = SW.beta_grid_configs([IMAGE_BETA], n_samples=1)
    runs = SW.fit_grid(_images(spark, sf_dir), IMAGE_SPEC, grid, "vec_id", "image", epochs=IMAGE_EPOCHS, batch_size=IMAGE_BATCH,
                       lr=SW.SCRIPT_LR, drop_remainder=True)
    return sinks.result_table(R.history_of(runs), sinks.HISTORY_COLUMNS)


TEXT_FIT_SPEC = VM.text_spec(num_words=1000, maxlen=500, units=(16, 8), embed_dim=8)


def _text_model_frame(spark, sf_dir):
    enc = _encoded(spark, sf_dir)
    return enc.withColumn("ids", V.pad_sequences("ids", CFG.maxlen))


@register("fit_text_history")
def q_fit_text_history(spark, sf_dir, epochs=25):
    """The book-paragraph pipeline end to end: paragraphs -> vocabulary ->
    padded ids -> local-SGD training of an embedding model (one data pass
    per epoch)."""
    data = _text_model_frame(spark, sf_dir)
    cfg = VIB.FitConfig(epochs=epochs, batch_size=50, beta=1e-4, alpha=1.0, lr=1e-3, mode="average")
    _, hist = VIB.fit(data, TEXT_FIT_SPEC, cfg, ["doc_id", "pos"], "ids")
    return VIB.history_frame(spark, hist)


@register("fit_text_script")
def q_fit_text_script(spark, sf_dir):
    """The text classifier at its full size: 1000 x 64 embedding of 500 ids,
    128 and 64 units, 25 epochs of sequential batches of 50 at 1e-4, one whole run
    in a task on any number of rows."""
    from ibex.operators import resident as R
    spec = VM.text_spec(CFG.num_words, CFG.maxlen, SW.SCRIPT_ALPHA_UNITS, dtype="float32")
    grid = SW.beta_grid_configs([SW.SCRIPT_ALPHA_BETA], n_samples=1)
    runs = SW.fit_grid(_text_model_frame(spark, sf_dir), spec, grid, ["doc_id", "pos"], "ids", epochs=25, batch_size=SW.SCRIPT_BATCH,
                       lr=SW.SCRIPT_LR, drop_remainder=True)
    return sinks.result_table(R.history_of(runs), sinks.HISTORY_COLUMNS)


STEP_BETA = 1e-3
STEP_LR = 1e-2


STEP_WORKERS = 8


def _step_rows(spark, sf_dir, sampled=False):
    """The train part of the vectors with its noise, dealt to workers."""
    from ibex.operators import block_model as BM
    vec = S.split_hash(C.read_vectors(spark, sf_dir), "vec_id").where("is_train").select("vec_id", "features", "label")
    return BM.worker_rows(VIB.with_noise(vec, ["vec_id"], VEC_SPEC.latent_dim, "0", 0, "eval", sampled), ["vec_id"], STEP_WORKERS)


def _step_gradient(spark, sf_dir, alpha=1.0):
    """Blocks of the mean gradient of the loss over the whole train part at
    the formula weights, and those weights' state."""
    from ibex.operators import block_model as BM
    state = BM.init_state(spark, VEC_SPEC, scheme="formula", block=STEP_BLOCK)
    rows = _step_rows(spark, sf_dir, alpha != 1.0)
    return state, BM.gradient(rows, state, VEC_SPEC, STEP_WORKERS, "features", "label", STEP_BETA, alpha, block=STEP_BLOCK)


STEP_BLOCK = 256


@register("train_step", OM.gradient_sql(STEP_BETA,
          "SELECT param, CAST(i AS BIGINT) AS i, round(g, 6) + 0.0 AS grad FROM grad"))
def q_train_step(spark, sf_dir):
    """Gradient of the loss (cross-entropy + beta x divergence, bits) over the
    whole train part, as blocks added up on the executors."""
    from ibex.operators import block_model as BM
    _, g = _step_gradient(spark, sf_dir)
    return BM.state_values(g, VEC_SPEC, "g", STEP_BLOCK).select("param", "i", r6("value").alias("grad"))


_STEP_ALPHAS = (0.5, 2.0, 5.0, float("inf"))


@register("train_step_alpha", OM.gradient_alpha_sql(STEP_BETA, _STEP_ALPHAS,
          "SELECT alpha, param, CAST(i AS BIGINT) AS i, round(g, 6) + 0.0 AS grad FROM grad"))
def q_train_step_alpha(spark, sf_dir):
    """Gradients for other orders: the sampled divergence over one batch that
    lies on many tasks, its log-sum-exp in a first pass."""
    from ibex.operators import block_model as BM
    out = None
    for alpha in _STEP_ALPHAS:
        _, g = _step_gradient(spark, sf_dir, alpha)
        one = BM.state_values(g, VEC_SPEC, "g", STEP_BLOCK).select(F.lit(str(alpha)).alias("alpha"), "param", "i", r6("value").alias("grad"))
        out = one if out is None else out.unionByName(one)
    return out


@register("adam_step", OM.gradient_sql(STEP_BETA, OM.adam_select(STEP_LR)))
def q_adam_step(spark, sf_dir):
    """The parameters after one Adam step on that gradient: a join of state
    and gradient on the block."""
    from ibex.operators import block_model as BM
    state, g = _step_gradient(spark, sf_dir)
    return BM.state_values(BM.adam_step(state, g, STEP_LR), VEC_SPEC, "p", STEP_BLOCK).select("param", "i", r6("value").alias("value"))


@register("loss_bits_alpha", OM.renyi_loss_sql((0.1, 0.5, 2.0, 5.0), VEC_BETA))
def q_loss_bits_alpha(spark, sf_dir):
    """The training loss of other orders per part: cross-entropy + beta x the
    sampled divergence (log-sum-exp over the part)."""
    scored = _vec_scored(spark, sf_dir)
    ce = scored.groupBy("is_train").agg(F.avg("ce_bits").alias("ce"))
    div = renyi_sampled(scored, [0.1, 0.5, 2.0, 5.0], ["vec_id"], ["is_train"], seed=0, tag="eval")
    loss = F.col("ce") + F.lit(VEC_BETA) * F.col("value") / F.lit(math.log(2.0))
    return div.join(F.broadcast(ce), "is_train").select("is_train", F.col("alpha").cast("string").alias("alpha"), r6(loss).alias("loss_bits"))


@register("sweep_fit_alpha")
def q_sweep_fit_alpha(spark, sf_dir):
    """Alpha x trial grid trained together (one data pass per epoch for the
    whole grid), summarised as mean and population std of the last-epoch
    Monte Carlo test accuracy per alpha."""
    vec = C.read_vectors(spark, sf_dir)
    grid = SW.alpha_trial_grid(SW.SCRIPT_ALPHAS, SW.SCRIPT_ALPHA_TRIALS, SW.SCRIPT_ALPHA_BETA)
    runs = SW.fit_sweep(vec, FIT_VEC_SPEC, grid, "vec_id", "features", epochs=SW.SCRIPT_ALPHA_EPOCHS,
                        batch_size=SW.SCRIPT_BATCH, lr=1e-3)
    return SW.summary_mean_std(SW.runs_for_summary(runs, "avg_acc", "alpha"), is_train=False)


@register("sweep_fit_beta")
def q_sweep_fit_beta(spark, sf_dir):
    """The beta sweep on the book paragraphs: 17 betas x 50 samples x 10
    epochs, each of the 850 runs whole in one task by sequential steps, on any
    number of rows; mean last-epoch train and test accuracy per beta.  The widths are an eighth of the script's (see the
    README for the cost at full width)."""
    table = SW.script_beta_sweep(_text_model_frame(spark, sf_dir), ["doc_id", "pos"], num_words=CFG.num_words, maxlen=CFG.maxlen,
                                 units=tuple(u // 8 for u in SW.SCRIPT_BETA_UNITS), embed_dim=8, lr=1e-3, drop_remainder=True)
    return sinks.result_table(table, sinks.BETA_COLUMNS)


@register("sweep_fit_alpha_text")
def q_sweep_fit_alpha_text(spark, sf_dir):
    """The alpha sweep on the book paragraphs at the script's size: each trial
    draws its own split and fits its own vocabulary; every run of the alpha x
    trial grid is whole in one task by sequential steps, on any number of rows."""
    from ibex.plans.text import trial_encoded
    trials = list(range(SW.SCRIPT_ALPHA_TRIALS))
    data, _ = trial_encoded(_labelled(spark, sf_dir), ["doc_id", "pos"], trials, CFG)
    table = SW.script_alpha_sweep(data, ["doc_id", "pos"], {t: f"ids_t{t}" for t in trials}, num_words=CFG.num_words, maxlen=CFG.maxlen,
                                  drop_remainder=True)
    return sinks.result_table(table, sinks.ALPHA_COLUMNS)


# ------------------------------------------------ subword branch (T1-T3) ---

from ibex.operators import subword as SWD  # noqa: E402


def _subword_encoded(spark, sf_dir):
    tok = _tokens(spark, sf_dir)
    vocab = SWD.subword_vocab(tok.where("is_train"), n_words=2000)
    enc = SWD.subword_encode(tok, vocab, "text", max_length=SWD.DEFAULT_MAX_LENGTH)
    return SWD.pad_to_longest(enc, "input_ids", "is_train", SWD.DEFAULT_MAX_LENGTH)


@register("subword_encode",
          f"WITH RECURSIVE {O.subword_cte()} SELECT doc_id, CAST(pos AS BIGINT) AS pos, is_train, CAST(width AS BIGINT) AS width, "
          f"CAST(len(list_filter(ids, lambda v: v <> 0)) AS BIGINT) AS n_ids, {O.join_ints(O.subword_padded())} AS input_ids FROM sub")
def q_subword_encode(spark, sf_dir):
    """Greedy longest-match subword ids with begin/end markers, truncated at
    512 and padded to the longest row of each part."""
    e = _subword_encoded(spark, sf_dir)
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "is_train",
                    F.size("input_ids").cast("bigint").alias("width"),
                    F.size(F.filter("input_ids", lambda v: v != 0)).cast("bigint").alias("n_ids"),
                    join_ints("input_ids").alias("input_ids"))


@register("subword_model_inputs",
          f"WITH RECURSIVE {O.subword_cte()}, full_rows AS (SELECT doc_id, pos, label, {O.subword_padded()} AS ids FROM sub) "
          f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {O.join_ints('ids')} AS input_ids, "
          "array_to_string(list_transform(ids, lambda v: CASE WHEN v <> 0 THEN '1' ELSE '0' END), ' ') AS attention_mask, "
          "CASE WHEN label = 0 THEN '1 0' WHEN label = 1 THEN '0 1' ELSE '0 0' END AS labels FROM full_rows")
def q_subword_model_inputs(spark, sf_dir):
    """Sequence-classifier inputs from subword ids: ids, mask, one-hot."""
    from ibex.operators.model_inputs import model_inputs
    e = _subword_encoded(spark, sf_dir).withColumnRenamed("input_ids", "sub_ids")
    m = model_inputs(e, maxlen=None, k=2, ids="sub_ids")
    return m.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    join_ints("input_ids").alias("input_ids"), join_ints("attention_mask").alias("attention_mask"),
                    join_ints(F.transform("labels", lambda v: v.cast("int"))).alias("labels"))


# ------------------------------------------------- grid x data (J4, X3) ---

_GRID_ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0)
_GRID_TRIALS = 5
_GRID_BETA = 1e-4


def _grid_values_sql() -> str:
    vals = ", ".join(f"({c.config_id}, {c.alpha}::DOUBLE, {c.beta}::DOUBLE, {c.trial})"
                     for c in SW.alpha_trial_grid(_GRID_ALPHAS, _GRID_TRIALS, _GRID_BETA))
    return f"configs(config_id, alpha, beta, trial) AS (VALUES {vals})"


@register("sweep_grid",
          f"WITH {O.labelled_cte()}, {_grid_values_sql()}, "
          "per AS (SELECT trial, "
          f"sum(CASE WHEN {O.uniform_sql(None, 'doc_id', 'pos', seed_sql='CAST(trial AS VARCHAR)')} >= 0.2 "
          "THEN 1 ELSE 0 END) AS n_train, count(*) AS n_rows "
          f"FROM labelled, (SELECT range AS trial FROM range({_GRID_TRIALS})) r GROUP BY trial) "
          "SELECT CAST(c.config_id AS BIGINT) AS config_id, c.alpha, c.beta, CAST(c.trial AS BIGINT) AS trial, "
          "CAST(p.n_train AS BIGINT) AS n_train, CAST(p.n_rows - p.n_train AS BIGINT) AS n_test "
          "FROM configs c JOIN per p ON c.trial = p.trial")
def q_sweep_grid(spark, sf_dir):
    """Every (alpha, trial) configuration with the size of the train and test
    part its own trial split gives it: one pass over the data with one
    split column per trial, then a join with the (bounded) grid on trial."""
    from ibex.operators.broadcast import broadcast_if_small
    lab = S.split_trials(_labelled(spark, sf_dir), ["doc_id", "pos"], _GRID_TRIALS)
    counts = lab.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.sum(F.col("is_train_trials")[t].cast("int")).alias(f"t{t}") for t in range(_GRID_TRIALS)])
    per = counts.select("n_rows", F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), F.col(f"t{t}").alias("n_train"))
                                                       for t in range(_GRID_TRIALS)])).alias("s")) \
        .select(F.col("s.trial").alias("trial"), F.col("s.n_train").alias("n_train"), "n_rows")
    grid = SW.alpha_trial_grid(_GRID_ALPHAS, _GRID_TRIALS, _GRID_BETA)
    configs = spark.createDataFrame([(c.config_id, c.alpha, c.beta, c.trial) for c in grid],
                                    "config_id int, alpha double, beta double, trial int")
    j = configs.join(broadcast_if_small(per), "trial")
    return j.select(F.col("config_id").cast("bigint").alias("config_id"), "alpha", "beta",
                    F.col("trial").cast("bigint").alias("trial"), F.col("n_train").cast("bigint").alias("n_train"),
                    (F.col("n_rows") - F.col("n_train")).cast("bigint").alias("n_test"))


# --------------------------------------------- message pipeline model (E3) ---

MSG_SPEC = VM.dense_spec(50, units=(32, 32), out_dim=2, latent_dim=2, transform="center")


@register("fit_message_history")
def q_fit_message_history(spark, sf_dir, epochs=20):
    """Messages: clean, label by category, split, vocabulary, ids padded to
    50 and divided by the vocabulary size, dense encoder on ``2x - 1``,
    local-SGD training with beta = 10^-0.5, 20 epochs."""
    from ibex.plans.text import message_pipeline
    enc, _ = message_pipeline(spark, sf_dir, "user", _MSG_CFG)
    cfg = VIB.FitConfig(epochs=epochs, batch_size=50, beta=10 ** -0.5, alpha=1.0, lr=1e-3, mode="average")
    _, hist = VIB.fit(enc, MSG_SPEC, cfg, "msg_id", "x")
    return VIB.history_frame(spark, hist)
