"""Stochastic latent classifier as Spark jobs.

* :func:`score` - one ``mapInArrow`` pass: per-row latent parameters,
  logits, predictions, cross-entropy and divergence.  Parameters travel as
  a broadcast variable (bounded by the model size, not the data).
* :func:`evaluate` - :func:`score` + one grouped aggregate per split:
  ``izy, izx, acc, avg_acc``.
* :func:`batch_gradient` - the gradient of one batch over any number of tasks;
  the sampled divergence takes two passes, its log-sum-exp and then weighted
  partial sums.
* :func:`fit` - mini-batch training.  ``mode='sync'``: one Spark job per
  step over data hash-partitioned by batch id, the task holding the batch
  returns its gradient sum, the driver applies Adam (same update as single-process training on
  the same batch).  ``mode='average'``: one job per epoch; the rows belong
  to ``n_workers`` workers by a hash of their key, every worker runs its own
  Adam steps over its rows and the resulting parameters are averaged weighted
  by row count (local SGD; an approximation, named as such, that needs one
  data pass per epoch at any scale).  The number of workers is a parameter,
  so the result depends on neither the input's layout nor the cores.

Noise is a Spark column (MD5 + Box-Muller of ``(seed, key, draw)``), so a
retried task or a different partitioning sees the same draws.
"""

from __future__ import annotations

import gc
import logging
import math
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ibex.functions.hashing import gaussian_array, hash32
from ibex.operators import params as P
from ibex.operators import vib_math as M
from ibex.operators.draws import draws
from ibex.operators.reduce import tree_sum_by_key
from ibex.operators.split import minibatch_exact, minibatch_ids

log = logging.getLogger("ibex.fit")

DEFAULT_DRAWS = 12
# Synchronous steps give each task about this many rows of a batch.
SYNC_ROWS_PER_TASK = 8192
# Small-batch synchronous training runs contiguous runs of batches in one
# task; a run holds about this many input values (64 MB of doubles).
SYNC_RUN_VALUES = 1 << 23
# Rows per NumPy chunk are chosen so one chunk's input matrix stays near
# this many doubles (about 128 MB).
_CHUNK_DOUBLES = 1 << 24


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_string(key) -> F.Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in _keys(key)])


def with_noise(df: DataFrame, key, latent_dim: int, seed, n_draws: int = DEFAULT_DRAWS,
               tag: str = "eval", divergence_draws: bool = False) -> DataFrame:
    """Adds ``eps`` (K draws) and ``eps_mc`` (n_draws x K draws, row-major).
    ``divergence_draws`` appends the two draws per latent dimension of the
    sampled divergence to ``eps``."""
    k = key_string(key)
    eps = gaussian_array(f"{seed}:{tag}", k, latent_dim)
    if divergence_draws:
        eps = F.concat(eps, *[gaussian_array(f"{seed}:{tag}:{r}", k, latent_dim) for r in ("r1", "r2")])
    out = df.withColumn("eps", eps)
    if n_draws:
        out = out.withColumn("eps_mc", gaussian_array(f"{seed}:{tag}:mc", k, n_draws * latent_dim))
    return out


def train_noise(seed, key: pa.Array, latent_dim: int, divergence_draws: bool) -> np.ndarray:
    """``eps`` of :func:`with_noise` for training, from a batch's key strings."""
    return np.concatenate([draws(f"{seed}:train{r}", key, latent_dim) for r in (("", ":r1", ":r2") if divergence_draws else ("",))], axis=1)


def eval_noise(seed, key: pa.Array, latent_dim: int, n_draws: int) -> tuple[np.ndarray, np.ndarray]:
    """``eps`` and ``eps_mc`` of :func:`with_noise` for evaluation."""
    return (draws(f"{seed}:eval", key, latent_dim),
            draws(f"{seed}:eval:mc", key, n_draws * latent_dim).reshape(-1, n_draws, latent_dim))


# ------------------------------------------------------------ arrow glue ---

def _to_matrix(col, width: int, dtype) -> np.ndarray:
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, width), dtype=dtype)
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    if col.null_count or np.any(lens != width):
        raise ValueError(f"every row needs exactly {width} values (pad or fix the input)")
    vals = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    return vals.astype(dtype, copy=False).reshape(n, width)


def _list_array(mat: np.ndarray, arrow_type):
    n, k = mat.shape
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1).astype(np.float64, copy=False), type=arrow_type))


def _x_width(spec: M.VibSpec) -> int:
    return spec.seq_len if spec.input_kind == "ids" else spec.input_dim


def _chunk_rows(spec: M.VibSpec) -> int:
    return max(1, _CHUNK_DOUBLES // max(1, spec.flat_in))


def stored(df: DataFrame, spec: M.VibSpec, columns: Sequence[str]) -> DataFrame:
    """The frame with its input columns as many passes want them: ids without
    the padding after the last one (two bytes each where the vocabulary is that
    small), numbers in the model's type.  A row of another width is an error.
    :func:`stored_inputs` reads them."""
    ids, width = spec.input_kind == "ids", _x_width(spec)
    if not ids and spec.dtype == "float64":
        return df
    small = spec.vocab_size <= 1 << 15
    item = (T.ShortType() if small else T.IntegerType()) if ids else T.FloatType()
    dtype = (np.int16 if small else np.int32) if ids else np.float32
    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.ArrayType(item)) if f.name in columns else f for f in df.schema])

    def cut(col):
        mat = _to_matrix(col, width, np.int64 if ids else np.float64)
        if not ids:
            lens, flat = np.full(len(mat), width), mat.astype(dtype).reshape(-1)
        else:
            mat = np.clip(mat, 0, spec.vocab_size - 1).astype(dtype)
            lens = M.id_lengths(mat)
            flat = mat[np.arange(width) < lens[:, None]]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(flat))

    def run(batches):
        for b in batches:
            for part in (b.slice(at, PACK_ROWS) for at in range(0, b.num_rows, PACK_ROWS)):
                yield pa.RecordBatch.from_arrays([cut(part.column(c)) if c in columns else part.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


#: Rows that are packed together.
PACK_ROWS = 1024


def packed(df: DataFrame, split: str, worker: bool = False) -> DataFrame:
    """The rows of a frame packed as Arrow, so that reading them again costs
    nothing by row: ``(worker, rows with split true, blob)`` for some
    thousand rows, of one worker where rows have one (``worker``).  :func:`unpacked` reads them."""
    def run(batches):
        some = (b.slice(at, 4 * PACK_ROWS) for b in batches for at in range(0, b.num_rows, 4 * PACK_ROWS))
        for w, one in (worker_rows(some) if worker else ((None, b) for b in some)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema) as out:
                out.write_batch(one)
            train = one.column(split).true_count if split in one.schema.names else one.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([train], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["_w", "n_train", "blob"])

    return df.mapInArrow(run, "_w int, n_train long, blob binary")


def unpacked(batches):
    """``(worker, rows)`` of each pack."""
    for b in batches:
        for w, blob in zip(b.column("_w").to_pylist(), b.column("blob")):
            for one in pa.ipc.open_stream(blob.as_buffer()):
                yield w, one


def stored_inputs(col, spec: M.VibSpec) -> np.ndarray:
    """The matrix of a column of :func:`stored`, with its padding."""
    import pyarrow.compute as pc

    width = _x_width(spec)
    if spec.input_kind != "ids":
        return _to_matrix(col, width, np.dtype(spec.dtype))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), width), dtype=flat.dtype)
    # places of the ids in the matrix
    out.reshape(-1)[np.arange(len(flat)) + np.repeat(np.arange(len(lens)) * width - np.cumsum(lens) + lens, lens)] = flat
    return out


#: Rows that are evaluated together, at most.
EVAL_ROWS = 512


def like_rows(spec: M.VibSpec, x: np.ndarray):
    """Chunks of one forward pass: the places of their rows, and the rows as the
    model takes them; rows of ids of like length together, so that a chunk's
    padding is not multiplied out."""
    chunk = min(_chunk_rows(spec), EVAL_ROWS)
    if spec.input_kind != "ids":
        for at in range(0, len(x), chunk):
            yield np.arange(at, min(at + chunk, len(x))), x[at:at + chunk]
        return
    lens = M.id_lengths(x)
    order = np.argsort(lens, kind="stable")
    for i in (order[at:at + chunk] for at in range(0, len(x), chunk)):
        yield i, M.IdRows(spec, x[i], lens[i])


SCORE_FIELDS = [
    ("mu", T.ArrayType(T.DoubleType())),
    ("sigma", T.ArrayType(T.DoubleType())),
    ("z", T.ArrayType(T.DoubleType())),
    ("logits", T.ArrayType(T.DoubleType())),
    ("pred", T.IntegerType()),
    ("ce_bits", T.DoubleType()),
    ("div_bits", T.DoubleType()),
    ("mc_pred", T.IntegerType()),
    ("mc_probs", T.ArrayType(T.DoubleType())),
]


def _shipped(spark, params):
    """The parameters as a broadcast (an existing broadcast is used as is,
    so a loop can release it once its job is done)."""
    from pyspark import Broadcast

    return params if isinstance(params, Broadcast) else spark.sparkContext.broadcast(params)


def score(df: DataFrame, spec: M.VibSpec, params, key, x: str = "ids",
          label: str = "label", keep: Sequence[str] = (), alpha: float = 1.0, seed=0,
          n_draws: int = DEFAULT_DRAWS, tag: str = "eval") -> DataFrame:
    """Per-row forward pass.  Output: key columns, ``label``, ``keep``
    columns and the fields of :data:`SCORE_FIELDS`."""
    keys = _keys(key)
    cols = list(dict.fromkeys(keys + [label] + list(keep)))
    src = with_noise(df.select(*cols, x), keys, spec.latent_dim, seed, n_draws, tag)
    in_schema = src.schema
    out_schema = T.StructType([in_schema[c] for c in cols] + [T.StructField(n, t) for n, t in SCORE_FIELDS])
    bc = _shipped(df.sparkSession, params)
    width, k, s, chunk = _x_width(spec), spec.latent_dim, n_draws, _chunk_rows(spec)
    xdtype = np.int64 if spec.input_kind == "ids" else np.float64

    def run(batches):
        flat = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            for start in range(0, b.num_rows, chunk):
                part = b.slice(start, chunk)
                xm = _to_matrix(part.column(x), width, xdtype)
                y = part.column(label).to_numpy(zero_copy_only=False)
                eps = _to_matrix(part.column("eps"), k, np.float64)
                emc = _to_matrix(part.column("eps_mc"), s * k, np.float64).reshape(-1, s, k) if s else None
                r = M.row_metrics(spec, flat, xm, y, eps, emc, alpha)
                arrays = [part.column(c) for c in cols]
                arrays += [
                    _list_array(r["mu"], pa.float64()), _list_array(r["sigma"], pa.float64()),
                    _list_array(r["z"], pa.float64()), _list_array(r["logits"], pa.float64()),
                    pa.array(r["pred"].astype(np.int32)), pa.array(r["ce_bits"].astype(np.float64)), pa.array(r["div_bits"].astype(np.float64)),
                    pa.array(r["mc_pred"].astype(np.int32)) if s else pa.nulls(part.num_rows, pa.int32()),
                    _list_array(r["mc_probs"], pa.float64()) if s else pa.nulls(part.num_rows, pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=out_schema.fieldNames())

    return src.mapInArrow(run, out_schema)


def metrics_by(scored: DataFrame, out_dim: int, by: Sequence[str] = ("is_train",),
               beta: float = 0.0, label: str = "label") -> DataFrame:
    """Information-plane bounds and accuracies per group (bits):
    ``izy = log2(out_dim) - mean CE``, ``izx = mean divergence``,
    ``acc`` (one draw), ``avg_acc`` (Monte Carlo), ``loss = CE + beta izx``."""
    ce = F.avg("ce_bits")
    izx = F.avg("div_bits")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(math.log2(out_dim)) - ce).alias("izy"),
        izx.alias("izx"),
        F.avg((F.col("pred") == F.col(label)).cast("double")).alias("acc"),
        F.avg((F.col("mc_pred") == F.col(label)).cast("double")).alias("avg_acc"),
        ce.alias("ce_bits"),
        (ce + F.lit(beta) * izx).alias("loss_bits"),
    )


def evaluate(df: DataFrame, spec: M.VibSpec, params: np.ndarray, key, x: str = "ids",
             label: str = "label", split: str = "is_train", alpha: float = 1.0, beta: float = 0.0,
             seed=0, n_draws: int = DEFAULT_DRAWS, tag: str = "eval") -> DataFrame:
    """One pass over both parts: metrics per value of ``split``."""
    scored = score(df, spec, params, key, x, label, [split], alpha, seed, n_draws, tag)
    return metrics_by(scored, spec.out_dim, [split], beta, label)


def predict(df: DataFrame, spec: M.VibSpec, params: np.ndarray, key, x: str = "ids",
            seed=0, n_draws: int = DEFAULT_DRAWS, tag: str = "predict") -> DataFrame:
    """Batch scoring of new rows: ``key, logits, probs (Monte Carlo), pred``."""
    d = df if "label" in df.columns else df.withColumn("label", F.lit(-1))
    s = score(d, spec, params, key, x, "label", (), 1.0, seed, n_draws, tag)
    return s.select(*_keys(key), "logits", F.col("mc_probs").alias("probs"), F.col("mc_pred").alias("pred"))


# ---------------------------------------------------------------- train ---

@dataclass(frozen=True)
class FitConfig:
    epochs: int = 25
    batch_size: int = 50
    beta: float = 1e-3
    alpha: float = 1.0
    lr: float = 1e-4
    seed: int = 0
    mode: str = "sync"
    n_draws: int = DEFAULT_DRAWS
    checkpoint_path: str | None = None
    # the divergence trained on for alpha != 1: "sampled" (log-sum-exp over the
    # batch of independent draws) or "closed"
    estimator: str = "sampled"
    # IZX reported for alpha != 1: the sampled "reference" / "mc" estimators of
    # ibex.operators.divergence, or "closed"
    izx_estimator: str = "reference"
    # workers of mode "average"; None: by the number of rows (``worker_count``)
    n_workers: int | None = None
    # sync mini-batches: "hash" (balanced by key hash, every row used) or
    # "exact" (contiguous slices of batch_size in a fixed shuffled order,
    # the remainder dropped)
    batching: str = "hash"


def _kernel_chunks(batches, spec, x, label, k):
    """Arrow batches as ``(x, y, eps)`` in chunks, so a task's memory does not
    grow with the batch."""
    width, chunk = _x_width(spec), _chunk_rows(spec)
    xdtype = np.int64 if spec.input_kind == "ids" else np.float64
    for b in batches:
        for start in range(0, b.num_rows, chunk):
            part = b.slice(start, chunk)
            yield (_to_matrix(part.column(x), width, xdtype), part.column(label).to_numpy(zero_copy_only=False),
                   _to_matrix(part.column("eps"), k, np.float64))


def batch_log_sum(step_df: DataFrame, spec, params, x, label, alpha) -> tuple[int, tuple[float, float]]:
    """First pass of a sampled-divergence step over any number of tasks: the
    batch's size and its ``(top, total)``, added from one row per task
    (log-sum-exp is associative)."""
    bc = _shipped(step_df.sparkSession, params)
    k = spec.latent_dim

    def run(batches):
        p = M.Layout(spec).views(bc.value)
        n, parts = 0, []
        for xm, _, eps in _kernel_chunks(batches, spec, x, label, 3 * k):
            mu, rho, _ = M.encode(spec, p, xm)
            ls, eps = M.log_softplus(rho - M.SCALE_SHIFT), eps.astype(spec.dtype, copy=False)
            d, _ = M.sampled_terms(mu, M.softplus(rho - M.SCALE_SHIFT), ls, eps[:, k:2 * k], eps[:, 2 * k:])
            n += len(xm)
            parts = [M.add_log_sums([*parts, M.log_sum(d, alpha)], alpha)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([parts[0][0]]), pa.array([parts[0][1]])],
                                             names=["n", "top", "total"])

    rows = step_df.mapInArrow(run, "n long, top double, total double").collect()  # a row for each task
    return sum(r["n"] for r in rows), M.add_log_sums(sorted((r["top"], r["total"]) for r in rows), alpha)


def _grad_partials(step_df: DataFrame, spec, params, x, label, beta, alpha, batch_total, estimator: str = "closed",
                   norm: tuple[float, float] | None = None):
    """Per-partition gradient sums of one step as rows of blocks.  Partial
    sums of a batch add up: the closed form by nature, the sampled divergence
    through ``norm``, the batch's log-sum-exp from :func:`batch_log_sum`."""
    bc = _shipped(step_df.sparkSession, params)
    k = M.noise_columns(spec, alpha, estimator)
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("ce", T.DoubleType()),
                           T.StructField("dv", T.DoubleType()), T.StructField("g", T.BinaryType())])

    def run(batches):
        flat = bc.value
        g = None
        n = 0
        ce = dv = 0.0
        for xm, y, eps in _kernel_chunks(batches, spec, x, label, k):
            gi, c, d, m = M.loss_and_grad(spec, flat, xm, y, eps, beta, alpha, batch_total, estimator, norm)
            g = gi.astype(np.float64) if g is None else g + gi
            n, ce, dv = n + m, ce + c, dv + d
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([ce]), pa.array([dv]), pa.array([g.tobytes()], pa.binary())],
                names=["n", "ce", "dv", "g"])

    return step_df.mapInArrow(run, schema)


def batch_gradient(step_df: DataFrame, spec, params, x, label, beta, alpha, estimator: str = "sampled"):
    """``(rows, mean gradient)`` of one batch spread over any number of tasks:
    one pass, or two where the divergence is sampled over the whole batch."""
    if M.noise_columns(spec, alpha, estimator) > spec.latent_dim:
        n, norm = batch_log_sum(step_df, spec, params, x, label, alpha)
        if not n:
            return 0, None
        return _sum_partials(_grad_partials(step_df, spec, params, x, label, beta, alpha, n, estimator, norm))
    n, g = _sum_partials(_grad_partials(step_df, spec, params, x, label, beta, alpha, 1, estimator))
    return n, g / n if n else None


def _sum_partials(parts: DataFrame):
    """Sum of per-partition gradient rows: ``(n, grad)``, block-wise in two
    levels on the executors."""
    tot = tree_sum_by_key(parts.rdd.map(lambda r: (0, (r["n"], np.frombuffer(r["g"], dtype=np.float64)))))
    return tot.get(0, (0, None))


def _sync_run(run_df: DataFrame, partition: int, spec, params, opt, x, label, beta, alpha, estimator):
    """Synchronous Adam steps over one run of batches (rows sorted by
    ``batch``, all in partition ``partition``): each batch's mean gradient
    is taken at the parameters left by the previous batch, exactly as one
    job per step would.  Only that partition is computed.  Returns the new
    parameters and optimizer."""
    state = (params, opt.m if opt.m is not None else np.zeros_like(params),
             opt.v if opt.v is not None else np.zeros_like(params), opt.t)
    bc = run_df.sparkSession.sparkContext.broadcast(state)
    width, k = _x_width(spec), M.noise_columns(spec, alpha, estimator)
    xdtype = np.int64 if spec.input_kind == "ids" else np.float64
    lr, b1, b2, ae = opt.lr, opt.beta1, opt.beta2, opt.eps
    schema = T.StructType([T.StructField("blob", T.BinaryType())])

    def run(batches):
        p0, m0, v0, t0 = bc.value
        local = M.Adam(lr, b1, b2, ae, t0, m0.copy(), v0.copy())
        p = p0.copy()
        pend, cur, steps = [], None, 0

        def flush():
            nonlocal p, steps
            xm = np.concatenate([a for a, _, _ in pend])
            y = np.concatenate([b for _, b, _ in pend])
            e = np.concatenate([c for _, _, c in pend])
            g, _, _, n = M.loss_and_grad(spec, p, xm, y, e, beta, alpha, len(xm), estimator)
            if n:
                p = local.step(p, g)
                steps += 1

        for b in batches:
            if b.num_rows == 0:
                continue
            bid = b.column("batch").to_numpy(zero_copy_only=False)
            xm = _to_matrix(b.column(x), width, xdtype)
            y = b.column(label).to_numpy(zero_copy_only=False)
            eps = _to_matrix(b.column("eps"), k, np.float64)
            cuts = [0, *(np.flatnonzero(np.diff(bid)) + 1).tolist(), len(bid)]
            for s0, s1 in zip(cuts[:-1], cuts[1:]):
                if cur is not None and bid[s0] != cur:
                    flush()
                    pend = []
                cur = bid[s0]
                pend.append((xm[s0:s1], y[s0:s1], eps[s0:s1]))
        if pend:
            flush()
        if steps:
            blob = np.concatenate([v.astype(np.float64, copy=False) for v in (p, local.m, local.v)] + [[float(local.t)]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    sc = run_df.sparkSession.sparkContext
    rows = sc.runJob(run_df.mapInArrow(run, schema).rdd, list, [partition])  # at most one row
    bc.unpersist()
    if not rows:
        return params, opt
    if len(rows) > 1:
        raise RuntimeError("a run of batches was split across partitions")
    v = np.frombuffer(rows[0]["blob"], dtype=np.float64)
    size, steps, v = len(params), int(v[-1]), v.astype(params.dtype, copy=False)
    new_opt = M.Adam(opt.lr, beta1=opt.beta1, beta2=opt.beta2, eps=opt.eps, m=v[size:2 * size].copy(),
                     v=v[2 * size:3 * size].copy(), t=steps)
    return v[:size].copy(), new_opt


def _settings(spec: M.VibSpec, cfg: FitConfig, keys, x: str, label: str, split: str, n_workers) -> dict:
    """What a resumed fit has to share with the saved one: everything that
    its numbers depend on but the number of epochs."""
    from dataclasses import asdict

    told = {k: v for k, v in asdict(cfg).items() if k not in ("epochs", "checkpoint_path", "n_workers")}
    return {"spec": asdict(spec), "columns": [*keys, x, label, split], "n_workers": n_workers} | told


def fit(data: DataFrame, spec: M.VibSpec, cfg: FitConfig, key, x: str = "ids", label: str = "label",
        split: str = "is_train", params: np.ndarray | None = None, opt: M.Adam | None = None, resume: bool = False):
    """Train on rows with ``split`` true, evaluate both parts after every
    epoch.  Returns ``(params, history rows as dicts)``; see
    :func:`history_frame` for the table.  ``params`` / ``opt`` continue
    from an earlier run; a given ``opt`` is left holding the final Adam
    state.

    With ``cfg.checkpoint_path`` every epoch is saved with its optimizer state
    and history.  ``resume`` goes on after the last epoch saved there (from
    the start if there is none) and ends with the bits of a fit that was never
    stopped; noise and batches depend on the seed and the epoch alone."""
    spark = data.sparkSession
    keys = _keys(key)
    params = M.init_params(spec, cfg.seed) if params is None else params.copy()
    opt_out = opt
    opt = M.Adam(cfg.lr) if opt is None else M.Adam(opt.lr, opt.beta1, opt.beta2, opt.eps, opt.t,
                                                     None if opt.m is None else opt.m.copy(),
                                                     None if opt.v is None else opt.v.copy())
    # materialise the model inputs once: every epoch re-reads them, and an
    # executor loss then re-reads checkpoint files instead of re-running the
    # whole text pipeline
    data = data.select(*dict.fromkeys(keys + [x, label, split]))
    # the sampled divergence is estimated from scored rows, other metrics are sums
    sums = cfg.mode == "average" and bool(cfg.n_draws) and (cfg.izx_estimator == "closed" or cfg.alpha == 1.0)
    if cfg.mode == "average":
        rows = stored(data, spec, [x]).withColumn("_k", key_string(keys)).where(F.col(split).isNotNull())
        packs = materialize(packed(rows, split))
        n_train = packs.agg(F.sum("n_train")).first()[0] or 0
        train = packs.mapInArrow(lambda batches: (one for _, one in unpacked(batches)), rows.schema).where(F.col(split)).select(*keys, "_k", x, label)
        data = packs if sums else materialize(data)
    else:
        data = materialize(data)
        train = data.where(F.col(split)).select(*keys, x, label)
        n_train = train.count()
    sampled = M.noise_columns(spec, cfg.alpha, cfg.estimator) > spec.latent_dim
    n_workers = (cfg.n_workers or worker_count(n_train)) if cfg.mode == "average" else None
    settings = _settings(spec, cfg, keys, x, label, split, n_workers)
    history: list[dict] = []
    if resume:
        if not cfg.checkpoint_path:
            raise ValueError("resume needs a checkpoint_path")
        saved = P.last_epoch(spark, cfg.checkpoint_path, spec, settings)
        if saved:
            _, params, m, v, steps, history = saved
            opt = M.Adam(opt.lr, opt.beta1, opt.beta2, opt.eps, steps, m, v)
    if cfg.mode == "sync":
        if cfg.batching == "exact":
            batched, n_batches = minibatch_exact(train, keys, cfg.batch_size, cfg.seed)
        elif cfg.batching == "hash":
            batched, n_batches = minibatch_ids(train, keys, cfg.batch_size, n_train, cfg.seed)
        else:
            raise ValueError(f"unknown batching {cfg.batching!r}")
        # A small batch is trained inside one task: the batches are cut into
        # ``n_runs`` contiguous runs, each run sits in one partition sorted by
        # batch, and one task per run advances the parameters and Adam state
        # batch after batch (one Spark job per run, not per step).  A large
        # batch is cut into ``fan`` hash slices so a step runs on several tasks.
        fan = max(1, -(-cfg.batch_size // SYNC_ROWS_PER_TASK))
        if fan == 1:
            run_rows = max(cfg.batch_size, SYNC_RUN_VALUES // max(1, _x_width(spec)))
            n_runs = max(1, min(n_batches, -(-n_train // run_rows)))
            run = F.floor(F.col("batch") * F.lit(n_runs) / F.lit(max(1, n_batches))).cast("int")
            batched = (batched.withColumn("_run", run).repartition(n_runs, "_run")
                       .sortWithinPartitions("_run", "batch", *keys).persist())
            # the partition holding each run (one row per run): a run's job
            # then launches one task instead of one per partition
            home = {0: 0} if n_runs == 1 else {r["_run"]: r["_p"] for r in batched.select(
                "_run", F.spark_partition_id().alias("_p")).distinct().collect()}
        else:
            batched = batched.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(fan)))
            parts = max(1, min(n_batches * fan, spark.sparkContext.defaultParallelism))
            batched = batched.repartition(parts, "batch", "_slice").persist()
    elif cfg.mode == "average":
        train = packed(by_worker(train, keys, n_workers, cfg.seed).drop(*keys), split, True).persist()
    else:
        raise ValueError(f"unknown mode {cfg.mode!r}")
    for epoch in range(len(history) + 1, cfg.epochs + 1):
        if cfg.mode == "sync" and fan == 1:
            noisy = with_noise(batched, keys, spec.latent_dim, f"{cfg.seed}:{epoch}", 0, "train", sampled)
            for r in sorted(home):
                params, opt = _sync_run(noisy.where(F.col("_run") == F.lit(r)), home[r], spec, params, opt, x,
                                        label, cfg.beta, cfg.alpha, cfg.estimator)
        elif cfg.mode == "sync":
            noisy = with_noise(batched, keys, spec.latent_dim, f"{cfg.seed}:{epoch}", 0, "train", sampled)
            for step in range(n_batches):
                # the step's ``fan`` slices run as separate tasks and their partials are tree-summed
                bc = spark.sparkContext.broadcast(params)
                n, g = batch_gradient(noisy.where(F.col("batch") == F.lit(step)), spec, bc, x, label, cfg.beta, cfg.alpha, cfg.estimator)
                bc.unpersist()
                if n:
                    params = opt.step(params, g.astype(params.dtype, copy=False))
        else:
            params, opt = _average_epoch(train, spec, params, opt, cfg, keys, x, label, epoch, n_workers)
        ev = (_part_sums(data, spec, params, x, label, split, cfg, epoch) if sums
              else _epoch_metrics(data, spec, params, keys, x, label, split, cfg, epoch))
        row = {"epoch": epoch}
        for part, name in ((True, "train"), (False, "test")):
            r = ev.get(part)
            for m in ("izy", "izx", "acc", "avg_acc"):
                row[f"{name}_{m}"] = float(r[m]) if r is not None and r[m] is not None else None
        history.append(row)
        log.info("epoch %d: test acc %.4f, avg acc %.4f, IZY %.2f, IZX %.2f", epoch,
                 row["test_acc"] or float("nan"), row["test_avg_acc"] or float("nan"),
                 row["test_izy"] or float("nan"), row["test_izx"] or float("nan"))
        if cfg.checkpoint_path:
            P.commit_epoch(spark, cfg.checkpoint_path, epoch, spec, params, opt, settings, history)
    (batched if cfg.mode == "sync" else train).unpersist()
    data.unpersist()
    if cfg.mode == "average":
        packs.unpersist()
    if opt_out is not None:
        opt_out.t, opt_out.m, opt_out.v = opt.t, opt.m, opt.v
    return params, history


def worker_count(n_rows: int, rows_per_worker: int = 1 << 16, least: int = 8) -> int:
    """Workers of a local-SGD fit: a function of the rows alone."""
    return max(least, -(-n_rows // rows_per_worker))


def by_worker(df: DataFrame, keys, n_workers: int, seed) -> DataFrame:
    """Rows of each local-SGD worker together and in a fixed order: ``_w`` is
    a hash of the key, worker ``i`` is partition ``i`` (placed by its number,
    so no task has two workers and none is idle), and rows are sorted by the
    key's MD5.  Nothing depends on how ``df`` is laid out."""
    n = int(n_workers)
    if n < 1:
        raise ValueError("n_workers is at least 1")
    worker = F.pmod(hash32(f"{seed}:worker", *keys), F.lit(n)).cast("int")
    return (df.withColumn("_w", worker).withColumn("_o", F.md5(key_string(keys)))
            .repartitionById(n, "_w").sortWithinPartitions("_w", "_o", *keys).drop("_o"))


#: Blocks that one task adds up.
SUM_FAN_IN = 32


def worker_sum(parts: DataFrame, block: int = 1 << 16, n_workers: int | None = None) -> dict:
    """Sum over workers of rows ``(config_id, worker, n, blob)``, block by
    block, each block's vectors added in the order of the workers (floating
    point sums then do not depend on the schedule): ``{config_id: (n, sum)}``.

    With more than ``SUM_FAN_IN`` workers the sums have levels: a task adds
    the same block of at most that many neighbouring workers."""
    schema = "config_id int, worker int, n long, block int, part binary"

    def cut(batches):
        for b in batches:
            for cid, w, n, blob in zip(*(b.column(c).to_pylist() for c in ("config_id", "worker", "n", "blob"))):
                pieces = [blob[i:i + 8 * block] for i in range(0, len(blob), 8 * block)]
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cid] * k, pa.int32()), pa.array([w] * k, pa.int32()), pa.array([n] * k, pa.int64()),
                     pa.array(range(k), pa.int32()), pa.array(pieces, pa.binary())],
                    names=["config_id", "worker", "n", "block", "part"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("worker").to_numpy(), kind="stable")
        part, total = group.column("part"), 0.0
        for i in order.tolist():
            total = total + np.frombuffer(part[i].as_buffer(), dtype=np.float64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()),
                         pa.array([sum(group.column("n").to_pylist())], pa.int64()), pa.array([key[1].as_py()], pa.int32()),
                         pa.array([total.tobytes()], pa.binary())], names=["config_id", "worker", "n", "block", "part"])

    left, blocks = n_workers or SUM_FAN_IN, parts.mapInArrow(cut, schema)
    while True:
        blocks = (blocks.groupBy("config_id", "block", F.floor(F.col("worker") / SUM_FAN_IN).cast("int").alias("team"))
                  .applyInArrow(add, schema))
        left = -(-left // SUM_FAN_IN)
        if left <= 1:
            break
    rows = blocks.collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["config_id"], r["block"])):
        out.setdefault(r["config_id"], (r["n"], []))[1].append(np.frombuffer(bytes(r["part"]), dtype=np.float64))
    return {c: (n, np.concatenate(pieces)) for c, (n, pieces) in out.items()}


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (files under ``spark.checkpoint.dir``) plus an
    in-memory copy for the iterations."""
    from ibex.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True).persist()


def _epoch_metrics(data, spec, params, keys, x, label, split, cfg: FitConfig, epoch: int) -> dict:
    """Metrics of both parts after an epoch: ``{part: {izy, izx, acc, avg_acc}}``."""
    seed = f"{cfg.seed}:{epoch}"
    bc = data.sparkSession.sparkContext.broadcast(params)
    scored = score(data, spec, bc, keys, x, label, [split], cfg.alpha, seed, cfg.n_draws, "eval")
    sampled = cfg.izx_estimator != "closed" and cfg.alpha != 1.0
    if sampled:
        scored = scored.persist()  # three aggregations read it
    out = {r[split]: r.asDict() for r in metrics_by(scored, spec.out_dim, [split], cfg.beta, label).collect()}
    if sampled:
        from ibex.operators.divergence import renyi_sampled

        est = renyi_sampled(scored, [cfg.alpha], keys, [split], seed, "eval", cfg.izx_estimator)
        for r in est.collect():
            if r[split] in out:
                out[r[split]]["izx"] = r["value"] / math.log(2.0)
        scored.unpersist()
    bc.unpersist()
    return out


HISTORY_SCHEMA = ("epoch int, train_izy double, train_izx double, train_acc double, train_avg_acc double, "
                  "test_izy double, test_izx double, test_acc double, test_avg_acc double")


def history_frame(spark, history: list[dict], run_id: str | None = None) -> DataFrame:
    """History table: one row per epoch (bounded by the epoch count)."""
    cols = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(h[c] for c in cols) for h in history], HISTORY_SCHEMA)
    return df if run_id is None else df.withColumn("run_id", F.lit(run_id))


class Slices:
    """Rows cut into slices of ``batch_size``, laid out once for all runs that
    train on them."""

    def __init__(self, spec, batch_size: int):
        self.spec, self.batch_size, self.pending = spec, batch_size, []

    def take(self, xs, ys, es, final: bool = False):
        """Every full slice as ``(x, y, eps)``; the rest waits for more rows, or
        for ``final``."""
        if len(xs):
            self.pending.append((xs, ys, es))
        if not self.pending or not (final or sum(len(a[0]) for a in self.pending) >= self.batch_size):
            return
        xs, ys, es = (np.concatenate([a[i] for a in self.pending]) for i in range(3))
        full = len(xs) if final else (len(xs) // self.batch_size) * self.batch_size
        # copies: a view would hold all rows of the batch
        self.pending = [(xs[full:].copy(), ys[full:].copy(), es[full:].copy())] if full < len(xs) else []
        ids = self.spec.input_kind == "ids"
        lens = M.id_lengths(xs[:full]) if ids else None
        for s0 in range(0, full, self.batch_size):
            at = slice(s0, min(s0 + self.batch_size, full))
            yield (M.IdRows(self.spec, xs[at], lens[at]) if ids else xs[at]), ys[at], es[at]


    def some(self, xs, ys, es):
        """The full slices of :meth:`take`, some at a time, so few are laid out."""
        for at in (slice(a, a + PACK_ROWS) for a in range(0, len(xs), PACK_ROWS)):
            yield list(self.take(xs[at], ys[at], es[at]))


class LocalRun:
    """Adam steps of one configuration over one worker's rows."""

    def __init__(self, spec, state, lr: float, beta: float, alpha: float, estimator: str, batch_size: int,
                 adam: tuple[float, float, float] = (0.9, 0.999, 1e-7)):
        p0, m0, v0, t0 = state
        self.spec, self.beta, self.alpha, self.estimator = spec, beta, alpha, estimator
        self.p, self.n, self.slices = p0.copy(), 0, Slices(spec, batch_size)
        self.g = np.empty_like(self.p)
        # what is updated after the gradient: all but the weights of ids, which are while it is taken
        at, shape = M.layout_of(spec).offsets[M.first_weights(spec)]
        self.rest = [(0, at), (at + math.prod(shape), len(self.p))] if spec.input_kind == "ids" else [(0, len(self.p))]
        self.opt = M.Adam(lr, *adam, t0, m0.copy(), v0.copy())

    @property
    def pending(self) -> list:
        return self.slices.pending

    def step(self, x, y, eps) -> None:
        """A step on one slice."""
        self.n += len(x)
        self.opt.begin(self.p)
        M.loss_and_grad(self.spec, self.p, x, y, eps, self.beta, self.alpha, len(x), self.estimator, out=self.g,
                        take=lambda at, grad: self.opt.update(self.p, grad, self.p, at))
        for at, end in self.rest:
            self.opt.update(self.p, self.g[at:end], self.p, at)

    def feed(self, xs, ys, es, final: bool = False) -> None:
        """Takes every full slice; the rest waits for more rows, or for
        ``final``."""
        for one in self.slices.take(xs, ys, es, final):
            self.step(*one)

    def finish(self) -> None:
        """The steps of what is left."""
        self.feed((), (), (), final=True)

    def pieces(self, config_id: int, worker: int):
        """Parameters and moments, block by block, for :func:`worker_mean`."""
        values = (self.p, self.opt.m, self.opt.v)
        for at in range(0, len(self.p), MEAN_BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((config_id, pa.int32()), (worker, pa.int32()), (self.n, pa.int64()), (float(self.opt.t * self.n), pa.float64()),
                                               (at // MEAN_BLOCK, pa.int32()))]
                + [pa.array([np.concatenate([v[at:at + MEAN_BLOCK] for v in values]).tobytes()], pa.binary())], names=PIECE_NAMES)


#: Parameters of a block (with their moments three times as many values).
MEAN_BLOCK = 1 << 15
PIECES = "config_id int, worker int, n long, steps double, block int, part binary"
PIECE_NAMES = [f.split()[0] for f in PIECES.split(", ")]


#: Workers' states that lie in the shuffle files of one job, in bytes.
WAVE_BYTES = 256 << 20


def waves(n_workers: int, state_bytes: int) -> list[tuple[int, int]]:
    """The workers in ranges ``(first, end)`` of nearly one size whose states,
    of ``state_bytes`` each, fit ``WAVE_BYTES`` (or of one worker)."""
    n = min(n_workers, -(-n_workers // max(1, WAVE_BYTES // max(1, state_bytes))))
    return [(i * n_workers // n, (i + 1) * n_workers // n) for i in range(n)]


@contextmanager
def _files_go_with_their_query(spark):
    """Shuffle files are deleted when their query ends; the driver's collector,
    which :func:`tidy` calls, sees a query's files only one query later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def wave_mean(spark, by_worker: DataFrame, train, dtype, n_workers: int, state_bytes: int) -> dict:
    """:func:`worker_mean` of ``train(rows of some workers)``, wave by wave: a
    wave's shuffle files go before the next one trains.  Means of waves are
    added as doubles, weighted by rows, in their order."""
    found: dict = {}
    cuts = waves(n_workers, state_bytes)
    with _files_go_with_their_query(spark):
        for first, end in cuts:
            rows = by_worker if len(cuts) == 1 else by_worker.where((F.col("_w") >= F.lit(first)) & (F.col("_w") < F.lit(end)))
            _add_means(found, worker_mean(train(rows), dtype, n_workers), dtype)
            tidy(spark)
    return {c: (*values, int(round(steps))) for c, (*values, steps, _) in found.items()}


def _add_means(found: dict, means: pa.Table, dtype) -> None:
    """Adds a wave's blocks to ``{config_id: [parameters, m, v, steps, rows]}``
    of the waves before, in place."""
    cid, n, steps, block = (means.column(c).to_numpy() for c in ("config_id", "n", "steps", "block"))
    part, fresh = means.column("part"), {}
    for i in np.lexsort((block, cid)).tolist():
        c, mean = int(cid[i]), np.frombuffer(part[i].as_buffer(), dtype=dtype).reshape(3, -1)
        if c not in found or c in fresh:
            fresh.setdefault(c, (float(steps[i]), int(n[i]), []))[2].append(mean)
            continue
        at, old = int(block[i]) * MEAN_BLOCK, found[c][4]
        for one, other in zip(found[c], mean):
            to = one[at:at + len(other)]
            to[:] = (to.astype(np.float64) * old + other.astype(np.float64) * n[i]) / (old + n[i])
    for i in np.flatnonzero(block == 0).tolist():
        c = int(cid[i])
        if c in fresh:
            t, rows, blocks = fresh[c]
            found[c] = [*(np.concatenate([b[j] for b in blocks]) for j in range(3)), t, rows]
        else:
            old = found[c][4]
            found[c][3:] = [(found[c][3] * old + float(steps[i]) * n[i]) / (old + int(n[i])), old + int(n[i])]


def worker_mean(pieces: DataFrame, dtype, n_workers: int) -> pa.Table:
    """The mean of the workers' states weighted by rows, from the blocks of
    :meth:`LocalRun.pieces`, as a row for each block.  Blocks
    travel in the model's type and are added as doubles in the order of the
    workers, at most ``SUM_FAN_IN`` of them in a task, in levels; the mean is
    taken before it is sent."""
    dtype = np.dtype(dtype)

    def adder(first: bool, last: bool):
        def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("worker").to_numpy(), kind="stable").tolist()
            part, n = group.column("part"), group.column("n").to_pylist()
            total, steps, rows = 0.0, sum(group.column("steps").to_pylist()), sum(n)
            for i in order:
                v = np.frombuffer(part[i].as_buffer(), dtype=dtype if first else np.float64)
                total = total + (v.astype(np.float64) * n[i] if first else v)
            if last:
                total, steps = (total / rows).astype(dtype), steps / rows
            return pa.table([pa.array([v], t) for v, t in ((key[0].as_py(), pa.int32()), (key[2].as_py(), pa.int32()), (rows, pa.int64()),
                                                           (steps, pa.float64()), (key[1].as_py(), pa.int32()), (total.tobytes(), pa.binary()))],
                            names=PIECE_NAMES)

        return add

    left, first = n_workers, True
    while True:
        left = -(-left // SUM_FAN_IN)
        pieces = (pieces.groupBy("config_id", "block", F.floor(F.col("worker") / SUM_FAN_IN).cast("int").alias("team"))
                  .applyInArrow(adder(first, left <= 1), PIECES))
        first = False
        if left <= 1:
            break
    return pieces.select("config_id", "n", "steps", "block", "part").toArrow()  # no Python rows


def tidy(spark) -> None:
    """Between the rounds of a long fit: shuffle files of rounds that are over
    are deleted once the driver's collector has seen that they are."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


PARTS = "config_id int, worker int, n long, blob binary"


def worker_rows(batches):
    """Arrow batches cut where the worker changes: ``(worker, rows)``."""
    for b in batches:
        if b.num_rows == 0:
            continue
        w = b.column("_w").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
        for s0, s1 in zip(cuts[:-1], cuts[1:]):
            yield int(w[s0]), b.slice(s0, s1 - s0)


def _average_epoch(train, spec, params, opt, cfg, keys, x, label, epoch, n_workers):
    """Local-SGD epoch over the packs of stored rows laid out by
    :func:`by_worker`, with their key strings ``_k``: each worker trains from the same start and the
    results are averaged by row count."""
    sampled = M.noise_columns(spec, cfg.alpha, cfg.estimator) > spec.latent_dim
    state = (params, opt.m if opt.m is not None else np.zeros_like(params),
             opt.v if opt.v is not None else np.zeros_like(params), opt.t)
    spark = train.sparkSession
    bc = spark.sparkContext.broadcast(state)
    make = (opt.lr, cfg.beta, cfg.alpha, cfg.estimator, cfg.batch_size, (opt.beta1, opt.beta2, opt.eps))
    seed = f"{cfg.seed}:{epoch}"

    def run(batches):
        now = one = None
        for w, b in unpacked(batches):
            if w != now:
                if one is not None:
                    one.finish()
                    yield from one.pieces(0, now)
                now, one = w, LocalRun(spec, bc.value, *make)
            one.feed(stored_inputs(b.column(x), spec), b.column(label).to_numpy(zero_copy_only=False),
                     train_noise(seed, b.column("_k"), spec.latent_dim, sampled))
        if one is not None:
            one.finish()
            yield from one.pieces(0, now)

    found = wave_mean(spark, train, lambda rows: rows.mapInArrow(run, PIECES), spec.dtype, n_workers, 3 * params.nbytes)
    bc.destroy()
    if not found:
        return params, opt
    p, m, v, steps = found[0]
    return p, M.Adam(opt.lr, opt.beta1, opt.beta2, opt.eps, steps, m, v)


def _part_sums(data, spec, params, x, label, split, cfg: FitConfig, epoch: int) -> dict:
    """The metrics of :func:`metrics_by` for both parts, from packs of stored rows
    with their key strings ``_k``: sums of each task and part."""
    spark = data.sparkSession
    bc = spark.sparkContext.broadcast(params)
    seed, k, alpha, n_draws = f"{cfg.seed}:{epoch}", spec.latent_dim, cfg.alpha, cfg.n_draws

    def run(batches):
        total = {}
        for _, b in unpacked(batches):
            xm, y = stored_inputs(b.column(x), spec), b.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            eps, mc = eval_noise(seed, b.column("_k"), k, n_draws)
            part = b.column(split).to_numpy(zero_copy_only=False).astype(bool)
            for i, rows in like_rows(spec, xm):
                add_metrics(total, M.row_metrics(spec, bc.value, rows, y[i], eps[i], mc[i], alpha), y[i], part[i])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.bool_()), *(pa.array(c) for c in zip(*total.values()))],
                                             names=["part", "n", "ce", "dv", "ok", "mc_ok"])

    # two rows for each task; exact sums do not depend on their order
    rows = data.mapInArrow(run, "part boolean, n double, ce double, dv double, ok double, mc_ok double").collect()
    bc.destroy()
    out = {}
    for part in (True, False):
        n, ce, dv, ok, mc_ok = (math.fsum(r[c] for r in rows if r["part"] == part) for c in ("n", "ce", "dv", "ok", "mc_ok"))
        if n:
            out[part] = {"izy": math.log2(spec.out_dim) - ce / n, "izx": dv / n, "acc": ok / n, "avg_acc": mc_ok / n}
    return out


def add_metrics(total: dict, r: dict, y: np.ndarray, part: np.ndarray, key=lambda part: part) -> None:
    """Adds ``[n, ce, divergence, hits, Monte Carlo hits]`` of scored rows to
    those of their part."""
    for p in (True, False):
        of = part == p
        if of.any():
            t = total.setdefault(key(p), np.zeros(5))
            t += [of.sum(), r["ce_bits"][of].sum(), r["div_bits"][of].sum(), (r["pred"][of] == y[of]).sum(),
                  (r["mc_pred"][of] == y[of]).sum() if "mc_pred" in r else np.nan]
