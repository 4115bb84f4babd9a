"""Training with the model as a table of blocks.

The parameters and both Adam moments are rows ``(block, p, m, v, t)`` of
``BLOCK`` values each.  They are made, moved, added up and updated on the
executors; the driver holds their table, never an array as large as the model.

* Every worker's rows meet all blocks of the model in one task (a cogroup on
  the worker; the rows stay where they are, the blocks are shuffled to them).
* Gradients and trained copies leave as blocks, which are added up block by
  block in the order of the workers, in levels.
* Adam is elementwise, so an update is a join on the block number.

Each new state is written to the checkpoint folder before the next step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ibex.operators import vib as VIB
from ibex.operators import vib_math as M

#: Values of a block (512 KB).
BLOCK = 1 << 16
STATE = "block int, p binary, m binary, v binary, t long"
PIECE = "block int, worker int, n long, g binary"


def _batch(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _values(column, dtype=np.float64) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=dtype) for v in column]


# --- making and reading state ---------------------------------------------

def block_values(spec: M.VibSpec, lo: int, hi: int, seed: int = 0, scheme: str = "glorot") -> np.ndarray:
    """The initial parameters ``lo`` to ``hi``, without the others.  ``formula``
    gives the values of ``vib_math.init_params``; ``glorot`` draws from the
    same distributions, each block from a stream of its own."""
    out = np.zeros(hi - lo)
    rng = np.random.Generator(np.random.Philox(key=[seed, lo]))
    order = {name: (li, fi, fo) for li, (name, fi, fo) in enumerate(spec.layers())}
    for name, (offset, shape) in M.Layout(spec).offsets.items():
        a, z = max(lo, offset), min(hi, offset + int(np.prod(shape)))
        if a >= z:
            continue
        i = np.arange(a - offset, z - offset)
        if name == "embed":
            t, d = np.divmod(i, spec.embed_dim)
            out[a - lo:z - lo] = np.sin(7.0 * t + 3.0 * d) / 4.0 if scheme == "formula" else rng.uniform(-0.05, 0.05, z - a)
            continue
        layer, kind = name.rsplit(".", 1)
        li, fi, fo = order[layer]
        if scheme == "formula":
            out[a - lo:z - lo] = (np.sin(i // fo + 31.0 * (i % fo) + 101.0 * li) / 8.0 if kind == "W"
                                  else np.cos(i + 101.0 * li) / 16.0)
        elif kind == "W":
            limit = math.sqrt(6.0 / (fi + fo))
            out[a - lo:z - lo] = rng.uniform(-limit, limit, z - a)
    return out


def init_state(spark: SparkSession, spec: M.VibSpec, seed: int = 0, scheme: str = "glorot", block: int = BLOCK) -> DataFrame:
    """The first state, each block made in a task."""
    size = M.Layout(spec).size

    def make(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                p = block_values(spec, i * block, min((i + 1) * block, size), seed, scheme)
                zero = np.zeros_like(p).tobytes()
                yield from _batch(STATE, [(i, p.tobytes(), zero, zero, 0)]).to_batches()

    return spark.range(-(-size // block)).mapInArrow(make, STATE)


def state_frame(spark: SparkSession, params: np.ndarray, opt: M.Adam | None = None, block: int = BLOCK) -> DataFrame:
    """State from arrays that are on the driver already (small models)."""
    m, v = (np.zeros(len(params)) if a is None else a for a in ((opt.m, opt.v) if opt else (None, None)))
    cut = [slice(a, a + block) for a in range(0, len(params), block)]
    return spark.createDataFrame([(i, *(bytearray(np.ascontiguousarray(a[s], dtype=np.float64).tobytes()) for a in (params, m, v)),
                                   opt.t if opt else 0) for i, s in enumerate(cut)], STATE)


def state_values(state: DataFrame, spec: M.VibSpec, column: str = "p", block: int = BLOCK) -> DataFrame:
    """(param, i, value) of every value, named on the executors."""
    places = [(name, offset, offset + int(np.prod(shape))) for name, (offset, shape) in M.Layout(spec).offsets.items()]

    def name(batches):
        for b in batches:
            for i, values in zip(b.column("block").to_pylist(), _values(b.column(column))):
                lo = i * block
                for param, first, last in places:
                    a, z = max(lo, first), min(lo + len(values), last)
                    if a < z:
                        yield pa.RecordBatch.from_arrays([pa.array([param] * (z - a)), pa.array(np.arange(a - first, z - first)),
                                                          pa.array(values[a - lo:z - lo])], names=["param", "i", "value"])

    return state.mapInArrow(name, "param string, i long, value double")


# --- steps -------------------------------------------------------------------

def worker_rows(df: DataFrame, keys, n_workers: int, seed=0) -> DataFrame:
    """The rows with their worker ``_w`` (a hash of the key), those of a worker
    in one partition: a cogroup on ``_w`` then moves the model only."""
    worker = F.pmod(VIB.hash32(f"{seed}:worker", *keys), F.lit(n_workers)).cast("int")
    return df.withColumn("_w", worker).withColumn("_o", F.md5(VIB.key_string(keys))).repartition(n_workers, "_w")


def _flat(blocks: pa.Table, column: str) -> np.ndarray:
    order = np.argsort(blocks.column("block").to_numpy())
    return np.concatenate([np.frombuffer(blocks.column(column)[i].as_buffer(), dtype=np.float64) for i in order.tolist()])


def _meet(rows: DataFrame, state: DataFrame, n_workers: int, work, schema: str) -> DataFrame:
    """``work(worker, rows, blocks)`` for every worker that has rows, the rows
    in the order of their key's MD5."""
    sent = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_workers - 1))).alias("_w"))

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, blocks: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _batch(schema, [])
        return _batch(schema, work(key[0].as_py(), mine.sort_by("_o"), blocks))

    return rows.groupBy("_w").cogroup(sent.groupBy("_w")).applyInArrow(run, schema)


def _pieces(worker: int, n: int, values: np.ndarray, block: int) -> list[tuple]:
    return [(i, worker, n, values[a:a + block].astype(np.float64, copy=False).tobytes()) for i, a in enumerate(range(0, len(values), block))]


def add_up(pieces: DataFrame, n_workers: int) -> DataFrame:
    """``(block, n, g)``: each block's sum over the workers, in their order,
    at most ``vib.SUM_FAN_IN`` of them in one task."""
    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("worker").to_numpy(), kind="stable").tolist()
        parts, total = group.column("g"), 0.0
        for i in order:
            total = total + np.frombuffer(parts[i].as_buffer(), dtype=np.float64)
        return _batch(PIECE, [(key[0].as_py(), key[1].as_py(), sum(group.column("n").to_pylist()), total.tobytes())])

    left = n_workers
    while True:
        pieces = pieces.groupBy("block", F.floor(F.col("worker") / VIB.SUM_FAN_IN).cast("int").alias("team")).applyInArrow(add, PIECE)
        left = -(-left // VIB.SUM_FAN_IN)
        if left <= 1:
            return pieces.drop("worker")


def gradient(rows: DataFrame, state: DataFrame, spec: M.VibSpec, n_workers: int, x: str, label: str, beta: float, alpha: float = 1.0,
             estimator: str = "sampled", block: int = BLOCK) -> DataFrame:
    """``(block, n, g)``: rows of the batch and the mean gradient's blocks.
    ``rows`` are those of :func:`worker_rows` with their noise (``eps``).  The
    sampled divergence of other orders takes a first pass for the batch's
    log-sum-exp, two numbers a worker."""
    k = M.noise_columns(spec, alpha, estimator)
    norm, total = None, 1
    if k > spec.latent_dim:
        def log_sum(worker, mine, blocks):
            p, parts, n = M.Layout(spec).views(_flat(blocks, "p")), [], 0
            for xm, _, eps in VIB._kernel_chunks(mine.to_batches(), spec, x, label, k):
                mu, rho, _ = M.encode(spec, p, xm)
                ls, d = M.log_softplus(rho - M.SCALE_SHIFT), spec.latent_dim
                parts.append(M.log_sum(M.sampled_terms(mu, M.softplus(rho - M.SCALE_SHIFT), ls, eps[:, d:2 * d], eps[:, 2 * d:])[0], alpha))
                n += len(xm)
            return [(n, *M.add_log_sums(parts, alpha))]

        found = _meet(rows, state.select("block", "p"), n_workers, log_sum, "n long, top double, total double").collect()
        total, norm = sum(r["n"] for r in found), M.add_log_sums(sorted((r["top"], r["total"]) for r in found), alpha)

    def grad(worker, mine, blocks):
        flat, n, g = _flat(blocks, "p"), 0, 0.0
        for xm, y, eps in VIB._kernel_chunks(mine.to_batches(), spec, x, label, k):
            gi, _, _, m = M.loss_and_grad(spec, flat, xm, y, eps, beta, alpha, total, estimator, norm)
            g, n = g + gi, n + m
        return _pieces(worker, n, g, block)

    summed = add_up(_meet(rows, state.select("block", "p"), n_workers, grad, PIECE), n_workers)

    def mean(batches):
        for b in batches:
            n = b.column("n").to_pylist()
            g = [(v if norm else v / c).tobytes() for v, c in zip(_values(b.column("g")), n)]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array(g, pa.binary())], names=["block", "n", "g"])

    return summed.mapInArrow(mean, "block int, n long, g binary")


def adam_step(state: DataFrame, grads: DataFrame, lr: float = 1e-4, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-7) -> DataFrame:
    """The state after an Adam step on ``grads`` (block, g): a join on the
    block, with the bits of ``vib_math.Adam``."""
    def step(batches):
        for b in batches:
            out = []
            for i, t, p, m, v, g in zip(b.column("block").to_pylist(), b.column("t").to_pylist(),
                                        *(_values(b.column(c)) for c in ("p", "m", "v", "g"))):
                opt = M.Adam(lr, beta1, beta2, eps, t, m.copy(), v.copy())
                out.append((i, opt.step(p, g).tobytes(), opt.m.tobytes(), opt.v.tobytes(), opt.t))
            yield from _batch(STATE, out).to_batches()

    return state.join(grads.select("block", "g"), "block").select("block", "p", "m", "v", "t", "g").mapInArrow(step, STATE)


def average_epoch(rows: DataFrame, state: DataFrame, spec: M.VibSpec, n_workers: int, x: str, label: str, beta: float,
                  alpha: float = 1.0, lr: float = 1e-4, batch_size: int = 50, estimator: str = "sampled", block: int = BLOCK) -> DataFrame:
    """The state after a local-SGD epoch: each worker trains from ``state`` on
    its own rows, and parameters, moments and step counts are averaged by row
    count (the numbers of ``vib.fit`` with ``mode="average"``)."""
    k = M.noise_columns(spec, alpha, estimator)
    width, xdtype = VIB._x_width(spec), np.int64 if spec.input_kind == "ids" else np.float64

    def train(worker, mine, blocks):
        start = tuple(_flat(blocks, c) for c in ("p", "m", "v"))
        run = VIB.LocalRun(spec, (*start, blocks.column("t")[0].as_py()), lr, beta, alpha, estimator, batch_size)
        for xm, y, eps in VIB._kernel_chunks(mine.to_batches(), spec, x, label, k):
            run.feed(xm, y, eps)
        run.feed(np.zeros((0, width), xdtype), np.zeros(0), np.zeros((0, k)), final=True)
        out = []
        for i, a in enumerate(range(0, len(run.p), block)):
            part = [v[a:a + block] * run.n for v in (run.p, run.opt.m, run.opt.v)]
            out.append((i, worker, run.n, np.concatenate([*part, [float(run.opt.t * run.n)]]).tobytes()))
        return out

    def mean(batches):
        for b in batches:
            out = []
            for i, n, total in zip(b.column("block").to_pylist(), b.column("n").to_pylist(), _values(b.column("g"))):
                p, m, v = np.split(total[:-1] / n, 3)
                out.append((i, p.tobytes(), m.tobytes(), v.tobytes(), int(round(total[-1] / n))))
            yield from _batch(STATE, out).to_batches()

    return add_up(_meet(rows, state, n_workers, train, PIECE), n_workers).mapInArrow(mean, STATE)


def evaluate(rows: DataFrame, state: DataFrame, spec: M.VibSpec, n_workers: int, x: str, label: str, split: str = "is_train",
             alpha: float = 1.0, n_draws: int = VIB.DEFAULT_DRAWS) -> DataFrame:
    """``(split, n, izy, izx, acc, avg_acc)`` of each part, from partial sums
    of the workers.  ``rows`` have the noise columns of ``vib.with_noise``."""
    k = spec.latent_dim

    def score(worker, mine, blocks):
        flat, total = _flat(blocks, "p"), {}
        for b in mine.to_batches(max_chunksize=VIB._chunk_rows(spec)):
            part = b.column(split).to_numpy(zero_copy_only=False).astype(bool)
            y = b.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            xm = VIB._to_matrix(b.column(x), VIB._x_width(spec), np.int64 if spec.input_kind == "ids" else np.float64)
            r = M.row_metrics(spec, flat, xm, y, VIB._to_matrix(b.column("eps"), k, np.float64),
                              VIB._to_matrix(b.column("eps_mc"), n_draws * k, np.float64).reshape(-1, n_draws, k), alpha)
            for s in (True, False):
                of = part == s
                total[s] = total.get(s, 0.0) + np.array([of.sum(), r["ce_bits"][of].sum(), r["div_bits"][of].sum(),
                                                         (r["pred"][of] == y[of]).sum(), (r["mc_pred"][of] == y[of]).sum()])
        return [(s, int(t[0]), *(float(v) for v in t[1:])) for s, t in total.items() if t[0]]

    sums = _meet(rows, state.select("block", "p"), n_workers, score, "part boolean, n long, ce double, dv double, ok double, mc double")
    n = F.sum("n")
    return sums.groupBy(F.col("part").alias(split)).agg(
        n.alias("n"), (F.lit(math.log2(spec.out_dim)) - F.sum("ce") / n).alias("izy"), (F.sum("dv") / n).alias("izx"),
        (F.sum("ok") / n).alias("acc"), (F.sum("mc") / n).alias("avg_acc"))


def fit(data: DataFrame, spec: M.VibSpec, cfg: VIB.FitConfig, key, x: str = "ids", label: str = "label", split: str = "is_train",
        state: DataFrame | None = None, block: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """Local-SGD training (``cfg.mode`` is "average") with the model as a
    table: ``(state, history rows)``.  Starts from ``state`` or from
    :func:`init_state`."""
    if cfg.mode != "average":
        raise ValueError("the block table is trained in mode 'average'")
    spark, keys = data.sparkSession, VIB._keys(key)
    data = VIB.materialize(data.select(*dict.fromkeys(keys + [x, label, split])))
    n_workers = cfg.n_workers or VIB.worker_count(data.where(F.col(split)).count())
    rows = worker_rows(data, keys, n_workers, cfg.seed).persist()
    state = _kept(init_state(spark, spec, cfg.seed, block=block) if state is None else state)
    sampled = M.noise_columns(spec, cfg.alpha, cfg.estimator) > spec.latent_dim
    history = []
    for epoch in range(1, cfg.epochs + 1):
        train = VIB.with_noise(rows.where(F.col(split)), keys, spec.latent_dim, f"{cfg.seed}:{epoch}", 0, "train", sampled)
        state = _kept(average_epoch(train, state, spec, n_workers, x, label, cfg.beta, cfg.alpha, cfg.lr, cfg.batch_size,
                                    cfg.estimator, block))
        both = VIB.with_noise(rows, keys, spec.latent_dim, f"{cfg.seed}:{epoch}", cfg.n_draws, "eval")
        row: dict = {"epoch": epoch}
        found = {r[split]: r for r in evaluate(both, state, spec, n_workers, x, label, split, cfg.alpha, cfg.n_draws).collect()}
        for part, name in ((True, "train"), (False, "test")):
            for c in ("izy", "izx", "acc", "avg_acc"):
                row[f"{name}_{c}"] = found[part][c] if part in found else None
        history.append(row)
    rows.unpersist()
    data.unpersist()
    return state, history


def _kept(state: DataFrame) -> DataFrame:
    from ibex.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(state.sparkSession)
    return state.checkpoint()
