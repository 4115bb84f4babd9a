"""Sweep tables and summaries.

A *runs* table has one row per ``(config, trial, epoch, is_train)`` with a
``metric`` column (an accuracy, a bound...).  Summaries are grouped
aggregates with map-side partial aggregation; "last epoch" is ``max_by``
(no window, so a run holding a third of all rows is still split across map
tasks).

:func:`fit_sweep` trains many configurations together.  Its tasks are keyed
by (configuration shard, worker): a task trains its shard's configurations on
its worker's rows, and each shard's state is sent by itself, so a task needs
the memory of one shard whatever the grid.
:func:`ibex.operators.resident.fit_runs` trains each run whole in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ibex.functions.hashing import uniform
from ibex.operators import vib as VIB
from ibex.operators import vib_math as M
from ibex.operators.split import split_hash

def beta_grid(lo: float = -6.0, hi: float = 2.0, step: float = 0.5) -> list[float]:
    """Powers of ten ``10 ** (lo + step * i)`` up to ``hi`` inclusive."""
    n = int(round((hi - lo) / step)) + 1
    return [10 ** (lo + step * i) for i in range(n)]


def runs_from_events(events: DataFrame, test_fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """A runs table derived from an event log: ``config = event_type``,
    ``trial = user_id``, ``epoch = day index of ts``, ``is_train`` by a hash
    of ``event_id``, ``metric = avg(value)``."""
    # days since 1970-01-01 of the wall-clock date: independent of the session time zone
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return (
        events.select(
            F.col("event_type").alias("config"),
            F.col("user_id").alias("trial"),
            day.alias("epoch"),
            (uniform(seed, "event_id") >= F.lit(test_fraction)).alias("is_train"),
            "value",
        )
        .groupBy("config", "trial", "epoch", "is_train")
        .agg(F.avg("value").alias("metric"))
    )


def history_wide(runs: DataFrame) -> DataFrame:
    """Train and test metrics side by side per epoch (conditional
    aggregation, one pass, no self join)."""
    return runs.groupBy("config", "trial", "epoch").agg(
        F.max(F.when(F.col("is_train"), F.col("metric"))).alias("train_metric"),
        F.max(F.when(~F.col("is_train"), F.col("metric"))).alias("test_metric"),
    )


def last_epoch(runs: DataFrame, by: Sequence[str] = ("config", "trial", "is_train")) -> DataFrame:
    """Value at the last epoch of every run (``max_by``)."""
    return runs.groupBy(*by).agg(
        F.max("epoch").alias("last_epoch"),
        F.max_by("metric", "epoch").alias("last_metric"),
        F.count(F.lit(1)).alias("n_epochs"),
    )


def summary_mean_std(runs: DataFrame, is_train: bool = False) -> DataFrame:
    """Per config: mean and population std over trials of the last-epoch
    metric of one part (the test part by default)."""
    last = last_epoch(runs.where(F.col("is_train") == F.lit(is_train)))
    return last.groupBy("config").agg(
        F.avg("last_metric").alias("avg_metric"),
        F.stddev_pop("last_metric").alias("std_metric"),
        F.count(F.lit(1)).alias("n_trials"),
    )


def summary_train_test(runs: DataFrame) -> DataFrame:
    """Per config: mean over trials of the last-epoch train and test metric."""
    last = last_epoch(runs)
    return last.groupBy("config").agg(
        F.avg(F.when(F.col("is_train"), F.col("last_metric"))).alias("train_metric"),
        F.avg(F.when(~F.col("is_train"), F.col("last_metric"))).alias("test_metric"),
    )


# ------------------------------------------------------------ training ---

@dataclass(frozen=True)
class SweepConfig:
    """One run of a sweep.  ``trial`` numbers the repetition; ``split`` is
    the seed of its train/test split (the trial itself unless given), so
    repetitions can share one split."""

    config_id: int
    alpha: float
    beta: float
    trial: int
    split: int | None = None

    @property
    def split_seed(self) -> int:
        return self.trial if self.split is None else self.split


def alpha_trial_grid(alphas: Sequence[float], n_trials: int, beta: float) -> list[SweepConfig]:
    out, i = [], 0
    for t in range(n_trials):
        for a in alphas:
            out.append(SweepConfig(i, float(a), float(beta), t))
            i += 1
    return out


def beta_grid_configs(betas: Sequence[float], n_samples: int, alpha: float = 1.0,
                      split: int | None = 0) -> list[SweepConfig]:
    """``n_samples`` fresh models per beta.  By default every sample trains
    on the same split (seed ``split``), as the beta sweep loads its data
    once; ``split=None`` gives each sample its own split."""
    out, i = [], 0
    for b in betas:
        for s in range(n_samples):
            out.append(SweepConfig(i, float(alpha), float(b), s, split))
            i += 1
    return out


# The settings of the two sweep scripts.  Both train the
# embedding text encoder (1000 x 64 embedding, sequences of 500 ids) with
# Adam at learning rate 1e-4 and batches of 50.
SCRIPT_ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0)
SCRIPT_ALPHA_TRIALS = 5
SCRIPT_ALPHA_EPOCHS = 5
SCRIPT_ALPHA_BETA = 1e-4
SCRIPT_ALPHA_UNITS = (128, 64)
SCRIPT_BETA_LOG10 = (-6.0, 2.0, 0.5)  # 10^-6, 10^-5.5, ..., 10^2: 17 betas
SCRIPT_BETA_SAMPLES = 50
SCRIPT_BETA_EPOCHS = 10
SCRIPT_BETA_ALPHA = 1.0
SCRIPT_BETA_UNITS = (128, 64, 32)
SCRIPT_BATCH = 50
SCRIPT_LR = 1e-4


RUN_SCHEMA = ("config_id int, alpha double, beta double, trial int, epoch int, is_train boolean, "
              "n bigint, izy double, izx double, acc double, avg_acc double")


def _x_columns(x, trials) -> dict:
    """Input column per split seed: one column for all, or a mapping
    ``{split seed: column}`` (e.g. ids encoded with each trial's own
    vocabulary)."""
    return {t: (x if isinstance(x, str) else x[t]) for t in trials}


def _prepared(data: DataFrame, keys, x, label, trials, test_fraction) -> DataFrame:
    base = data.select(*keys, *dict.fromkeys(_x_columns(x, trials).values()), label)
    for t in trials:
        base = base.withColumn(f"_tr{t}", uniform(t, *keys) >= F.lit(test_fraction))
    return base


def fit_sweep(data: DataFrame, spec: M.VibSpec, configs: Sequence[SweepConfig], key, x="ids",
              label: str = "label", epochs: int = 5, batch_size: int = 50, lr: float = 1e-4,
              seed: int = 0, test_fraction: float = 0.2, n_draws: int = 12,
              max_state_doubles: int = 1 << 23, n_workers: int | None = None, estimator: str = "sampled",
              max_task_doubles: int = 1 << 23, max_shards: int = 64, last_only: bool = False, is_stored: bool = False) -> DataFrame:
    """Train every configuration with a fresh model and a hash split per
    trial (seed = trial), in local-SGD mode: the rows belong to ``n_workers``
    workers by a hash of their key (None: by the number of rows), each worker
    takes Adam steps from the same state, results are averaged by row count.
    ``estimator`` is the divergence trained on for alpha != 1 (see
    ``vib_math``).

    Per epoch: one job trains the whole grid, its tasks keyed by
    (configuration shard, worker), and averages the states block by block in
    levels; one job evaluates it (partial sums per configuration and part), or
    after the last epoch only where no other is asked for (``last_only``).
    Rows stream through Arrow batches, their noise is made in the task; a task
    holds the state of its shard, at most ``max_task_doubles`` (64 MiB) or one
    configuration.  The grid is cut into groups whose state (parameters and two
    Adam moments per configuration) fits in ``max_state_doubles`` (64 MiB) on
    the driver, or of one configuration; each group takes its own passes.  A
    round takes the workers in waves whose states fit 256 MiB of shuffle files,
    which go before the next (:func:`vib.wave_mean`).  Shards and groups change
    no result, waves the rounding of a mean.  ``is_stored``: ``data`` is a materialized
    frame of :func:`vib.stored`.  Returns the runs table (``RUN_SCHEMA``).
    """
    spark = data.sparkSession
    keys = VIB._keys(key)
    trials = sorted({c.split_seed for c in configs})
    columns = list(dict.fromkeys(_x_columns(x, trials).values()))
    base = _prepared(data if is_stored else VIB.stored(data.select(*keys, *columns, label), spec, columns), keys, x, label, trials, test_fraction)
    base = base.withColumn("_k", VIB.key_string(keys))
    if not is_stored:
        base = VIB.materialize(base)
    sampled = any(M.noise_columns(spec, c.alpha, estimator) > spec.latent_dim for c in configs)
    size = M.Layout(spec).size
    per_group = max(1, max_state_doubles // (3 * size))
    all_cfgs = list(configs)
    n_workers = n_workers or VIB.worker_count(base.count())
    workers = VIB.by_worker(base, keys, n_workers, seed).drop(*keys).persist()
    rows = []
    for g0 in range(0, len(all_cfgs), per_group):
        cfgs = all_cfgs[g0:g0 + per_group]
        tasks = -(-spark.sparkContext.defaultParallelism // n_workers)
        n_shards = max(-(-3 * size * len(cfgs) // max_task_doubles), min(tasks, max_shards))
        shards = _cut(cfgs, n_shards)
        rows += _fit_group(base.drop(*keys), workers, spec, shards, x, label, trials, epochs, batch_size,
                           lr, seed, n_draws, sampled, size, estimator, n_workers, last_only)
    workers.unpersist()
    if not is_stored:
        base.unpersist()
    return spark.createDataFrame(rows, RUN_SCHEMA)


def fit_sweep_sequential(data: DataFrame, spec: M.VibSpec, configs: Sequence[SweepConfig], key, x="ids",
                         label: str = "label", epochs: int = 5, batch_size: int = 50, lr: float = 1e-4,
                         seed: int = 0, test_fraction: float = 0.2, n_draws: int = 12, mode: str = "sync",
                         warm_start: bool = False, estimator: str = "sampled") -> DataFrame:
    """Train the configurations one after another with :func:`vib.fit`
    (each on its own hash split, ``seed = split_seed``).  ``warm_start``
    continues every run from the parameters and Adam state the previous run
    left, as one model reused across a whole sweep does (runs are then not
    independent); off by default, every run starts from fresh parameters.
    Returns the runs table (``RUN_SCHEMA``)."""
    spark = data.sparkSession
    keys = VIB._keys(key)
    xcols = _x_columns(x, sorted({c.split_seed for c in configs}))
    params, opt = None, (M.Adam(lr) if warm_start else None)
    rows = []
    for c in configs:
        part = split_hash(data, keys, test_fraction, c.split_seed)
        counts = {r["is_train"]: r["n"] for r in part.groupBy("is_train").agg(F.count(F.lit(1)).alias("n")).collect()}
        cfg = VIB.FitConfig(epochs=epochs, batch_size=batch_size, beta=c.beta, alpha=c.alpha, lr=lr,
                            seed=seed * 100003 + c.config_id, mode=mode, n_draws=n_draws, estimator=estimator)
        start = params if warm_start else None
        params, hist = VIB.fit(part, spec, cfg, keys, xcols[c.split_seed], label, params=start,
                               opt=opt if warm_start else None)
        for h in hist:
            for is_train, name in ((True, "train"), (False, "test")):
                if counts.get(is_train):
                    rows.append((c.config_id, c.alpha, c.beta, c.trial, h["epoch"], is_train, int(counts[is_train]),
                                 h[f"{name}_izy"], h[f"{name}_izx"], h[f"{name}_acc"], h[f"{name}_avg_acc"]))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def _cut(cfgs: list, n_shards: int) -> list[list]:
    """The configurations in at most ``n_shards`` shards of nearly one size."""
    n = min(n_shards, len(cfgs))
    return [cfgs[i * len(cfgs) // n:(i + 1) * len(cfgs) // n] for i in range(n)]


def _for_shards(df: DataFrame, shards: list[list], work, schema) -> DataFrame:
    """``work(shard number)``, a function of Arrow batches, run over the
    (cached) rows for each shard: a task for every shard and partition, and
    nothing is shuffled."""
    out = None
    for i in range(len(shards)):
        one = df.mapInArrow(work(i), schema)
        out = one if out is None else out.unionAll(one)
    return out


def _fit_group(base, by_worker, spec, shards, x, label, trials, epochs, batch_size, lr, seed, n_draws,
               sampled, size, estimator, n_workers, last_only):
    spark = base.sparkSession
    xcols = _x_columns(x, trials)
    zeros = np.zeros(size, dtype=spec.dtype)

    def ship(state_of):
        return [spark.sparkContext.broadcast({c.config_id: state_of(c, i) for c in shard}) for i, shard in enumerate(shards)]

    # the driver keeps no state that is sent
    rows, sent = [], ship(lambda c, i: (M.init_params(spec, seed * 100003 + c.config_id), zeros, zeros, 0))
    for epoch in range(1, epochs + 1):
        def train_shard(i, sent=sent, noise=f"{seed}:{epoch}"):
            cfgs, state_of = shards[i], sent[i]

            def train(batches):
                now, runs, cuts = None, [], {}

                def steps(t, taken):
                    for c, r in zip(cfgs, runs):
                        if c.split_seed == t:
                            for one in taken:
                                r.step(*one)

                def done():
                    for t, cut in cuts.items():
                        steps(t, list(cut.take((), (), (), final=True)))
                    for c, r in zip(cfgs, runs):
                        if r.n:
                            yield from r.pieces(c.config_id, now)

                for w, b in VIB.worker_rows(batches):
                    if w != now:
                        yield from done()
                        now = w
                        runs = [VIB.LocalRun(spec, state_of.value[c.config_id], lr, c.beta, c.alpha, estimator, batch_size) for c in cfgs]
                        cuts = {c.split_seed: VIB.Slices(spec, batch_size) for c in cfgs}
                    Y = b.column(label).to_numpy(zero_copy_only=False)
                    E = VIB.train_noise(noise, b.column("_k"), spec.latent_dim, sampled)
                    for t, cut in cuts.items():
                        sel = b.column(f"_tr{t}").to_numpy(zero_copy_only=False).astype(bool)
                        for taken in cut.some(VIB.stored_inputs(b.column(xcols[t]), spec)[sel], Y[sel], E[sel]):
                            steps(t, taken)
                yield from done()

            return train

        found = VIB.wave_mean(spark, by_worker, lambda rows, train_shard=train_shard: _for_shards(rows, shards, train_shard, VIB.PIECES),
                              spec.dtype, n_workers, 3 * zeros.nbytes * sum(map(len, shards)))
        before = sent
        # what is evaluated is what the next epoch starts from; a run without rows to train on stays as it was
        sent = ship(lambda c, i: found.pop(c.config_id, None) or before[i].value[c.config_id])
        for bc in before:
            bc.destroy()
        if epoch == epochs or not last_only:
            rows += _evaluate_grid(base, spec, shards, sent, x, label, trials, epoch, seed, n_draws)
    for bc in sent:
        bc.destroy()
    return rows


def _evaluate_grid(base, spec, shards, sent, x, label, trials, epoch, seed, n_draws):
    """One pass scoring every configuration on its own split; each task
    emits partial sums per (configuration, part), Spark adds them."""
    xcols = _x_columns(x, trials)
    k = spec.latent_dim
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("config_id", T.IntegerType()), ("is_train", T.BooleanType()), ("n", T.LongType()),
        ("ce", T.DoubleType()), ("dv", T.DoubleType()), ("ok", T.DoubleType()), ("mc_ok", T.DoubleType()))])

    def score_shard(i):
        cfgs, state_of = shards[i], sent[i]

        def score(batches):
            acc: dict = {}
            for b in batches:
                mats = {c: VIB.stored_inputs(b.column(c), spec) for c in {xcols[c.split_seed] for c in cfgs}}
                Y = b.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
                E, EM = VIB.eval_noise(f"{seed}:{epoch}", b.column("_k"), k, n_draws)
                flags = {t: b.column(f"_tr{t}").to_numpy(zero_copy_only=False).astype(bool) for t in trials}
                # chunks bound the memory of a forward pass, whatever the Arrow batch
                for x_of, mat in mats.items():
                    for at, rows in VIB.like_rows(spec, mat):
                        for c in (c for c in cfgs if xcols[c.split_seed] == x_of):
                            r = M.row_metrics(spec, state_of.value[c.config_id][0], rows, Y[at], E[at], EM[at], c.alpha)
                            VIB.add_metrics(acc, r, Y[at], flags[c.split_seed][at], lambda part: (c.config_id, part))
            if acc:
                ks = list(acc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in ks], pa.int32()), pa.array([p for _, p in ks]),
                     pa.array([int(acc[q][0]) for q in ks], pa.int64())]
                    + [pa.array([float(acc[q][i]) for q in ks]) for i in range(1, 5)],
                    names=schema.fieldNames())

        return score

    agg = _for_shards(base, shards, score_shard, schema).groupBy("config_id", "is_train").agg(
        *[F.sum(c).alias(c) for c in ("n", "ce", "dv", "ok", "mc_ok")]).collect()
    by_id = {c.config_id: c for shard in shards for c in shard}
    out = []
    for r in agg:
        if not r["n"]:
            continue
        c = by_id[r["config_id"]]
        n = r["n"]
        izx = r["dv"] / n
        out.append((c.config_id, c.alpha, c.beta, c.trial, epoch, bool(r["is_train"]), int(n),
                    math.log2(spec.out_dim) - r["ce"] / n, izx if math.isfinite(izx) else None,
                    r["ok"] / n, r["mc_ok"] / n))
    return out


def runs_for_summary(runs: DataFrame, metric: str = "avg_acc", config: str = "alpha") -> DataFrame:
    """Adapt a training runs table to the summary operators."""
    return runs.select(F.col(config).cast("string").alias("config"), "trial", "epoch", "is_train",
                       F.col(metric).alias("metric"))


def fit_grid(data: DataFrame, spec: M.VibSpec, configs: Sequence[SweepConfig], key, x="ids", label: str = "label",
             n_draws: int = 12, estimator: str = "sampled", max_bytes: int | None = None, drop_remainder: bool = False,
             last_only: bool = False, **kw) -> DataFrame:
    """The runs table of a grid: each run whole in one task, by sequential
    steps, whatever the number of rows.  Only a caller that sets ``max_bytes``
    asks for local SGD over workers (whose last slices are never dropped)
    where the counted rows take more."""
    from ibex.operators import resident as R

    kw |= {"n_draws": n_draws, "estimator": estimator, "last_only": last_only}
    if max_bytes is None:
        return R.fit_runs(data, spec, configs, key, x, label, drop_remainder=drop_remainder, **kw)
    columns = list(dict.fromkeys(_x_columns(x, {c.split_seed for c in configs}).values()))
    data = VIB.materialize(VIB.stored(data.select(*VIB._keys(key), *columns, label), spec, columns))
    try:
        if R.fits(data.count(), spec, configs, len(columns), kw.get("epochs", 5), n_draws, estimator, max_bytes):
            return R.fit_runs(data, spec, configs, key, x, label, drop_remainder=drop_remainder, is_stored=True, **kw)
        return fit_sweep(data, spec, configs, key, x, label, is_stored=True, **kw)
    finally:
        data.unpersist()


def script_alpha_sweep(data: DataFrame, key, x="ids", label: str = "label", num_words: int = 1000,
                       maxlen: int = 500, **kw) -> DataFrame:
    """The alpha sweep script's grid on encoded text rows: mean and
    population std over trials of the last-epoch Monte Carlo test accuracy
    per alpha.  ``kw`` goes to :func:`fit_grid` (``seed``)."""
    spec = M.text_spec(num_words, maxlen, SCRIPT_ALPHA_UNITS, dtype="float32")
    grid = alpha_trial_grid(SCRIPT_ALPHAS, SCRIPT_ALPHA_TRIALS, SCRIPT_ALPHA_BETA)
    runs = fit_grid(data, spec, grid, key, x, label, epochs=SCRIPT_ALPHA_EPOCHS, batch_size=SCRIPT_BATCH,
                    lr=SCRIPT_LR, last_only=True, **kw)
    return summary_mean_std(runs_for_summary(runs, "avg_acc", "alpha"), is_train=False)


def script_beta_sweep(data: DataFrame, key, x="ids", label: str = "label", num_words: int = 1000,
                      maxlen: int = 500, units: Sequence[int] = SCRIPT_BETA_UNITS, embed_dim: int = 64, lr: float = SCRIPT_LR,
                      **kw) -> DataFrame:
    """The beta sweep script's grid (17 betas, 50 samples, 10 epochs) on
    encoded text rows: mean over samples of the last-epoch one-draw train and
    test accuracy per beta."""
    spec = M.text_spec(num_words, maxlen, units, embed_dim=embed_dim, dtype="float32")
    grid = beta_grid_configs(beta_grid(*SCRIPT_BETA_LOG10), SCRIPT_BETA_SAMPLES, SCRIPT_BETA_ALPHA)
    runs = fit_grid(data, spec, grid, key, x, label, epochs=SCRIPT_BETA_EPOCHS, batch_size=SCRIPT_BATCH, lr=lr, last_only=True, **kw)
    return summary_train_test(runs_for_summary(runs, "acc", "beta"))
