"""Training over many tasks: sampled divergence in two passes, workers placed
by number, sums in levels, grids sharded by configuration."""

from __future__ import annotations

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from ibex.operators import resident as R
from ibex.operators import split as S
from ibex.operators import sweep as SW
from ibex.operators import vib as VIB
from ibex.operators import vib_math as M
from ibex.sources import corpus as C

SPEC = M.dense_spec(64, units=(6,), out_dim=10)


def vectors(spark, folder=SF_SMALL):
    return S.split_hash(C.read_vectors(spark, folder), "vec_id")


@pytest.mark.parametrize("alpha", [0.5, 2.0, 5.0, math.inf])
def test_sampled_gradient_over_many_tasks_equals_one(spark, alpha):
    p = M.init_params(SPEC, 1)
    vec = VIB.with_noise(vectors(spark), "vec_id", SPEC.latent_dim, "0:1", 0, "train", True)
    pdf = vec.select("features", "label", "eps").toPandas()
    x, e = (np.stack(pdf[c].map(np.asarray).values) for c in ("features", "eps"))
    want, _, dv, n = M.loss_and_grad(SPEC, p, x, pdf["label"].values, e, 0.3, alpha, len(x), "sampled")
    for parts in (1, 3, 16):
        rows, got = VIB.batch_gradient(vec.repartition(parts), SPEC, p, "features", "label", 0.3, alpha)
        assert rows == n and np.allclose(got, want, rtol=1e-9, atol=1e-12)
    # the divergence itself, from the two numbers that travel
    _, (top, total) = VIB.batch_log_sum(vec.repartition(5), SPEC, p, "features", "label", alpha)
    value = top if math.isinf(alpha) else (top + math.log(total)) / (alpha - 1.0)
    assert abs(value * n / math.log(2) - dv) < 1e-8
    assert VIB.batch_gradient(vec.limit(0), SPEC, p, "features", "label", 0.3, alpha) == (0, None)


def test_log_sums_of_parts_and_ties():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(50, 2)) * 40
    for alpha in (0.5, 3.0):
        whole = M.log_sum(d, alpha)
        top, total = M.add_log_sums([M.log_sum(d[:7], alpha), (-math.inf, 0.0), M.log_sum(d[7:], alpha)], alpha)
        assert top == whole[0] and abs(total / whole[1] - 1) < 1e-12
    d[3, 0] = d[40, 1] = d.max() + 1
    assert M.add_log_sums([M.log_sum(d[:20], math.inf), M.log_sum(d[20:], math.inf)], math.inf) == (d.max(), 2.0)
    assert M.add_log_sums([], 2.0) == (-math.inf, 0.0)


@pytest.mark.parametrize("alpha", [2.0, math.inf])
def test_sync_fit_of_large_batches_with_sampled_divergence(spark, monkeypatch, alpha):
    cfg = VIB.FitConfig(epochs=1, batch_size=200, lr=1e-2, mode="sync", alpha=alpha, izx_estimator="closed" if alpha == 2.0 else "reference")
    one, _ = VIB.fit(vectors(spark), SPEC, cfg, "vec_id", "features")
    monkeypatch.setattr(VIB, "SYNC_ROWS_PER_TASK", 16)
    many, _ = VIB.fit(vectors(spark), SPEC, cfg, "vec_id", "features")
    assert np.allclose(one, many, atol=1e-9)


@pytest.mark.parametrize("n", [1, 8, 256])
def test_a_worker_is_a_partition(spark, n):
    df = spark.range(20000).withColumnRenamed("id", "vec_id").repartition(7)
    laid = VIB.by_worker(df, ["vec_id"], n, 0)
    assert laid.rdd.getNumPartitions() == n
    rows = laid.groupBy("_w", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r._w, r.p) for r in rows) == [(i, i) for i in range(n)] and sum(r.n for r in rows) == 20000
    assert max(r.n for r in rows) < 2 * 20000 / n + 50


def test_sums_in_levels_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(0)
    blobs = [rng.normal(size=300) for _ in range(200)]
    rows = [(4, w, w % 3 + 1, bytearray(v.tobytes())) for w, v in enumerate(blobs)]
    frame = spark.createDataFrame(rows, VIB.PARTS)
    got = [VIB.worker_sum(frame.repartition(k), block=64, n_workers=200)[4] for k in (1, 5, 11)]
    assert got[0][0] == sum(w % 3 + 1 for w in range(200))
    assert np.allclose(got[0][1], np.sum(blobs, axis=0), atol=1e-9)
    assert all(np.array_equal(g[1], got[0][1]) for g in got)
    # each level adds neighbours, in order
    firsts = [np.sum([0.0]) + blobs[a] for a in range(0, 200, VIB.SUM_FAN_IN)]
    for k, a in enumerate(range(0, 200, VIB.SUM_FAN_IN)):
        for w in range(a + 1, min(a + VIB.SUM_FAN_IN, 200)):
            firsts[k] = firsts[k] + blobs[w]
    total = firsts[0]
    for f in firsts[1:]:
        total = total + f
    assert np.array_equal(total, got[0][1])


def test_fit_with_256_workers(spark):
    cfg = VIB.FitConfig(epochs=2, batch_size=4, lr=1e-2, mode="average", n_workers=256, n_draws=2)
    a, ha = VIB.fit(vectors(spark, SF_CHECK).repartition(3), SPEC, cfg, "vec_id", "features")
    b, hb = VIB.fit(vectors(spark, SF_CHECK).repartition(11), SPEC, cfg, "vec_id", "features")
    assert np.array_equal(a, b) and ha[-1]["test_acc"] == hb[-1]["test_acc"]


def test_workers_follow_the_rows_alone():
    assert VIB.worker_count(0) == VIB.worker_count(1000) == 8
    assert VIB.worker_count(10**9) == -(-10**9 // (1 << 16))


ON_CORES = """
import hashlib, sys
sys.path[:0] = [{root!r}, {tests!r}]
from ibex.session import local_session
spark = local_session({cores}, shuffle_partitions={cores})
from test_scale_training import SPEC, vectors
from ibex.operators import vib as VIB
cfg = VIB.FitConfig(epochs=2, batch_size=10, lr=1e-2, mode="average", n_workers=16, n_draws=2, alpha=2.0)
params, history = VIB.fit(vectors(spark), SPEC, cfg, "vec_id", "features")
print("RESULT", hashlib.sha256(params.tobytes()).hexdigest(), history[-1]["test_acc"], history[-1]["train_avg_acc"])
"""


def test_equal_results_on_two_four_and_eight_cores():
    tests = os.path.dirname(os.path.abspath(__file__))
    seen = set()
    for cores in (2, 4, 8):
        code = ON_CORES.format(root=os.path.dirname(tests), tests=tests, cores=cores)
        env = {**os.environ, "IBEX_DRIVER_MEMORY": "2g"}
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env).stdout
        seen.add(next(line for line in out.splitlines() if line.startswith("RESULT")))
    assert len(seen) == 1


def by_id(runs):
    return sorted((r.asDict() for r in runs.collect()), key=lambda r: (r["config_id"], r["epoch"], r["is_train"]))


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [x[c] for c in ("config_id", "trial", "epoch", "is_train", "n", "acc", "avg_acc")] == \
               [y[c] for c in ("config_id", "trial", "epoch", "is_train", "n", "acc", "avg_acc")]
        assert abs(x["izy"] - y["izy"]) < 1e-9 and abs((x["izx"] or 0) - (y["izx"] or 0)) < 1e-9


GRID = SW.alpha_trial_grid([0.5, 1.0, 2.0], n_trials=2, beta=1e-3)


def test_shards_of_any_size_give_the_same_runs(spark):
    vec = C.read_vectors(spark, SF_SMALL)
    size = M.Layout(SPEC).size
    runs = [by_id(SW.fit_sweep(vec, SPEC, GRID, "vec_id", "features", epochs=2, lr=1e-2, n_workers=3, **kw))
            for kw in ({"max_task_doubles": 3 * size}, {"max_task_doubles": 1 << 24, "max_shards": 1}, {"max_state_doubles": 6 * size})]
    assert len(runs[0]) == len(GRID) * 2 * 2
    same(runs[0], runs[1])
    same(runs[0], runs[2])


def test_runs_whole_in_one_task_equal_the_sweep_with_one_worker(spark):
    vec = C.read_vectors(spark, SF_SMALL)
    kw = {"epochs": 3, "lr": 1e-2, "batch_size": 30}
    whole = by_id(R.fit_runs(vec.repartition(5), SPEC, GRID, "vec_id", "features", **kw))
    same(whole, by_id(SW.fit_sweep(vec, SPEC, GRID, "vec_id", "features", n_workers=1, **kw)))
    assert whole[-1]["izy"] > whole[0]["izy"]


def test_rows_beyond_the_bound_are_dealt_to_workers(spark):
    vec = C.read_vectors(spark, SF_SMALL)
    with pytest.raises(ValueError):
        R.fit_runs(vec, SPEC, GRID[:1], "vec_id", "features", epochs=1, max_bytes=1000)
    same(by_id(SW.fit_grid(vec, SPEC, GRID[:2], "vec_id", "features", epochs=1, lr=1e-2, max_bytes=1000)),
         by_id(SW.fit_sweep(vec, SPEC, GRID[:2], "vec_id", "features", epochs=1, lr=1e-2)))


def test_half_width_floats_follow_the_wide_ones():
    rng = np.random.default_rng(3)
    x, y, e = rng.integers(0, 50, (20, 30)), rng.integers(0, 2, 20), rng.normal(size=(20, 2))
    wide = M.text_spec(50, 30, (8,), embed_dim=4)
    half = M.text_spec(50, 30, (8,), embed_dim=4, dtype="float32")
    p = M.init_params(wide, 1)
    g, ce, dv, _ = M.loss_and_grad(wide, p, x, y, e, 0.1, 1.0, 20)
    h, ce32, dv32, _ = M.loss_and_grad(half, p.astype(np.float32), x, y, e, 0.1, 1.0, 20)
    assert h.dtype == np.float32 and np.allclose(g, h, atol=1e-5) and abs(ce - ce32) < 1e-4 and abs(dv - dv32) < 1e-4
    assert M.Adam(1e-2).step(p.astype(np.float32), h).dtype == np.float32


def test_the_last_epoch_alone_is_the_last_of_all(spark):
    vec = C.read_vectors(spark, SF_SMALL)
    kw = {"epochs": 3, "lr": 1e-2, "batch_size": 30, "drop_remainder": True}
    every = by_id(R.fit_runs(vec, SPEC, GRID[:2], "vec_id", "features", **kw))
    last = by_id(R.fit_runs(vec, SPEC, GRID[:2], "vec_id", "features", last_only=True, **kw))
    same([r for r in every if r["epoch"] == 3], last)
