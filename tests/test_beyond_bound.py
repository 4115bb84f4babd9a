"""Fits and sweeps on rows beyond the bound of a broadcast: what is stored, what
is made in the task and what the driver and a task hold of a grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ibex.functions.hashing import gaussian_array
from ibex.operators import resident as R
from ibex.operators import split as S
from ibex.operators import sweep as SW
from ibex.operators import vib as VIB
from ibex.operators import vib_math as M
from ibex.operators.draws import draws
from ibex.plans import queries as Q
from ibex.sources import corpus as C


def history(rows, epochs):
    assert sorted(r["Epoch"] for r in rows) == list(range(1, epochs + 1))
    assert all(0 <= r[c] <= 1 for r in rows for c in ("TrainAcc", "TrainAvgAcc", "TestAcc", "TestAvgAcc"))
    assert all(np.isfinite(r[c]) for r in rows for c in ("TrainIZY", "TrainIZX", "TestIZY", "TestIZX"))


def test_image_fit_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(R, "fits", lambda *a, **kw: False)
    monkeypatch.setattr(Q, "IMAGE_EPOCHS", 3)
    history(Q.QUERIES["fit_image_history"](spark, SF_SMALL).collect(), 3)


def test_text_fit_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(R, "fits", lambda *a, **kw: False)
    monkeypatch.setattr(SW, "SCRIPT_ALPHA_UNITS", (4,))
    history(Q.QUERIES["fit_text_script"](spark, SF_SMALL).collect(), 25)


def groups(spark, monkeypatch, spec, grid):
    """Sizes of the groups of a grid, and of their largest shard, in bytes of state."""
    seen = []
    one = 3 * M.Layout(spec).size * np.dtype(spec.dtype).itemsize
    monkeypatch.setattr(SW, "_fit_group", lambda base, workers, spec, shards, *a, **kw: seen.append([len(s) * one for s in shards]) or [])
    rows = spark.range(20).select(F.col("id").alias("k"), F.array_repeat(F.lit(3), spec.seq_len).alias("ids"), F.lit(1).alias("label"))
    SW.fit_sweep(rows, spec, grid, "k")
    assert sum(map(sum, seen)) == one * len(grid)
    return one, [sum(g) for g in seen], max(map(max, seen))


def test_the_driver_holds_one_large_model_of_a_grid(spark, monkeypatch):
    spec = M.text_spec(1000, 500, SW.SCRIPT_ALPHA_UNITS, dtype="float32")
    one, held, _ = groups(spark, monkeypatch, spec, SW.alpha_trial_grid(SW.SCRIPT_ALPHAS, SW.SCRIPT_ALPHA_TRIALS, 1e-4))
    assert max(held) <= max(one, 64 << 20)


def test_a_task_and_a_round_of_a_large_grid_are_bounded(spark, monkeypatch):
    spec = M.text_spec(1000, 500, (16, 8, 4), embed_dim=8, dtype="float32")
    grid = SW.beta_grid_configs(SW.beta_grid(), SW.SCRIPT_BETA_SAMPLES)
    _, held, most = groups(spark, monkeypatch, spec, grid)
    assert len(grid) == 850 and max(held) <= 64 << 20 and most <= 64 << 20


def test_noise_of_a_task_is_that_of_the_columns(spark):
    rows = spark.range(30).select(F.col("id").alias("a"), (F.col("id") % 4).alias("b")).withColumn("_k", VIB.key_string(["a", "b"]))
    both = VIB.with_noise(VIB.with_noise(rows, ["a", "b"], 2, "0:3", 0, "train", True).withColumnRenamed("eps", "t"), ["a", "b"], 2, "0:3", 5).toArrow()
    key = both.column("_k").combine_chunks()
    eps, mc = VIB.eval_noise("0:3", key, 2, 5)
    for name, got in (("t", VIB.train_noise("0:3", key, 2, True)), ("eps", eps), ("eps_mc", mc.reshape(30, 10))):
        assert np.allclose(np.array(both.column(name).to_pylist()), got, rtol=1e-12, atol=1e-14)


@pytest.mark.parametrize("vocab", [100, 70000])
def test_stored_ids_have_no_padding_and_come_back(spark, vocab):
    spec = M.text_spec(vocab, 6, (4,))
    ids = [[5, 0, 7, 0, 0, 0], [0] * 6, [1, 2, 3, 4, 5, vocab - 1]]
    kept = VIB.stored(spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "k int, ids array<int>").coalesce(1), spec, ["ids"]).toArrow()
    assert [len(v) for v in kept.column("ids").to_pylist()] == [3, 0, 6]
    assert VIB.stored_inputs(kept.column("ids"), spec).tolist() == ids
    with pytest.raises(Exception, match="exactly 6 values"):
        VIB.stored(spark.createDataFrame([(0, [1, 2])], "k int, ids array<int>"), spec, ["ids"]).collect()


def test_a_fit_is_evaluated_by_sums(spark, monkeypatch):
    vec, spec = S.split_hash(C.read_vectors(spark, SF_SMALL), "vec_id"), M.dense_spec(64, units=(6,), out_dim=10)
    cfg = VIB.FitConfig(epochs=2, batch_size=20, lr=1e-2, mode="average", n_draws=4)
    by_rows = VIB.evaluate(vec, spec, VIB.fit(vec, spec, cfg, "vec_id", "features")[0], "vec_id", "features", seed="0:2", n_draws=4).collect()
    monkeypatch.setattr(VIB, "score", None)  # no row leaves its task
    last = VIB.fit(vec, spec, cfg, "vec_id", "features")[1][-1]
    for r in by_rows:
        for m in ("izy", "izx", "acc", "avg_acc"):
            assert abs(last[f"{'train' if r['is_train'] else 'test'}_{m}"] - r[m]) < 1e-9


def test_a_run_keeps_no_batch_behind_its_last_rows():
    spec = M.text_spec(50, 40, (4,), dtype="float32")
    start = M.init_params(spec, 1)
    run = VIB.LocalRun(spec, (start, np.zeros_like(start), np.zeros_like(start), 0), 1e-3, 1e-3, 1.0, "sampled", 50)
    run.feed(np.ones((2049, 40), dtype=np.int16), np.ones(2049, dtype=np.int64), np.zeros((2049, 2)))
    assert [len(a) for a in run.pending[0]] == [49] * 3
    assert all(a.base is None for a in run.pending[0])


def test_large_states_are_averaged_in_waves(spark, monkeypatch):
    """A wave's states fit the bound, results are those of one wave."""
    spec = M.text_spec(1000, 500, SW.SCRIPT_ALPHA_UNITS, dtype="float32")
    one = 3 * M.Layout(spec).size * 4
    cuts = VIB.waves(8, one)
    assert [w for a, b in cuts for w in range(a, b)] == list(range(8)) and max(b - a for a, b in cuts) * one <= VIB.WAVE_BYTES
    vec, small = C.read_vectors(spark, SF_SMALL), M.dense_spec(64, units=(6,), out_dim=10)
    grid = SW.beta_grid_configs([1e-3, 1e-1], 1)
    kw = {"epochs": 2, "lr": 1e-2, "n_workers": 5, "n_draws": 4}
    whole = SW.fit_sweep(vec, small, grid, "vec_id", "features", **kw).orderBy("config_id", "epoch", "is_train").collect()
    taken = []
    mean = VIB.worker_mean
    monkeypatch.setattr(VIB, "worker_mean", lambda *a: taken.append(1) or mean(*a))
    monkeypatch.setattr(VIB, "WAVE_BYTES", 2 * 2 * 3 * M.Layout(small).size * 8)
    parts = SW.fit_sweep(vec, small, grid, "vec_id", "features", **kw).orderBy("config_id", "epoch", "is_train").collect()
    assert len(taken) == 2 * 3
    assert np.allclose([list(map(float, r)) for r in whole], [list(map(float, r)) for r in parts], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("n", [1, 12])
def test_draws_of_keys_of_any_length(spark, n):
    keys = ["", "7", "12:3", "é:5", "x" * 41, "y" * 46, "z" * 47, "w" * 150] + [str(i ** 5) for i in range(40)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    want = [r["g"] for r in df.withColumn("g", gaussian_array("3:2:eval", "k", n)).orderBy("i").collect()]
    assert np.allclose(draws("3:2:eval", pa.array(["off", *keys])[1:], n), want, rtol=1e-12, atol=1e-14)


def test_a_run_without_rows_to_train_on_stays_as_it_was(spark):
    spec = M.dense_spec(3, units=(2,), out_dim=2)
    rows = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1)], "k int, features array<double>, label int")
    grid = [SW.SweepConfig(i, 1.0, 1e-3, i) for i in range(12)]
    runs = SW.fit_sweep(rows, spec, grid, "k", "features", epochs=2, n_draws=2).collect()
    assert sorted((r["config_id"], r["epoch"]) for r in runs) == [(i, e) for i in range(12) for e in (1, 2)]
    assert {r["is_train"] for r in runs} == {True, False}


def test_a_grid_takes_the_same_steps_on_any_number_of_rows(spark, monkeypatch):
    """Sequential steps, whatever size the rows are said to have; packs, files
    and groups of runs change nothing."""
    vec, spec = C.read_vectors(spark, SF_SMALL), M.dense_spec(64, units=(6,), out_dim=10)
    grid = SW.alpha_trial_grid([0.5, 1.0], n_trials=2, beta=1e-3)
    kw = {"epochs": 2, "lr": 1e-2, "batch_size": 30, "n_draws": 4}

    def rows(runs):
        return [list(map(float, r)) for r in runs.orderBy("config_id", "epoch", "is_train").collect()]

    one_worker = rows(SW.fit_sweep(vec, spec, grid, "vec_id", "features", n_workers=1, **kw))
    monkeypatch.setattr(R, "fits", lambda *a, **b: False)
    assert np.allclose(rows(SW.fit_grid(vec, spec, grid, "vec_id", "features", **kw)), one_worker, rtol=1e-9, atol=1e-12)
    whole = rows(R.fit_runs(vec, spec, grid, "vec_id", "features", **kw))
    for name, value in (("PACK_ROWS", 7), ("SPOOL_BYTES", 100), ("TOGETHER_BYTES", 0)):
        monkeypatch.setattr(R, name, value)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert np.allclose(rows(R.fit_runs(vec.repartition(5), spec, grid, "vec_id", "features", **kw)), whole, rtol=1e-9, atol=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)


def test_a_grid_without_rows_has_no_runs(spark):
    vec, spec = C.read_vectors(spark, SF_SMALL).limit(0), M.dense_spec(64, units=(6,), out_dim=10)
    assert SW.fit_grid(vec, spec, SW.beta_grid_configs([1e-3], 2), "vec_id", "features", epochs=1).collect() == []


def long_tailed(n=60, width=90, vocab=40):
    rng = np.random.default_rng(5)
    lens = np.minimum(rng.geometric(0.06, n), width)
    lens[:3] = (0, width - 7, 1)
    x = rng.integers(0, vocab, (n, width)) * (np.arange(width) < lens[:, None])
    return x, rng.integers(0, 2, n), rng.normal(size=(n, 2))


@pytest.mark.parametrize("units", [(6, 3), ()])
def test_rows_of_ids_are_multiplied_in_their_own_cells(units):
    x, y, eps = long_tailed()
    spec = M.text_spec(40, 90, units, embed_dim=4)
    rows = M.IdRows(spec, x)
    assert len(rows.cells) < 0.5 * x.size and rows.columns == M.id_lengths(x).max()
    # the same rows as numbers: no cell is left out
    p = M.init_params(spec, 1)
    at, shape = M.layout_of(spec).offsets["embed"]
    flat = p[at:at + 160].reshape(shape)[x].reshape(len(x), -1)
    dense = M.dense_spec(360, units, 2, transform="none")
    want = M.loss_and_grad(dense, p[160:], flat, y, eps, 0.1, 1.0, len(x))
    got = M.loss_and_grad(spec, p, rows, y, eps, 0.1, 1.0, len(x))
    assert np.allclose(got[0][160:], want[0], rtol=1e-10, atol=1e-14) and np.allclose(got[1:3], want[1:3])


def test_weights_are_updated_while_their_gradient_is_taken(monkeypatch):
    """The steps of a run are those of whole gradients, whatever the pieces."""
    x, y, eps = long_tailed()
    spec = M.text_spec(40, 90, (6, 3), embed_dim=4)
    p, adam = M.init_params(spec, 1), M.Adam(1e-2)
    for at in (slice(0, 25), slice(25, 50), slice(50, 60)):
        p = adam.step(p, M.loss_and_grad(spec, p, x[at], y[at], eps[at], 0.1, 1.0, len(x[at]), "sampled")[0])
    monkeypatch.setattr(M, "ADAM_BLOCK", 100)
    start = M.init_params(spec, 1)
    run = VIB.LocalRun(spec, (start, np.zeros_like(start), np.zeros_like(start), 0), 1e-2, 0.1, 1.0, "sampled", 25)
    run.feed(x, y, eps)
    run.finish()
    assert run.opt.t == 3 and all(np.allclose(a, b, rtol=1e-9, atol=1e-13) for a, b in ((run.p, p), (run.opt.m, adam.m), (run.opt.v, adam.v)))


def test_packed_rows_come_back(spark):
    rows = spark.range(9000).selectExpr("id AS k", "id % 3 = 0 AS is_train", "cast(id % 4 AS int) AS _w", "array(id, id + 1) AS x").repartitionById(4, "_w")
    packs = VIB.packed(rows, "is_train", True)
    assert packs.agg(F.sum("n_train")).first()[0] == 3000
    back = packs.mapInArrow(lambda batches: (b.append_column("w", pa.array([w] * len(b), pa.int32())) for w, b in VIB.unpacked(batches)),
                            "k long, is_train boolean, _w int, x array<long>, w int").collect()
    assert sorted(r["k"] for r in back) == list(range(9000)) and all(r["w"] == r["_w"] == r["k"] % 4 and r["x"] == [r["k"], r["k"] + 1] for r in back)
