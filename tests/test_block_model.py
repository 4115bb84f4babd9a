"""The model as a table of blocks: the bits of the training on arrays."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import SF_SMALL
from ibex.operators import block_model as B
from ibex.operators import split as S
from ibex.operators import vib as VIB
from ibex.operators import vib_math as M
from ibex.sources import corpus as C

SPEC = M.dense_spec(64, units=(6,), out_dim=10)
SIZE = M.Layout(SPEC).size


def vectors(spark):
    return S.split_hash(C.read_vectors(spark, SF_SMALL), "vec_id")


def flat(state, column="p"):
    return np.concatenate([np.frombuffer(bytes(r[column]), np.float64) for r in sorted(state.collect(), key=lambda r: r.block)])


def test_blocks_of_the_first_state(spark):
    text = M.text_spec(50, 7, units=(5, 3), embed_dim=3)
    for spec in (SPEC, text):
        size = M.Layout(spec).size
        want = M.init_params(spec, scheme="formula")
        for block in (7, 100, 10**6):
            got = [B.block_values(spec, a, min(a + block, size), scheme="formula") for a in range(0, size, block)]
            assert np.array_equal(np.concatenate(got), want)
    drawn = flat(B.init_state(spark, text, seed=3, block=40))
    again = flat(B.init_state(spark, text, seed=3, block=40).repartition(5))
    assert np.array_equal(drawn, again) and not np.array_equal(drawn, flat(B.init_state(spark, text, seed=4, block=40)))
    big = M.text_spec(200, 20, units=(40, 30), embed_dim=8)
    values = np.concatenate([B.block_values(big, a, min(a + 999, M.Layout(big).size), 5) for a in range(0, M.Layout(big).size, 999)])
    views, same = M.Layout(big).views(values), M.Layout(big).views(M.init_params(big, 0))
    for name, values in views.items():
        if name.endswith(".b"):
            assert not values.any()
        elif values.size > 500:
            assert abs(values.std() / same[name].std() - 1) < 0.1 and abs(np.abs(values).max() / np.abs(same[name]).max() - 1) < 0.05


def test_adam_steps_have_the_bits_of_the_array(spark):
    rng = np.random.default_rng(0)
    params, opt = M.init_params(SPEC, 1), M.Adam(1e-2)
    state = B.state_frame(spark, params, block=100)
    for _ in range(3):
        g = rng.normal(size=SIZE)
        params = opt.step(params, g)
        grads = spark.createDataFrame([(i, bytearray(g[a:a + 100].tobytes())) for i, a in enumerate(range(0, SIZE, 100))],
                                      "block int, g binary")
        state = B._kept(B.adam_step(state, grads, lr=1e-2))
        assert np.array_equal(flat(state), params)
    assert np.array_equal(flat(state, "m"), opt.m) and np.array_equal(flat(state, "v"), opt.v)
    assert {r.t for r in state.collect()} == {3}


@pytest.mark.parametrize("alpha", [1.0, 0.5, math.inf])
def test_gradient_equals_one_task(spark, alpha):
    params = M.init_params(SPEC, 1)
    sampled = alpha != 1.0
    noisy = VIB.with_noise(vectors(spark), "vec_id", 2, "0:1", 0, "train", sampled)
    pdf = noisy.select("features", "label", "eps").toPandas()
    x, e = (np.stack(pdf[c].map(np.asarray).values) for c in ("features", "eps"))
    want, _, _, n = M.loss_and_grad(SPEC, params, x, pdf["label"].values, e, 0.3, alpha, len(x), "sampled")
    rows = B.worker_rows(noisy, ["vec_id"], 40)
    got = B.gradient(rows, B.state_frame(spark, params, block=64), SPEC, 40, "features", "label", 0.3, alpha, block=64)
    assert {r.n for r in got.collect()} == {n}
    assert np.allclose(flat(got, "g"), want, rtol=1e-9, atol=1e-12)


def test_fit_has_the_numbers_of_the_fit_on_arrays(spark):
    cfg = VIB.FitConfig(epochs=2, batch_size=20, lr=1e-2, mode="average", n_workers=5, n_draws=3, beta=1e-3)
    params, history = VIB.fit(vectors(spark), SPEC, cfg, "vec_id", "features")
    start = B.state_frame(spark, M.init_params(SPEC, cfg.seed), block=128)
    state, told = B.fit(vectors(spark).repartition(3), SPEC, cfg, "vec_id", "features", state=start, block=128)
    assert np.array_equal(flat(state), params)
    for a, b in zip(history, told):
        assert a["epoch"] == b["epoch"] and a["test_acc"] == b["test_acc"] and a["train_avg_acc"] == b["train_avg_acc"]
        assert abs(a["train_izy"] - b["train_izy"]) < 1e-9 and abs(a["test_izx"] - b["test_izx"]) < 1e-9
    with pytest.raises(ValueError):
        B.fit(vectors(spark), SPEC, VIB.FitConfig(mode="sync"), "vec_id", "features")


def test_values_are_named_on_the_executors(spark):
    params = M.init_params(SPEC, 2)
    got = {(r.param, r.i): r.value for r in B.state_values(B.state_frame(spark, params, block=33), SPEC, block=33).collect()}
    want = {(k, i): v for k, a in M.Layout(SPEC).views(params).items() for i, v in enumerate(a.reshape(-1).tolist())}
    assert got == want


def test_only_the_model_moves_in_an_epoch(spark):
    """The cached rows of a worker are in one partition already."""
    rows = B.worker_rows(vectors(spark), ["vec_id"], 6).persist()
    rows.count()
    noisy = VIB.with_noise(rows, "vec_id", 2, "0:1", 0, "train")
    state = B._kept(B.state_frame(spark, M.init_params(SPEC, 1), block=512))
    plan = B._meet(noisy, state, 6, lambda w, mine, blocks: [(w,)], "w int")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.split("InMemoryTableScan")[0].count("Exchange") <= 1, shown
    assert sorted(r.w for r in plan.collect()) == list(range(6))
    rows.unpersist()
