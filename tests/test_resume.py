"""A fit stopped after any epoch ends with the bits of one never stopped."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from conftest import SF_SMALL
from ibex.operators import params as P
from ibex.operators import split as S
from ibex.operators import vib as VIB
from ibex.operators import vib_math as M
from ibex.sources import corpus as C

SPEC = M.dense_spec(64, units=(4,), out_dim=10)


def fit(spark, cfg, **kw):
    opt = M.Adam(cfg.lr)
    params, history = VIB.fit(S.split_hash(C.read_vectors(spark, SF_SMALL), "vec_id"), kw.pop("spec", SPEC), cfg, "vec_id", "features",
                              opt=opt, **kw)
    return params, history, opt


@pytest.mark.parametrize("mode", ["average", "sync"])
def test_stopped_after_any_epoch(spark, tmp_path, mode):
    cfg = VIB.FitConfig(epochs=4, batch_size=50, lr=1e-2, mode=mode, alpha=2.0, izx_estimator="closed", n_draws=2)
    whole, history, opt = fit(spark, cfg)
    for stop in (1, 3):
        path = str(tmp_path / f"{mode}{stop}")
        fit(spark, replace(cfg, epochs=stop, checkpoint_path=path))
        params, told, end = fit(spark, replace(cfg, checkpoint_path=path), resume=True)
        assert np.array_equal(params, whole) and end.t == opt.t
        assert np.array_equal(end.m, opt.m) and np.array_equal(end.v, opt.v)
        assert [h["epoch"] for h in told] == [1, 2, 3, 4]
        assert [h["test_acc"] for h in told] == [h["test_acc"] for h in history]


def test_an_epoch_without_its_commit_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ck")
    cfg = VIB.FitConfig(epochs=2, batch_size=50, lr=1e-2, mode="average", checkpoint_path=path, n_draws=2)
    whole, _, _ = fit(spark, replace(cfg, checkpoint_path=None))
    # stopped in the second epoch, after some of its tables
    save, done = P.save_params, []

    def breaks(spark, spec, flat, to):
        if "epoch=2/" in to and to.endswith("-v"):
            raise RuntimeError("stopped")
        done.append(to)
        save(spark, spec, flat, to)

    monkeypatch.setattr(P, "save_params", breaks)
    with pytest.raises(RuntimeError, match="stopped"):
        fit(spark, cfg)
    monkeypatch.undo()
    assert any("epoch=2/" in d for d in done)
    settings = VIB._settings(SPEC, cfg, ["vec_id"], "features", "label", "is_train", 8)
    assert P.last_epoch(spark, path, SPEC, settings)[0] == 1
    params, history, _ = fit(spark, cfg, resume=True)
    assert np.array_equal(params, whole) and len(history) == 2
    # nothing left to do
    again, history, _ = fit(spark, cfg, resume=True)
    assert np.array_equal(again, whole) and len(history) == 2


def test_other_settings_and_missing_checkpoints(spark, tmp_path):
    path = str(tmp_path / "ck")
    cfg = VIB.FitConfig(epochs=1, batch_size=50, lr=1e-2, mode="average", checkpoint_path=path, n_draws=2)
    first, _, _ = fit(spark, cfg, resume=True)  # nothing there yet: from the start
    with pytest.raises(ValueError, match="batch_size"):
        fit(spark, replace(cfg, batch_size=20), resume=True)
    with pytest.raises(ValueError, match="spec"):
        fit(spark, cfg, resume=True, spec=M.dense_spec(64, units=(5,), out_dim=10))
    with pytest.raises(ValueError, match="checkpoint_path"):
        fit(spark, replace(cfg, checkpoint_path=None), resume=True)
    half = M.dense_spec(64, units=(4,), out_dim=10, dtype="float32")
    there = replace(cfg, checkpoint_path=path + "32")
    a, _, _ = fit(spark, there, spec=half)
    b, _, _ = fit(spark, there, spec=half, resume=True)
    assert a.dtype == b.dtype == np.float32 and np.array_equal(a, b)
