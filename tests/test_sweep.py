"""Sweep summaries on a hand-made runs table: last epoch, population std."""

import math

from ibex.operators import sweep as SW


def test_summaries(spark):
    rows = []
    vals = {}
    for a in ("0.1", "2.0"):
        for t in range(3):
            for e in (1, 2):
                for part in (True, False):
                    v = (t + 1) * 0.1 + e + (0.5 if part else 0.0) + (1.0 if a == "2.0" else 0.0)
                    rows.append((a, t, e, part, v))
                    vals[(a, t, e, part)] = v
    runs = spark.createDataFrame(rows, "config string, trial int, epoch int, is_train boolean, metric double")
    s = {r["config"]: r for r in SW.summary_mean_std(runs).collect()}
    for a in ("0.1", "2.0"):
        last = [vals[(a, t, 2, False)] for t in range(3)]
        mean = sum(last) / 3
        std = math.sqrt(sum((x - mean) ** 2 for x in last) / 3)
        assert abs(s[a]["avg_metric"] - mean) < 1e-12
        assert abs(s[a]["std_metric"] - std) < 1e-12
        assert s[a]["n_trials"] == 3
    tt = {r["config"]: r for r in SW.summary_train_test(runs).collect()}
    assert abs(tt["0.1"]["train_metric"] - sum(vals[("0.1", t, 2, True)] for t in range(3)) / 3) < 1e-12
    wide = SW.history_wide(runs).where("config = '0.1' and trial = 0 and epoch = 1").first()
    assert wide["train_metric"] == vals[("0.1", 0, 1, True)] and wide["test_metric"] == vals[("0.1", 0, 1, False)]


def test_beta_grid():
    g = SW.beta_grid()
    assert len(g) == 17 and abs(g[0] - 1e-6) < 1e-18 and abs(g[-1] - 100.0) < 1e-9
    assert abs(g[8] - 1e-2) < 1e-15


def test_fit_sweep_groups_give_same_runs(spark):
    from conftest import SF_SMALL
    from ibex.operators import vib_math as M
    from ibex.sources import corpus as C

    vec = C.read_vectors(spark, SF_SMALL)
    spec = M.dense_spec(64, units=(4,), out_dim=10)
    grid = SW.alpha_trial_grid([0.5, 2.0], n_trials=2, beta=1e-3)
    size = M.Layout(spec).size
    a = SW.fit_sweep(vec, spec, grid, "vec_id", "features", epochs=1, lr=1e-2)
    b = SW.fit_sweep(vec, spec, grid, "vec_id", "features", epochs=1, lr=1e-2, max_state_doubles=3 * size)
    key = lambda r: (r["config_id"], r["is_train"])
    ra, rb = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(ra) == 8
    for x, y in zip(ra, rb):
        assert x["n"] == y["n"] and abs(x["acc"] - y["acc"]) < 1e-12 and abs(x["izy"] - y["izy"]) < 1e-9


def test_script_presets_on_text(spark, monkeypatch):
    from conftest import SF_SMALL
    from ibex.plans import text as TP
    from ibex.plans.text import TextConfig

    monkeypatch.setattr(SW, "SCRIPT_ALPHA_EPOCHS", 2)  # the full grid, fewer epochs
    cfg = TextConfig(num_words=50, maxlen=20)
    corpus_cfg = TP.corpus_pipeline(spark, SF_SMALL, cfg)[0].select("doc_id", "pos", "ids", "label")
    a = {r["config"]: r for r in SW.script_alpha_sweep(corpus_cfg, ["doc_id", "pos"], num_words=50, maxlen=20)
         .collect()}
    assert sorted(float(k) for k in a) == list(SW.SCRIPT_ALPHAS)
    assert all(r["n_trials"] == SW.SCRIPT_ALPHA_TRIALS and 0 <= r["avg_metric"] <= 1 for r in a.values())
    monkeypatch.setattr(SW, "SCRIPT_BETA_SAMPLES", 2)
    monkeypatch.setattr(SW, "SCRIPT_BETA_EPOCHS", 1)
    b = SW.script_beta_sweep(corpus_cfg, ["doc_id", "pos"], num_words=50, maxlen=20).collect()
    assert len(b) == 17 and all(0 <= r["train_metric"] <= 1 for r in b)


def test_beta_samples_share_one_split(spark):
    from conftest import SF_SMALL
    from ibex.operators import vib_math as M
    from ibex.sources import corpus as C

    vec = C.read_vectors(spark, SF_SMALL)
    spec = M.dense_spec(64, units=(4,), out_dim=10)
    grid = SW.beta_grid_configs([1e-3], n_samples=3)
    runs = SW.fit_sweep(vec, spec, grid, "vec_id", "features", epochs=1, lr=1e-2).collect()
    n_train = {r["trial"]: r["n"] for r in runs if r["is_train"]}
    assert len(n_train) == 3 and len(set(n_train.values())) == 1
    own = SW.fit_sweep(vec, spec, SW.beta_grid_configs([1e-3], 3, split=None), "vec_id", "features",
                       epochs=1, lr=1e-2).collect()
    assert len({r["n"] for r in own if r["is_train"]}) > 1


def test_sequential_sweep_warm_start(spark):
    from conftest import SF_SMALL
    from ibex.operators import vib as VIB
    from ibex.operators import vib_math as M
    from ibex.operators.split import split_hash
    from ibex.sources import corpus as C

    vec = C.read_vectors(spark, SF_SMALL)
    spec = M.dense_spec(64, units=(4,), out_dim=10)
    grid = SW.beta_grid_configs([1e-3, 1e-1], n_samples=1)
    kw = dict(epochs=1, batch_size=50, lr=1e-2)
    fresh = SW.fit_sweep_sequential(vec, spec, grid, "vec_id", "features", **kw)
    warm = SW.fit_sweep_sequential(vec, spec, grid, "vec_id", "features", warm_start=True, **kw)
    key = lambda r: (r["config_id"], r["is_train"])
    f, w = sorted(fresh.collect(), key=key), sorted(warm.collect(), key=key)
    assert len(f) == len(w) == 4
    # an independent run of the second configuration equals the fresh sweep's row
    cfg = VIB.FitConfig(epochs=1, batch_size=50, beta=1e-1, alpha=1.0, lr=1e-2, seed=1, mode="sync")
    _, hist = VIB.fit(split_hash(vec, ["vec_id"], 0.2, 0), spec, cfg, ["vec_id"], "features")
    assert abs(hist[0]["test_acc"] - [r for r in f if r["config_id"] == 1 and not r["is_train"]][0]["acc"]) < 1e-12
    # warm start: the first run is the same, the second continues from it
    assert [r["acc"] for r in f[:2]] == [r["acc"] for r in w[:2]]
    assert any(abs(a["izx"] - b["izx"]) > 1e-9 for a, b in zip(f[2:], w[2:]))
