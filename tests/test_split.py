"""Split and batch assignment: exact sizes, brute-force agreement, stability."""

import hashlib
import math

from pyspark.sql import functions as F

from ibex.operators import split as S


def _h(seed, *parts):
    s = ":".join([str(seed)] + [str(p) for p in parts])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def test_split_hash_matches_python_and_is_stable(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    a = S.split_hash(df, "k", 0.2, seed=3)
    b = S.split_hash(df.repartition(7), "k", 0.2, seed=3)
    ga = {r["k"]: r["is_train"] for r in a.collect()}
    gb = {r["k"]: r["is_train"] for r in b.collect()}
    assert ga == gb
    assert all(ga[k] == (_h(3, k) / 2 ** 32 >= 0.2) for k in range(3000))
    share = sum(not v for v in ga.values()) / 3000
    assert 0.17 < share < 0.23


def test_split_exact_equals_brute_force(spark):
    rows = [(d, p) for d in range(400) for p in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, pos int").repartition(5)
    got = {(r["doc_id"], r["pos"]): r["is_train"] for r in S.split_exact(df, ["doc_id", "pos"], 0.2, 1).collect()}
    order = sorted(rows, key=lambda r: (_h(1, *r), r[0], r[1]))
    n_test = math.ceil(0.2 * len(rows))
    want = {r: i >= n_test for i, r in enumerate(order)}
    assert got == want
    assert sum(not v for v in got.values()) == n_test


def test_split_trials_independent(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    t = S.split_trials(df, "k", 3, 0.2).select("k", "is_train_trials").collect()
    for trial in range(3):
        for r in t[:50]:
            assert r["is_train_trials"][trial] == (_h(trial, r["k"]) / 2 ** 32 >= 0.2)
    assert any(len(set(r["is_train_trials"])) > 1 for r in t)


def test_minibatch_ids_balanced(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    b, n = S.minibatch_ids(df, "k", 50, 5000)
    assert n == 100
    sizes = [r["count"] for r in b.groupBy("batch").count().collect()]
    assert len(sizes) == 100 and sum(sizes) == 5000
    assert max(sizes) < 90 and min(sizes) > 20


def test_split_exact_refined_boundary_equals_brute_force(spark, monkeypatch):
    # every boundary bucket counts as large: the low-bit histogram picks one exact hash
    monkeypatch.setattr(S, "_RANK_MAX_ROWS", 0)
    rows = [(d, p) for d in range(300) for p in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, pos int").repartition(4)
    for frac in (0.2, 0.5, 0.97):
        got = {(r["doc_id"], r["pos"]): r["is_train"] for r in S.split_exact(df, ["doc_id", "pos"], frac, 2).collect()}
        order = sorted(rows, key=lambda r: (_h(2, *r), r[0], r[1]))
        n_test = math.ceil(frac * len(rows))
        assert got == {r: i >= n_test for i, r in enumerate(order)}


def test_minibatch_exact_equals_contiguous_slices(spark, monkeypatch):
    rows = [(d, p) for d in range(250) for p in range(3)]  # 750 rows
    df = spark.createDataFrame(rows, "doc_id long, pos int").repartition(6)
    order = sorted(rows, key=lambda r: (_h(7919 + 4, *r), r[0], r[1]))
    want = {r: i // 40 for i, r in enumerate(order) if i < (len(rows) // 40) * 40}
    for max_rows in (S._RANK_MAX_ROWS, 3):  # default, and finer buckets forced
        monkeypatch.setattr(S, "_RANK_MAX_ROWS", max_rows)
        b, n = S.minibatch_exact(df, ["doc_id", "pos"], 40, seed=4)
        got = {(r["doc_id"], r["pos"]): r["batch"] for r in b.collect()}
        assert n == 18 and got == want
    b, n = S.minibatch_exact(df.limit(10), ["doc_id", "pos"], 40)
    assert n == 0 and b.count() == 0


def test_fit_with_exact_batches(spark):
    from conftest import SF_SMALL
    from ibex.operators import vib as VIB
    from ibex.operators import vib_math as M
    from ibex.sources import corpus as C

    vec = S.split_hash(C.read_vectors(spark, SF_SMALL), "vec_id")
    spec = M.dense_spec(64, units=(4,), out_dim=10)
    cfg = VIB.FitConfig(epochs=1, batch_size=30, lr=1e-2, mode="sync", batching="exact")
    p, hist = VIB.fit(vec, spec, cfg, "vec_id", "features")
    assert len(hist) == 1 and not (p == M.init_params(spec, 0)).all()


def test_exact_split_and_batches_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(n=st.integers(1, 400), frac=st.floats(0.0, 1.0), bs=st.integers(1, 60), seed=st.integers(0, 50))
    def check(n, frac, bs, seed):
        rows = [(k,) for k in range(n)]
        df = spark.createDataFrame(rows, "k long").repartition(3)
        order = sorted(range(n), key=lambda k: (_h(seed, k), k))
        n_test = math.ceil(frac * n)
        got = {r["k"]: r["is_train"] for r in S.split_exact(df, "k", frac, seed).collect()}
        assert got == {k: i >= n_test for i, k in enumerate(order)}
        border = sorted(range(n), key=lambda k: (_h(seed + 7919, k), k))
        b, nb = S.minibatch_exact(df, "k", bs, seed)
        assert nb == n // bs
        assert {r["k"]: r["batch"] for r in b.collect()} == {k: i // bs for i, k in enumerate(border) if i < nb * bs}

    check()


def _flags(df, keys, frac, seed=0):
    return {tuple(r[k] for k in keys): r["is_train"] for r in S.split_exact(df, keys, frac, seed).collect()}


def test_boundary_from_every_level_of_kept_rows(spark, monkeypatch):
    """Whole tasks, a wide and a narrow stretch of the hashes, and the way back
    where the stretch misses the boundary."""
    rows = [(d, p) for d in range(700) for p in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, pos int").repartition(3)
    order = sorted(rows, key=lambda r: (_h(5, *r), r[0], r[1]))
    asked = []
    ranked = S._ranked
    monkeypatch.setattr(S, "_ranked", lambda hashed, cols, rank: asked.append(hashed.count()) or ranked(hashed, cols, rank))
    for kept, most in ((((1.0, 1 << 12), (0.05, 1 << 20), (0.004, None)), 2100), (((1.0, 100), (0.05, 10**6), (0.004, None)), 300),
                       (((1.0, 100), (0.2, 200), (0.05, None)), 300), (((1.0, 10), (0.5, 20), (1e-9, None)), 2100)):
        monkeypatch.setattr(S, "_KEPT", kept)
        for frac in (0.2, 0.97):
            n_test = math.ceil(frac * len(rows))
            assert _flags(df, ["doc_id", "pos"], frac, 5) == {r: i >= n_test for i, r in enumerate(order)}
            assert asked.pop() <= most


def test_exact_split_scans_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(20000).withColumnRenamed("id", "k").repartition(4).mapInArrow(watch, "k long")
    flagged = S.split_exact(df, "k", 0.3, 1)
    assert seen.value == 20000
    assert flagged.where("not is_train").count() == 6000


def test_exact_split_of_nothing(spark):
    df = spark.createDataFrame([], "k long")
    assert S.split_exact(df, "k", 0.3).collect() == []
    assert [r["is_train"] for r in S.split_exact(spark.createDataFrame([(1,)], "k long"), "k", 0.0).collect()] == [True]
