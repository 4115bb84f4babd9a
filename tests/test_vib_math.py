import math

import numpy as np
import pytest

from ibex.operators import vib_math as M


def _fd_check(spec, alpha, beta, seed=1, estimator="closed"):
    rng = np.random.default_rng(seed)
    n = 7
    if spec.input_kind == "ids":
        x = rng.integers(0, spec.vocab_size, size=(n, spec.seq_len))
    else:
        x = rng.uniform(0, 1, size=(n, spec.input_dim))
    y = rng.integers(0, spec.out_dim, size=n)
    eps = rng.standard_normal((n, M.noise_columns(spec, alpha, estimator)))
    p = M.init_params(spec, seed)
    # push sigma into a range where all terms matter
    lay = M.Layout(spec)
    p[lay.offsets["enc_out.b"][0] + spec.latent_dim: lay.offsets["enc_out.b"][0] + 2 * spec.latent_dim] = 4.5
    g, _, _, _ = M.loss_and_grad(spec, p, x, y, eps, beta, alpha, n, estimator)
    idx = rng.choice(len(p), size=40, replace=False)
    h = 1e-6
    for i in idx:
        e = np.zeros_like(p)
        e[i] = h
        fd = (M.total_loss(spec, p + e, x, y, eps, beta, alpha, estimator) - M.total_loss(spec, p - e, x, y, eps, beta, alpha, estimator)) / (2 * h)
        assert abs(fd - g[i]) < 1e-6 + 1e-4 * abs(fd), (i, fd, g[i])


@pytest.mark.parametrize("alpha", [1.0, 0.5, 2.0])
def test_gradient_dense(alpha):
    spec = M.dense_spec(5, units=(4, 3), out_dim=3, dec_units=(3,))
    _fd_check(spec, alpha, beta=0.3)


def test_gradient_embedding():
    spec = M.text_spec(num_words=11, maxlen=4, units=(5,), embed_dim=3)
    _fd_check(spec, 1.0, beta=0.1)


def test_divergence_values():
    # fixed pairs (mu, sigma) and their closed-form values in nats
    mu = np.array([0.0, 0.7, -1.2])
    s = np.array([1.0, 0.4, 0.9])
    kl = M.divergence(mu, s, 1.0)
    assert np.allclose(kl, [0.0, 0.741291, 0.730361], atol=1e-6)
    expected = {0.1: [0.233041, 0.088026], 0.5: [0.582770, 0.403330],
                2.0: [0.877712, 1.228468], 5.0: [1.013195, 2.080151]}
    for a, vals in expected.items():
        assert np.allclose(M.divergence(mu[1:], s[1:], a), vals, atol=1e-6), a


def test_renyi_tends_to_kl():
    mu, s = np.array([0.3]), np.array([0.6])
    kl = M.divergence(mu, s, 1.0)
    assert abs(M.divergence(mu, s, 1.0 + 1e-6) - kl) < 1e-5
    assert abs(M.divergence(mu, s, 1.0 - 1e-6) - kl) < 1e-5


def test_adam_first_step_moves_by_lr():
    opt = M.Adam(lr=0.1)
    p = opt.step(np.array([1.0, -1.0]), np.array([3.0, -0.5]))
    assert np.allclose(p, [0.9, -0.9], atol=1e-6)


def test_argmax_first_on_ties_and_large_logits():
    logits = np.array([[2.0, 2.0, 1.0], [1e4, 0.0, -1e4]])
    assert list(np.argmax(logits, axis=1)) == [0, 0]
    assert np.all(np.isfinite(M.logsumexp(logits)))


@pytest.mark.parametrize("alpha", [0.1, 0.5, 1.0, 2.0, 5.0, math.inf])
def test_gradient_of_the_sampled_divergence(alpha):
    _fd_check(M.dense_spec(5, units=(4, 3), out_dim=3, dec_units=(3,)), alpha, 0.3, estimator="sampled")
    _fd_check(M.text_spec(num_words=11, maxlen=4, units=(5,), embed_dim=3), alpha, 0.1, estimator="sampled")


def test_sampled_divergence_by_hand():
    mu, s, r1, r2 = (np.array([[v]]) for v in (0.5, 0.8, -0.3, 1.1))
    d = -0.5 * 0.09 - math.log(0.8) + 0.5 * (0.5 + 0.8 * 1.1) ** 2
    for alpha in (0.5, 2.0, math.inf):
        assert abs(M.sampled_divergence(mu, s, np.log(s), r1, r2, alpha)[0] - d) < 1e-12


def test_closed_form_that_does_not_exist_is_an_error():
    spec = M.dense_spec(3, units=(4,), out_dim=2)
    p = M.init_params(spec, 0)
    lay = M.Layout(spec)
    at = lay.offsets["enc_out.b"][0]
    p[at + spec.latent_dim:at + 2 * spec.latent_dim] = 8.0  # sigma about 3
    rng = np.random.default_rng(0)
    x, y = rng.uniform(size=(4, 3)), np.array([0, 1, 0, 1])
    with pytest.raises(FloatingPointError):
        M.loss_and_grad(spec, p, x, y, rng.normal(size=(4, 2)), 0.1, 5.0, 4)
    g, *_ = M.loss_and_grad(spec, p, x, y, rng.normal(size=(4, 6)), 0.1, 5.0, 4, "sampled")
    assert np.isfinite(g).all()


@pytest.mark.parametrize("units", [(6, 4), ()])
def test_padding_is_the_same_as_any_other_column(units):
    """Values and gradients do not depend on how many columns are padding in
    all rows: a batch with one long row has the rows' sum of gradients."""
    rng = np.random.default_rng(2)
    spec = M.text_spec(30, 12, units, embed_dim=3)
    p = M.init_params(spec, 1)
    x = np.zeros((6, 12), dtype=np.int64)
    for i, n in enumerate((0, 1, 3, 4, 4, 12)):
        x[i, :n] = rng.integers(1, 30, n)
    y, e = rng.integers(0, 2, 6), rng.normal(size=(6, 2))
    whole, ce, dv, _ = M.loss_and_grad(spec, p, x, y, e, 0.1, 1.0, 6)
    parts = [M.loss_and_grad(spec, p, x[i:i + 1], y[i:i + 1], e[i:i + 1], 0.1, 1.0, 6) for i in range(6)]
    assert np.allclose(whole, sum(g for g, _, _, _ in parts), atol=1e-12)
    assert abs(ce - sum(c for _, c, _, _ in parts)) < 1e-9 and abs(dv - sum(d for _, _, d, _ in parts)) < 1e-9
    # against finite differences, embedding of the padding id included
    at = [0, 1, 2, 5, 40, len(p) - 1] + list(range(90, len(p), 29))
    for i in at:
        up, down = p.copy(), p.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (M.total_loss(spec, up, x[:4], y[:4], e[:4], 0.1, 1.0) - M.total_loss(spec, down, x[:4], y[:4], e[:4], 0.1, 1.0)) / 2e-6
        got = M.loss_and_grad(spec, p, x[:4], y[:4], e[:4], 0.1, 1.0, 4)[0][i]
        assert abs(slope - got) < 1e-6
