"""Batch kernels of the stochastic latent classifier (NumPy).

These run inside Spark tasks on Arrow batches; Spark does the partitioning,
the reduction of gradients and all metric aggregation.  Gradients are
written out (no autodiff):

with batch size B, latent width K, ``z = mu + sigma * eps``,
``sigma = softplus(rho - 5)``, ``p = softmax(logits)``:

* ``dlogits = (p - y) / (B ln 2)``
* ``dmu = dz + beta / (B K ln 2) * dD/dmu``
* ``dsigma = dz * eps + beta / (B K ln 2) * dD/dsigma``;
  ``drho = dsigma * sigmoid(rho - 5)``
* then ordinary dense / relu / embedding back-propagation.

``D`` is the divergence of order alpha to N(0, 1).  For alpha = 1 it is KL.
For other orders training uses, by default, the *sampled* form: with two
independent draws ``x1 = mu + sigma r1`` and ``x2 = mu + sigma r2`` per row
and latent dimension, ``d = log p(x1) - log q(x2)`` and
``D = logsumexp((alpha - 1) d) / (alpha - 1)`` over the whole batch (alpha =
inf: ``max d``), whose gradient weighs every ``d`` by the softmax of
``(alpha - 1) d``.  The *closed* form per latent dimension is the other
choice; it does not exist everywhere for alpha > 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache, cached_property, reduce

import numpy as np

LN2 = math.log(2.0)
SCALE_SHIFT = 5.0


@dataclass(frozen=True)
class VibSpec:
    """Model shape.  ``input_kind='ids'``: token ids through an embedding
    table and a flatten; ``'dense'``: a numeric vector, optionally centred
    with ``2x - 1``."""

    input_kind: str = "ids"
    vocab_size: int = 1000
    embed_dim: int = 64
    seq_len: int = 500
    input_dim: int = 0
    input_transform: str = "none"
    enc_units: tuple[int, ...] = (128, 128)
    latent_dim: int = 2
    dec_units: tuple[int, ...] = ()
    out_dim: int = 2
    #: Type of parameters, activations and gradients.
    dtype: str = "float64"

    @property
    def flat_in(self) -> int:
        return self.seq_len * self.embed_dim if self.input_kind == "ids" else self.input_dim

    def layers(self) -> list[tuple[str, int, int]]:
        """Dense layers in order: ``(name, fan_in, fan_out)``."""
        out, fan = [], self.flat_in
        for i, u in enumerate(self.enc_units):
            out.append((f"enc{i}", fan, u))
            fan = u
        out.append(("enc_out", fan, 2 * self.latent_dim))
        fan = self.latent_dim
        for i, u in enumerate(self.dec_units):
            out.append((f"dec{i}", fan, u))
            fan = u
        out.append(("dec_out", fan, self.out_dim))
        return out

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        s = []
        if self.input_kind == "ids":
            s.append(("embed", (self.vocab_size, self.embed_dim)))
        for name, fi, fo in self.layers():
            s.append((f"{name}.W", (fi, fo)))
            s.append((f"{name}.b", (fo,)))
        return s


def text_spec(num_words: int = 1000, maxlen: int = 500, units=(128, 128), latent_dim: int = 2,
              embed_dim: int = 64, out_dim: int = 2, dtype: str = "float64") -> VibSpec:
    return VibSpec("ids", num_words, embed_dim, maxlen, 0, "none", tuple(units), latent_dim, (), out_dim, dtype)


def dense_spec(input_dim: int, units=(32, 32), out_dim: int = 2, latent_dim: int = 2,
               transform: str = "center", dec_units=(), dtype: str = "float64") -> VibSpec:
    return VibSpec("dense", 0, 0, 0, input_dim, transform, tuple(units), latent_dim, tuple(dec_units), out_dim, dtype)


@dataclass
class Layout:
    """Offsets of every parameter inside one flat float64 vector."""

    spec: VibSpec
    offsets: dict = field(default_factory=dict)
    size: int = 0

    def __post_init__(self):
        off = 0
        for name, shape in self.spec.shapes():
            self.offsets[name] = (off, shape)
            off += math.prod(shape)
        self.size = off

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[o:o + math.prod(s)].reshape(s) for k, (o, s) in self.offsets.items()}


@cache
def layout_of(spec: VibSpec) -> Layout:
    """The layout, made once for the many steps of a model."""
    return Layout(spec)


def first_weights(spec: VibSpec) -> str:
    """The name of the first layer's weights."""
    return f"{spec.layers()[0][0]}.W" if spec.enc_units else "enc_out.W"


def init_params(spec: VibSpec, seed: int = 0, scheme: str = "glorot") -> np.ndarray:
    """Initial flat parameter vector.

    ``glorot``: uniform(+-sqrt(6/(fan_in+fan_out))) kernels, zero biases,
    uniform(+-0.05) embedding (the usual layer defaults).
    ``formula``: deterministic values a SQL engine can recompute -
    layer ``l`` kernel ``W[i, j] = sin(i + 31 j + 101 l) / 8``, bias
    ``b[j] = cos(j + 101 l) / 16``, embedding ``E[t, d] = sin(7 t + 3 d) / 4``.
    """
    lay = Layout(spec)
    flat = np.zeros(lay.size)
    v = lay.views(flat)
    rng = np.random.default_rng(seed)
    if spec.input_kind == "ids":
        if scheme == "formula":
            t, d = np.meshgrid(np.arange(spec.vocab_size), np.arange(spec.embed_dim), indexing="ij")
            v["embed"][:] = np.sin(7.0 * t + 3.0 * d) / 4.0
        else:
            v["embed"][:] = rng.uniform(-0.05, 0.05, size=v["embed"].shape)
    for li, (name, fi, fo) in enumerate(spec.layers()):
        if scheme == "formula":
            i, j = np.meshgrid(np.arange(fi), np.arange(fo), indexing="ij")
            v[f"{name}.W"][:] = np.sin(i + 31.0 * j + 101.0 * li) / 8.0
            v[f"{name}.b"][:] = np.cos(np.arange(fo) + 101.0 * li) / 16.0
        else:
            lim = math.sqrt(6.0 / (fi + fo))
            v[f"{name}.W"][:] = rng.uniform(-lim, lim, size=(fi, fo))
    return flat.astype(spec.dtype, copy=False)


# ----------------------------------------------------------- activations ---

def softplus(x):
    return np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def log_softplus(x, value=None):
    """Its logarithm; ``value`` is ``softplus(x)`` where that is known."""
    with np.errstate(divide="ignore"):
        return np.where(x < -30.0, x, np.log(softplus(x) if value is None else value))


def logsumexp(a, axis=-1):
    m = np.max(a, axis=axis, keepdims=True)
    return (m + np.log(np.sum(np.exp(a - m), axis=axis, keepdims=True))).squeeze(axis)


def softmax(a, axis=-1):
    if axis == -1 and 0 < a.shape[-1] < 8:  # so few columns are faster one by one, in the same order
        columns = [a[..., i] for i in range(a.shape[-1])]
        top = reduce(np.maximum, columns)
        columns = [np.exp(c - top) for c in columns]
        total = reduce(np.add, columns)
        out = np.empty_like(a)
        for i, c in enumerate(columns):
            np.divide(c, total, out=out[..., i])
        return out
    e = np.exp(a - np.max(a, axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


# ----------------------------------------------------------- divergence ---

def divergence(mu, sigma, alpha: float, log_sigma=None):
    """Closed-form Renyi divergence of order alpha to N(0,1), element-wise.
    alpha = 1 is KL; inf where it does not exist."""
    ls = np.log(sigma) if log_sigma is None else log_sigma
    if alpha == 1.0:
        return -ls + (sigma * sigma + mu * mu - 1.0) / 2.0
    if math.isinf(alpha):
        s = 1.0 - sigma * sigma
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(s > 0, -ls + mu * mu / (2.0 * s), np.inf)
    s = alpha + (1.0 - alpha) * sigma * sigma
    with np.errstate(divide="ignore", invalid="ignore"):
        val = -ls - np.log(s) / (2.0 * (alpha - 1.0)) + alpha * mu * mu / (2.0 * s)
    return np.where(s > 0, val, np.inf)


def divergence_grads(mu, sigma, alpha: float):
    """(dD/dmu, dD/dsigma) of :func:`divergence`."""
    if alpha == 1.0:
        return mu, sigma - 1.0 / sigma
    if math.isinf(alpha):
        s = 1.0 - sigma * sigma
        return mu / s, -1.0 / sigma + mu * mu * sigma / (s * s)
    s = alpha + (1.0 - alpha) * sigma * sigma
    dmu = alpha * mu / s
    dsig = -1.0 / sigma + sigma / s + alpha * (alpha - 1.0) * mu * mu * sigma / (s * s)
    return dmu, dsig


def sampled_terms(mu, sigma, log_sigma, r1, r2):
    """``d = log p(x1) - log q(x2)`` of every row and latent dimension, and
    ``x2``."""
    x2 = mu + sigma * r2
    return -0.5 * r1 * r1 - log_sigma + 0.5 * x2 * x2, x2


def log_sum(d, alpha: float) -> tuple[float, float]:
    """``(top, total)`` of one part of a batch: the largest ``(alpha - 1) d``
    and the sum of the exponentials less it; for alpha = inf the largest ``d``
    and how many entries have it.  See :func:`add_log_sums`."""
    if d.size == 0:
        return -math.inf, 0.0
    t = d if math.isinf(alpha) else (alpha - 1.0) * d
    top = float(t.max())
    return top, float((t == top).sum() if math.isinf(alpha) else np.exp(t - top).sum())


def add_log_sums(parts, alpha: float) -> tuple[float, float]:
    """``(top, total)`` of a batch from those of its parts."""
    parts = [(t, s) for t, s in parts if s > 0]
    if not parts:
        return -math.inf, 0.0
    top = max(t for t, _ in parts)
    if math.isinf(alpha):
        return top, sum(s for t, s in parts if t == top)
    return top, sum(s * math.exp(t - top) for t, s in parts)


def sampled_divergence(mu, sigma, log_sigma, r1, r2, alpha: float, norm: tuple[float, float] | None = None):
    """Sampled divergence of a whole batch (nats) and its gradients
    ``(value, dD/dmu, dD/dsigma)``.  The rows are the whole batch, or a part
    of the one whose ``(top, total)`` is ``norm``: the gradients of the parts
    are then those of the batch.  For alpha = inf the gradient is shared by
    all entries with the largest value."""
    d, x2 = sampled_terms(mu, sigma, log_sigma, r1, r2)
    top, total = norm or log_sum(d, alpha)
    if math.isinf(alpha):
        w, value = (d == top) / total, top
    else:
        w = np.exp((alpha - 1.0) * d - top) / total
        value = (top + math.log(total)) / (alpha - 1.0)
    return value, w * x2, w * (x2 * r2 - 1.0 / sigma)


ESTIMATORS = ("sampled", "closed")


def noise_columns(spec: "VibSpec", alpha: float, estimator: str) -> int:
    """Gaussian draws per row that one training step needs."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; expected one of {ESTIMATORS}")
    return spec.latent_dim * (3 if estimator == "sampled" and alpha != 1.0 else 1)


# -------------------------------------------------------------- forward ---

class IdRows:
    """Rows of token ids as the first layer takes them, laid out once for any
    number of models.

    Rows come in order of falling length and columns in blocks; a block has the
    rows that reach into it.  All others have the padding id 0 there, one and
    the same vector, so one more row of padding stands for them; so it does for
    all rows in the columns that none reaches.
    """

    def __init__(self, spec: VibSpec, x: np.ndarray, lens: np.ndarray | None = None):
        lens = id_lengths(x) if lens is None else lens
        falling = -lens
        self.order = np.argsort(falling, kind="stable")
        falling, n = falling[self.order], len(lens)
        lens = (-falling).tolist()
        self.n, self.columns = n, lens[0] if n else 0
        ids = x[:, :self.columns][self.order]
        #: ``(rows, first column, end, first cell, end)``
        self.blocks, cells, at, begin = [], [], 0, 0
        while begin < self.columns:
            rows = int(np.searchsorted(falling, -begin))  # those longer than ``begin``
            end = max(lens[rows // 2], min(begin + BLOCK_COLUMNS, self.columns))  # half of them have ended there
            cells.append(ids[:rows, begin:end].reshape(-1))
            if rows < n:
                cells.append(np.zeros(end - begin, dtype=ids.dtype))
            size = (rows + (rows < n)) * (end - begin)
            self.blocks.append((rows, begin, end, at, at + size))
            at, begin = at + size, end
        self.cells = np.concatenate(cells).astype(np.intp) if cells else np.empty(0, dtype=np.intp)
        np.clip(self.cells, 0, spec.vocab_size - 1, out=self.cells)

    def __len__(self) -> int:
        return self.n

    def values(self, width: int) -> np.ndarray:
        """The place in an embedding of this width of each value of the cells."""
        return (self.cells[:, None] * width + np.arange(width)).reshape(-1)

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells in order of their id, where each id begins, and the ids."""
        small = len(self.cells) and self.cells.max() < 1 << 15
        order = np.argsort(self.cells.astype(np.int16) if small else self.cells, kind="stable")  # short ones are sorted by radix
        ordered = self.cells[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, dtype=np.intp)
        return order, begin, ordered[begin]


#: Embeddings up to this width have their gradient counted value by value.
NARROW = 16
#: Columns of a block, at least.
BLOCK_COLUMNS = 16


def id_lengths(mat: np.ndarray) -> np.ndarray:
    """Ids of each row up to the last that is not padding."""
    if not mat.size:
        return np.zeros(len(mat), dtype=np.int64)
    used = mat != 0
    return np.where(used.any(axis=1), mat.shape[1] - used[:, ::-1].argmax(axis=1), 0)


class Inputs:
    """The input rows, as the first layer sees them: numbers, or token ids
    through the embedding and a flatten (see :class:`IdRows`)."""

    def __init__(self, spec: VibSpec, p: dict, x):
        self.spec, self.p = spec, p
        if spec.input_kind == "ids":
            self.rows = x if isinstance(x, IdRows) else IdRows(spec, x)
            self.h = np.take(p["embed"], self.rows.cells, axis=0)
            self.padding = np.tile(p["embed"][0], spec.seq_len - self.rows.columns)
        else:
            self.h = x.astype(spec.dtype)
            if spec.input_transform == "center":
                self.h = 2.0 * self.h - 1.0

    def layer(self, name: str) -> np.ndarray:
        """Rows times the layer's weights, plus its bias."""
        w = self.p[f"{name}.W"]
        if self.spec.input_kind != "ids":
            return self.h @ w + self.p[f"{name}.b"]
        rows, width = self.rows, self.spec.embed_dim
        total = np.empty((len(rows), w.shape[1]), dtype=w.dtype)
        total[:] = self.p[f"{name}.b"]
        for n, begin, end, first, last in rows.blocks:
            part = self.h[first:last].reshape(-1, (end - begin) * width) @ w[begin * width:end * width]
            total[:n] += part[:n]
            if n < len(rows):
                total[n:] += part[n]
        if len(self.padding):
            total += self.padding @ w[rows.columns * width:]
        out = np.empty_like(total)
        out[rows.order] = total
        return out

    def backward(self, name: str, da: np.ndarray, gv: dict, take=None) -> None:
        """Gradients of the layer and the embedding from that of its output.
        ``take(at, gradient)`` gets that of the ids' weights in pieces, while they
        are in the cache, in place of ``gv``, and may change the weights there
        (``at`` counts from the first)."""
        w, gw = self.p[f"{name}.W"], gv[f"{name}.W"]
        total = da.sum(axis=0)
        gv[f"{name}.b"][:] = total
        if self.spec.input_kind != "ids":
            np.matmul(self.h.T, da, out=gw)
            return
        rows, width = self.rows, self.spec.embed_dim
        da, dh, each = da[rows.order], np.empty_like(self.h), width * w.shape[1]
        columns = max(1, ADAM_BLOCK // each) if take else rows.columns
        scratch = np.empty((columns * width, w.shape[1]), dtype=w.dtype) if take else None
        for n, first, end, at, stop in rows.blocks:
            d = da if n == len(rows) else np.concatenate([da[:n], da[n:].sum(axis=0, keepdims=True)])
            h, to = (v[at:stop].reshape(len(d), -1) for v in (self.h, dh))
            for c in range(first, end, columns):
                part, own = slice(c * width, min(c + columns, end) * width), slice((c - first) * width, (min(c + columns, end) - first) * width)
                np.matmul(d, w[part].T, out=to[:, own])
                g = scratch[:part.stop - part.start] if take else gw[part]
                np.matmul(h[:, own].T, d, out=g)
                if take:
                    take(c * each, g.reshape(-1))
        if len(dh) and width <= NARROW:
            embed = gv["embed"]
            embed[:] = np.bincount(rows.values(width), weights=dh.reshape(-1), minlength=embed.size).reshape(embed.shape)
        elif len(dh):
            order, begin, ids = rows.by_id
            gv["embed"][ids] = np.add.reduceat(np.take(dh, order, axis=0), begin, axis=0)
        if len(self.padding):
            gv["embed"][0] += (w[rows.columns * width:] @ total).reshape(-1, width).sum(axis=0)
            # the same for each column
            same = np.multiply(self.padding[:width, None], total).reshape(-1)
            if take:
                scratch.reshape(-1, each)[:] = same
                for c in range(rows.columns, self.spec.seq_len, columns):
                    take(c * each, scratch.reshape(-1)[:(min(c + columns, self.spec.seq_len) - c) * each])
            else:
                gw[rows.columns * width:].reshape(-1, each)[:] = same


def encode(spec: VibSpec, p: dict, x, keep: bool = False):
    """Encoder of rows or :class:`IdRows`: returns ``(mu, rho, cache)``."""
    inputs, h = Inputs(spec, p, x), None
    cache = {"inputs": inputs, "acts": []}
    for i in range(len(spec.enc_units)):
        a = inputs.layer("enc0") if i == 0 else h @ p[f"enc{i}.W"] + p[f"enc{i}.b"]
        if keep:
            cache["acts"].append((h, a))
        h = np.maximum(a, 0.0)
    out = inputs.layer("enc_out") if h is None else h @ p["enc_out.W"] + p["enc_out.b"]
    cache["h_last"] = h
    k = spec.latent_dim
    return out[:, :k], out[:, k:], cache


def decode(spec: VibSpec, p: dict, z: np.ndarray, keep: bool = False):
    h = z
    acts = []
    for i in range(len(spec.dec_units)):
        a = h @ p[f"dec{i}.W"] + p[f"dec{i}.b"]
        if keep:
            acts.append((h, a))
        h = np.maximum(a, 0.0)
    logits = h @ p["dec_out.W"] + p["dec_out.b"]
    return logits, (acts, h)


def row_metrics(spec: VibSpec, flat: np.ndarray, x: np.ndarray, y: np.ndarray, eps: np.ndarray,
                eps_mc: np.ndarray | None, alpha: float = 1.0) -> dict[str, np.ndarray]:
    """Per-row evaluation outputs: latent parameters, one-draw logits and
    prediction, cross-entropy (bits), divergence (bits, mean over latent
    dimensions), and the Monte Carlo prediction over ``S`` draws."""
    p = layout_of(spec).views(flat)
    mu, rho, _ = encode(spec, p, x)
    sigma = softplus(rho - SCALE_SHIFT)
    ls = log_softplus(rho - SCALE_SHIFT, sigma)
    eps = eps.astype(spec.dtype, copy=False)
    z = mu + sigma * eps
    logits, _ = decode(spec, p, z)
    lse = logsumexp(logits)
    yi = y.astype(np.int64)
    valid = (yi >= 0) & (yi < spec.out_dim)
    picked = np.where(valid, logits[np.arange(len(yi)), np.clip(yi, 0, spec.out_dim - 1)], 0.0)
    # out-of-range label: an all-zero one-hot row has zero cross-entropy
    ce = np.where(valid, (lse - picked) / LN2, 0.0).astype(np.float64, copy=False)
    div = (divergence(mu, sigma, alpha, ls).mean(axis=1) / LN2).astype(np.float64, copy=False)
    out = {"mu": mu, "sigma": sigma, "z": z, "logits": logits,
           "pred": np.argmax(logits, axis=1), "ce_bits": ce, "div_bits": div}
    if eps_mc is not None:
        s_draws = eps_mc.shape[1]
        eps_mc = eps_mc.astype(spec.dtype, copy=False)
        zs = mu[:, None, :] + sigma[:, None, :] * eps_mc            # (B, S, K)
        lg, _ = decode(spec, p, zs.reshape(-1, spec.latent_dim))
        probs = softmax(lg).reshape(len(x), s_draws, spec.out_dim).mean(axis=1)
        out["mc_pred"] = np.argmax(probs, axis=1)
        out["mc_probs"] = probs
    return out


# ------------------------------------------------------------- backward ---

def loss_and_grad(spec: VibSpec, flat: np.ndarray, x: np.ndarray, y: np.ndarray, eps: np.ndarray,
                  beta: float, alpha: float, batch_total: int, estimator: str = "closed",
                  norm: tuple[float, float] | None = None, out: np.ndarray | None = None, take=None):
    """Loss contributions and gradient of the *global* batch loss from the
    rows given here; ``batch_total`` is the global batch size B, so partial
    results from several tasks add up to the full-batch values.

    With ``estimator="sampled"`` and alpha != 1, ``eps`` holds three draws per
    latent dimension (the decoder's, ``r1``, ``r2``).  The log-sum-exp runs
    over the whole batch: either the rows are that (the divergence is added
    once, and the gradient is that of the batch loss times ``n_rows /
    batch_total``), or ``norm`` is the batch's ``(top, total)`` from
    :func:`add_log_sums` and ``batch_total`` its size.  The closed form raises
    where it does not exist.  ``out`` takes the gradient, whatever it held.
    ``take`` see :meth:`Inputs.backward`; ``at`` is the place in ``flat``, and what
    it got is not in the gradient returned.

    Returns ``(grad_flat, ce_sum_bits, div_sum_bits, n_rows)``; the divergence
    sum is the batch value times ``n_rows`` in the sampled case.
    """
    lay = layout_of(spec)
    p = lay.views(flat)
    g = np.empty(lay.size, dtype=spec.dtype) if out is None else out
    gv = lay.views(g)
    n = len(x)
    if n == 0:
        g[:] = 0
        return g, 0.0, 0.0, 0
    if "embed" in gv:  # only its rows in use are written below; the other parameters are, all of them
        gv["embed"][:] = 0
    B, K = float(batch_total), spec.latent_dim
    sampled = noise_columns(spec, alpha, estimator) > K
    eps = eps.astype(spec.dtype, copy=False)
    eps, draws = eps[:, :K], eps[:, K:3 * K]
    mu, rho, cache = encode(spec, p, x, keep=True)
    sigma = softplus(rho - SCALE_SHIFT)
    ls = log_softplus(rho - SCALE_SHIFT, sigma)
    z = mu + sigma * eps
    logits, (dacts, h_dec) = decode(spec, p, z, keep=True)
    yi = y.astype(np.int64)
    onehot = np.zeros_like(logits)
    valid = (yi >= 0) & (yi < spec.out_dim)
    onehot[np.arange(n)[valid], yi[valid]] = 1.0
    lse = logsumexp(logits)
    ce_rows = (onehot.sum(axis=1) * lse - (logits * onehot).sum(axis=1)) / LN2
    if sampled:
        value, dDmu, dDsig = sampled_divergence(mu, sigma, ls, draws[:, :K], draws[:, K:], alpha, norm)
        c = beta / LN2 if norm else beta * n / (B * LN2)
        div_sum = value * n / LN2
    else:
        div_rows = divergence(mu, sigma, alpha, ls)
        if not np.isfinite(div_rows).all():
            raise FloatingPointError(f"the closed form of order {alpha} does not exist for sigma up to {sigma.max():.3g}; "
                                     "train with estimator='sampled'")
        dDmu, dDsig = divergence_grads(mu, sigma, alpha)
        c = beta / (B * K * LN2)
        div_sum = float(div_rows.mean(axis=1).sum() / LN2)
    # decoder
    dlog = (softmax(logits) * onehot.sum(axis=1, keepdims=True) - onehot) / (B * LN2)
    np.matmul(h_dec.T, dlog, out=gv["dec_out.W"])
    gv["dec_out.b"][:] = dlog.sum(axis=0)
    dh = dlog @ p["dec_out.W"].T
    for i in reversed(range(len(spec.dec_units))):
        h_in, a = dacts[i]
        da = dh * (a > 0)
        np.matmul(h_in.T, da, out=gv[f"dec{i}.W"])
        gv[f"dec{i}.b"][:] = da.sum(axis=0)
        dh = da @ p[f"dec{i}.W"].T
    dz = dh
    # latent code
    dmu = dz + c * dDmu
    dsig = dz * eps + c * dDsig
    drho = dsig * sigmoid(rho - SCALE_SHIFT)
    dout = np.concatenate([dmu, drho], axis=1)
    h_last, inputs = cache["h_last"], cache["inputs"]
    if take and spec.input_kind == "ids":
        begin, given = lay.offsets[first_weights(spec)][0], take
        take = lambda at, grad: given(begin + at, grad)
    if h_last is None:
        inputs.backward("enc_out", dout, gv, take)
    else:
        np.matmul(h_last.T, dout, out=gv["enc_out.W"])
        gv["enc_out.b"][:] = dout.sum(axis=0)
        dh = dout @ p["enc_out.W"].T
    for i in reversed(range(len(spec.enc_units))):
        h_in, a = cache["acts"][i]
        da = dh * (a > 0)
        if i == 0:
            inputs.backward("enc0", da, gv, take)
            break
        np.matmul(h_in.T, da, out=gv[f"enc{i}.W"])
        gv[f"enc{i}.b"][:] = da.sum(axis=0)
        dh = da @ p[f"enc{i}.W"].T
    return g, float(ce_rows.sum()), float(div_sum), n


def total_loss(spec, flat, x, y, eps, beta, alpha, estimator="closed"):
    """Full-batch loss in bits (for finite-difference tests)."""
    p = Layout(spec).views(flat)
    mu, rho, _ = encode(spec, p, x)
    sigma = softplus(rho - SCALE_SHIFT)
    k = spec.latent_dim
    sampled = noise_columns(spec, alpha, estimator) > k
    eps, draws = eps[:, :k], eps[:, k:3 * k]
    z = mu + sigma * eps
    logits, _ = decode(spec, p, z)
    yi = y.astype(np.int64)
    ce = (logsumexp(logits) - logits[np.arange(len(yi)), yi]).mean() / LN2
    if sampled:
        ls = log_softplus(rho - SCALE_SHIFT)
        div = sampled_divergence(mu, sigma, ls, draws[:, :k], draws[:, k:], alpha)[0] / LN2
    else:
        div = divergence(mu, sigma, alpha).mean() / LN2
    return ce + beta * div


# ----------------------------------------------------------------- Adam ---

#: Values updated together.
ADAM_BLOCK = 1 << 15


@dataclass
class Adam:
    """Adam with the common defaults (beta1 0.9, beta2 0.999, eps 1e-7)."""

    lr: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7
    t: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def step(self, params: np.ndarray, grad: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The parameters after one step, in ``out`` if given (``params`` itself
        may be)."""
        out = np.empty_like(params) if out is None else out
        self.begin(params)
        self.update(params, grad, out)
        return out

    def begin(self, params: np.ndarray) -> None:
        """The next step begins; :meth:`update` is to take every value once."""
        if self.m is None:
            self.m = np.zeros_like(params)
            self.v = np.zeros_like(params)
        self.t += 1

    def update(self, params: np.ndarray, grad: np.ndarray, out: np.ndarray, start: int = 0) -> None:
        """The step for the values from ``start`` on that ``grad`` has.  Blocks
        keep the temporaries in the cache; every value is computed as it would be
        alone."""
        a = self.lr * math.sqrt(1.0 - self.beta2 ** self.t) / (1.0 - self.beta1 ** self.t)
        left, right = (np.empty(min(ADAM_BLOCK, len(grad)), dtype=params.dtype) for _ in range(2))
        for at in range(0, len(grad), ADAM_BLOCK):
            g = grad[at:at + ADAM_BLOCK]
            part = slice(start + at, start + at + len(g))
            m, v = self.m[part], self.v[part]
            s, t = left[:len(g)], right[:len(g)]
            # m += (g - m) * (1 - beta1), v += (g * g - v) * (1 - beta2)
            np.subtract(g, m, out=s)
            s *= 1.0 - self.beta1
            m += s
            np.multiply(g, g, out=s)
            s -= v
            s *= 1.0 - self.beta2
            v += s
            # params - a * m / (sqrt(v) + eps)
            np.sqrt(v, out=s)
            s += self.eps
            np.multiply(m, a, out=t)
            t /= s
            np.subtract(params[part], t, out=out[part])
