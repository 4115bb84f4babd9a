"""Plain-SQL forward pass of the dense-input classifier with formula
weights, for cross-checking the NumPy kernels run by Spark.

Model (see :func:`ibex.operators.vib_math.init_params`, scheme
``formula``): input ``2x - 1`` (64 values) -> dense 8 relu -> dense 4
(mu 2, rho 2) -> ``sigma = softplus(rho - 5)`` -> ``z = mu + sigma eps`` ->
dense 10 logits.  Layer ``l`` weights ``sin(i + 31 j + 101 l) / 8``,
biases ``cos(j + 101 l) / 16``.  Noise ``eps`` is Box-Muller over
``md5('seed:tag:key:draw')``.
"""

from __future__ import annotations

HIDDEN = 8
LATENT = 2
CLASSES = 10
DRAWS = 12
EMBED = 4


def _w(i: str, j: str, layer: int) -> str:
    return f"(sin({i} + 31.0 * {j} + {101.0 * layer}) / 8.0)"


def _b(j: str, layer: int) -> str:
    return f"(cos({j} + {101.0 * layer}) / 16.0)"


def _gauss(tag: str, key: str, draw: str) -> str:
    d = f"md5(concat_ws(':', '{tag}', CAST({key} AS VARCHAR), CAST({draw} AS VARCHAR)))"
    u1 = f"((('0x' || substr({d}, 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    u2 = f"((('0x' || substr({d}, 9, 8))::BIGINT + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def softplus_sql(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1.0 + exp(-abs({x}))))"


def forward_ctes(seed: int = 0, test_fraction: float = 0.2) -> str:
    """CTEs ``x, h0, o, lat(vec_id, k, mu, sigma), z(vec_id, k, z),
    lg(vec_id, c, logit), rows(vec_id, label, is_train)``."""
    tag = f"{seed}:eval"
    return f"""
rows AS (SELECT vec_id, label, (('0x' || substr(md5(concat_ws(':', '{seed}', CAST(vec_id AS VARCHAR))), 1, 8))::BIGINT
         / 4294967296.0) >= {test_fraction} AS is_train FROM embeddings),
x AS (SELECT vec_id, 2.0 * CAST(v AS DOUBLE) - 1.0 AS v, CAST(i AS BIGINT) - 1 AS i
      FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
h0 AS (SELECT x.vec_id, r.j, greatest(sum(x.v * {_w('x.i', 'r.j', 0)}) + {_b('r.j', 0)}, 0.0) AS h
       FROM x, (SELECT range AS j FROM range({HIDDEN})) r GROUP BY x.vec_id, r.j),
o AS (SELECT h0.vec_id, r.k, sum(h0.h * {_w('h0.j', 'r.k', 1)}) + {_b('r.k', 1)} AS o
      FROM h0, (SELECT range AS k FROM range({2 * LATENT})) r GROUP BY h0.vec_id, r.k),
lat AS (SELECT m.vec_id, m.k, m.o AS mu, {softplus_sql('s.o - 5.0')} AS sigma
        FROM o m JOIN o s ON m.vec_id = s.vec_id AND s.k = m.k + {LATENT} WHERE m.k < {LATENT}),
z AS (SELECT vec_id, k, mu + sigma * {_gauss(tag, 'vec_id', 'k')} AS z FROM lat),
lg AS (SELECT z.vec_id, r.c, sum(z.z * {_w('z.k', 'r.c', 2)}) + {_b('r.c', 2)} AS logit
       FROM z, (SELECT range AS c FROM range({CLASSES})) r GROUP BY z.vec_id, r.c),
zmc AS (SELECT lat.vec_id, d.s, lat.k,
        lat.mu + lat.sigma * {_gauss(tag + ':mc', 'lat.vec_id', f'd.s * {LATENT} + lat.k')} AS z
        FROM lat, (SELECT range AS s FROM range({DRAWS})) d),
lgmc AS (SELECT zmc.vec_id, zmc.s, r.c, sum(zmc.z * {_w('zmc.k', 'r.c', 2)}) + {_b('r.c', 2)} AS logit
         FROM zmc, (SELECT range AS c FROM range({CLASSES})) r GROUP BY zmc.vec_id, zmc.s, r.c),
pmc AS (SELECT vec_id, s, c, exp(logit - max(logit) OVER (PARTITION BY vec_id, s)) AS e FROM lgmc),
probs AS (SELECT vec_id, c, avg(p) AS prob FROM
          (SELECT vec_id, s, c, e / sum(e) OVER (PARTITION BY vec_id, s) AS p FROM pmc) GROUP BY vec_id, c),
mcpred AS (SELECT vec_id, first(c ORDER BY prob DESC, c) AS mc_pred, max(prob) AS max_prob FROM probs GROUP BY vec_id),
pred AS (SELECT vec_id, first(c ORDER BY logit DESC, c) AS pred, max(logit) AS mx FROM lg GROUP BY vec_id),
ce AS (SELECT lg.vec_id, (pred.mx + ln(sum(exp(lg.logit - pred.mx)))
        - max(CASE WHEN lg.c = rows.label THEN lg.logit END)) / ln(2.0) AS ce_bits
       FROM lg JOIN pred USING (vec_id) JOIN rows USING (vec_id) GROUP BY lg.vec_id, pred.mx),
kl AS (SELECT vec_id, avg(-ln(sigma) + (sigma * sigma + mu * mu - 1.0) / 2.0) / ln(2.0) AS div_bits
       FROM lat GROUP BY vec_id),
per AS (SELECT rows.vec_id, rows.label, rows.is_train, pred.pred, mcpred.mc_pred, ce.ce_bits, kl.div_bits
        FROM rows JOIN pred USING (vec_id) JOIN mcpred USING (vec_id) JOIN ce USING (vec_id)
        JOIN kl USING (vec_id))"""


def embedding_ctes(padded: str) -> str:
    """``elat(doc_id, pos, k, mu, sigma)`` from ``enc(doc_id, pos, ids)``: the
    embedding encoder (``EMBED`` wide) with formula weights."""
    return f"""
pad AS (SELECT doc_id, pos, {padded} AS ids FROM enc),
tokpos AS (SELECT doc_id, pos, unnest(ids) AS t, generate_subscripts(ids, 1) - 1 AS p FROM pad),
used AS (SELECT t, p, sum(1) AS n FROM tokpos GROUP BY t, p),
part AS (SELECT u.t, u.p, r.j, sum(sin(7.0 * u.t + 3.0 * d.d) / 4.0 * {_w(f'(u.p * {EMBED} + d.d)', 'r.j', 0)}) AS v
         FROM used u, (SELECT range AS d FROM range({EMBED})) d, (SELECT range AS j FROM range({HIDDEN})) r
         GROUP BY u.t, u.p, r.j),
eh AS (SELECT k.doc_id, k.pos, q.j, greatest(sum(q.v) + {_b('q.j', 0)}, 0.0) AS h
       FROM tokpos k JOIN part q ON k.t = q.t AND k.p = q.p GROUP BY k.doc_id, k.pos, q.j),
eo AS (SELECT e.doc_id, e.pos, r.k, sum(e.h * {_w('e.j', 'r.k', 1)}) + {_b('r.k', 1)} AS o
       FROM eh e, (SELECT range AS k FROM range({2 * LATENT})) r GROUP BY e.doc_id, e.pos, r.k),
elat AS (SELECT m.doc_id, m.pos, m.k, m.o AS mu, {softplus_sql('s.o - 5.0')} AS sigma
         FROM eo m JOIN eo s ON m.doc_id = s.doc_id AND m.pos = s.pos AND s.k = m.k + {LATENT} WHERE m.k < {LATENT})"""


def with_forward(select: str, seed: int = 0) -> str:
    return "WITH " + forward_ctes(seed).strip() + "\n" + select


def renyi_closed_sql(alphas) -> str:
    parts = []
    for a in alphas:
        if a == float("inf"):
            s, name = "(1.0 - sigma * sigma)", "Infinity"
            value = f"-ln(sigma) + mu * mu / (2.0 * {s})"
        else:
            s, name = f"({a} + {1.0 - a} * sigma * sigma)", str(a)
            value = f"-ln(sigma) - ln({s}) / {2.0 * (a - 1.0)} + {a} * mu * mu / (2.0 * {s})"
        parts.append(
            f"SELECT vec_id, '{name}' AS alpha, CASE WHEN min({s}) > 0 THEN "
            f"round(avg(CASE WHEN {s} > 0 THEN {value} END), 6) + 0.0 END AS div_nats FROM lat GROUP BY vec_id")
    return with_forward(" UNION ALL ".join(parts))


def gradient_sql(beta: float, select: str, seed: int = 0) -> str:
    """``grad(param, i, g)``: mean gradient of cross-entropy + beta x KL (both
    in bits) over the train rows, by back-propagation in SQL."""
    tr = "(SELECT vec_id, label FROM rows WHERE is_train)"
    eps = _gauss(f"{seed}:eval", "l.vec_id", "l.k")
    return f"""WITH {forward_ctes(seed).strip()},
n AS (SELECT count(*) AS n FROM rows WHERE is_train),
dlog AS (SELECT lg.vec_id, lg.c, (exp(lg.logit - p.mx) / sum(exp(lg.logit - p.mx)) OVER (PARTITION BY lg.vec_id)
         - CASE WHEN lg.c = r.label THEN 1.0 ELSE 0.0 END) / ln(2.0) AS d
         FROM lg JOIN pred p USING (vec_id) JOIN {tr} r USING (vec_id)),
dz AS (SELECT d.vec_id, r.k, sum(d.d * {_w('r.k', 'd.c', 2)}) AS d
       FROM dlog d, (SELECT range AS k FROM range({LATENT})) r GROUP BY d.vec_id, r.k),
dlat AS (SELECT l.vec_id, l.k, dz.d + {beta} / ({LATENT} * ln(2.0)) * l.mu AS dmu,
         (dz.d * {eps} + {beta} / ({LATENT} * ln(2.0)) * (l.sigma - 1.0 / l.sigma))
         * (1.0 - exp(-l.sigma)) AS drho
         FROM lat l JOIN dz USING (vec_id, k)),
dout AS (SELECT vec_id, k AS j, dmu AS d FROM dlat UNION ALL SELECT vec_id, k + {LATENT} AS j, drho AS d FROM dlat),
dh AS (SELECT h.vec_id, h.j, CASE WHEN h.h > 0 THEN s.d ELSE 0.0 END AS d FROM h0 h JOIN
       (SELECT o.vec_id, r.j, sum(o.d * {_w('r.j', 'o.j', 1)}) AS d
        FROM dout o, (SELECT range AS j FROM range({HIDDEN})) r GROUP BY o.vec_id, r.j) s USING (vec_id, j)),
grad AS (
 SELECT 'enc0.W' AS param, x.i * {HIDDEN} + d.j AS i, sum(x.v * d.d) / max(n.n) AS g FROM x JOIN dh d USING (vec_id), n
 GROUP BY x.i, d.j
 UNION ALL SELECT 'enc0.b', d.j, sum(d.d) / max(n.n) FROM dh d, n GROUP BY d.j
 UNION ALL SELECT 'enc_out.W', h.j * {2 * LATENT} + d.j, sum(h.h * d.d) / max(n.n) FROM h0 h JOIN dout d USING (vec_id), n
 GROUP BY h.j, d.j
 UNION ALL SELECT 'enc_out.b', d.j, sum(d.d) / max(n.n) FROM dout d, n GROUP BY d.j
 UNION ALL SELECT 'dec_out.W', z.k * {CLASSES} + d.c, sum(z.z * d.d) / max(n.n) FROM z JOIN dlog d USING (vec_id), n
 GROUP BY z.k, d.c
 UNION ALL SELECT 'dec_out.b', d.c, sum(d.d) / max(n.n) FROM dlog d, n GROUP BY d.c)
{select}"""


def gradient_alpha_sql(beta: float, alphas, select: str, seed: int = 0) -> str:
    """``grad(alpha, param, i, g)``: gradient of mean cross-entropy + beta x
    sampled divergence of other orders (bits) over the train rows; every entry
    of the log-sum-exp weighs in by its softmax (for inf: the largest)."""
    tag = f"{seed}:eval"
    r1, r2, eps = (_gauss(t, "l.vec_id", "l.k") for t in (tag + ":r1", tag + ":r2", tag))
    orders = ", ".join(f"('{a}')" for a in alphas)
    weight = " UNION ALL ".join(
        "SELECT '%s' AS alpha, vec_id, k, x2, r2, sigma, %s AS w FROM ld" % (
            a, "CASE WHEN d = max(d) OVER () THEN 1.0 ELSE 0.0 END" if a == float("inf") else
            f"exp({a - 1.0} * d - max({a - 1.0} * d) OVER ())") for a in alphas)
    tr = "(SELECT vec_id, label FROM rows WHERE is_train)"
    return f"""WITH {forward_ctes(seed).strip()},
orders(alpha) AS (VALUES {orders}),
n AS (SELECT count(*) AS n FROM rows WHERE is_train),
ld AS (SELECT vec_id, k, x2, r2, sigma, -0.5 * r1 * r1 - ln(sigma) + 0.5 * x2 * x2 AS d FROM (
       SELECT l.vec_id, l.k, l.sigma, {r1} AS r1, {r2} AS r2, l.mu + l.sigma * {r2} AS x2 FROM lat l JOIN {tr} r USING (vec_id))),
raw AS ({weight}),
wt AS (SELECT alpha, vec_id, k, x2, r2, sigma, w / sum(w) OVER (PARTITION BY alpha) AS w FROM raw),
dlog AS (SELECT lg.vec_id, lg.c, (exp(lg.logit - p.mx) / sum(exp(lg.logit - p.mx)) OVER (PARTITION BY lg.vec_id)
         - CASE WHEN lg.c = r.label THEN 1.0 ELSE 0.0 END) / ln(2.0) AS d
         FROM lg JOIN pred p USING (vec_id) JOIN {tr} r USING (vec_id)),
dz AS (SELECT d.vec_id, r.k, sum(d.d * {_w('r.k', 'd.c', 2)}) AS d
       FROM dlog d, (SELECT range AS k FROM range({LATENT})) r GROUP BY d.vec_id, r.k),
dlat AS (SELECT w.alpha, l.vec_id, l.k, dz.d + n.n * {beta} / ln(2.0) * w.w * w.x2 AS dmu,
         (dz.d * {eps} + n.n * {beta} / ln(2.0) * w.w * (w.x2 * w.r2 - 1.0 / l.sigma)) * (1.0 - exp(-l.sigma)) AS drho
         FROM lat l JOIN dz USING (vec_id, k) JOIN wt w USING (vec_id, k), n),
dout AS (SELECT alpha, vec_id, k AS j, dmu AS d FROM dlat UNION ALL SELECT alpha, vec_id, k + {LATENT} AS j, drho AS d FROM dlat),
dh AS (SELECT s.alpha, h.vec_id, h.j, CASE WHEN h.h > 0 THEN s.d ELSE 0.0 END AS d FROM h0 h JOIN
       (SELECT o.alpha, o.vec_id, r.j, sum(o.d * {_w('r.j', 'o.j', 1)}) AS d
        FROM dout o, (SELECT range AS j FROM range({HIDDEN})) r GROUP BY o.alpha, o.vec_id, r.j) s USING (vec_id, j)),
grad AS (
 SELECT d.alpha, 'enc0.W' AS param, x.i * {HIDDEN} + d.j AS i, sum(x.v * d.d) / max(n.n) AS g FROM x JOIN dh d USING (vec_id), n
 GROUP BY d.alpha, x.i, d.j
 UNION ALL SELECT d.alpha, 'enc0.b', d.j, sum(d.d) / max(n.n) FROM dh d, n GROUP BY d.alpha, d.j
 UNION ALL SELECT d.alpha, 'enc_out.W', h.j * {2 * LATENT} + d.j, sum(h.h * d.d) / max(n.n) FROM h0 h JOIN dout d USING (vec_id), n
 GROUP BY d.alpha, h.j, d.j
 UNION ALL SELECT d.alpha, 'enc_out.b', d.j, sum(d.d) / max(n.n) FROM dout d, n GROUP BY d.alpha, d.j
 UNION ALL SELECT o.alpha, 'dec_out.W', z.k * {CLASSES} + d.c, sum(z.z * d.d) / max(n.n) FROM z JOIN dlog d USING (vec_id), n, orders o
 GROUP BY o.alpha, z.k, d.c
 UNION ALL SELECT o.alpha, 'dec_out.b', d.c, sum(d.d) / max(n.n) FROM dlog d, n, orders o GROUP BY o.alpha, d.c)
{select}"""


def adam_select(lr: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-7) -> str:
    """First Adam step on ``grad`` from the formula weights."""
    start = f"""CASE param
 WHEN 'enc0.W' THEN {_w(f'(i // {HIDDEN})', f'(i % {HIDDEN})', 0)} WHEN 'enc0.b' THEN {_b('i', 0)}
 WHEN 'enc_out.W' THEN {_w(f'(i // {2 * LATENT})', f'(i % {2 * LATENT})', 1)} WHEN 'enc_out.b' THEN {_b('i', 1)}
 WHEN 'dec_out.W' THEN {_w(f'(i // {CLASSES})', f'(i % {CLASSES})', 2)} ELSE {_b('i', 2)} END"""
    move = (f"{lr} * sqrt(1.0 - {beta2}) / (1.0 - {beta1}) * ((1.0 - {beta1}) * g) "
            f"/ (sqrt((1.0 - {beta2}) * g * g) + {eps})")
    return f"SELECT param, CAST(i AS BIGINT) AS i, round({start} - {move}, 6) + 0.0 AS value FROM grad"


def renyi_loss_sql(alphas, beta: float, seed: int = 0) -> str:
    """Mean cross-entropy + beta x sampled divergence (bits) per part."""
    tag = f"{seed}:eval"
    ld = (f"ld AS (SELECT r.is_train, "
          f"-0.5 * power({_gauss(tag + ':r1', 'lat.vec_id', 'lat.k')}, 2) - ln(lat.sigma) "
          f"+ 0.5 * power(lat.mu + lat.sigma * {_gauss(tag + ':r2', 'lat.vec_id', 'lat.k')}, 2) AS d "
          "FROM lat JOIN rows r USING (vec_id)), "
          "part AS (SELECT is_train, avg(ce_bits) AS ce FROM per GROUP BY is_train)")
    parts = [f"SELECT is_train, '{a}' AS alpha, round(part.ce + {beta} * v.v / ln(2.0), 6) + 0.0 AS loss_bits FROM part JOIN "
             f"(SELECT is_train, ln(sum(exp({a - 1.0} * d))) / {a - 1.0} AS v FROM ld GROUP BY is_train) v USING (is_train)"
             for a in alphas]
    return "WITH " + forward_ctes(seed).strip() + ",\n" + ld + "\n" + " UNION ALL ".join(parts)


def renyi_mc_sql(alphas, seed: int = 0) -> str:
    """Reference-style estimator: independent draws for the two densities,
    log-sum-exp over every row and latent dimension of a split."""
    tag = f"{seed}:eval"
    ld = (f"ld AS (SELECT r.is_train, "
          f"(-0.5 * power({_gauss(tag + ':r1', 'lat.vec_id', 'lat.k')}, 2) - ln(lat.sigma) - 0.5 * ln(2.0 * pi())) - "
          f"(-0.5 * power(lat.mu + lat.sigma * {_gauss(tag + ':r2', 'lat.vec_id', 'lat.k')}, 2) "
          f"- 0.5 * ln(2.0 * pi())) AS d, "
          f"(-0.5 * power({_gauss(tag + ':r1', 'lat.vec_id', 'lat.k')}, 2) - ln(lat.sigma)) - "
          f"(-0.5 * power(lat.mu + lat.sigma * {_gauss(tag + ':r1', 'lat.vec_id', 'lat.k')}, 2)) AS d_shared "
          "FROM lat JOIN rows r USING (vec_id))")
    parts = []
    for a in alphas:
        if isinstance(a, str) and a.startswith("mc"):
            f = float(a[2:]) - 1.0
            parts.append(
                f"SELECT ld.is_train, '{a}' AS alpha, round((m.m + ln(sum(exp({f} * ld.d_shared - m.m))) - ln(m.n)) "
                f"/ {f}, 6) + 0.0 AS value FROM ld JOIN (SELECT is_train, max({f} * d_shared) AS m, count(*) AS n "
                f"FROM ld GROUP BY is_train) m USING (is_train) GROUP BY ld.is_train, m.m, m.n")
            continue
        if a == "inf":
            parts.append("SELECT is_train, 'inf' AS alpha, round(max(d), 6) + 0.0 AS value FROM ld GROUP BY is_train")
        else:
            f = a - 1.0
            parts.append(
                f"SELECT ld.is_train, '{a}' AS alpha, round((m.m + ln(sum(exp({f} * ld.d - m.m)))) / {f}, 6) + 0.0 "
                f"AS value FROM ld JOIN (SELECT is_train, max({f} * d) AS m FROM ld GROUP BY is_train) m "
                f"USING (is_train) GROUP BY ld.is_train, m.m")
    return "WITH " + forward_ctes(seed).strip() + ",\n" + ld + "\n" + " UNION ALL ".join(parts)
