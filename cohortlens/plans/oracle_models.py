"""Oracle SQL for scaling, sampling, scoring, naming and cluster-metric queries."""

from __future__ import annotations

from .. import schema as S
from ..operators import scaling as SC
from .model_queries import GIVEN_K, GIVEN_STEPS, INVERSE_POINTS, YJ_LAMBDAS, fixed_mixture
from .stream_queries import ARRIVALS, DECAY, SPANS
from .oracle import ATTRS, F_BAND, M_BAND, MALL, NORM, R_BAND, RULE, SEG, q


def _lit(v: float) -> str:
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def _dist_terms(x: str, y: str, cx: float, cy: float, sx: str | None, sy: str | None) -> str:
    dx = f"({x} - {_lit(cx)})" if sx is None else f"(({x} - {_lit(cx)}) / {sx})"
    dy = f"({y} - {_lit(cy)})" if sy is None else f"(({y} - {_lit(cy)}) / {sy})"
    return f"({dx} * {dx} + {dy} * {dy})"


def _nearest(x: str, y: str, sx: str | None, sy: str | None) -> tuple[str, str]:
    ds = [_dist_terms(x, y, cx, cy, sx, sy) for _, cx, cy in S.FIXED_CENTERS]
    m = f"least({', '.join(ds)})"
    case = "CASE " + " ".join(f"WHEN {d} = {m} THEN {i}" for i, d in enumerate(ds)) + " END"
    return case, m


MOM = "mom AS (SELECT avg(income_k) AS mi, stddev_pop(income_k) AS si, avg(score) AS ms, stddev_pop(score) AS ss FROM mall)"
CMAP = "(VALUES " + ", ".join(f"({i}, {q(n)})" for i, (n, _, _) in enumerate(S.FIXED_CENTERS)) + ") AS cmap(cluster, segment)"
REQ = """req AS (SELECT o_orderkey AS request_id, CAST(o_orderkey % 103 AS INT) AS age,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CAST(FLOOR(o_totalprice / 1000) AS DOUBLE) AS income, CAST(o_custkey % 102 AS DOUBLE) AS score FROM orders),
reqv AS (SELECT *, CASE WHEN age IS NULL OR NOT (age BETWEEN 1 AND 100) THEN %s
  WHEN income IS NULL OR isnan(income) OR NOT (income BETWEEN 0 AND 300) THEN %s
  WHEN score IS NULL OR isnan(score) OR NOT (score BETWEEN 1 AND 100) THEN %s END AS reject_reason FROM req)""".replace(
    "%s", "{}").format(q(S.MSG_REQ_AGE), q(S.MSG_REQ_INCOME), q(S.MSG_REQ_SCORE))

SCALED = f"z AS (SELECT customer_id, (income_k - mi) / si AS x, (score - ms) / ss AS y, {RULE} AS segment FROM mall CROSS JOIN mom)"


def _dispersion(points: str, label: str) -> str:
    """CTEs db and ch over a CTE of points (x, y, label)."""
    return f"""c AS (SELECT {label} AS l, COUNT(*) AS n, AVG(x) AS cx, AVG(y) AS cy FROM {points} GROUP BY 1),
si AS (SELECT c.l, cx, cy, AVG(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS s FROM {points} p JOIN c ON p.{label} = c.l GROUP BY ALL),
r AS (SELECT a.l, MAX(CASE WHEN (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) > 0
      THEN (a.s + b.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) ELSE 0.0 END) AS worst
      FROM si a JOIN si b ON a.l <> b.l GROUP BY a.l),
db AS (SELECT AVG(worst) AS db FROM r),
w AS (SELECT SUM((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS w FROM {points} p JOIN c ON p.{label} = c.l),
g AS (SELECT SUM(n) AS nn, COUNT(*) AS k, SUM(n * cx) / SUM(n) AS mx, SUM(n * cy) / SUM(n) AS my FROM c),
b AS (SELECT SUM(n * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) AS b FROM c CROSS JOIN g),
ch AS (SELECT CASE WHEN w = 0 THEN 1.0 ELSE (b * (nn - k)) / (w * (k - 1)) END AS ch FROM w, g, b)"""


def _silhouette_sq(points: str, label: str) -> str:
    """CTE sq: Spark ML's silhouette with squared distances, which decomposes into per-cluster sums:
    mean ||z - w||^2 over cluster C = ||z||^2 - 2 z.mu_C + mean_C ||w||^2."""
    return f"""qc AS (SELECT {label} AS l, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, AVG(x * x + y * y) AS mq FROM {points} GROUP BY 1),
qp AS (SELECT p.customer_id, p.{label} AS own, qc.l AS cs, qc.n AS cn,
      (p.x * p.x + p.y * p.y) - 2 * (p.x * qc.mx + p.y * qc.my) + qc.mq AS avgsq FROM {points} p CROSS JOIN qc),
qab AS (SELECT customer_id, MAX(CASE WHEN cs = own THEN cn END) AS na,
      MAX(CASE WHEN cs = own THEN CASE WHEN cn > 1 THEN avgsq * cn / (cn - 1) ELSE 0 END END) AS a,
      MIN(CASE WHEN cs <> own THEN avgsq END) AS b FROM qp GROUP BY customer_id),
sq AS (SELECT AVG(CASE WHEN na = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS sq FROM qab)"""


def _normal_quantile(p: str) -> str:
    """The rational approximation of the inverse normal, as SQL over a column."""
    def poly(coefficients, x):
        out = _lit(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {_lit(c)})"
        return out

    def tail(side):
        root = f"sqrt(-2 * ln({side}))"
        return f"{poly(SC._C, root)} / {poly([*SC._D, 1.0], root)}"
    q, low = f"({p} - 0.5e0)", "0.02425e0"
    return (f"CASE WHEN {p} < {low} THEN {tail(p)} WHEN {p} > 1 - {low} THEN -({tail(f'(1 - {p})')}) "
            f"ELSE {poly(SC._A, f'({q} * {q})')} * {q} / {poly([*SC._B, 1.0], f'({q} * {q})')} END")


def _quantile_normal(c: str) -> str:
    """CTEs z_<c> (value, z) over mall: knots linear between ranks, the share of a value, its normal quantile."""
    return f"""s_{c} AS (SELECT list(CAST({c} AS DOUBLE) ORDER BY {c}) AS v, COUNT(*) AS n, greatest(10, least(1000, COUNT(*))) AS nq FROM mall),
i_{c} AS (SELECT v, n, nq, unnest(range(0, CAST(nq AS BIGINT))) AS i FROM s_{c}),
k_{c} AS (SELECT i, nq, v[(i * (n - 1)) // (nq - 1) + 1] + (v[(i * (n - 1)) // (nq - 1) + 1 + CASE WHEN (i * (n - 1)) % (nq - 1) > 0 THEN 1 ELSE 0 END]
  - v[(i * (n - 1)) // (nq - 1) + 1]) * (CAST((i * (n - 1)) % (nq - 1) AS DOUBLE) / (nq - 1)) AS q FROM i_{c}),
l_{c} AS (SELECT list(q ORDER BY i) AS q, any_value(CAST(nq AS DOUBLE)) AS nq FROM k_{c}),
d_{c} AS (SELECT DISTINCT CAST({c} AS DOUBLE) AS x FROM mall),
n_{c} AS (SELECT x, COUNT(*) FILTER (q <= x) AS le, COUNT(*) FILTER (q < x) AS lt FROM d_{c} CROSS JOIN k_{c} GROUP BY x),
p_{c} AS (SELECT x, greatest(1e-7, least(1 - 1e-7, CASE WHEN x <= q[1] THEN 0.0e0 WHEN x >= q[-1] THEN 1.0e0
  WHEN le > lt THEN ((le - 1) / (nq - 1) + lt / (nq - 1)) / 2
  ELSE (le - 1) / (nq - 1) + (le / (nq - 1) - (le - 1) / (nq - 1)) / (q[le + 1] - q[le]) * (x - q[le]) END)) AS p FROM n_{c} CROSS JOIN l_{c}),
z_{c} AS (SELECT x, {_normal_quantile('p')} AS z FROM p_{c})"""


def _given_sweep(k: int) -> str:
    """One k of the sweep: Lloyd steps from the first k fixed centers, then the labels' quality."""
    ctes = ["f0 AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {_lit(x)}, {_lit(y)})" for i, (_, x, y) in enumerate(S.FIXED_CENTERS[:k])) + ") AS t(cluster, cx, cy))"]
    for i in range(1, GIVEN_STEPS + 2):
        ctes.append(f"""d{i} AS (SELECT * FROM (SELECT m.customer_id, CAST(m.income_k AS DOUBLE) AS x, CAST(m.score AS DOUBLE) AS y, f.cluster,
  (m.income_k - cx) * (m.income_k - cx) + (m.score - cy) * (m.score - cy) AS d2, row_number() OVER (PARTITION BY m.customer_id
  ORDER BY (m.income_k - cx) * (m.income_k - cx) + (m.score - cy) * (m.score - cy), f.cluster) AS rk FROM mall m CROSS JOIN f{i - 1} f) WHERE rk = 1),
f{i} AS (SELECT f.cluster, COALESCE(a.cx, f.cx) AS cx, COALESCE(a.cy, f.cy) AS cy FROM f{i - 1} f LEFT JOIN
  (SELECT cluster, AVG(x) AS cx, AVG(y) AS cy FROM d{i} GROUP BY cluster) a ON f.cluster = a.cluster)""")
    last = f"d{GIVEN_STEPS + 1}"
    return f"""SELECT * FROM (WITH {', '.join(ctes)}, {_dispersion(last, 'cluster')}, {_silhouette_sq(last, 'cluster')}
SELECT CAST({k} AS INT) AS k, (SELECT round(SUM(d2), 4) FROM {last}) AS inertia, round(sq, 6) AS silhouette, round(db, 6) AS davies,
  round(ch, 4) AS calinski FROM sq, db, ch)"""


def _given_mixture(covariance: str) -> str:
    """EM steps around the fixed centers; a component's covariance is [[a, b], [b, c]]."""
    k, reg = len(S.FIXED_CENTERS), "1e-4"
    ctes = ["v AS (SELECT var_pop(income_k) AS vx, var_pop(score) AS vy FROM mall)",
            f"q0 AS (SELECT j, 1.0e0 / {k} AS w, mx, my, vx / {k} + {reg} AS a, 0.0e0 AS b, vy / {k} + {reg} AS c FROM (VALUES "
            + ", ".join(f"({i}, {_lit(x)}, {_lit(y)})" for i, (_, x, y) in enumerate(S.FIXED_CENTERS)) + ") AS t(j, mx, my) CROSS JOIN v)"]
    for i in range(1, GIVEN_STEPS + 2):
        ctes.append(f"""e{i} AS (SELECT customer_id, CAST(income_k AS DOUBLE) AS x, CAST(score AS DOUBLE) AS y, j,
  w * exp(-0.5e0 * (c * (income_k - mx) * (income_k - mx) - 2 * b * (income_k - mx) * (score - my) + a * (score - my) * (score - my))
  / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b)) AS d FROM mall CROSS JOIN q{i - 1}),
t{i} AS (SELECT customer_id, SUM(d) AS s FROM e{i} GROUP BY customer_id),
m{i} AS (SELECT j, greatest(SUM(d / s), 1e-12) AS r, SUM(d / s * x) AS sx, SUM(d / s * y) AS sy, SUM(d / s * x * x) AS sxx,
  SUM(d / s * x * y) AS sxy, SUM(d / s * y * y) AS syy FROM e{i} JOIN t{i} USING (customer_id) GROUP BY j),
q{i} AS (SELECT j, r / SUM(r) OVER () AS w, sx / r AS mx, sy / r AS my, sxx / r - (sx / r) * (sx / r) + {reg} AS a,
  {'0.0e0' if covariance == 'diag' else '(sxy / r - (sx / r) * (sy / r))'} AS b, syy / r - (sy / r) * (sy / r) + {reg} AS c FROM m{i})""")
    return f"""SELECT * FROM (WITH {', '.join(ctes)}
SELECT '{covariance}' AS covariance, CAST(j AS INT) AS component, round(w, 4) AS weight, round(mx, 4) AS income_k, round(my, 4) AS score,
  round(a, 4) AS var_income, round(b, 4) AS covar, round(c, 4) AS var_score,
  (SELECT round(AVG(ln(s)), 4) FROM t{GIVEN_STEPS + 1}) AS mean_log_likelihood FROM q{GIVEN_STEPS})"""


def model_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    W = f"WITH {MALL}"
    out["exact_sample"] = f"""{W}
SELECT customer_id, gender, age, income_k, score FROM mall
ORDER BY md5(CAST(customer_id AS VARCHAR) || '{S.SAMPLE_SEED}'), customer_id LIMIT 500"""
    out["standard_scale"] = f"""{W}, {MOM}
SELECT customer_id, round((income_k - mi) / si, 6) AS z_income_k, round((score - ms) / ss, 6) AS z_score FROM mall CROSS JOIN mom"""
    out["robust_scale"] = f"""{W}, qs AS (SELECT quantile_cont(income_k, [0.25, 0.5, 0.75]) AS qi, quantile_cont(score, [0.25, 0.5, 0.75]) AS qsc FROM mall)
SELECT customer_id, round((income_k - qi[2]) / (qi[3] - qi[1]), 6) AS r_income_k,
  round((score - qsc[2]) / (qsc[3] - qsc[1]), 6) AS r_score FROM mall CROSS JOIN qs"""
    near_o, d2_o = _nearest("income_k", "score", None, None)
    out["nearest_centroid"] = f"{W} SELECT customer_id, {near_o} AS cluster, {d2_o} AS d2 FROM mall"
    out["scatter_export"] = f"""{W}, n AS (SELECT *, {near_o} AS cluster FROM mall)
SELECT customer_id AS "CustomerID", gender AS "Gender", age AS "Age", income_k AS "Annual Income (k$)",
  score AS "Spending Score (1-100)", n.cluster AS "Cluster", segment AS "Segment",
  {R_BAND} AS "R_proxy", {F_BAND} AS "F_proxy", {M_BAND} AS "M_proxy"
FROM n LEFT JOIN {CMAP} ON n.cluster = cmap.cluster"""
    out["label_join"] = f"""{W}, n AS (SELECT customer_id, {near_o} AS cluster FROM mall)
SELECT customer_id, n.cluster, segment FROM n LEFT JOIN {CMAP} ON n.cluster = cmap.cluster"""
    out["score_requests_validated"] = f"{W}, {REQ} SELECT request_id, age, gender, income, score, reject_reason FROM reqv"
    near_s, _ = _nearest("income", "score", "si", "ss")
    cx = "[" + ", ".join(_lit(c[1]) for c in S.FIXED_CENTERS) + "]"
    cy = "[" + ", ".join(_lit(c[2]) for c in S.FIXED_CENTERS) + "]"
    scored = f"""{W}, {MOM}, {REQ},
sc AS (SELECT request_id, income, score, {near_s} AS cluster FROM reqv CROSS JOIN mom WHERE reject_reason IS NULL),
sd AS (SELECT *, sqrt((income - {cx}[cluster + 1]) * (income - {cx}[cluster + 1]) + (score - {cy}[cluster + 1]) * (score - {cy}[cluster + 1])) AS dist FROM sc),
sf AS (SELECT sd.*, segment, greatest(0.0, least(100.0, round(100.0 - 2.0 * dist, 1))) AS confidence FROM sd LEFT JOIN {CMAP} ON sd.cluster = cmap.cluster)"""
    out["score_requests"] = f"{scored} SELECT request_id, cluster, segment, dist, confidence FROM sf"
    out["prediction_confidence"] = f"{scored} SELECT request_id, confidence FROM sf"
    near_c, _ = _nearest("income_k", "score", "si", "ss")
    out["score_with_similar_rows"] = f"""{scored},
sc5 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY customer_id) AS rk FROM
  (SELECT customer_id, income_k, score, {near_c} AS cluster FROM mall CROSS JOIN mom))
SELECT request_id, sf.cluster, segment, confidence, CAST(rk - 1 AS INT) AS position, customer_id AS similar_id,
  sc5.income_k AS similar_income, sc5.score AS similar_score FROM sf JOIN sc5 ON sf.cluster = sc5.cluster WHERE rk <= 5"""
    _, d2_s = _nearest("income_k", "score", "si", "ss")
    out["inertia"] = f"{W}, {MOM} SELECT round(SUM({d2_s}), 6) AS inertia FROM mall CROSS JOIN mom"

    Z = f"{W}, {MOM}, {SCALED}"
    out["silhouette_euclidean"] = f"""{Z},
sz AS (SELECT segment, COUNT(*) AS n FROM z GROUP BY segment),
p AS (SELECT a.customer_id, a.segment AS la, b.segment AS lb, SUM(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS sd
      FROM z a JOIN z b ON a.customer_id <> b.customer_id GROUP BY ALL),
m AS (SELECT p.customer_id, p.la, MAX(CASE WHEN p.la = p.lb THEN sd / (sz.n - 1) END) AS a,
      MIN(CASE WHEN p.la <> p.lb THEN sd / sz.n END) AS b FROM p JOIN sz ON p.lb = sz.segment GROUP BY ALL),
s AS (SELECT z.customer_id, CASE WHEN sz.n <= 1 OR m.a IS NULL THEN 0.0 ELSE (m.b - m.a) / greatest(m.a, m.b) END AS s
      FROM z JOIN sz ON z.segment = sz.segment LEFT JOIN m ON z.customer_id = m.customer_id)
SELECT round(AVG(s), 6) AS silhouette FROM s"""
    disp = _dispersion("z", "segment")
    out["davies_bouldin"] = f"{Z}, {disp} SELECT round(db, 6) AS davies_bouldin FROM db"
    out["calinski_harabasz"] = f"{Z}, {disp} SELECT round(ch, 6) AS calinski_harabasz FROM ch"

    keys = [
        (S.VIP, "income + score"),
        (S.AT_RISK, "-(score * 2 + income * 0.25e0)"),
        (S.NEW, "income - score * 1.1e0"),
        (S.DISCOUNT, "score * 1.4e0 - income"),
    ]
    ctes = [f"cent AS (SELECT {near_o} AS cluster, AVG(income_k) AS income, AVG(score) AS score FROM mall GROUP BY 1)",
            "r0 AS (SELECT * FROM cent)"]
    for i, (name, key) in enumerate(keys, start=1):
        ctes.append(f"p{i} AS (SELECT cluster, {q(name)} AS segment FROM r{i - 1} ORDER BY {key} DESC, cluster LIMIT 1)")
        ctes.append(f"r{i} AS (SELECT * FROM r{i - 1} WHERE cluster NOT IN (SELECT cluster FROM p{i}))")
    ctes.append(f"p5 AS (SELECT cluster, {q(S.LOYAL)} AS segment FROM r4 ORDER BY cluster LIMIT 1)")
    out["greedy_naming"] = (f"{W}, " + ",\n".join(ctes) + """
SELECT cent.cluster, n.segment, income, score FROM cent JOIN
 (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5) n
 ON cent.cluster = n.cluster""")
    out["silhouette_sq"] = f"{Z}, {_silhouette_sq('z', 'segment')} SELECT round(sq, 6) AS silhouette_sq FROM sq"
    near_z, d2_z = _nearest("income_k", "score", "si", "ss")
    lab = f"lab AS (SELECT customer_id, (income_k - mi) / si AS x, (score - ms) / ss AS y, {near_z} AS cluster, {d2_z} AS d2 FROM mall CROSS JOIN mom)"
    out["metrics_document"] = f"""{W}, {MOM}, {lab}, {_dispersion('lab', 'cluster')}, {_silhouette_sq('lab', 'cluster')}
SELECT round(sq, 4) AS silhouette, round(db, 3) AS davies, round(ch, 1) AS calinski, (SELECT round(SUM(d2), 1) FROM lab) AS inertia,
  CAST(NULL AS DOUBLE) AS aic, CAST(NULL AS DOUBLE) AS bic, CAST(0 AS INT) AS n_iter, 'fixed' AS model_variant,
  'standard' AS preprocessor_variant, CAST(NULL AS INT) AS best_k, CAST(5 AS INT) AS final_k FROM sq, db, ch"""
    out["model_roundtrip"] = f"""{W}, {MOM}, {lab}
SELECT lab.cluster, segment, COUNT(*) AS n, CAST(0 AS BIGINT) AS changed FROM lab LEFT JOIN {CMAP} ON lab.cluster = cmap.cluster GROUP BY ALL"""
    out["run_history"] = f"""{W}, h AS (SELECT 'group_' || (c_nationkey % 5) AS dataset_label, printf('nation_%02d.csv', c_nationkey) AS dataset_path,
  printf('2024-01-01 00:%02d:00', c_nationkey) AS trained_at, COUNT(*) AS rows FROM mall GROUP BY c_nationkey)
SELECT dataset_label, arg_max(dataset_path, trained_at) AS dataset_path, max(trained_at) AS trained_at,
  arg_max(rows, trained_at) AS rows, CAST(NULL AS DOUBLE) AS silhouette, COUNT(*) AS runs FROM h GROUP BY dataset_label"""
    near_f, _ = _nearest("income_k", "score", None, None)
    out["scatter_colored"] = f"""{W}, n AS (SELECT *, {near_f} AS cluster FROM mall)
SELECT customer_id, gender, age, income_k, score, n.cluster, cmap.segment, color
FROM n LEFT JOIN {CMAP} ON n.cluster = cmap.cluster LEFT JOIN {ATTRS} ON cmap.segment = attrs.segment"""
    k = len(S.FIXED_CENTERS)
    step, ctes = "f0", ["f0 AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {_lit(x)}, {_lit(y)})" for i, (_, x, y) in enumerate(S.FIXED_CENTERS)) + ") AS t(cluster, cx, cy))"]
    for i in range(1, 4):
        ctes.append(f"""d{i} AS (SELECT m.customer_id, m.income_k, m.score, f.cluster,
  row_number() OVER (PARTITION BY m.customer_id ORDER BY (m.income_k - cx) * (m.income_k - cx) + (m.score - cy) * (m.score - cy), f.cluster) AS rk
  FROM mall m CROSS JOIN {step} f),
f{i} AS (SELECT f.cluster, COALESCE(a.cx, f.cx) AS cx, COALESCE(a.cy, f.cy) AS cy, a.n FROM {step} f LEFT JOIN
  (SELECT cluster, AVG(income_k) AS cx, AVG(score) AS cy, COUNT(*) AS n FROM d{i} WHERE rk = 1 GROUP BY cluster) a ON f.cluster = a.cluster)""")
        step = f"f{i}"
    out["lloyd_steps"] = f"""{W}, {', '.join(ctes)}
SELECT CAST(cluster AS INT) AS cluster, n, round(cx, 6) AS income_k, round(cy, 6) AS score FROM f3 WHERE n IS NOT NULL"""
    step, ctes = "v", ["v AS (SELECT cluster, cx, cy, CAST(0 AS DOUBLE) AS w FROM (VALUES " + ", ".join(
        f"({i}, {_lit(x)}, {_lit(y)})" for i, (_, x, y) in enumerate(S.FIXED_CENTERS)) + ") AS t(cluster, cx, cy))"]
    for i in range(ARRIVALS):
        ctes.append(f"""a{i} AS (SELECT m.customer_id, m.income_k, m.score, f.cluster,
  row_number() OVER (PARTITION BY m.customer_id ORDER BY (m.income_k - cx) * (m.income_k - cx) + (m.score - cy) * (m.score - cy), f.cluster) AS rk
  FROM mall m CROSS JOIN {step} f WHERE m.customer_id % {ARRIVALS} = {i}),
v{i} AS (SELECT f.cluster, CASE WHEN {DECAY} * w + coalesce(n, 0) > 0 THEN ({DECAY} * w * cx + coalesce(sx, 0)) / ({DECAY} * w + coalesce(n, 0)) ELSE cx END AS cx,
  CASE WHEN {DECAY} * w + coalesce(n, 0) > 0 THEN ({DECAY} * w * cy + coalesce(sy, 0)) / ({DECAY} * w + coalesce(n, 0)) ELSE cy END AS cy,
  {DECAY} * w + coalesce(n, 0) AS w FROM {step} f LEFT JOIN (SELECT cluster, SUM(income_k) AS sx, SUM(score) AS sy, COUNT(*) AS n
  FROM a{i} WHERE rk = 1 GROUP BY cluster) s ON f.cluster = s.cluster)""")
        step = f"v{i}"
    every = " UNION ALL ".join(f"""SELECT CAST({i} AS INT) AS version, CAST(cluster AS INT) AS cluster, round(CAST(w AS DOUBLE), 6) AS weight,
  round(CAST(cx AS DOUBLE), 6) AS income_k, round(CAST(cy AS DOUBLE), 6) AS score FROM v{i}""" for i in range(ARRIVALS))
    out["stream_kmeans"] = f"{W}, {', '.join(ctes)} {every}"
    # a 2 x 2 covariance [[a, b], [b, c]]: determinant and inverse written out
    mix = fixed_mixture()
    (va, vb), (_, vc) = mix.covariances[0]
    det = va * vc - vb * vb
    dens = [f"exp(-0.5e0 * ({_lit(vc)} * (income_k - {_lit(x)}) * (income_k - {_lit(x)}) - {_lit(2 * vb)} * (income_k - {_lit(x)}) * (score - {_lit(y)}) "
            f"+ {_lit(va)} * (score - {_lit(y)}) * (score - {_lit(y)})) / {_lit(det)})" for x, y in mix.means]
    free = k * 2 + k * 3 + k - 1
    out["mixture_aic_bic"] = f"""{W}, s AS (SELECT COUNT(*) AS n,
  SUM(ln(({' + '.join(dens)}) / {_lit(k)} / (2 * pi() * sqrt({_lit(det)})))) AS ll FROM mall)
SELECT n, round(ll, 4) AS log_likelihood, round(-2 * ll + {2 * free}, 4) AS aic, round(-2 * ll + {free} * ln(n), 4) AS bic FROM s"""
    yj = [f"(pow({c} + 1, {_lit(lm)}) - 1) / {_lit(lm)}" for c, lm in zip(S.FEATURES, YJ_LAMBDAS)]  # features are not negative
    out["yeo_johnson_given"] = f"""{W}, t AS (SELECT customer_id, {yj[0]} AS a, {yj[1]} AS b FROM mall),
m AS (SELECT AVG(a) AS ma, stddev_pop(a) AS sa, AVG(b) AS mb, stddev_pop(b) AS sb FROM t)
SELECT customer_id, round((a - ma) / sa, 6) AS z_income_k, round((b - mb) / sb, 6) AS z_score FROM t CROSS JOIN m"""
    out["quantile_normal"] = f"""{W}, {_quantile_normal('income_k')}, {_quantile_normal('score')}
SELECT customer_id, round(a.z, 6) AS z_income_k, round(b.z, 6) AS z_score
FROM mall JOIN z_income_k a ON mall.income_k = a.x JOIN z_score b ON mall.score = b.x"""
    out["quantile_normal_incremental"] = out["quantile_normal"]
    points = ", ".join(f"({_lit(z)})" for z in INVERSE_POINTS)
    back = [f"pow(greatest((z * {sd} + {mean}) * {_lit(lm)} + 1, 1e-300), 1 / {_lit(lm)}) - 1"
            for sd, mean, lm in (("sa", "ma", YJ_LAMBDAS[0]), ("sb", "mb", YJ_LAMBDAS[1]))]
    below = [f"1 - pow(greatest(1 - (z * {sd} + {mean}) * (2 - {_lit(lm)}), 1e-300), 1 / (2 - {_lit(lm)}))"
             for sd, mean, lm in (("sa", "ma", YJ_LAMBDAS[0]), ("sb", "mb", YJ_LAMBDAS[1]))]
    out["scaler_inverse"] = f"""{W}, {MOM}, pt(z) AS (VALUES {points}),
qs AS (SELECT quantile_cont(income_k, [0.25, 0.5, 0.75]) AS qi, quantile_cont(score, [0.25, 0.5, 0.75]) AS qsc FROM mall),
m AS (SELECT AVG(a) AS ma, stddev_pop(a) AS sa, AVG(b) AS mb, stddev_pop(b) AS sb FROM (SELECT {yj[0]} AS a, {yj[1]} AS b FROM mall))
SELECT 'standard' AS scaler, CAST(z AS DOUBLE) AS z, round(z * si + mi, 6) AS income_k, round(z * ss + ms, 6) AS score FROM pt CROSS JOIN mom
UNION ALL SELECT 'robust', z, round(z * (qi[3] - qi[1]) + qi[2], 6), round(z * (qsc[3] - qsc[1]) + qsc[2], 6) FROM pt CROSS JOIN qs
UNION ALL SELECT 'yeo_johnson', z, round(CASE WHEN z * sa + ma >= 0 THEN {back[0]} ELSE {below[0]} END, 6),
  round(CASE WHEN z * sb + mb >= 0 THEN {back[1]} ELSE {below[1]} END, 6) FROM pt CROSS JOIN m"""
    ranked = []
    for name, expr in (("rule", RULE), ("recency", R_BAND), ("monetary", M_BAND)):
        ranked.append(f"""SELECT * FROM (WITH z AS (SELECT customer_id, (income_k - mi) / si AS x, (score - ms) / ss AS y, {expr} AS lab FROM mall CROSS JOIN mom),
{_dispersion('z', 'lab')} SELECT '{name}' AS labeling, round(db, 6) AS davies, round(ch, 6) AS calinski FROM db, ch)""")
    out["label_ranking"] = f"""{W}, {MOM}, u AS ({' UNION ALL '.join(ranked)})
SELECT *, CAST(row_number() OVER (ORDER BY davies, calinski DESC, labeling) AS INT) AS position FROM u"""
    out["sweep_given"] = f"""{W}, u AS ({' UNION ALL '.join(map(_given_sweep, GIVEN_K))})
SELECT *, k = (SELECT MIN(k) FROM u WHERE silhouette = (SELECT MAX(silhouette) FROM u)) AS best FROM u"""
    out["mixture_steps_given"] = f"{W} {_given_mixture('full')} UNION ALL {_given_mixture('diag')}"
    absent = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("silhouette", "inertia", "aic", "bic"))
    out["candidate_results_document"] = f"""SELECT first_value(labeling) OVER (ORDER BY position) AS model_variant, CAST(position - 1 AS INT) AS place,
  labeling AS variant, 'standard' AS preprocessor, '{",".join(S.FEATURES)}' AS features, davies, calinski, {absent},
  CAST(NULL AS VARCHAR) AS error FROM ({out['label_ranking']})"""
    long_ = f"""lv0 AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding,
      unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
lv AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM lv0),
cen AS (SELECT label, i, AVG(v) AS c FROM lv GROUP BY label, i),
cnt AS (SELECT label, COUNT(DISTINCT vec_id) AS n FROM lv GROUP BY label)"""
    out["embedding_calinski_harabasz"] = f"""WITH {long_},
w AS (SELECT SUM((v - c) * (v - c)) AS w FROM lv JOIN cen ON lv.label = cen.label AND lv.i = cen.i),
gm AS (SELECT cen.i, SUM(n * c) / SUM(n) AS m FROM cen JOIN cnt ON cen.label = cnt.label GROUP BY cen.i),
b AS (SELECT SUM(n * (c - m) * (c - m)) AS b FROM cen JOIN cnt ON cen.label = cnt.label JOIN gm ON cen.i = gm.i),
g AS (SELECT SUM(n) AS nn, COUNT(*) AS k FROM cnt)
SELECT round(CASE WHEN w = 0 THEN 1.0 ELSE (b * (nn - k)) / (w * (k - 1)) END, 6) AS calinski_harabasz FROM w, b, g"""
    out["embedding_davies_bouldin"] = f"""WITH {long_},
d AS (SELECT vec_id, lv.label, sqrt(SUM((v - c) * (v - c))) AS d FROM lv JOIN cen ON lv.label = cen.label AND lv.i = cen.i GROUP BY ALL),
si AS (SELECT label, AVG(d) AS s FROM d GROUP BY label),
cd AS (SELECT a.label AS la, b.label AS lb, sqrt(SUM((a.c - b.c) * (a.c - b.c))) AS dist FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
r AS (SELECT la, MAX(CASE WHEN dist > 0 THEN (sa.s + sb.s) / dist ELSE 0.0 END) AS worst FROM cd JOIN si sa ON cd.la = sa.label JOIN si sb ON cd.lb = sb.label GROUP BY la)
SELECT round(AVG(worst), 6) AS davies_bouldin FROM r"""
    out["embedding_silhouette"] = f"""WITH lv0 AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding,
      unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
lv AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM lv0),
pd AS (SELECT a.vec_id AS va, a.label AS la, b.vec_id AS vb, b.label AS lb, sqrt(SUM((a.v - b.v) * (a.v - b.v))) AS d
      FROM lv a JOIN lv b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
sz AS (SELECT label, COUNT(DISTINCT vec_id) AS n FROM lv GROUP BY label),
m AS (SELECT va, la, lb, SUM(d) AS sd FROM pd GROUP BY ALL),
ab AS (SELECT va, la, MAX(CASE WHEN la = lb THEN sd / (n - 1) END) AS a, MIN(CASE WHEN la <> lb THEN sd / n END) AS b
      FROM m JOIN sz ON m.lb = sz.label GROUP BY ALL),
s AS (SELECT v.vec_id, CASE WHEN sz.n <= 1 OR ab.a IS NULL THEN 0.0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS s
      FROM (SELECT DISTINCT vec_id, label FROM lv) v JOIN sz ON v.label = sz.label LEFT JOIN ab ON v.vec_id = ab.va)
SELECT round(AVG(s), 6) AS silhouette FROM s"""
    out["stream_segment_counts"] = f"""WITH {SEG}
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, segment,
  COUNT(*) AS events FROM events JOIN seg ON events.user_id + 1 = seg.customer_id GROUP BY ALL"""
    out["stream_segment_counts_append"] = out["stream_segment_counts"]
    out["stream_segment_counts_late"] = f"""WITH {SEG},
b AS (SELECT epoch_us(MIN(ts)) AS lo, epoch_us(MAX(ts)) AS hi FROM events),
a AS (SELECT ts, user_id, CAST(floor((epoch_us(ts) - lo) * {SPANS} / (hi - lo + 1)) AS INT)
      + CASE WHEN event_id % 37 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS arrival FROM events CROSS JOIN b),
w AS (SELECT arrival, MAX(MAX(epoch_us(ts) // 1000)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - 3600000 AS mark FROM a GROUP BY arrival)
SELECT coalesce(segment, 'Unknown') AS segment, date_trunc('hour', ts) AS window_start,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  COUNT(*) FILTER (mark IS NULL OR epoch_ms(date_trunc('hour', ts)) + 3600000 > mark) AS events,
  COUNT(*) FILTER (epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark) AS late_events
FROM a JOIN w USING (arrival) LEFT JOIN seg ON a.user_id + 1 = seg.customer_id GROUP BY ALL"""
    near_v, _ = _nearest("income_k", "score", "si", "ss")
    out["stream_score"] = f"""WITH {NORM}, {MOM},
good AS (SELECT id_t AS customer_id, income_k_num AS income_k, score_num AS score, c_nationkey FROM normr WHERE reject_reason IS NULL AND c_nationkey <> 24),
g AS (SELECT customer_id, {near_v} AS cluster, c_nationkey FROM good CROSS JOIN mom)
SELECT customer_id, g.cluster, segment, 'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS upload_label,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_nationkey AS BIGINT)) AS arrival_ts
FROM g LEFT JOIN {CMAP} ON g.cluster = cmap.cluster"""
    out["stream_score_redelivered"] = out["stream_score"]
    return out
