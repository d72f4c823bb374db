"""Independent ANSI/DuckDB SQL for the correctness check of every checkable query.

The SQL is written against the driver's views (customer, orders, events,
conversations, ...) and re-derives everything from them; it shares no code
path with the Spark plans, only the fixed values of :mod:`cohortlens.schema`.
"""

from __future__ import annotations

from .. import schema as S
from ..operators import rfm as RFM


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ratio(num: str, den: str, d: int) -> str:
    """Half-up rounding of num/den to d decimals by integer division (den > 0)."""
    return (f"(CAST(((2 * {10 ** d} * CAST({num} AS BIGINT) + CAST({den} AS BIGINT)) // "
            f"(2 * CAST({den} AS BIGINT))) AS DOUBLE) / {10 ** d})")


def pct(part: str, total: str, d: int = 1) -> str:
    return f"(CASE WHEN ({total}) = 0 THEN 0.0 ELSE {ratio(f'(CAST({part} AS BIGINT) * 100)', total, d)} END)"


def iround(num: str, den: str) -> str:
    return f"CAST((2 * CAST({num} AS BIGINT) + CAST({den} AS BIGINT)) // (2 * CAST({den} AS BIGINT)) AS BIGINT)"


RULE = (
    "CASE WHEN income_k >= 70 AND score >= 60 THEN 'VIP Customers' "
    "WHEN income_k >= 40 AND income_k < 70 THEN 'Loyal Customers' "
    "WHEN income_k < 40 AND score >= 55 THEN 'Discount Seekers' "
    "WHEN income_k < 40 AND score < 55 THEN 'At-Risk / Churn' "
    "WHEN income_k >= 70 AND score < 60 THEN 'New Customers' ELSE 'Loyal Customers' END"
)
R_BAND = "CASE WHEN score >= 60 THEN 'High' WHEN score >= 35 THEN 'Moderate' ELSE 'Low' END"
F_BAND = "CASE WHEN age <= 30 THEN 'High' WHEN age <= 45 THEN 'Moderate' ELSE 'Low' END"
M_BAND = "CASE WHEN income_k >= 70 THEN 'High' WHEN income_k >= 45 THEN 'Moderate' ELSE 'Low' END"

MALL = """spend AS (SELECT o_custkey, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents FROM orders
  WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
mx AS (SELECT MAX(cents) AS mc FROM spend),
mall AS (SELECT CAST(c_custkey + 1 AS BIGINT) AS customer_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CAST(18 + c_custkey % 53 AS INT) AS age,
  CAST(15 + FLOOR((c_acctbal + 1000) * 122 / 11000) AS INT) AS income_k,
  CAST(1 + FLOOR(99.0e0 * COALESCE(cents, 0) / mc) AS INT) AS score,
  c_mktsegment, c_nationkey
  FROM customer LEFT JOIN spend ON c_custkey = o_custkey CROSS JOIN mx)"""

SEG = MALL + f""",
seg AS (SELECT customer_id, gender, age, income_k, score,
  CAST(gender = 'Female' AS INT) AS gender_enc, {RULE} AS segment,
  {R_BAND} AS r_proxy, {F_BAND} AS f_proxy, {M_BAND} AS m_proxy FROM mall)"""

ATTRS = "(VALUES " + ", ".join(
    "(" + ", ".join(q(v) for v in (s, S.SEGMENT_COLORS[s], S.SEGMENT_STRATEGIES[s], S.SEGMENT_ACTIONS[s],
                                   S.SEGMENT_BEHAVIOR[s])) + ")"
    for s in S.SEGMENTS) + ") AS attrs(segment, color, strategy, action, rfm_behavior)"

OFFERS = "(VALUES " + ", ".join(
    f"({q(s)}, {q(o)}, {q(S.OFFER_MATCH[s][i])})" for s in S.SEGMENTS for i, o in enumerate(S.OFFERS)
) + ") AS offers(segment, offer, level)"

NA_LIST = ", ".join(q(t) for t in S.NA_TOKENS)


def _num(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR {x} IN ({NA_LIST}) OR isnan(TRY_CAST({x} AS DOUBLE)) THEN NULL "
            f"ELSE TRY_CAST({x} AS DOUBLE) END)")


def _gender_norm(x: str) -> str:
    stripped = f"regexp_replace(regexp_replace({x}, '^[\\s\\x{{00A0}}]+', ''), '[\\s\\x{{00A0}}]+$', '')"
    return (f"(CASE WHEN {x} IS NULL OR {x} IN ({NA_LIST}) THEN 'Nan' "
            f"ELSE upper(left({stripped}, 1)) || lower(substr({stripped}, 2)) END)")


RAW = MALL + """,
raw AS (SELECT
  CASE WHEN customer_id % 211 = 17 THEN 'C' || CAST(customer_id AS VARCHAR) ELSE CAST(customer_id AS VARCHAR) END AS "CustomerID",
  CASE WHEN customer_id % 97 = 5 THEN c_mktsegment WHEN customer_id % 89 = 3 THEN NULL
       WHEN customer_id % 83 = 2 THEN 'NA' WHEN customer_id % 10 = 1 THEN upper(gender)
       WHEN customer_id % 10 = 2 THEN ' ' || lower(gender) || ' ' WHEN customer_id % 10 = 3 THEN lower(gender) || chr(9)
       WHEN customer_id % 10 = 4 THEN chr(160) || gender || chr(160)
       ELSE gender END AS "Gender",
  CASE WHEN customer_id % 131 = 4 THEN '101' WHEN customer_id % 127 = 9 THEN 'NA'
       WHEN customer_id % 109 = 11 THEN CAST(age AS VARCHAR) || 'd'
       WHEN customer_id % 7 = 3 THEN CAST(age AS VARCHAR) || '.0' ELSE CAST(age AS VARCHAR) END AS "Age",
  CASE WHEN customer_id % 139 = 6 THEN '-' || CAST(income_k AS VARCHAR) WHEN customer_id % 113 = 5 THEN 'abc'
       WHEN customer_id % 107 = 12 THEN '0x1p3'
       WHEN customer_id % 5 = 4 THEN CAST(income_k AS VARCHAR) || '.0' ELSE CAST(income_k AS VARCHAR) END AS "Annual Income (k$)",
  CASE WHEN customer_id % 149 = 8 THEN '0' WHEN customer_id % 151 = 10 THEN 'NaN'
       ELSE CAST(score AS VARCHAR) END AS "Spending Score (1-100)",
  c_nationkey
  FROM mall)"""

NORM = RAW + f""",
norm0 AS (SELECT "CustomerID" AS customer_id_raw, "Gender" AS gender_raw, "Age" AS age_raw,
  "Annual Income (k$)" AS income_k_raw, "Spending Score (1-100)" AS score_raw,
  {_gender_norm('"Gender"')} AS gender,
  {_num('"CustomerID"')} AS customer_id_num, {_num('"Age"')} AS age_num,
  {_num('"Annual Income (k$)"')} AS income_k_num, {_num('"Spending Score (1-100)"')} AS score_num,
  c_nationkey
  FROM raw),
norm1 AS (SELECT *, TRY_CAST(trunc(customer_id_num) AS BIGINT) AS id_t, TRY_CAST(trunc(age_num) AS BIGINT) AS age_t FROM norm0),
norm AS (SELECT *,
  gender NOT IN ('Female', 'Male') AS gender_bad,
  (customer_id_num IS NULL OR age_num IS NULL OR income_k_num IS NULL OR score_num IS NULL
   OR isinf(customer_id_num) OR isinf(age_num) OR isinf(income_k_num) OR isinf(score_num)
   OR (customer_id_num IS NOT NULL AND id_t IS NULL)) AS numeric_bad,
  CASE WHEN age_t IS NULL THEN age_num IS NOT NULL ELSE NOT (age_t BETWEEN 1 AND 100) END AS age_bad,
  income_k_num < 0 AS income_bad,
  NOT (score_num BETWEEN 1 AND 100) AS score_bad
  FROM norm1),
normr AS (SELECT *, CASE WHEN gender_bad THEN 'invalid_gender' WHEN numeric_bad THEN 'invalid_numeric'
  WHEN age_bad THEN 'age_out_of_range' WHEN income_bad THEN 'negative_income'
  WHEN score_bad THEN 'score_out_of_range' END AS reject_reason FROM norm)"""


def _seg_agg() -> str:
    return ("a AS (SELECT segment, COUNT(*) AS n, SUM(income_k) AS si, SUM(score) AS ss, SUM(age) AS sa, "
            "COUNT(*) FILTER (WHERE gender = 'Female') AS fe, COUNT(*) FILTER (WHERE score >= 60) AS hr, "
            "COUNT(*) FILTER (WHERE age <= 30) AS hf, COUNT(*) FILTER (WHERE income_k >= 70) AS hm, "
            "SUM(income_k * score) AS rev FROM seg GROUP BY segment), t AS (SELECT SUM(n) AS total FROM a)")


def _lvl(letter: str) -> str:
    return (f"CASE WHEN instr(rfm_behavior, 'High {letter}') > 0 THEN 'High' "
            f"WHEN instr(rfm_behavior, 'Low {letter}') > 0 THEN 'Low' ELSE 'Moderate' END")


RFM_CTE = f"""lastd AS (SELECT MAX(CAST(o_orderdate AS DATE)) AS d FROM orders),
per AS (SELECT o_custkey, MAX(CAST(o_orderdate AS DATE)) AS last_order, COUNT(*) AS frequency,
  SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY o_custkey),
rfm AS (SELECT CAST(o_custkey + 1 AS BIGINT) AS customer_id, last_order,
  CAST(date_diff('day', last_order, d) AS INT) AS recency_days, frequency,
  CAST(cents AS DOUBLE) / 100.0 AS monetary FROM per CROSS JOIN lastd),
bands AS (SELECT customer_id, recency_days, frequency, monetary,
  CASE WHEN recency_days <= {RFM.RECENCY_HIGH_DAYS} THEN 'High' WHEN recency_days <= {RFM.RECENCY_MODERATE_DAYS} THEN 'Moderate' ELSE 'Low' END AS r_band,
  CASE WHEN frequency >= {RFM.FREQUENCY_HIGH} THEN 'High' WHEN frequency >= {RFM.FREQUENCY_MODERATE} THEN 'Moderate' ELSE 'Low' END AS f_band,
  CASE WHEN monetary >= {RFM.MONETARY_HIGH} THEN 'High' WHEN monetary >= {RFM.MONETARY_MODERATE} THEN 'Moderate' ELSE 'Low' END AS m_band
  FROM rfm)"""


def report_sql() -> dict[str, str]:
    W = f"WITH {SEG}"
    WA = f"WITH {SEG}, {_seg_agg()}"
    out: dict[str, str] = {}
    out["rule_segment"] = f"WITH {MALL} SELECT customer_id, income_k, score, {RULE} AS segment FROM mall"
    out["gender_enc"] = f"WITH {MALL} SELECT customer_id, gender, CAST(gender = 'Female' AS INT) AS gender_enc FROM mall"
    out["rfm_bands"] = f"{W} SELECT customer_id, r_proxy, f_proxy, m_proxy, segment AS rfm_segment FROM seg"
    out["segment_stats"] = f"""{WA}
SELECT a.segment, n, {pct('n', 'total')} AS pct, {ratio('si', 'n', 3)} AS avg_income,
  {ratio('ss', 'n', 3)} AS avg_score, {ratio('sa', 'n', 1)} AS avg_age, {pct('fe', 'n')} AS female_pct,
  {ratio('si', 'n', 1)} AS cx, {ratio('ss', 'n', 1)} AS cy, color, strategy, action, rfm_behavior
FROM a CROSS JOIN t LEFT JOIN {ATTRS} ON a.segment = attrs.segment"""
    out["overview"] = f"""{W}
SELECT COUNT(*) AS total, {ratio('SUM(income_k)', 'COUNT(*)', 1)} AS avg_income,
  {ratio('SUM(score)', 'COUNT(*)', 1)} AS avg_score, {ratio('SUM(age)', 'COUNT(*)', 1)} AS avg_age,
  {pct("COUNT(*) FILTER (WHERE gender = 'Female')", 'COUNT(*)')} AS female_pct FROM seg"""
    out["cluster_balance"] = f"""{WA}
SELECT a.segment, n AS count, {pct('n', 'total')} AS pct, color FROM a CROSS JOIN t LEFT JOIN {ATTRS} ON a.segment = attrs.segment"""
    out["rfm_high_pct"] = f"""{WA}
SELECT segment, n, {pct('n', 'total')} AS pct, {pct('hr', 'n')} AS high_r_pct, {pct('hf', 'n')} AS high_f_pct,
  {pct('hm', 'n')} AS high_m_pct FROM a CROSS JOIN t"""
    out["revenue_share"] = f"""{W}, r AS (SELECT segment, CAST(SUM(income_k * score) AS BIGINT) AS rev FROM seg GROUP BY segment),
tr AS (SELECT SUM(rev) AS total FROM r)
SELECT segment, rev / 100 AS revenue, {pct('rev', 'total')} AS rev_share_pct FROM r CROSS JOIN tr"""
    out["impact_summary"] = f"""{W}, c AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE segment = 'At-Risk / Churn') AS at_risk_count,
  COUNT(*) FILTER (WHERE segment = 'VIP Customers') AS vip_count FROM seg)
SELECT total, at_risk_count, vip_count, {pct('vip_count', 'total')} AS vip_pct, {pct('at_risk_count', 'total')} AS at_risk_pct,
  greatest(total - vip_count, 0) AS wrong_offer_count, {pct('greatest(total - vip_count, 0)', 'total')} AS efficiency_waste_pct FROM c"""
    out["gender_split"] = f"""{W}, g AS (SELECT segment, COUNT(*) AS n, COUNT(*) FILTER (WHERE gender = 'Female') AS female FROM seg GROUP BY segment),
g2 AS (SELECT *, (2000 * female + n) // (2 * n) AS tenths FROM g)
SELECT segment, female, n - female AS male, CAST(tenths AS DOUBLE) / 10 AS female_pct,
  CAST((2 * (1000 - tenths) + 10) // 20 AS BIGINT) AS male_pct FROM g2"""
    out["at_risk_profile"] = f"""{W}, r AS (SELECT COUNT(*) AS n, SUM(income_k) AS si, SUM(score) AS ss, SUM(age) AS sa
  FROM seg WHERE segment = 'At-Risk / Churn')
SELECT n AS at_risk_count, CASE WHEN n > 0 THEN {iround('si', 'n')} END AS avg_income,
  CASE WHEN n > 0 THEN {iround('ss', 'n')} END AS avg_score, CASE WHEN n > 0 THEN {iround('sa', 'n')} END AS avg_age FROM r"""
    out["segment_distribution"] = f"""{WA}
SELECT segment, n, {iround('100 * n', 'total')} AS share_pct FROM a CROSS JOIN t"""
    out["segment_list"] = f"""{W}
SELECT 'All' AS segment, 0 AS position
UNION ALL SELECT segment, CAST(row_number() OVER (ORDER BY segment) AS INT) AS position FROM (SELECT DISTINCT segment FROM seg)"""
    out["feature_moments"] = f"""WITH {MALL}
SELECT round(avg(income_k), 6) AS mean_income_k, round(stddev_pop(income_k), 6) AS std_income_k,
  round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM mall"""
    out["segment_profile"] = f"""{WA}, m AS (SELECT segment, n, (2000 * si + n) // (2 * n) AS milli FROM a)
SELECT segment, n, CAST(milli AS DOUBLE) / 1000 AS avg_income, {ratio('milli', str(S.INCOME_SCALE_MAX * 10), 1)} AS income_bar_pct FROM m"""
    out["campaign_fit"] = f"""{WA}
SELECT segment, n, {pct('n', 'total')} AS share_pct, CASE WHEN segment = 'VIP Customers' THEN 'OK' ELSE 'MISS' END AS fit FROM a CROSS JOIN t"""
    out["campaign_audience"] = f"""{WA}
SELECT offer, CAST(SUM(n) AS BIGINT) AS audience, string_agg(a.segment, ', ' ORDER BY a.segment) AS segments
FROM a JOIN {OFFERS} ON a.segment = offers.segment WHERE level = 'High' GROUP BY offer"""
    out["rfm_criteria"] = f"""{W}
SELECT attrs.segment, rfm_behavior, {_lvl('R')} AS recency, {_lvl('F')} AS frequency, {_lvl('M')} AS monetary,
  strategy AS rfm_strategy FROM (SELECT DISTINCT segment FROM seg) s JOIN {ATTRS} ON s.segment = attrs.segment"""
    out["segment_attributes"] = f"""{W}
SELECT customer_id, seg.segment, color, strategy, action, rfm_behavior FROM seg LEFT JOIN {ATTRS} ON seg.segment = attrs.segment"""
    out["context_summary"] = f"""{WA}
SELECT CAST(SUM(n) AS BIGINT) AS rows, 'Dataset: customer+orders' || chr(10) || 'Rows: ' || CAST(SUM(n) AS VARCHAR) || chr(10) || 'Segments:' || chr(10) || '- ' ||
  string_agg(segment || ': ' || CAST(n AS VARCHAR) || ' customers, avg income ' || CAST({ratio('si', 'n', 3)} AS VARCHAR)
    || 'k, avg score ' || CAST({ratio('ss', 'n', 3)} AS VARCHAR), chr(10) || '- ' ORDER BY segment) AS context FROM a"""
    cols = "customer_id, gender, age, income_k, score, segment"
    out["customers_by_segment"] = f"{W} SELECT {cols} FROM seg WHERE segment = 'VIP Customers'"
    out["customer_lookup"] = f"{W} SELECT {cols} FROM seg WHERE customer_id = 42"
    out["customer_lookup_published"] = out["customer_lookup"]
    out["similar_customers_published"] = f"{W} SELECT {cols} FROM seg WHERE segment = {q(S.LOYAL)} ORDER BY customer_id LIMIT {S.SIMILAR_LIMIT}"
    out["at_risk_list"] = f"""{W}
SELECT customer_id, gender, age, income_k, score, r_proxy, f_proxy FROM seg WHERE segment = 'At-Risk / Churn'
ORDER BY customer_id LIMIT {S.AT_RISK_LIST_LIMIT}"""
    out["known_segments"] = f"""{W}
SELECT customer_id, segment FROM seg WHERE segment IN (SELECT segment FROM {ATTRS})"""
    out["similar_customers"] = f"""{W}, r AS (SELECT {cols}, CAST(row_number() OVER (PARTITION BY segment ORDER BY customer_id) AS INT) AS rank FROM seg)
SELECT * FROM r WHERE rank <= {S.SIMILAR_LIMIT}"""
    out["chat_window"] = f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= {S.CHAT_HISTORY_LIMIT}"""

    # ---- validation ----
    N = f"WITH {NORM}"
    g_prefix = S.MSG_GENDER.split("{found}")[0]
    out["validation_summary"] = f"""{N},
found AS (SELECT string_agg(g, ', ' ORDER BY g) AS f FROM (SELECT DISTINCT gender AS g FROM norm WHERE gender_bad ORDER BY g LIMIT 5)),
c AS (SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE gender_bad) AS invalid_gender_rows,
  COUNT(*) FILTER (WHERE numeric_bad) AS invalid_numeric_rows, COUNT(*) FILTER (WHERE age_bad) AS age_out_of_range_rows,
  COUNT(*) FILTER (WHERE income_bad) AS negative_income_rows, COUNT(*) FILTER (WHERE score_bad) AS score_out_of_range_rows FROM norm)
SELECT c.*, COALESCE(f, '') AS invalid_genders,
  CASE WHEN total_rows = 0 THEN {q(S.MSG_EMPTY)} WHEN total_rows < {S.MIN_ROWS} THEN {q(S.MSG_TOO_FEW)}
       WHEN invalid_gender_rows > 0 THEN {q(g_prefix)} || COALESCE(f, '')
       WHEN invalid_numeric_rows > 0 THEN {q(S.MSG_NUMERIC)} WHEN age_out_of_range_rows > 0 THEN {q(S.MSG_AGE)}
       WHEN negative_income_rows > 0 THEN {q(S.MSG_INCOME)} WHEN score_out_of_range_rows > 0 THEN {q(S.MSG_SCORE)} END AS message
FROM c CROSS JOIN found"""
    out["gender_normalise"] = f"{N} SELECT customer_id_raw, gender FROM norm"
    out["invalid_genders"] = f"{N} SELECT DISTINCT gender AS invalid_gender FROM norm WHERE gender_bad ORDER BY 1 LIMIT 5"
    out["numeric_coerce"] = f"{N} SELECT customer_id_raw, customer_id_num, age_num, income_k_num, score_num FROM norm"
    out["quarantine"] = f"""{N}
SELECT customer_id_raw AS "CustomerID", gender_raw AS "Gender", age_raw AS "Age", income_k_raw AS "Annual Income (k$)",
  score_raw AS "Spending Score (1-100)", reject_reason FROM normr WHERE reject_reason IS NOT NULL"""
    out["validated_customers"] = f"""{N}
SELECT id_t AS customer_id, gender, CAST(age_t AS SMALLINT) AS age, income_k_num AS income_k, score_num AS score
FROM normr WHERE reject_reason IS NULL"""
    out["dataset_health"] = f"""{N}
SELECT CAST(COUNT(*) / 5 AS BIGINT) AS dataset_rows, CAST(5 AS BIGINT) AS dataset_cols,
  CAST(SUM(CASE WHEN v IS NULL OR v IN ({NA_LIST}) THEN 1 ELSE 0 END) AS BIGINT) AS missing_values
FROM (SELECT unnest(["CustomerID", "Gender", "Age", "Annual Income (k$)", "Spending Score (1-100)"]) AS v FROM raw)"""

    out["scan_customers"] = out["validated_customers"]
    out["write_required_projection"] = f"""WITH {MALL}
SELECT customer_id, gender, CAST(age AS SMALLINT) AS age, CAST(income_k AS DOUBLE) AS income_k,
  CAST(score AS DOUBLE) AS score FROM mall"""
    out["write_segmented"] = f"""{W}
SELECT customer_id, gender, age, income_k, score, gender_enc, segment, r_proxy, f_proxy, m_proxy,
  segment AS rfm_segment FROM seg"""
    out["landing_ingest"] = f"""{N}
SELECT 'nation_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS upload_label,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_nationkey AS BIGINT)) AS arrival_ts,
  COUNT(*) AS rows, COUNT(*) FILTER (WHERE reject_reason IS NULL AND c_nationkey <> 24) AS valid_rows
FROM normr GROUP BY ALL"""

    # ---- RFM and drift ----
    out["true_rfm"] = f"WITH {RFM_CTE} SELECT customer_id, last_order, recency_days, frequency, monetary FROM rfm"
    out["true_rfm_bands"] = f"WITH {RFM_CTE} SELECT * FROM bands"
    out["rfm_cube"] = f"""WITH {RFM_CTE}
SELECT r_band, f_band, m_band, CAST(GROUPING(r_band, f_band, m_band) AS INT) AS grouping_level, COUNT(*) AS customers
FROM bands GROUP BY CUBE (r_band, f_band, m_band)"""
    out["segment_drift"] = f"""{W},
pc AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, COUNT(*) AS o FROM orders GROUP BY ALL),
c AS (SELECT quarter, segment, COUNT(*) AS customers, CAST(SUM(o) AS BIGINT) AS orders FROM pc JOIN seg ON pc.o_custkey + 1 = seg.customer_id GROUP BY ALL)
SELECT quarter, segment, customers, orders, lag(customers) OVER (PARTITION BY segment ORDER BY quarter) AS prev_customers,
  customers - lag(customers) OVER (PARTITION BY segment ORDER BY quarter) AS change FROM c"""
    out["rfm_incremental"] = out["true_rfm"]
    out["segment_drift_as_of"] = f"""WITH h AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS TIMESTAMP) AS valid_from,
  SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
j AS (SELECT o.o_custkey, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS quarter,
  CASE WHEN cents >= {RFM.QUARTER_HIGH * 100} THEN 'High' WHEN cents >= {RFM.QUARTER_MODERATE * 100} THEN 'Moderate' WHEN cents IS NULL THEN 'New' ELSE 'Low' END AS held
  FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate >= h.valid_from),
c AS (SELECT quarter, held, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) AS orders FROM j GROUP BY ALL)
SELECT quarter, held, customers, orders, lag(customers) OVER (PARTITION BY held ORDER BY quarter) AS prev_customers,
  customers - lag(customers) OVER (PARTITION BY held ORDER BY quarter) AS change FROM c"""
    out["segment_drift_wide"] = f"""{W},
pc AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders GROUP BY ALL),
c AS (SELECT quarter, segment, COUNT(*) AS customers FROM pc JOIN seg ON pc.o_custkey + 1 = seg.customer_id GROUP BY ALL)
SELECT quarter, """ + ", ".join(
        f"MAX(CASE WHEN segment = {q(s)} THEN customers END) AS \"{s}\"" for s in S.SEGMENTS) + """
FROM c GROUP BY quarter"""
    return out


def oracle_sql() -> dict[str, str]:
    out = report_sql()
    from . import oracle_models
    out.update(oracle_models.model_sql())
    return out
