"""Independent SQL statements (DuckDB dialect) for the SQL-checkable queries.

They run on the driver tables ``customer`` and ``orders``; the subscriber
view text is the one of FIXTURES.md.  They are written as plain SQL with
global windows and exact ``median`` because they only serve as a check on
small data; the Spark side is built for scale.
"""

from __future__ import annotations

from churnlens import schema as S

SUBS = """
WITH o AS (SELECT o_custkey, max(o_orderdate) AS last_d FROM orders
           WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT c_custkey AS k, c_name AS customer_id,
  CAST(coalesce((2001 - year(last_d)) * 12 + 8 - month(last_d), 0) AS INT) AS tenure,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'One year' WHEN 'MACHINERY' THEN 'Two year'
       ELSE 'Month-to-month' END AS contract,
  CASE c_nationkey % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS internet_service,
  18.25e0 + ((c_custkey * 37) % 401) * 0.25e0 AS monthly_charges
  FROM customer LEFT JOIN o ON o_custkey = c_custkey),
subs AS (SELECT b.*,
  CASE WHEN tenure = 0 THEN ' ' WHEN k % 211 = 5 THEN '0'
       ELSE CAST(tenure * monthly_charges AS VARCHAR(20)) END AS total_charges_raw,
  CASE WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS online_security,
  CASE WHEN k % 97 = 0 THEN NULL WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS online_backup,
  CASE WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 5 < 2 THEN 'Yes' ELSE 'No' END AS device_protection,
  CASE WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS tech_support,
  CASE WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 11 < 5 THEN 'Yes' ELSE 'No' END AS streaming_tv,
  CASE WHEN internet_service = 'No' THEN 'No internet service' WHEN k % 13 < 6 THEN 'Yes' ELSE 'No' END AS streaming_movies,
  CASE WHEN (k * 61) % 100 < 10
       + CASE WHEN contract = 'Month-to-month' THEN 30 ELSE 0 END
       + CASE WHEN tenure < 12 THEN 15 ELSE 0 END
       + CASE WHEN internet_service = 'Fiber optic' THEN 10 ELSE 0 END
       THEN 'Yes' ELSE 'No' END AS churn,
  (8 + CASE WHEN contract = 'Month-to-month' THEN 40 ELSE 0 END
     + CASE WHEN tenure < 12 THEN 24 ELSE 0 END
     + CASE WHEN internet_service = 'Fiber optic' THEN 16 ELSE 0 END
     + (k * 29) % 41) / 128e0 AS score
  FROM b)"""


def _cut(col: str, edges, labels) -> str:
    parts = " ".join(
        f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'" for lo, hi, lab in zip(edges[:-1], edges[1:], labels)
    )
    return f"CASE {parts} END"


_SVC = " + ".join(
    f"CASE WHEN coalesce({c} NOT IN ('No', 'No internet service'), true) THEN 1 ELSE 0 END"
    for c in S.SERVICE_COLUMNS
)

FEAT = (
    SUBS
    + """,
parsed AS (SELECT *, TRY_CAST(trim(total_charges_raw) AS DOUBLE) AS tc FROM subs),
med AS (SELECT median(tc) AS m FROM parsed),
clean AS (SELECT p.*, CASE WHEN p.tc IS NULL OR p.tc = 0 THEN med.m ELSE p.tc END AS total_charges
          FROM parsed p CROSS JOIN med),
feat AS (SELECT *,
  CASE churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_label,
  """
    + _cut("tenure", S.TENURE_EDGES, S.TENURE_LABELS)
    + """ AS tenure_group,
  """
    + _cut("monthly_charges", S.CHARGES_EDGES, S.CHARGES_LABELS)
    + """ AS charges_group,
  CASE WHEN contract = 'Month-to-month' AND tenure < 12 THEN 'High'
       WHEN contract = 'Month-to-month' AND tenure >= 12 THEN 'Medium' ELSE 'Low' END AS risk_segment,
  ("""
    + _SVC
    + """) AS service_count,
  CASE WHEN monthly_charges > 70 AND contract = 'Two year' THEN 1 ELSE 0 END AS high_value,
  """
    + _cut("total_charges", S.TOTAL_EDGES, S.TOTAL_LABELS)
    + """ AS total_charges_group
  FROM clean),
sc AS (SELECT *, score AS churn_probability, """
    + _cut("score", S.RISK_BAND_EDGES, S.RISK_BAND_LABELS)
    + """ AS churn_risk FROM feat)
"""
)

TENURE_BINS = "(VALUES " + ", ".join(f"('{lab}', {i})" for i, lab in enumerate(S.TENURE_LABELS)) + ") AS bins(tenure_group, ord)"
CHARGES_BINS = "(VALUES " + ", ".join(f"('{lab}', {i})" for i, lab in enumerate(S.CHARGES_LABELS)) + ") AS bins(level, ord)"


def _rate_by(key: str) -> str:
    return f"""
SELECT {key}, count(*) AS customers,
       (count(*) FILTER (WHERE churn = 'Yes'))::DOUBLE / count(*) * 100 AS churn_rate_pct
FROM feat WHERE {key} IS NOT NULL GROUP BY {key}"""


def _counts_by(key: str) -> str:
    return f"""
SELECT {key}, count(*) FILTER (WHERE churn = 'No') AS n_no, count(*) FILTER (WHERE churn = 'Yes') AS n_yes
FROM feat WHERE {key} IS NOT NULL AND churn IN ('No', 'Yes') GROUP BY {key}"""


SQL: dict[str, str] = {}

# ---- sources and projections ---------------------------------------------
SQL["subscriber_scan"] = FEAT + """
SELECT customer_id, tenure, contract, internet_service, monthly_charges, tc AS total_charges_parsed,
       online_security, online_backup, device_protection, tech_support, streaming_tv, streaming_movies, churn
FROM feat"""

SQL["dataset_profile"] = SUBS + """
SELECT count(*) AS n_rows, 15 AS n_columns FROM subs"""

SQL["csv_quarantine"] = SUBS + """
SELECT CASE WHEN k % 107 = 9 OR k % 103 = 8 THEN 'quarantine: fields' WHEN k % 101 = 7 THEN 'quarantine: value' ELSE 'rows' END AS kind,
       count(*) AS n_rows
FROM subs GROUP BY 1"""

SQL["missing_count"] = SUBS + """
SELECT count(*) FILTER (WHERE TRY_CAST(trim(total_charges_raw) AS DOUBLE) IS NULL) AS missing_total_charges,
       count(*) AS n_rows FROM subs"""

SQL["lenient_cast"] = FEAT + """
SELECT customer_id, tc AS total_charges_parsed FROM feat"""

SQL["impute_total_charges"] = FEAT + """
SELECT customer_id, total_charges FROM feat"""

SQL["label_map"] = FEAT + """
SELECT customer_id, churn, churn_label FROM feat"""

SQL["tenure_group"] = FEAT + """
SELECT customer_id, tenure, tenure_group FROM feat"""

SQL["charges_group"] = FEAT + """
SELECT customer_id, monthly_charges, charges_group FROM feat"""

SQL["total_charges_group"] = FEAT + """
SELECT customer_id, total_charges, total_charges_group FROM feat"""

SQL["risk_segment"] = FEAT + """
SELECT customer_id, contract, tenure, risk_segment FROM feat"""

SQL["service_count"] = FEAT + """
SELECT customer_id, service_count FROM feat"""

SQL["high_value_flag"] = FEAT + """
SELECT customer_id, monthly_charges, contract, high_value FROM feat"""

# ---- descriptive ----------------------------------------------------------
SQL["churn_distribution"] = FEAT + """
, g AS (SELECT churn, count(*) AS customers FROM feat WHERE churn IS NOT NULL GROUP BY churn)
SELECT churn, customers, customers / (SELECT sum(customers) FROM g)::DOUBLE * 100 AS share_pct FROM g"""

SQL["churn_revenue"] = FEAT + """
, g AS (SELECT churn, sum(monthly_charges) AS monthly_revenue FROM feat WHERE churn IS NOT NULL GROUP BY churn)
SELECT churn, monthly_revenue, monthly_revenue / (SELECT sum(monthly_revenue) FROM g) * 100 AS share_pct FROM g"""

SQL["charges_churn_count"] = FEAT + _counts_by("monthly_charges")
SQL["contract_churn_count"] = FEAT + _counts_by("contract")
SQL["tenure_churn_count"] = FEAT + f"""
, c AS ({_counts_by("tenure_group")})
SELECT bins.tenure_group, CAST(array_position({list(S.TENURE_LABELS)}, bins.tenure_group) - 1 AS INT) AS tenure_group_order, coalesce(c.n_no, 0) AS n_no, coalesce(c.n_yes, 0) AS n_yes
FROM {TENURE_BINS} LEFT JOIN c ON c.tenure_group = bins.tenure_group"""

SQL["charges_churn_rate"] = FEAT + _rate_by("monthly_charges")
SQL["contract_churn_rate"] = FEAT + _rate_by("contract")
SQL["tenure_churn_rate"] = FEAT + f"""
, r AS ({_rate_by("tenure_group")})
SELECT bins.tenure_group, CAST(array_position({list(S.TENURE_LABELS)}, bins.tenure_group) - 1 AS INT) AS tenure_group_order, coalesce(r.customers, 0) AS customers, r.churn_rate_pct
FROM {TENURE_BINS} LEFT JOIN r ON r.tenure_group = bins.tenure_group"""

SQL["internet_churn_crosstab"] = FEAT + f"""
, c AS ({_counts_by("internet_service")})
SELECT internet_service, n_no / (n_no + n_yes)::DOUBLE * 100 AS no_pct,
       n_yes / (n_no + n_yes)::DOUBLE * 100 AS yes_pct FROM c"""

_SERVICE_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS service, '{t}' AS title, {c} AS level, churn FROM feat"
    for c, t in zip(S.SERVICE_COLUMNS, S.SERVICE_TITLES)
)
_SERVICE_LONG = f"""
, sl AS ({_SERVICE_UNION}),
sr AS (SELECT service, title, level, count(*) AS customers, count(*) FILTER (WHERE churn = 'Yes') AS churned,
              (count(*) FILTER (WHERE churn = 'Yes'))::DOUBLE / count(*) * 100 AS churn_rate_pct
       FROM sl WHERE level IN ('Yes', 'No') GROUP BY service, title, level)"""

SQL["service_churn_rate"] = FEAT + _SERVICE_LONG + """
SELECT service, level, customers, churned, churn_rate_pct,
       replace(replace(title, 'Streaming', 'Stream.'), 'Online', 'Onl.') AS display_name,
       lower(title) AS file_key
FROM sr"""


def _service_wide(value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN service = '{c}' THEN {value} END) AS {c}" for c in S.SERVICE_COLUMNS)
    return FEAT + _SERVICE_LONG + f"""
SELECT level, {cols} FROM sr GROUP BY level"""


SQL["service_rate_wide"] = _service_wide("churn_rate_pct")
SQL["service_count_wide"] = _service_wide("churned")

# ---- scorecard (fixture score in place of a model probability) -------------
SQL["churn_risk_band"] = FEAT + """
SELECT customer_id, churn_probability, churn_risk FROM sc"""


def _profile(dim: str, col: str) -> str:
    return f"""SELECT '{dim}' AS dimension, CAST({col} AS VARCHAR) AS level,
  round_even((count(*) FILTER (WHERE churn = 'Yes'))::DOUBLE / count(*), 4) AS actual_churn_rate,
  round_even(avg(churn_probability), 4) AS avg_churn_probability,
  round_even(avg(monthly_charges), 4) AS avg_monthly_charges,
  count(customer_id) AS customer_count
FROM sc WHERE {col} IS NOT NULL GROUP BY {col}"""


def _profile_sql(dims) -> str:
    body = " UNION ALL ".join(_profile(d, c) for d, c in dims)
    empty = []
    for d, labels in (("Tenure", S.TENURE_LABELS), ("MonthlyCharges", S.CHARGES_LABELS)):
        if d in [x for x, _ in dims]:
            empty += [f"('{d}', '{lab}')" for lab in labels]
    sql = FEAT + f", prof AS ({body})\nSELECT * FROM prof"
    if empty:
        sql += f"""
UNION ALL
SELECT v.dimension, v.level, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0::BIGINT
FROM (VALUES {", ".join(empty)}) AS v(dimension, level)
WHERE NOT EXISTS (SELECT 1 FROM prof WHERE prof.dimension = v.dimension AND prof.level = v.level)"""
    return sql


SQL["segment_profile"] = _profile_sql(S.PROFILE_DIMENSIONS)
for _key, (_dim, _col) in zip(
    ["segment_tenure", "segment_contract", "segment_charges", "segment_internet", "segment_risk"],
    S.PROFILE_DIMENSIONS,
):
    SQL[_key] = _profile_sql([(_dim, _col)])

_HR = FEAT + """
, hr AS (SELECT *, monthly_charges AS monthly_revenue_at_risk FROM sc WHERE churn_risk = 'High')"""

SQL["revenue_at_risk"] = _HR + """
SELECT count(*) AS high_risk_customers, coalesce(sum(monthly_charges), 0e0) AS monthly_revenue_at_risk,
       coalesce(sum(monthly_charges), 0e0) * 12 AS annual_revenue_at_risk FROM hr"""

SQL["high_risk_filter"] = _HR + """
SELECT customer_id, churn_probability, monthly_revenue_at_risk FROM hr"""

_RULES = [
    "contract = 'Month-to-month' AND tenure < 12",
    "monthly_charges > 70 AND contract = 'Month-to-month'",
    "internet_service = 'Fiber optic'",
    "service_count < 2",
    "streaming_tv = 'Yes' OR streaming_movies = 'Yes'",
]
_MEMBERS = " UNION ALL ".join(
    f"SELECT customer_id, churn_probability, monthly_charges, {i} AS segment_id FROM hr WHERE {r}"
    for i, r in enumerate(_RULES, 1)
)
_SEG = _HR + f"""
, mem AS ({_MEMBERS}),
seg AS (SELECT segment_id, count(*) AS customer_count, avg(churn_probability) AS avg_churn_probability,
               sum(monthly_charges) AS monthly_revenue_at_risk FROM mem GROUP BY segment_id)"""

SQL["segment_membership"] = _HR + f"""
, mem AS ({_MEMBERS})
SELECT customer_id, churn_probability, monthly_charges, segment_id FROM mem"""

SQL["retention_segments"] = _SEG + """
SELECT * FROM seg"""

_PLAN_VALUES = ", ".join(
    f"({i}, '{seg}', '{strat}', '{'; '.join(items)}', '{imp}', '{cost}', '{roi}')"
    for i, seg, strat, items, imp, cost, roi in S.RETENTION_PLAN
)
_PLAN = _SEG + f"""
, pd AS (SELECT * FROM (VALUES {_PLAN_VALUES})
         AS t(segment_id, segment, strategy, action_items, expected_impact, cost_per_customer, roi)),
pl AS (SELECT seg.segment_id, segment, customer_count, avg_churn_probability, monthly_revenue_at_risk,
              strategy, action_items, expected_impact, cost_per_customer, roi
       FROM seg JOIN pd ON seg.segment_id = pd.segment_id)"""

SQL["retention_plan"] = _PLAN + """
SELECT * FROM pl"""

SQL["report_lines"] = _PLAN + """
, p AS (SELECT *, row_number() OVER (ORDER BY segment_id) AS pos FROM pl),
k AS (SELECT count(*) AS n, coalesce(sum(monthly_charges), 0e0) AS m FROM hr)
SELECT 'retention' AS section, CAST(pos * 100 + 1 AS INT) AS line_no, 'Segment ' || pos || ': ' || segment AS text FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 2 AS INT), 'Customer Count: ' || format('{:,}', customer_count) FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 3 AS INT), 'Average Churn Probability: ' || format('{:.2f}%', avg_churn_probability * 100) FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 4 AS INT), 'Monthly Revenue At Risk: $' || format('{:,.2f}', monthly_revenue_at_risk) FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 5 AS INT), 'Strategy: ' || strategy FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 9 + i AS INT), '  • ' || string_split(action_items, '; ')[i]
  FROM p, LATERAL (SELECT unnest(range(1, len(string_split(action_items, '; ')) + 1)) AS i)
UNION ALL SELECT 'retention', CAST(pos * 100 + 30 AS INT), 'Expected Impact: ' || expected_impact FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 31 AS INT), 'Cost per Customer: ' || cost_per_customer FROM p
UNION ALL SELECT 'retention', CAST(pos * 100 + 32 AS INT), 'ROI: ' || roi FROM p
UNION ALL SELECT 'summary', 1, 'Total High-Risk Customers: ' || format('{:,}', n) FROM k
UNION ALL SELECT 'summary', 2, 'Total Monthly Revenue At Risk: $' || format('{:,.2f}', m) FROM k
UNION ALL SELECT 'summary', 3, 'Annual Revenue At Risk: $' || format('{:,.2f}', m * 12) FROM k"""

EXTRACT_FEATURES = [
    "tenure", "internet_service", "online_security", "online_backup", "device_protection", "tech_support",
    "streaming_tv", "streaming_movies", "contract", "monthly_charges", "total_charges",
    "tenure_group", "charges_group", "risk_segment", "service_count", "total_charges_group", "high_value",
]
_EXTRACT_EXTRA = [c for c in EXTRACT_FEATURES if c not in
                  ("customer_id", "churn_probability", "churn_risk", "contract", "tenure", "monthly_charges",
                   "internet_service", "monthly_revenue_at_risk")]
SQL["high_risk_extract"] = _HR + f"""
SELECT customer_id, churn_probability, churn_risk, contract, tenure, monthly_charges, internet_service,
       monthly_revenue_at_risk, {", ".join(_EXTRACT_EXTRA)}
FROM hr ORDER BY churn_probability DESC, customer_id ASC LIMIT 1000"""

# ---- split and metrics (test split of the scorecard) -----------------------
_SPLIT = FEAT + """
, lab AS (SELECT *, md5(customer_id || '#42') AS h FROM sc WHERE churn_label IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY churn_label ORDER BY h, customer_id) AS rn,
              count(*) OVER (PARTITION BY churn_label) AS cn FROM lab),
sp AS (SELECT *, CASE WHEN rn <= round(cn * 0.2) THEN 'test' ELSE 'train' END AS split FROM rk),
te AS (SELECT * FROM sp WHERE split = 'test' AND churn_probability IS NOT NULL)"""

SQL["stratified_split"] = _SPLIT + """
SELECT customer_id, churn_label, split FROM sp"""

SQL["scored_rows"] = _SPLIT + """
SELECT split, churn_label, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unscored FROM sp GROUP BY split, churn_label"""

SQL["split_balance"] = _SPLIT + """
SELECT split, count(*) AS n_rows, avg(churn_label::DOUBLE) AS churn_rate FROM sp GROUP BY split"""

_CC = _SPLIT + """
, cc AS (SELECT count(*) AS n,
   count(*) FILTER (WHERE churn_label = 1 AND churn_probability > 0.5) AS tp,
   count(*) FILTER (WHERE churn_label = 0 AND churn_probability > 0.5) AS fp,
   count(*) FILTER (WHERE churn_label = 1 AND NOT churn_probability > 0.5) AS fn,
   count(*) FILTER (WHERE churn_label = 0 AND NOT churn_probability > 0.5) AS tn FROM te),
mt AS (SELECT n, tp, fp, fn, tn,
   coalesce((tp + tn)::DOUBLE / nullif(n, 0)::DOUBLE, 0e0) AS accuracy,
   coalesce(tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE, 0e0) AS precision,
   coalesce(tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE, 0e0) AS recall,
   coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0e0) AS f1_score FROM cc),
t AS (SELECT churn_probability AS score, count(*) FILTER (WHERE churn_label = 1) AS pos,
             count(*) FILTER (WHERE churn_label = 0) AS neg FROM te GROUP BY churn_probability),
c AS (SELECT score, pos, neg,
   sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
   sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
   row_number() OVER (ORDER BY score DESC) - 1 AS idx,
   lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM t),
au AS (SELECT sum(pos::DOUBLE * (2 * (N - fps) + neg)::DOUBLE) / (2e0 * max(P)::DOUBLE * max(N)::DOUBLE) AS auc FROM c)"""

SQL["classification_metrics"] = _CC + """
SELECT * FROM mt"""

SQL["confusion_matrix"] = _CC + """
SELECT 0 AS actual, 0 AS predicted, tn AS count FROM cc UNION ALL
SELECT 0, 1, fp FROM cc UNION ALL SELECT 1, 0, fn FROM cc UNION ALL SELECT 1, 1, tp FROM cc"""

SQL["roc_curve"] = _CC + """
SELECT 'Infinity'::DOUBLE AS threshold, 0e0 AS fpr, 0e0 AS tpr
UNION ALL
SELECT score, fps::DOUBLE / N::DOUBLE, tps::DOUBLE / P::DOUBLE FROM c
WHERE idx = 0 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"""

SQL["roc_auc"] = _CC + """
SELECT auc FROM au"""

SQL["evaluation_table"] = _CC + """
SELECT 'Accuracy' AS metric, accuracy AS value FROM mt UNION ALL
SELECT 'Precision', precision FROM mt UNION ALL SELECT 'Recall', recall FROM mt UNION ALL
SELECT 'F1 Score', f1_score FROM mt UNION ALL SELECT 'AUC', auc FROM au"""

# ---- model inputs ----------------------------------------------------------
SQL["model_features"] = FEAT + """
SELECT customer_id, tenure, contract, internet_service, monthly_charges, online_security, online_backup,
       device_protection, tech_support, streaming_tv, streaming_movies, total_charges, tenure_group,
       charges_group, risk_segment, service_count, high_value, total_charges_group
FROM feat"""

_CATS = ["contract", "internet_service", "online_security", "online_backup", "device_protection", "tech_support",
         "streaming_tv", "streaming_movies", "tenure_group", "charges_group", "risk_segment", "total_charges_group"]
SQL["label_encode"] = FEAT + """
SELECT customer_id, """ + ",\n       ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}" for c in _CATS
) + """
FROM feat"""

SQL["plan_action_text"] = _PLAN + """
SELECT segment_id, segment, action_items FROM pl"""

SQL["service_display_name"] = FEAT + _SERVICE_LONG + """
SELECT DISTINCT service, replace(replace(title, 'Streaming', 'Stream.'), 'Online', 'Onl.') AS display_name,
       lower(title) AS file_key
FROM sr"""


SQL["report_tables"] = f"""
SELECT 'evaluation' AS section,
       CAST(array_position({S.METRIC_NAMES}, metric) AS INT) AS line_no, metric || ': ' || format('{{:.4f}}', value) AS text
FROM ({SQL["evaluation_table"]}) e
UNION ALL
SELECT 'segments',
       CAST(array_position({[d for d, _ in S.PROFILE_DIMENSIONS]}, dimension) * 100
            + row_number() OVER (PARTITION BY dimension ORDER BY level) AS INT),
       dimension || ' ' || level || ': ' || coalesce(format('{{:.4f}}', actual_churn_rate), 'nan') || ', '
         || coalesce(format('{{:.4f}}', avg_churn_probability), 'nan') || ', '
         || coalesce(format('{{:.4f}}', avg_monthly_charges), 'nan') || ', ' || customer_count
FROM ({SQL["segment_profile"]}) s"""
