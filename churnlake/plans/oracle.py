"""DuckDB SQL oracle, one statement per registered query (same column names)."""

from __future__ import annotations

from churnlake import schema as S
from churnlake.operators.evaluate import THRESHOLD_GRID
from churnlake.operators.explain import DEMO_SCORER
from churnlake.plans import queries as Q
from churnlake.plans.oracle_base import (SCORED_CTE, SCORED_MODELS_CTE, keyword_sql, label_sql, prepared_ctes,
                                         q, subscribers_ctes)
from churnlake.sources import adapters as A

SUBS = subscribers_ctes(False)
SUBS_T = subscribers_ctes(True)
STRUCT = prepared_ctes(False)
PREP = prepared_ctes(True)

SUB_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
            "MultipleLines", "InternetService", *A.INTERNET_DEPENDENT, "Contract", "PaperlessBilling",
            "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn"]
SUB_COLS_T = SUB_COLS + ["complaint_text"]


def W(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + body


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


HASH = "CAST(('0x' || substr(md5(customerID || ':42'), 1, 15)) AS BIGINT)"


def split_ctes(src: str) -> str:
    lab = label_sql("Churn")
    return f""",
split_sizes AS (
  SELECT {lab} AS _y, count(*) AS _c, sum(count(*)) OVER () AS _all, ceil(sum(count(*)) OVER () * 0.2)::BIGINT AS _test
  FROM {src} GROUP BY 1),
split_shares AS (
  SELECT _y, _c * _test // _all + CAST(row_number() OVER (ORDER BY _c * _test % _all DESC, _y NULLS LAST)
         <= _test - sum(_c * _test // _all) OVER () AS INTEGER) AS _share FROM split_sizes),
split_rank AS (
  SELECT t.*, row_number() OVER (PARTITION BY {lab} ORDER BY {HASH}, customerID) - 1 AS _rank FROM {src} t),
split AS (
  SELECT r.* EXCLUDE (_rank), CASE WHEN _rank < _share THEN 'test' ELSE 'train' END AS split
  FROM split_rank r JOIN split_shares s ON {lab} IS NOT DISTINCT FROM s._y)"""


def scorer_p(override: dict | None = None) -> str:
    override = override or {}
    z = D(DEMO_SCORER.intercept)
    for f, w in DEMO_SCORER.weights.items():
        x = override.get(f, f"CAST({f} AS DOUBLE)")
        z += f" + {D(w)} * {x}"
    return f"1.0 / (1.0 + exp(-({z})))"


def tier_sql(cp: str) -> str:
    e, lab = S.RISK_EDGES, S.RISK_LABELS
    parts = [f"WHEN {cp} > {e[0]} AND {cp} <= {hi} THEN {q(name)}" for hi, name in zip(e[1:], lab)]
    return "CASE " + " ".join(parts) + " END"


# ------------------------------------------------------------------ sources / sinks

def _sinks() -> dict:
    roster = W(STRUCT, f"""
SELECT customerID, tenure, MonthlyCharges, Contract, InternetService, network_quality,
       round_even({scorer_p()}, 4) AS churn_probability, {tier_sql(f'round_even({scorer_p()}, 4)')} AS risk_tier
FROM prepared ORDER BY churn_probability DESC, customerID LIMIT 20""")
    return {
        "load_customers": W(SUBS_T, "SELECT * FROM subscribers"),
        "load_checked": W(SUBS, "SELECT * FROM subscribers"),
        "missing_columns": "SELECT 'network_quality' AS missing_column",
        "save_versioned": W(STRUCT, "SELECT * FROM prepared"),
        "save_roster": roster,
        "save_model_comparison": W(SCORED_MODELS_CTE + "," + _comparison_ctes(), """
SELECT model, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1, round(roc_auc, 4) AS roc_auc FROM comparison"""),
    }


# ------------------------------------------------------------------ cleaning / quality

def _quality() -> dict:
    miss = " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, count(*) - count({c}) AS missing FROM subscribers" for c in SUB_COLS_T)
    total = " + ".join(f"(count(*) - count({c}))" for c in SUB_COLS_T)
    num_cols = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
    summ = " UNION ALL ".join(f"""
SELECT {q(c)} AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(max(CAST({c} AS DOUBLE)), 6) AS max
FROM cleaned""" for c in num_cols)
    cleaned = STRUCT  # contains the `cleaned` CTE
    return {
        "clean_total_charges": W(STRUCT, "SELECT customerID, TotalCharges FROM cleaned"),
        "imputed_count": W(STRUCT, """
SELECT CAST(count(*) FILTER (WHERE TotalCharges IS NULL) AS BIGINT) AS imputed, count(*) AS rows
FROM (SELECT """ + "CASE WHEN regexp_matches(TotalCharges, " + q(
            r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$") +
            ") THEN try_cast(trim(TotalCharges) AS DOUBLE) END AS TotalCharges FROM subscribers)"),
        "dedup_customers": """
SELECT customerID, event_id, event_type, value FROM (
  SELECT CAST(user_id AS VARCHAR) AS customerID, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
        "quality_shape": W(SUBS_T, f"SELECT count(*) AS n_rows, CAST({len(SUB_COLS_T)} AS BIGINT) AS n_columns, "
                                   f"CAST({total} AS BIGINT) AS total_missing FROM subscribers"),
        "quality_missing": W(SUBS_T, miss),
        "quality_numeric_summary": W(cleaned, summ),
    }


# ------------------------------------------------------------------ filters / projections

def _filters() -> dict:
    f = Q.FILTER
    pred = (f"network_quality IN ({', '.join(str(v) for v in f['network_qualities'])}) "
            f"AND tenure BETWEEN {f['tenure_range'][0]} AND {f['tenure_range'][1]} "
            f"AND MonthlyCharges BETWEEN {D(f['charges_range'][0])} AND {D(f['charges_range'][1])} "
            f"AND sentiment_score BETWEEN {D(f['sentiment_range'][0])} AND {D(f['sentiment_range'][1])}")
    numeric = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "network_quality",
               "tenure_network_interaction", "charges_network_interaction", "service_bundle_count",
               "high_value_customer", "tenure_bracket_encoded", "avg_monthly_charges", "recent_contract_change",
               "sentiment_score", "sentiment_negative", "sentiment_positive", "complaint_network",
               "complaint_billing", "complaint_service"]
    return {
        "filter_customers": W(PREP, f"SELECT customerID, network_quality, tenure, MonthlyCharges, sentiment_score "
                                    f"FROM prepared WHERE {pred}"),
        "filter_bounds": W(STRUCT, """
SELECT (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT network_quality AS v FROM prepared))
         AS network_qualities,
       min(tenure) AS tenure_min, max(tenure) AS tenure_max,
       min(MonthlyCharges) AS charges_min, max(MonthlyCharges) AS charges_max FROM prepared"""),
        "filtered_count": W(PREP, f"SELECT count(*) FILTER (WHERE {pred}) AS shown, count(*) AS total FROM prepared"),
        "preview": W(SUBS, "SELECT * FROM subscribers ORDER BY customerID LIMIT 10"),
        "feature_target_split": W(STRUCT, f"SELECT * EXCLUDE (Churn), {label_sql('Churn')} AS label FROM prepared"),
        "drop_non_model_columns": W(PREP, f"SELECT customerID, {', '.join(numeric)}, complaint_text_clean FROM prepared"),
        "churn_to_numeric": W(SUBS, f"SELECT customerID, {label_sql('Churn')} AS Churn FROM subscribers"),
        "network_quality_label": W(STRUCT, """
SELECT customerID, network_quality, CASE network_quality WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium'
  WHEN 2 THEN 'High' ELSE CAST(network_quality AS VARCHAR) END AS network_quality_label FROM prepared"""),
    }


# ------------------------------------------------------------------ features / text

def _features() -> dict:
    def cols(*c):
        return W(STRUCT, f"SELECT customerID, {', '.join(c)} FROM prepared")

    def tcols(*c):
        return W(PREP, f"SELECT customerID, {', '.join(c)} FROM prepared")

    return {
        "network_quality": cols("network_quality"),
        "interaction_features": cols("tenure_network_interaction", "charges_network_interaction"),
        "polynomial_features": W(STRUCT, """
SELECT customerID, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges,
  CAST(tenure AS DOUBLE) * CAST(tenure AS DOUBLE) AS "tenure^2",
  CAST(tenure AS DOUBLE) * MonthlyCharges AS "tenure MonthlyCharges",
  MonthlyCharges * MonthlyCharges AS "MonthlyCharges^2" FROM prepared"""),
        "service_bundle_count": cols("service_bundle_count"),
        "high_value_customer": cols("MonthlyCharges", "high_value_customer"),
        "tenure_bracket": cols("tenure", "tenure_bracket", "tenure_bracket_encoded"),
        "avg_monthly_charges": cols("avg_monthly_charges"),
        "recent_contract_change": cols("recent_contract_change"),
        "feature_pipeline": W(PREP, "SELECT * FROM prepared"),
        "clean_text": tcols("complaint_text_clean"),
        "sentiment_score": tcols("sentiment_score"),
        "sentiment_flags": tcols("sentiment_negative", "sentiment_positive"),
        "keyword_flags": tcols("complaint_network", "complaint_billing", "complaint_service"),
        "keyword_flags_corpus": W(PREP, "SELECT customerID, " + ", ".join(
            f"{keyword_sql('complaint_text_clean', Q.CORPUS_KEYWORDS[k])} AS complaint_{k}"
            for k in ("network", "billing", "service")) + " FROM prepared"),
        "complaint_breakdown": W(PREP, "SELECT category, CAST(sum(hit) AS BIGINT) AS customers, "
                                       "round(100.0 * sum(hit) / greatest(count(*), 1), 6) AS pct FROM (" + " UNION ALL ".join(
            f"SELECT {q(k.title())} AS category, {keyword_sql('complaint_text_clean', Q.CORPUS_KEYWORDS[k])} AS hit FROM prepared"
            for k in ("network", "billing", "service")) + ") GROUP BY category"),
        "complaint_preview": W(SUBS_T, "SELECT customerID, substring(coalesce(complaint_text, ''), 1, 60) "
                                       "AS complaint_preview FROM subscribers"),
        "term_frequency": W(PREP, """
SELECT term, count(*) AS frequency FROM (
  SELECT unnest(string_split(complaint_text_clean, ' ')) AS term FROM prepared WHERE Churn = 'Yes')
WHERE term <> '' GROUP BY term ORDER BY frequency DESC, term LIMIT 80"""),
        **_tfidf(),
    }


def _grams(src: str, name: str) -> str:
    return f""",
{name}_toks AS (
  SELECT customerID, list_filter(string_split(coalesce(complaint_text_clean, ''), ' '), lambda w: w <> '') AS t
  FROM {src}),
{name} AS (
  SELECT customerID, unnest(t) AS term FROM {name}_toks
  UNION ALL
  SELECT customerID, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM {name}_toks WHERE len(t) >= 2)"""


def _tfidf() -> dict:
    base = PREP + split_ctes("prepared") + ",\ntrain AS (SELECT * FROM split WHERE split = 'train')" + \
        _grams("train", "train_grams") + """,
n_train AS (SELECT count(*) AS n FROM train),
per_doc AS (SELECT term, customerID, count(*) AS c FROM train_grams GROUP BY ALL),
stats AS (SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM per_doc GROUP BY term),
vocab AS (
  SELECT term, tf, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM stats, n_train
  WHERE df >= 2 ORDER BY tf DESC, term LIMIT 50)"""
    feats = base + _grams("split", "all_grams") + """,
counts AS (SELECT g.customerID, g.term, v.idf, count(*) AS c FROM all_grams g JOIN vocab v USING (term) GROUP BY ALL),
weighted AS (SELECT customerID, term, (1 + ln(c)) * idf AS raw FROM counts)"""
    return {
        "tfidf_vocabulary": W(base, "SELECT term, tf, df, round(idf, 6) AS idf FROM vocab"),
        "tfidf_features": W(feats, """
SELECT customerID, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY customerID)), 6) AS tfidf
FROM weighted"""),
        "tfidf_wide": W(feats, """
, norm AS (SELECT customerID, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY customerID)), 6) AS tfidf FROM weighted)
SELECT s.customerID, v.term, coalesce(n.tfidf, 0.0) AS tfidf
FROM split s CROSS JOIN vocab v LEFT JOIN norm n ON n.customerID = s.customerID AND n.term = v.term"""),
        "tfidf_top_terms": W(base, "SELECT term, round(idf, 6) AS idf_score FROM vocab ORDER BY idf, term LIMIT 20"),
    }


# ------------------------------------------------------------------ EDA

def hist_sql(features: list[str], ctes: str, bins: int = 30) -> str:
    lab = label_sql("Churn")
    long = " UNION ALL ".join(
        f"SELECT {q(f)} AS feature, CAST({f} AS DOUBLE) AS x, {lab} AS cls FROM prepared" for f in features)
    return W(ctes + f""",
long AS ({long}),
filt AS (SELECT * FROM long WHERE x IS NOT NULL AND NOT isnan(x) AND cls IS NOT NULL AND cls IN (0, 1)),
rng AS (
  SELECT feature, cls,
    CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM filt GROUP BY feature, cls),
b AS (
  SELECT f.feature, f.cls, lo, hi, CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin
  FROM filt f JOIN rng USING (feature, cls)),
every AS (SELECT feature, cls, lo, hi, CAST(i AS INTEGER) AS bin FROM rng CROSS JOIN range({bins}) t(i))""", f"""
SELECT e.feature, e.cls AS churn, e.bin, round(e.lo + e.bin * (e.hi - e.lo) / {bins}, 6) AS bin_start,
  round(e.lo + (e.bin + 1) * (e.hi - e.lo) / {bins}, 6) AS bin_end, count(b.feature) AS count
FROM every e LEFT JOIN b USING (feature, cls, bin) GROUP BY e.feature, e.cls, e.bin, e.lo, e.hi""")


def rate_sql(feature: str, ctes: str) -> str:
    lab = label_sql("Churn")
    return W(ctes, f"""
SELECT CAST({feature} AS VARCHAR) AS {feature}, round(avg(CAST({lab} AS DOUBLE)) * 100.0, 6) AS churn_rate,
  count(*) AS customers
FROM prepared WHERE {feature} IS NOT NULL GROUP BY {feature}""")


def _eda() -> dict:
    from itertools import combinations
    lab = label_sql("Churn")
    pairs = list(combinations(Q.CORR_COLS, 2))
    corr = " UNION ALL ".join(
        f"SELECT {q(b)} AS feature_a, {q(a)} AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r "
        f"FROM prepared" for a, b in pairs)
    seg = " UNION ALL ".join(
        f"SELECT {q(f)} AS feature, CAST({f} AS VARCHAR) AS value, CAST({lab} AS DOUBLE) AS y FROM prepared"
        for f in S.SEGMENT_FEATURES)
    return {
        "churn_rate_by_feature": rate_sql("tenure_bracket", STRUCT),
        "histogram_by_class": hist_sql(["MonthlyCharges"], STRUCT),
        "correlation_matrix": W(STRUCT, corr),
        "overall_churn_rate": W(SUBS, f"SELECT round(avg(CAST({lab} AS DOUBLE)), 6) AS churn_rate, "
                                      f"count(*) AS customers FROM subscribers"),
        "segment_report": W(STRUCT, f"""
SELECT feature, value, round(avg(y) * 100.0, 6) AS churn_rate, count(*) AS customers
FROM ({seg}) WHERE value IS NOT NULL GROUP BY feature, value"""),
        "negative_sentiment_churn": rate_sql("sentiment_negative", PREP),
        "numeric_distributions": hist_sql(["tenure", "MonthlyCharges", "TotalCharges"], STRUCT),
        "sentiment_by_class": hist_sql(["sentiment_score"], PREP),
    }


# ------------------------------------------------------------------ encoding / split

def _encode() -> dict:
    lab = label_sql("Churn")
    binary = ", ".join(
        f"CAST(CASE {c} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 END AS INTEGER) AS {c}"
        for c in S.BINARY_COLUMNS if c != "Churn")
    cats = {
        "MultipleLines": ["No", "No phone service", "Yes"],
        "InternetService": sorted(A.INTERNET_BY_NATION_MOD3),
        **{c: ["No", "No internet service", "Yes"] for c in A.INTERNET_DEPENDENT},
        "Contract": sorted(set(A.CONTRACT_BY_SEGMENT.values())),
        "PaymentMethod": sorted(A.PAYMENT_BY_NATION_MOD4),
    }
    onehot = ", ".join(f"coalesce(CAST({c} = {q(v)} AS INTEGER), 0) AS \"{c}_{v}\""
                       for c in S.CATEGORICAL_COLUMNS for v in sorted(cats[c])[1:])
    scaled = ["tenure", "MonthlyCharges", "TotalCharges", *S.SCALED_EXTRA_COLUMNS]
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)), 0), 1) AS s_{c}"
                      for c in scaled)
    scaled_sel = ", ".join(f"round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in scaled)
    folds_rank = f"""
SELECT customerID, Churn, CAST((row_number() OVER (PARTITION BY {lab} ORDER BY {HASH}, customerID) - 1) % 5 AS INTEGER)
  AS fold FROM subscribers"""
    return {
        "encode_binary": W(SUBS, f"SELECT customerID, {binary}, {lab} AS Churn FROM subscribers"),
        "encode_senior": W(SUBS, "SELECT customerID, CAST(SeniorCitizen AS INTEGER) AS SeniorCitizen FROM subscribers"),
        "onehot_encode": W(SUBS, f"SELECT customerID, {onehot} FROM subscribers"),
        "standard_scale": W(STRUCT + split_ctes("prepared") + f""",
st AS (SELECT {stats} FROM split WHERE split = 'train')""", f"SELECT customerID, split, {scaled_sel} FROM split, st"),
        "stratified_split": W(PREP + split_ctes("prepared"), "SELECT customerID, Churn, split FROM split"),
        "split_report": W(PREP + split_ctes("prepared"),
                          f"SELECT split, count(*) AS rows, round(avg(CAST({lab} AS DOUBLE)), 6) AS churn_rate "
                          f"FROM split GROUP BY split"),
        "row_sample": W(SUBS, f"SELECT customerID, tenure, MonthlyCharges FROM subscribers "
                              f"ORDER BY {HASH}, customerID LIMIT 200"),
        "cv_folds": W(SUBS, folds_rank),
    }


# ------------------------------------------------------------------ evaluation

def _cells(t: float, where: str = "") -> str:
    return (f"count(*) FILTER (WHERE y <> 1 AND p < {D(t)}) AS tn, count(*) FILTER (WHERE y <> 1 AND p >= {D(t)}) AS fp, "
            f"count(*) FILTER (WHERE y = 1 AND p < {D(t)}) AS fn, count(*) FILTER (WHERE y = 1 AND p >= {D(t)}) AS tp")


METRICS = """round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0), 6) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0), 6) AS f1"""


def _auc_ctes(src: str, by: str | None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f""",
g AS (SELECT {keys}p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {src} GROUP BY ALL),
c AS (
  SELECT {keys}p, pos, neg,
    sum(pos) OVER ({part}ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
    sum(neg) OVER ({part}ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
    sum(pos) OVER ({part}) AS n_pos,
    sum(neg) OVER ({part}) AS n_neg
  FROM g)"""


def _comparison_ctes() -> str:
    return f"""
cm AS (SELECT model, {_cells(0.5)} FROM scored_models GROUP BY model),
metrics AS (SELECT model, {METRICS} FROM cm)""" + _auc_ctes("scored_models", "model") + """,
auc AS (SELECT model, round(CAST(sum(pos * (2 * (n_neg - cum_neg) + neg)) AS DOUBLE) / (2.0 * max(n_pos) * max(n_neg)), 6) AS roc_auc
        FROM c GROUP BY model),
comparison AS (SELECT * FROM metrics JOIN auc USING (model))"""


def _evaluate() -> dict:
    prec = "coalesce(CAST(cum_pos AS DOUBLE) / nullif(cum_pos + cum_neg, 0), 0.0)"
    prev_cp, prev_cn = "(cum_pos - pos)", "(cum_neg - neg)"
    prev_prec = (f"CASE WHEN {prev_cp} + {prev_cn} = 0 THEN 1.0 ELSE "
                 f"coalesce(CAST({prev_cp} AS DOUBLE) / nullif({prev_cp} + {prev_cn}, 0), 0.0) END")
    rec = "CASE WHEN n_pos = 0 THEN 1.0 ELSE CAST(cum_pos AS DOUBLE) / n_pos END"
    prev_rec = (f"CASE WHEN {prev_cp} + {prev_cn} = 0 THEN 0.0 WHEN n_pos = 0 THEN 1.0 "
                f"ELSE CAST({prev_cp} AS DOUBLE) / n_pos END")
    edges = [i * (1.0 / 10) for i in range(1, 10)]
    calib_bin = "CASE " + " ".join(f"WHEN p <= {D(e)} THEN {i}" for i, e in enumerate(edges)) + " ELSE 9 END"
    thr = " UNION ALL ".join(f"SELECT {D(t)} AS threshold, {_cells(t)} FROM scored" for t in THRESHOLD_GRID)
    cm = f"""
SELECT tn, fp, fn, tp,
  round(100.0 * tn / greatest(tn + fp + fn + tp, 1), 6) AS tn_pct, round(100.0 * fp / greatest(tn + fp + fn + tp, 1), 6) AS fp_pct,
  round(100.0 * fn / greatest(tn + fp + fn + tp, 1), 6) AS fn_pct, round(100.0 * tp / greatest(tn + fp + fn + tp, 1), 6) AS tp_pct
FROM (SELECT {_cells(0.5)} FROM scored)"""
    report = f"""
SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS label, p0 AS pr, r0 AS rc, f0 AS f, s0 AS support FROM m
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, s0 + s1 FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                   (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)"""
    m = f"""
cm AS (SELECT {_cells(0.5)} FROM scored),
m AS (SELECT
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS p1, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS r1,
  coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) AS f1,
  coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0) AS p0, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0) AS r0,
  coalesce(2.0 * tn / nullif(2.0 * tn + fn + fp, 0), 0.0) AS f0,
  tp + fn AS s1, tn + fp AS s0, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0) AS acc FROM cm)"""
    gains = SCORED_CTE + """,
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) - 1 AS i FROM scored),
t AS (SELECT count(*) AS N, sum(y) AS T FROM scored),
d AS (SELECT CAST(CASE WHEN N <= 1 THEN 0 ELSE greatest(floor((i * 10 + N - 2) / (N - 1)) - 1, 0) END AS INTEGER)
        AS decile, y FROM r, t),
per AS (SELECT decile, count(*) AS customers, sum(y) AS s FROM d GROUP BY decile),
full_per AS (SELECT CAST(i AS INTEGER) AS decile, coalesce(customers, 0) AS customers, coalesce(s, 0) AS s
  FROM range(10) x(i) LEFT JOIN per ON per.decile = x.i),
cum AS (SELECT decile, customers, sum(s) OVER (ORDER BY decile) AS churners_cum FROM full_per),
gains AS (
  SELECT decile, customers, CAST(churners_cum AS BIGINT) AS churners_cum,
    round(CAST(decile + 1 AS DOUBLE) / 10.0, 6) AS pct_customers,
    round(CAST(churners_cum AS DOUBLE) / nullif(T, 0), 6) AS pct_churners_captured,
    round((CAST(churners_cum AS DOUBLE) / nullif(T, 0)) / (CAST(decile + 1 AS DOUBLE) / 10.0), 6) AS lift
  FROM cum, t)"""
    fn, fp_ = S.COST_FALSE_NEGATIVE, S.COST_FALSE_POSITIVE
    return {
        "apply_threshold": W(SCORED_CTE, "SELECT id, CAST(p >= 0.5 AS INTEGER) AS y_pred FROM scored"),
        "confusion_matrix": W(SCORED_CTE, cm),
        "classification_metrics": W(SCORED_CTE, f"SELECT {D(0.5)} AS threshold, {METRICS} FROM (SELECT {_cells(0.5)} FROM scored)"),
        "classification_report": W(SCORED_CTE + "," + m, report),
        "threshold_metrics": W(SCORED_CTE, f"SELECT threshold, tn, fp, fn, tp, {METRICS} FROM ({thr})"),
        "roc_auc": W(SCORED_CTE + _auc_ctes("scored", None),
                     "SELECT round(CAST(sum(pos * (2 * (n_neg - cum_neg) + neg)) AS DOUBLE) / (2.0 * max(n_pos) * max(n_neg)), 6) "
                     "AS roc_auc FROM c"),
        "roc_curve": W(SCORED_MODELS_CTE + _auc_ctes("scored_models", "model"), """
SELECT model, p AS threshold, round(CAST(cum_neg AS DOUBLE) / n_neg, 6) AS fpr, round(CAST(cum_pos AS DOUBLE) / n_pos, 6) AS tpr
FROM (SELECT *, lag(pos) OVER d AS before, lead(pos) OVER d AS next_pos, lead(neg) OVER d AS next_neg FROM c
      WINDOW d AS (PARTITION BY model ORDER BY p DESC))
WHERE before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM scored_models"""),
        "pr_curve": W(SCORED_CTE + _auc_ctes("scored", None), f"""
SELECT p AS threshold, round({prec}, 6) AS precision, round({rec}, 6) AS recall FROM c
UNION ALL SELECT NULL, 1.0, 0.0"""),
        "pr_auc": W(SCORED_CTE + _auc_ctes("scored", None), f"""
SELECT round(sum(({rec} - {prev_rec}) * ({prec} + {prev_prec}) / 2.0), 6) AS pr_auc,
  round(CAST(max(n_pos) AS DOUBLE) / (max(n_pos) + max(n_neg)), 6) AS baseline FROM c"""),
        "calibration_curve": W(SCORED_CTE, f"""
SELECT bin, round(avg(p), 6) AS mean_predicted, round(avg(CAST(y AS DOUBLE)), 6) AS fraction_positive, count(*) AS count
FROM (SELECT {calib_bin} AS bin, p, y FROM scored) GROUP BY bin"""),
        "gains_table": W(gains, "SELECT * FROM gains"),
        "lift_by_decile": W(gains, "SELECT decile, lift FROM gains"),
        "cost_evaluation": W(SCORED_CTE, f"""
SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
  CAST(fn * {D(fn)} AS DOUBLE) AS cost_false_negatives, CAST(fp * {D(fp_)} AS DOUBLE) AS cost_false_positives,
  fn * {D(fn)} + fp * {D(fp_)} AS total_model_cost, (tp + fn) * {D(fn)} AS baseline_cost_no_model,
  (tp + fn) * {D(fn)} - (fn * {D(fn)} + fp * {D(fp_)}) AS cost_saved_vs_baseline,
  round((fn * {D(fn)} + fp * {D(fp_)}) / greatest(tn + fp + fn + tp, 1), 6) AS cost_per_customer
FROM (SELECT {_cells(0.5)} FROM scored)"""),
        "model_comparison": W(SCORED_MODELS_CTE + "," + _comparison_ctes(), "SELECT * FROM comparison"),
        "best_model": W(SCORED_MODELS_CTE + "," + _comparison_ctes(),
                        "SELECT model AS best_model, roc_auc FROM comparison ORDER BY roc_auc DESC, model LIMIT 1"),
    }


# ------------------------------------------------------------------ roster / explain

def _explain() -> dict:
    feats = list(DEMO_SCORER.weights)
    means = "m AS (SELECT " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in feats) + " FROM prepared)"
    long = " UNION ALL ".join(
        f"SELECT customerID, {q(f)} AS feature, CAST({f} AS DOUBLE) AS value, "
        f"{D(DEMO_SCORER.weights[f])} * (CAST({f} AS DOUBLE) - m_{f}) AS shap FROM prepared, m" for f in feats)
    shap = STRUCT + f",\n{means},\nshap AS ({long})"
    base = D(DEMO_SCORER.intercept) + "".join(f" + {D(DEMO_SCORER.weights[f])} * m_{f}" for f in feats)
    return {
        "risk_tier": W(SCORED_CTE, f"SELECT id, round_even(p, 4) AS churn_probability, "
                                   f"{tier_sql('round_even(p, 4)')} AS risk_tier FROM scored"),
        "high_risk_roster": _sinks()["save_roster"],
        "roster_for_test_split": W(STRUCT_T + split_ctes("prepared"), f"""
SELECT customerID, tenure, MonthlyCharges, Contract, InternetService, network_quality,
  substring(coalesce(complaint_text, ''), 1, 60) AS complaint_preview,
  round_even({scorer_p()}, 4) AS churn_probability, {tier_sql(f'round_even({scorer_p()}, 4)')} AS risk_tier
FROM split WHERE split = 'test' ORDER BY churn_probability DESC, customerID LIMIT 50"""),
        "score_customers": W(STRUCT, f"SELECT customerID, round({scorer_p()}, 6) AS p FROM prepared"),
        "shap_linear": W(shap, "SELECT customerID, feature, value, round(shap, 6) AS shap FROM shap"),
        "shap_global": W(shap, "SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap FROM shap GROUP BY feature "
                               "ORDER BY avg(abs(shap)) DESC, feature LIMIT 15"),
        "shap_summary": W(shap, "SELECT customerID, feature, value, round(shap, 6) AS shap FROM shap"),
        "shap_waterfall": W(shap, f"""
SELECT rank, feature, value, round(shap, 6) AS shap, round(({base}) + sum(shap) OVER (ORDER BY rank), 6) AS cumulative
FROM (SELECT CAST(row_number() OVER (ORDER BY abs(shap) DESC, feature) AS INTEGER) AS rank, feature, value, shap
      FROM shap WHERE customerID = {q(Q.WATERFALL_CUSTOMER)}), m"""),
        "shap_customer_top": W(shap, """
SELECT customerID, rank, feature, value, round(shap, 6) AS shap_value,
  CASE WHEN shap > 0 THEN 'increases_churn' ELSE 'reduces_churn' END AS direction
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customerID ORDER BY abs(shap) DESC, feature) AS INTEGER) AS rank
      FROM shap) WHERE rank <= 2"""),
        "partial_dependence": _pdp_sql(),
        "ice_curves": _ice_sql(),
    }


def _struct_with_text() -> str:
    """Structured features over the subscribers table that keeps complaint_text."""
    full = prepared_ctes(True)
    cut = full.index(",\ntxt AS (")
    return full[:cut] + ",\nprepared AS (SELECT * FROM structured)"


STRUCT_T = _struct_with_text()


def _grid_ctes(src: str, feature: str, res: int = 100) -> str:
    """Grid of the PDP: distinct values when fewer than res, else linspace between
    plotting-position (0.4, 0.4) quantiles at 5% and 95%."""
    x = f"CAST({feature} AS DOUBLE)"

    def quant(p: float) -> str:
        m = 0.4 + p * (1 - 0.4 - 0.4)
        return f"""(SELECT (1 - g) * lo_v + g * hi_v FROM (
  SELECT least(greatest(n * {D(p)} + {D(m)} - k, 0.0), 1.0) AS g,
         (SELECT v FROM sorted_{feature} WHERE r = k - 1) AS lo_v, (SELECT v FROM sorted_{feature} WHERE r = k) AS hi_v
  FROM (SELECT n, CAST(floor(least(greatest(n * {D(p)} + {D(m)}, 1), n - 1)) AS BIGINT) AS k FROM cnt_{feature})))"""

    return f""",
uniq_{feature} AS (SELECT DISTINCT {x} AS v FROM {src} WHERE {feature} IS NOT NULL),
sorted_{feature} AS (SELECT {x} AS v, row_number() OVER (ORDER BY {x}) - 1 AS r FROM {src} WHERE {feature} IS NOT NULL),
cnt_{feature} AS (SELECT count(*) AS n FROM sorted_{feature}),
ends_{feature} AS (SELECT {quant(0.05)} AS lo, {quant(0.95)} AS hi),
grid_{feature} AS (
  SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS grid_index, v AS grid_value FROM uniq_{feature}
  WHERE (SELECT count(*) FROM uniq_{feature}) < {res}
  UNION ALL
  SELECT CAST(i AS INTEGER), CASE WHEN i = {res - 1} THEN hi ELSE lo + i * ((hi - lo) / {res - 1}) END
  FROM ends_{feature}, range(0, {res}) t(i)
  WHERE (SELECT count(*) FROM uniq_{feature}) >= {res})"""


def _pdp_sql() -> str:
    feats = ["tenure", "MonthlyCharges"]
    ctes = STRUCT + "".join(_grid_ctes("prepared", f) for f in feats)
    parts = []
    for f in feats:
        p = scorer_p({f: "g.grid_value"})
        parts.append(f"""SELECT {q(f)} AS feature, g.grid_index, round(g.grid_value, 6) AS grid_value,
  round(avg({p}), 6) AS partial_dependence FROM prepared, grid_{f} g GROUP BY g.grid_index, g.grid_value""")
    return W(ctes, " UNION ALL ".join(parts))


def _ice_sql() -> str:
    ctes = STRUCT + f""",
smp AS (SELECT * FROM prepared ORDER BY {HASH}, customerID LIMIT 100)""" + _grid_ctes("smp", "tenure")
    p = scorer_p({"tenure": "g.grid_value"})
    return W(ctes + f""",
curves AS (SELECT customerID, g.grid_index, g.grid_value, {p} AS p FROM smp, grid_tenure g)""", """
SELECT customerID, grid_index, round(grid_value, 6) AS grid_value, round(p, 6) AS prediction FROM curves
UNION ALL
SELECT '__mean__', grid_index, round(grid_value, 6), round(avg(p), 6) FROM curves GROUP BY grid_index, grid_value""")


def _models() -> dict:
    lab = label_sql("Churn")
    return {"class_weights": W(SUBS, f"""
SELECT CAST(label AS INTEGER) AS label, n_c AS count, round(n / (2.0 * n_c), 6) AS balanced_weight,
  round(CAST(neg AS DOUBLE) / greatest(pos, 1), 6) AS scale_pos_weight
FROM (SELECT {lab} AS label, count(*) AS n_c FROM subscribers GROUP BY 1) c,
     (SELECT count(*) AS n, count(*) FILTER (WHERE {lab} = 1) AS pos, count(*) FILTER (WHERE {lab} = 0) AS neg
      FROM subscribers) t""")}


def _root_splits() -> str:
    """The first tree's best cut of each feature: margins are 0, so a row's gradient is w (1/2 - y) and its hessian w / 4."""
    from churnlake.plans.queries import ROOT_FEATURES
    lab = label_sql("Churn")
    rows = " UNION ALL ".join(f"SELECT {q(f)} AS feature, CAST({f} AS DOUBLE) AS x, y FROM tr" for f in ROOT_FEATURES)
    return W(STRUCT + split_ctes("prepared") + f""",
tr AS (SELECT *, {lab} AS y FROM split WHERE split = 'train' AND {lab} IS NOT NULL),
wt AS (SELECT CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / greatest(count(*) FILTER (WHERE y = 1), 1) AS w FROM tr),
long AS ({rows}),
gh AS (SELECT feature, x, CASE WHEN y = 1 THEN w ELSE 1 END * (0.5 - y) AS g, CASE WHEN y = 1 THEN w ELSE 1 END * 0.25 AS h FROM long, wt),
ranked AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS r, count(*) OVER (PARTITION BY feature) AS n,
                  max(x) OVER (PARTITION BY feature) AS top FROM gh WHERE x IS NOT NULL),
cuts AS (SELECT DISTINCT feature, x AS threshold FROM ranked, range(1, 255) t(k) WHERE r = CAST(ceil(k * n / 256.0) AS BIGINT) AND x < top),
total AS (SELECT feature, sum(g) AS g, sum(h) AS h FROM gh GROUP BY feature),
sides AS (SELECT c.feature, c.threshold, sum(gh.g) AS gl, sum(gh.h) AS hl FROM cuts c JOIN gh ON gh.feature = c.feature AND gh.x <= c.threshold
          GROUP BY 1, 2),
gains AS (SELECT s.feature, threshold, gl, hl, gl * gl / (hl + 1) + (t.g - gl) * (t.g - gl) / (t.h - hl + 1) - t.g * t.g / (t.h + 1) AS gain
          FROM sides s JOIN total t USING (feature) WHERE hl >= 1 AND t.h - hl >= 1),
best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 5) DESC, threshold) AS nth FROM gains)""",
             "SELECT feature, round(threshold, 4) AS threshold, round(gain, 3) AS gain, round(gl, 3) AS left_gradient, "
             "round(hl, 3) AS left_hessian FROM best WHERE nth = 1")


def _trained() -> dict:
    """What must hold of any trained model, for the rows of the split that SQL makes itself."""
    test = W(STRUCT + split_ctes("prepared"), "SELECT customerID, {} FROM split WHERE split = 'test'")
    return {
        "models_learn": W(STRUCT + split_ctes("prepared"), """
SELECT model, count(*) AS n_train, TRUE AS learnt FROM split,
  (VALUES ('logistic'), ('forest'), ('gbt'), ('gbt_light')) m(model) WHERE split = 'train' GROUP BY model"""),
        "shap_tree_additive": test.format("TRUE AS additive"),
        "logistic_scorer": test.format("TRUE AS equal"),
        "model_roundtrip_equal": test.format("TRUE AS equal"),
        "logistic_optimum": W(STRUCT + split_ctes("prepared"),
                              "SELECT count(*) AS n_train, TRUE AS stationary FROM split WHERE split = 'train'"),
        "importance_identity": "SELECT CAST(i AS INTEGER) AS tree, TRUE AS adds_up FROM range(200) t(i)",
        "boosting_root_splits": _root_splits(),
        "evaluation_curve_end": "SELECT 300 AS iteration, TRUE AS same_area",
    }


def oracle_sql() -> dict:
    out = {}
    for part in (_sinks, _quality, _filters, _features, _eda, _encode, _evaluate, _explain, _models, _trained):
        out.update(part())
    return out
