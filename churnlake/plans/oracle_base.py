"""SQL (DuckDB dialect) building blocks of the oracle: the adapters and the
prepared customer table, written independently of the DataFrame code but
from the same fixed constants."""

from __future__ import annotations

from churnlake import schema as S
from churnlake.functions.text import MENTION_RE, NON_ALPHA_RE, URL_RE, WS_RUN_RE
from churnlake.operators.sentiment import LEXICON
from churnlake.sources import adapters as A


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _yes_no(bit: int) -> str:
    return f"CASE WHEN (c_custkey >> {bit}) & 1 = 1 THEN 'Yes' ELSE 'No' END"


def _case_mod(expr: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def subscribers_ctes(with_text: bool = True) -> str:
    internet = _case_mod("c_nationkey % 3", A.INTERNET_BY_NATION_MOD3)
    contract = "CASE " + " ".join(f"WHEN c_mktsegment = {q(k)} THEN {q(v)}"
                                  for k, v in A.CONTRACT_BY_SEGMENT.items()) + " END"
    dep = ",\n".join(
        f"    CASE WHEN {internet} = 'No' THEN 'No internet service' ELSE {_yes_no(A.BIT_OF[c])} END AS {c}"
        for c in A.INTERNET_DEPENDENT)
    text_join = "LEFT JOIN documents d ON d.doc_id = c.c_custkey" if with_text else ""
    text_col = ",\n    d.text AS complaint_text" if with_text else ""
    return f"""
o_agg AS (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_d, max(CAST(o_orderdate AS DATE)) AS last_d,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders GROUP BY o_custkey),
o_latest AS (SELECT max(CAST(o_orderdate AS DATE)) AS latest_d FROM orders),
subscribers AS (
  SELECT
    CAST(c.c_custkey AS VARCHAR) AS customerID,
    CASE WHEN (c_custkey >> {A.BIT_OF['gender']}) & 1 = 1 THEN 'Male' ELSE 'Female' END AS gender,
    CAST((c_custkey >> {A.BIT_OF['SeniorCitizen']}) & 1 AS INTEGER) AS SeniorCitizen,
    {_yes_no(A.BIT_OF['Partner'])} AS Partner,
    {_yes_no(A.BIT_OF['Dependents'])} AS Dependents,
    CAST(coalesce(floor((last_d - first_d) / 30), 0) AS INTEGER) AS tenure,
    {_yes_no(A.BIT_OF['PhoneService'])} AS PhoneService,
    CASE WHEN {_yes_no(A.BIT_OF['PhoneService'])} = 'No' THEN 'No phone service'
         ELSE {_yes_no(A.BIT_OF['MultipleLines'])} END AS MultipleLines,
    {internet} AS InternetService,
{dep},
    {contract} AS Contract,
    {_yes_no(A.BIT_OF['PaperlessBilling'])} AS PaperlessBilling,
    {_case_mod("c_nationkey % 4", A.PAYMENT_BY_NATION_MOD4)} AS PaymentMethod,
    abs(c_acctbal) / 100 AS MonthlyCharges,
    CASE WHEN c_custkey % {A.BLANK_TOTAL_EVERY} = 0 THEN ' ' ELSE CAST(total AS VARCHAR) END AS TotalCharges,
    CASE WHEN (latest_d - last_d) > {A.CHURN_GAP_DAYS} THEN 'Yes' ELSE 'No' END AS Churn{text_col}
  FROM customer c LEFT JOIN o_agg o ON c.c_custkey = o.o_custkey CROSS JOIN o_latest
  {text_join})"""


NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_number_sql(expr: str) -> str:
    return (f"CASE WHEN regexp_matches(CAST({expr} AS VARCHAR), {q(NUMBER_RE)}) "
            f"THEN try_cast(trim(CAST({expr} AS VARCHAR)) AS DOUBLE) END")


def label_sql(expr: str) -> str:
    s = f"upper(trim(CAST({expr} AS VARCHAR)))"
    return (f"(CASE WHEN {s} IN ('YES','1','1.0','TRUE') THEN 1 "
            f"WHEN {s} IN ('NO','0','0.0','FALSE') THEN 0 END)")


def tenure_label_sql(t: str = "tenure") -> str:
    e, lab = S.TENURE_EDGES, S.TENURE_LABELS
    parts = [f"WHEN {t} >= {e[0]} AND {t} <= {e[1]} THEN {q(lab[0])}"]
    for lo, hi, name in zip(e[1:-1], e[2:], lab[1:-1]):
        parts.append(f"WHEN {t} > {lo} AND {t} <= {hi} THEN {q(name)}")
    parts.append(f"WHEN {t} > {e[-1]} THEN {q(lab[-1])}")
    return "CASE " + " ".join(parts) + " END"


def tenure_code_sql(t: str = "tenure") -> str:
    lab = tenure_label_sql(t)
    return "CASE " + " ".join(f"WHEN {lab} = {q(n)} THEN {i}" for i, n in enumerate(S.TENURE_LABELS)) + " END"


def clean_text_sql(expr: str) -> str:
    t = f"lower(coalesce({expr}, ''))"
    t = f"regexp_replace({t}, {q(URL_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(MENTION_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(NON_ALPHA_RE)}, ' ', 'g')"
    t = f"trim(regexp_replace({t}, {q(WS_RUN_RE)}, ' ', 'g'))"
    stop = "[" + ", ".join(q(w) for w in S.STOPWORDS) + "]"
    return (f"array_to_string(list_filter(string_split({t}, ' '), "
            f"lambda w: length(w) > 1 AND NOT list_contains({stop}, w)), ' ')")


def keyword_sql(expr: str, words: list[str]) -> str:
    if not words:
        return "0"
    anyhit = " OR ".join(f"contains({expr}, {q(w)})" for w in words)
    return f"CASE WHEN coalesce({expr}, '') = '' THEN 0 ELSE CAST(({anyhit}) AS INTEGER) END"


def lexicon_values() -> str:
    number = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"CAST({x!r} AS DOUBLE)"
    return "VALUES " + ", ".join(f"({q(e.words)}, {number(e.polarity)}, {number(e.intensity)})" for e in LEXICON)


def prepared_ctes(with_text: bool = True) -> str:
    """subscribers -> cleaned -> structured features -> text features (table `prepared`)."""
    services = " + ".join(f"(CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END)" for c in S.SERVICE_COLUMNS)
    nq = "CASE " + " ".join(f"WHEN InternetService = {q(k)} THEN {v}"
                            for k, v in S.INTERNET_NETWORK_QUALITY.items()) + " ELSE 0 END"
    ctes = subscribers_ctes(with_text) + f""",
cleaned AS (
  SELECT * REPLACE (coalesce({parse_number_sql('TotalCharges')}, tenure * MonthlyCharges) AS TotalCharges)
  FROM subscribers),
hv AS (SELECT quantile_cont(MonthlyCharges, {S.HIGH_VALUE_QUANTILE}) AS thr FROM cleaned),
structured AS (
  SELECT c.*,
    CAST({nq} AS INTEGER) AS network_quality,
    tenure * CAST({nq} AS INTEGER) AS tenure_network_interaction,
    MonthlyCharges * CAST({nq} AS INTEGER) AS charges_network_interaction,
    CAST({services} AS INTEGER) AS service_bundle_count,
    coalesce(CAST(MonthlyCharges > hv.thr AS INTEGER), 0) AS high_value_customer,
    {tenure_label_sql()} AS tenure_bracket,
    {tenure_code_sql()} AS tenure_bracket_encoded,
    CASE WHEN tenure > 0 THEN TotalCharges / tenure ELSE MonthlyCharges END AS avg_monthly_charges,
    coalesce(CAST(tenure <= {S.RECENT_CONTRACT_TENURE} AND Contract = 'Month-to-month' AS INTEGER), 0)
      AS recent_contract_change
  FROM cleaned c CROSS JOIN hv)"""
    if not with_text:
        return ctes + ",\nprepared AS (SELECT * FROM structured)"
    return ctes + f""",
txt AS (SELECT *, {clean_text_sql('complaint_text')} AS complaint_text_clean FROM structured),
lexicon(term, pol, scale) AS ({lexicon_values()}),
toks AS (SELECT customerID, string_split(complaint_text_clean, ' ') AS ws FROM txt),
grams AS (
  SELECT customerID, pos, size, array_to_string(ws[pos:pos + size - 1], ' ') AS term
  FROM (SELECT customerID, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM toks, range(1, {1 + max(len(e.words.split()) for e in LEXICON)}) k(size))),
hits AS (
  SELECT g.customerID, pos, max(size) AS size, arg_max(pol, size) AS pol, arg_max(scale, size) AS scale
  FROM grams g JOIN lexicon l USING (term) GROUP BY g.customerID, pos),
held AS (
  SELECT h.* FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.customerID = h.customerID AND o.pos < h.pos AND o.pos + o.size >= h.pos + h.size)),
sent AS (
  SELECT h.customerID, avg(greatest(least(h.pol * coalesce(b.scale, 1.0), 1.0), -1.0)) AS s
  FROM held h LEFT JOIN held b ON b.customerID = h.customerID AND b.pos + b.size = h.pos AND b.scale IS NOT NULL
  WHERE h.pol IS NOT NULL GROUP BY h.customerID),
prepared AS (
  SELECT txt.*,
    coalesce(sent.s, 0.0) AS sentiment_score,
    CAST(coalesce(sent.s, 0.0) < {S.SENTIMENT_NEGATIVE_BELOW} AS INTEGER) AS sentiment_negative,
    CAST(coalesce(sent.s, 0.0) > {S.SENTIMENT_POSITIVE_ABOVE} AS INTEGER) AS sentiment_positive,
    {keyword_sql('complaint_text_clean', S.NETWORK_KEYWORDS)} AS complaint_network,
    {keyword_sql('complaint_text_clean', S.BILLING_KEYWORDS)} AS complaint_billing,
    {keyword_sql('complaint_text_clean', S.SERVICE_KEYWORDS)} AS complaint_service
  FROM txt LEFT JOIN sent USING (customerID))"""


SCORED_CTE = """scored AS (
  SELECT event_id AS id, CAST(event_type = 'error' AS INTEGER) AS y, least(value / 500.0, 1.0) AS p
  FROM events)"""

SCORED_MODELS_CTE = SCORED_CTE + """,
scored_models AS (
  SELECT 'direct' AS model, id, y, p FROM scored
  UNION ALL SELECT 'inverse', id, y, 1.0 - p FROM scored
  UNION ALL SELECT 'squared', id, y, p * p FROM scored)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"
