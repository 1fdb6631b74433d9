"""SQL of the queries that join several operators, for DuckDB over the same tables."""

from __future__ import annotations

from paysift.operators.features import FEATURES
from paysift.operators.model import COLUMNS, NUMBERS, VOCABULARIES
from paysift.operators.quality import MART_SUITES
from paysift.plans.oracle import _COSINE, _DECISIONS, _FACTS, _LABELS, _NOW, _PAYMENTS, _PLACED, _SILVER, _WINDOWS, ORACLE, _features, _fraction
from paysift.plans.inputs import FRAUD_SEED

_ROWS = {
    "silver": "(SELECT o_orderkey AS transaction_id, md5(CAST(o_custkey AS VARCHAR)) AS card_token, o_totalprice AS amount FROM orders)",
    "decisions": "(SELECT transaction_id, decision FROM attempts UNION ALL SELECT transaction_id, 'allow' FROM attempts WHERE transaction_id % 5 = 0)",
    "chargebacks": "labels", "fct_decisions": "facts",
    "agg_daily_kpis": "kpis", "agg_model_performance": "perf", "agg_rule_effectiveness": "fired",
}
_MARTS = f"""kpis AS ({ORACLE['daily_kpis'].partition(_FACTS)[2]}), perf AS ({ORACLE['model_performance'].partition(_FACTS)[2]}), fired AS ({ORACLE['rule_effectiveness'].partition(_FACTS)[2]})"""


def _unexpected(kind: str, column: str, args: dict) -> str:
    if kind == "not_null":
        return f"count(*) FILTER ({column} IS NULL)"
    if kind == "unique":
        return f"count({column}) - coalesce((SELECT count(*) FROM (SELECT {column} FROM t WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) = 1)), 0)"
    if kind == "between":
        return f"count(*) FILTER ({column} < {args['low']} OR {column} > {args['high']})"
    return f"count(*) FILTER ({column} NOT IN ({', '.join(repr(v) for v in args['values'])}))"


def _contracts() -> str:
    parts = []
    for name, suite in MART_SUITES.items():
        for i, e in enumerate(suite):
            bad = _unexpected(e.kind, e.column, e.args)
            parts.append(f"SELECT '{name}' AS \"table\", {i}::INTEGER AS i, '{e.name}' AS expectation, n = 0 AS success, n AS unexpected_count FROM (WITH t AS (SELECT * FROM {_ROWS[name]}) SELECT CAST({bad} AS BIGINT) AS n FROM t)")
    return f"WITH {_FACTS}, {_MARTS} " + " UNION ALL ".join(parts)


_QUALITY = f"""WITH {_SILVER}, {{more}} q AS (SELECT count(*) AS n, {{token}} AS bad_token, count(*) FILTER (amount < 0.0001::DOUBLE OR amount > 100000) AS bad_amount, count(product_cd) FILTER (product_cd NOT IN ('W', 'C', 'R', 'H', 'S')) AS bad_product, count(product_cd) AS products,
    {{repeated}} AS repeated FROM {{rows}}),
r AS (SELECT unnest([
  {{{{'i': 0, 'expectation': 'row_count', 'success': n >= 1, 'observed': n::VARCHAR, 'unexpected_count': 0}}}}, {{{{'i': 1, 'expectation': 'columns', 'success': '{{odd}}' = '', 'observed': '{{odd}}', 'unexpected_count': {{n_odd}}}}}},
  {{{{'i': 2, 'expectation': 'not_null(transaction_id)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}}, {{{{'i': 3, 'expectation': 'unique(transaction_id)', 'success': repeated = 0, 'observed': repeated::VARCHAR, 'unexpected_count': repeated}}}},
  {{{{'i': 4, 'expectation': 'not_null(event_time)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}}, {{{{'i': 5, 'expectation': 'not_null(card_token)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}},
  {{{{'i': 6, 'expectation': 'regex(card_token)', 'success': bad_token = 0, 'observed': bad_token::VARCHAR, 'unexpected_count': bad_token}}}}, {{{{'i': 7, 'expectation': 'not_null(amount)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}},
  {{{{'i': 8, 'expectation': 'between(amount)', 'success': bad_amount = 0, 'observed': bad_amount::VARCHAR, 'unexpected_count': bad_amount}}}},
  {{{{'i': 9, 'expectation': 'in_set(product_cd)', 'success': products = 0 OR products - bad_product >= products * 0.99, 'observed': bad_product::VARCHAR, 'unexpected_count': bad_product}}}},
  {{{{'i': 10, 'expectation': 'in_set(card6)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}}, {{{{'i': 11, 'expectation': 'in_set(device_type)', 'success': true, 'observed': '0', 'unexpected_count': 0}}}}]) AS x FROM q)
SELECT CAST(x.i AS INTEGER) AS i, x.expectation AS expectation, x.success AS success, {{observed}} CAST(x.unexpected_count AS BIGINT) AS unexpected_count FROM r"""


def _quality(more: str, token: str, repeated: str, rows: str, odd: str, observed: str) -> str:
    return _QUALITY.format(more=more, token=token, repeated=repeated, rows=rows, odd=odd, n_odd=len(odd.split(",")) if odd else 0, observed=observed).replace("{{", "{").replace("}}", "}")


def _drift(rows: str, numbers: str, texts: str | None) -> str:
    """Verdicts of columns (part, column, v): numbers by Kolmogorov-Smirnov or Wasserstein, texts by chi-square (even degrees of freedom) or Jensen-Shannon."""
    ks = "least(1, greatest(0, CASE WHEN x < 1e-9 THEN 1 ELSE 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (k * x) ** 2) for k in range(1, 101)]) END))"
    sql = f"""{rows}, e AS ({numbers}),
c AS (SELECT "column", v, count(*) FILTER (WHERE part = 'reference') AS a, count(*) FILTER (WHERE part = 'current') AS b FROM e WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(a) OVER o AS sa, sum(b) OVER o AS sb, sum(a) OVER p AS na, sum(b) OVER p AS nb, lead(v) OVER o AS nx FROM c WINDOW o AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
d AS (SELECT "column", stddev_samp(v) AS dev FROM e WHERE part = 'reference' GROUP BY 1),
g AS (SELECT "column", max(na) AS na, max(abs(sa / na::DOUBLE - sb / nb::DOUBLE)) * sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS x, sum(coalesce(nx - v, 0) * abs(sa / na::DOUBLE - sb / nb::DOUBLE)) / greatest(max(dev), 0.001::DOUBLE) AS w FROM k JOIN d USING ("column") GROUP BY "column"),
verdicts AS (SELECT "column", CASE WHEN na <= 1000 THEN 'ks' ELSE 'wasserstein' END AS test, CASE WHEN na <= 1000 THEN {ks} ELSE w END AS value, CASE WHEN na <= 1000 THEN {ks} < 0.05 ELSE w >= 0.1 END AS drifted FROM g"""
    if texts is None:
        return sql + ")"
    return sql + f""" UNION ALL SELECT "column", CASE WHEN na <= 1000 THEN 'chi2' ELSE 'jensen_shannon' END, CASE WHEN na <= 1000 THEN p ELSE js END, CASE WHEN na <= 1000 THEN p < 0.05 ELSE js >= 0.1 END
  FROM (SELECT *, exp(-chi2 / 2) * list_sum([(chi2 / 2) ** j / factorial(j::INTEGER) for j in range(0, (n - 1) // 2)]) AS p FROM ({texts})))"""


_TEXTS = ORACLE["drift_categories"]
_TEXT_COUNTS = """SELECT "column", max(na) AS na, count(*) AS n, sum(CASE WHEN a > 0 THEN (b - nb * x) ** 2 / (nb * x) ELSE b END) AS chi2,
      sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 0)) AS js
    FROM (SELECT *, sum(a) OVER p AS na, sum(b) OVER p AS nb, a / sum(a) OVER p AS x, b / sum(b) OVER p AS y
          FROM (SELECT 'device_info' AS "column", device_info AS v, count(*) FILTER (WHERE part = 'reference')::DOUBLE AS a, count(*) FILTER (WHERE part = 'current')::DOUBLE AS b FROM win WHERE device_info IS NOT NULL GROUP BY device_info) WINDOW p AS (PARTITION BY "column")) GROUP BY "column\""""
_COLUMNS = """SELECT part, 'amount' AS "column", amount AS v FROM win UNION ALL SELECT part, 'transaction_dt', transaction_dt::DOUBLE FROM win UNION ALL SELECT part, 'day_of_week', day_of_week::DOUBLE FROM win"""
_SCORES = f"{_DECISIONS}, p AS (SELECT *, row_number() OVER (ORDER BY decided_at, transaction_id) - 1 AS place, count(*) OVER () AS total FROM attempts), win AS (SELECT *, CASE WHEN place < floor(total * 0.7) THEN 'reference' ELSE 'current' END AS part FROM p)"

_FLAGGED = f"""{_DECISIONS}, {_LABELS}, flagged AS (SELECT *, CASE WHEN rule_name IS NOT NULL THEN 'rule' ELSE 'model' END AS triggered_by FROM attempts WHERE decision <> 'allow'),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS transaction_id, round(list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 9) AS similarity FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
near AS (SELECT query_id, rank, transaction_id, similarity, amount, decision, decided_at, is_fraud = 1 AS is_fraud FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, transaction_id) AS rank FROM s)
         JOIN attempts USING (transaction_id) JOIN labels USING (transaction_id) WHERE rank <= 3)"""
_HEAD = """'PAYMENT UNDER REVIEW' || chr(10) || '- transaction id: ' || f.transaction_id || chr(10) || printf('- amount: %.2f', f.amount) || chr(10) || '- decision: ' || f.decision || chr(10) || '- decided by: ' || f.triggered_by || coalesce(' (rule: ' || f.rule_name || ')', '')
  || coalesce(chr(10) || printf('- model score: %.4f (review at 0.5000, block at 0.9000)', f.score), '') || chr(10) || chr(10) || 'BEHAVIOURAL FACTS' || chr(10) || '- payment amount: ' || CASE WHEN f.amount = floor(f.amount) THEN CAST(f.amount AS BIGINT)::VARCHAR ELSE printf('%.2f', f.amount) END"""
_ANSWERS = f"""{_FLAGGED}, a AS (SELECT *, transaction_id % 5 <> 0 AS valid, EXISTS (SELECT 1 FROM near WHERE query_id = flagged.transaction_id) AS has_case,
    CASE WHEN transaction_id % 5 <> 0 THEN (transaction_id % 3 = 0)::INT END AS n_unsupported FROM flagged),
g AS (SELECT *, CASE WHEN valid THEN CASE WHEN transaction_id % 2 = 0 AND has_case THEN 0 ELSE 1 END END AS n_invented FROM a)"""

_FLAT = """payments AS (SELECT o_orderkey AS transaction_id, TIMESTAMP '2023-01-01' + to_seconds(o_orderkey * 600) AS event_time, CAST(o_custkey AS VARCHAR) || '|unknown|' || CASE WHEN o_orderkey % 2 = 0 THEN 'GMAIL.com' ELSE 'some.org' END AS card_key,
  o_totalprice AS amount, CAST(NULL AS VARCHAR) AS device_info, CAST(NULL AS VARCHAR) AS r_emaildomain, o_custkey, o_totalprice FROM orders)"""
_CELLS = {
    "card3": "CASE WHEN transaction_id % 2 = 0 THEN 150.0::DOUBLE END", "C1": "CASE WHEN transaction_id % 4 = 0 THEN round(o_totalprice, 6) END", "C14": "(transaction_id % 7)::DOUBLE", "D1": "CASE WHEN transaction_id % 3 = 1 THEN 5.0::DOUBLE END",
    "D15": "(o_custkey % 30)::DOUBLE", "product_cd": "CASE WHEN transaction_id % 3 = 0 THEN 'W' ELSE 'other' END", "card4": "CASE WHEN transaction_id % 5 = 0 THEN 'visa' ELSE 'missing' END", "card6": "'debit'",
    "device_type": "'missing'", "p_emaildomain": "CASE WHEN transaction_id % 2 = 0 THEN 'gmail.com' ELSE 'other' END", "r_emaildomain": "'missing'",
}
_MATRIX = ", ".join(f'{c} AS "{c}"' if c in FEATURES else f'{_CELLS.get(c, "CAST(NULL AS DOUBLE)")} AS "{c}"' for c in COLUMNS)


def _place(column: str) -> str:
    words = [*VOCABULARIES[column], "other", "missing"]
    return f"CAST(list_position({words!r}, {_CELLS[column]}) - 1 AS INTEGER) AS {column}"


_PARTS = f"""{_PAYMENTS}, x AS (SELECT transaction_id, amount, product_cd, [{{'f': 'amount', 'c': round((amount - 60) / 10, 6)}}, {{'f': 'hour_of_day', 'c': hour(event_time) - 12.0::DOUBLE}}, {{'f': 'is_night', 'c': CASE WHEN hour(event_time) < 6 THEN 3.5::DOUBLE ELSE -0.5::DOUBLE END}},
  {{'f': 'product_cd', 'c': CASE WHEN product_cd = 'click' THEN 2.25::DOUBLE ELSE -1.0::DOUBLE END}}] AS parts FROM payments)"""
_LIVES = f"""{_PAYMENTS.replace('payments AS', 'every AS')}, gaps AS (SELECT *, floor(epoch_us(event_time) / 1000000) - lag(floor(epoch_us(event_time) / 1000000)) OVER (PARTITION BY card_key ORDER BY floor(epoch_us(event_time) / 1000000), transaction_id) > 48 * 3600 AS fresh FROM every),
payments AS (SELECT * REPLACE (card_key || '/' || sum(coalesce(fresh, false)::INT) OVER (PARTITION BY card_key ORDER BY floor(epoch_us(event_time) / 1000000), transaction_id) AS card_key) FROM gaps)"""

_TESTED = f"""{_LABELS}, {_PAYMENTS}, known AS (SELECT *, row_number() OVER (ORDER BY event_time, transaction_id) - 1 AS place, count(*) OVER () AS total FROM payments JOIN labels USING (transaction_id)),
    tested AS (SELECT * FROM known WHERE place >= floor(total * 0.85::DOUBLE))"""

SQL: dict[str, str] = {
    "gated_rebuilds": f"""WITH {_SILVER}, b AS (SELECT amount FROM silver UNION ALL SELECT -amount FROM silver WHERE transaction_id % 2 = 0),
        g AS (SELECT count(*) AS rows, round(sum(amount), 2) AS amount FROM silver), w AS (SELECT count(*) AS rows, round(sum(amount), 2) AS amount FROM b)
        SELECT 1 AS attempt, '' AS told, rows, amount, 1 AS version FROM g UNION ALL SELECT 2, 'the table does not meet between(amount), unique(transaction_id)', rows, amount, 1 FROM g
        UNION ALL SELECT 3, 'between(amount),unique(transaction_id)', rows, amount, 2 FROM w""",
    "case_bucket_upsert": f"""WITH {_DECISIONS}, latest AS (SELECT transaction_id, amount, decision FROM attempts)
        SELECT transaction_id, amount, CASE WHEN transaction_id % 10 = 0 THEN 'block' ELSE decision END AS decision, CASE WHEN transaction_id % 10 = 0 THEN 'new' ELSE 'old' END AS resolution FROM latest
        UNION ALL SELECT -transaction_id - 1, amount * 2, 'block', 'new' FROM latest WHERE transaction_id % 20 = 0""",
    "labels_by_availability": f"WITH {_LABELS} SELECT transaction_id, is_fraud, label_available_at FROM labels ORDER BY label_available_at, transaction_id LIMIT 1000",
    "indexed_recall": f"WITH {_COSINE} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reaches, true AS similar FROM t",
    "distinct_by_month": f"WITH {_PAYMENTS} SELECT strftime(event_time, '%Y-%m') AS unit, count(*) AS rows, min(event_time) AS first_event, max(event_time) AS last_event, true AS transactions_close, true AS cards_close FROM payments GROUP BY 1",
    "embedder_checks": """WITH c AS (SELECT vec_id, 'given-' || (label % 3) AS embedder FROM embeddings), n AS (SELECT DISTINCT embedder FROM c UNION ALL SELECT 'another')
        SELECT n.embedder, NOT EXISTS (SELECT 1 FROM c WHERE vec_id % 3 <> 0 AND c.embedder <> n.embedder) AS may_search, (SELECT nullif(count(*), 0) FROM c WHERE c.embedder = n.embedder) AS cases FROM n""",
    "boosted_model": f"WITH {_TESTED} SELECT count(*) AS rows, count(*) FILTER (is_fraud = 1) AS fraud_count, round(sum(amount) FILTER (is_fraud = 1), 4) AS baseline_cost FROM tested",
    "boosted_reasons": f"WITH {_TESTED} SELECT transaction_id, {len(NUMBERS) + sum(len(v) + 1 for v in VOCABULARIES.values())}::INTEGER AS n_inputs, true AS adds_up FROM known WHERE place < floor(total * 0.85::DOUBLE)",
    "quality_report": _quality("", "count(*) FILTER (NOT regexp_matches(card_token, '^[0-9a-f]{32}$'))", "count(*) - count(DISTINCT transaction_id)", "silver", "", "x.observed AS observed,"),
    "contract_failures": _quality(
        "b AS (SELECT transaction_id, card_token, amount, product_cd FROM silver UNION ALL SELECT transaction_id, '4111', -amount, product_cd FROM silver WHERE transaction_id % 2 = 0),",
        "count(*) FILTER (card_token = '4111')", "2 * count(*) FILTER (card_token = '4111')", "b", "card1", "",
    ),
    "mart_contracts": _contracts(),
    "drift_report": f'WITH {_drift(_WINDOWS, _COLUMNS, _TEXT_COUNTS)} SELECT "column", test, round(value, 6) AS value, drifted FROM verdicts',
    "prediction_drift": f"""WITH {_drift(_SCORES, "SELECT part, 'score' AS " + '"column"' + ", score AS v FROM win", None)} SELECT count(*) AS columns_checked, count(*) FILTER (drifted) AS columns_drifted, count(*) FILTER (drifted) / count(*)::DOUBLE AS drift_share,
        count(*) FILTER (drifted) / count(*)::DOUBLE >= 0.3 AS dataset_drift, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (drifted), '') AS drifted_columns FROM verdicts""",
    "response_checks": """SELECT conv_id, turn, coalesce(length(text) BETWEEN 20 AND 1200, false) AND turn / 4.0 BETWEEN 0 AND 1 AS valid,
        CASE WHEN NOT coalesce(length(text) BETWEEN 20 AND 1200, false) THEN 'summary' WHEN NOT turn / 4.0 BETWEEN 0 AND 1 THEN 'confidence' END AS error FROM conversations""",
    "facts_texts": f"WITH {_FLAGGED} SELECT transaction_id, {_HEAD} || chr(10) || chr(10) || 'SIMILAR PAST CASES: none found.' AS facts FROM flagged f",
    "facts_with_cases": f"""WITH {_FLAGGED}, l AS (SELECT query_id, count(*) AS n, string_agg(printf('- id %d: ', transaction_id) || strftime(decided_at, '%Y-%m-%d') || printf(': %.2f ', amount) || decision || ' -> ' || CASE WHEN is_fraud THEN 'confirmed fraud' ELSE 'confirmed legitimate' END
          || ' (chargeback)' || CASE WHEN similarity <> 0 THEN printf(', similarity %.2f', similarity) ELSE '' END, chr(10) ORDER BY rank) AS lines FROM near GROUP BY query_id)
        SELECT transaction_id, CAST(n AS INTEGER) AS n_cases, {_HEAD} || chr(10) || chr(10) || 'SIMILAR PAST CASES (already confirmed)' || chr(10) || lines AS facts FROM flagged f JOIN l ON query_id = transaction_id""",
    "grounded_responses": f"WITH {_ANSWERS} SELECT transaction_id, valid, CAST(n_unsupported AS INTEGER) AS n_unsupported, CAST(n_invented AS INTEGER) AS n_invented FROM g",
    "response_report": f"""WITH {_ANSWERS}, o AS (SELECT list(latency_ms ORDER BY latency_ms) AS xs, count(*) AS n FROM g), i AS (SELECT *, least(n, greatest(1, 0.95::DOUBLE * (n + 1))) AS p_at FROM o),
        t AS (SELECT xs[CAST(floor(p_at) AS BIGINT)] + (xs[least(n, CAST(floor(p_at) AS BIGINT) + 1)] - xs[CAST(floor(p_at) AS BIGINT)]) * (p_at - floor(p_at)) AS p95 FROM i)
        SELECT count(*) AS responses, round(count(*) FILTER (valid) / count(*)::DOUBLE, 6) AS schema_validity, round(count(*) FILTER (n_unsupported + n_invented = 0) / (count(*) FILTER (valid))::DOUBLE, 6) AS factual_accuracy,
               round(count(*) FILTER (n_unsupported + n_invented = 0) / count(*)::DOUBLE, 6) AS usable, round(median(latency_ms), 6) AS latency_p50_ms, round(any_value(p95), 6) AS latency_p95_ms, round(avg(latency_ms), 6) AS latency_mean_ms FROM g, t""",
    "stream_landed_decisions": f"WITH {_DECISIONS} SELECT transaction_id, decided_at, CAST(decided_at AS DATE) AS decision_date, decision, round(score, 9) AS score, rule_name FROM attempts",
    "appended_layers": f"WITH {_PAYMENTS} SELECT transaction_id, round(amount * 2, 6) AS doubled, CAST(event_time AS DATE) AS event_date FROM payments",
    "published_marts": f"WITH {_FACTS} SELECT rule_name, count(*) AS times_fired, count(*) FILTER (label_is_known) AS labels_known, count(*) FILTER (is_confirmed_fraud) AS caught_fraud FROM facts WHERE rule_name IS NOT NULL GROUP BY rule_name",
    "stream_expiring_cards": f"WITH {_LIVES}, {_features('payments')} SELECT transaction_id, {', '.join(FEATURES)} FROM f",
    "full_matrix": f"WITH {_FLAT}, {_features('payments')} SELECT transaction_id, {_MATRIX} FROM f",
    "matrix_defaults": f"WITH {_FLAT} SELECT transaction_id, {', '.join(_place(c) for c in VOCABULARIES)} FROM payments",
    "ranked_reasons": f"""WITH {_PARTS}, y AS (SELECT transaction_id, amount, product_cd, unnest(parts) AS p FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY p.c DESC, p.f) AS k FROM y WHERE p.c > 0 AND amount >= 50)
        SELECT x.transaction_id, coalesce(string_agg(p.f || ':' || CASE WHEN p.f = 'product_cd' THEN z.product_cd ELSE '-' END || ':' || printf('%.3f', round(p.c, 4)) || ':increases risk', '|' ORDER BY k) FILTER (k <= 3), '') AS reasons FROM x LEFT JOIN z USING (transaction_id) GROUP BY x.transaction_id""",
    "mean_contributions": f"""WITH {_PARTS}, y AS (SELECT unnest(parts) AS p FROM x) SELECT CASE WHEN p.f = 'product_cd' THEN 'product_cd=click' ELSE p.f END AS feature, round(avg(abs(p.c)), 4) AS importance FROM y GROUP BY 1 ORDER BY avg(abs(p.c)) DESC, 1 LIMIT 3""",
    "case_vector_properties": f"WITH {_LABELS}, {_DECISIONS} SELECT transaction_id, CAST(384 AS INTEGER) AS dims, 1.0::DOUBLE AS norm, CAST(1 AS BIGINT) AS n_vectors FROM attempts JOIN labels USING (transaction_id) WHERE label_available_at <= {_NOW}",
    "case_lines": f"""WITH {_LABELS}, {_DECISIONS} SELECT transaction_id, strftime(decided_at, '%Y-%m-%d') || printf(': %.2f ', amount) || decision || ' -> ' || CASE WHEN is_fraud = 1 THEN 'confirmed fraud' ELSE 'confirmed legitimate' END || ' (chargeback)' AS line
        FROM attempts JOIN labels USING (transaction_id) WHERE label_available_at <= {_NOW}""",
    "case_ingest": f"WITH {_LABELS}, {_DECISIONS} SELECT count(*) AS cases, count(*) FILTER (is_fraud = 1) AS fraud, count(*) FILTER (is_fraud = 0) AS legitimate, count(*) AS from_chargebacks FROM attempts JOIN labels USING (transaction_id) WHERE label_available_at <= {_NOW}",
    "review_upsert": f"WITH {_DECISIONS} SELECT transaction_id, CASE WHEN transaction_id % 3 = 0 OR transaction_id % 8 = 0 THEN 'fraud' ELSE 'legitimate' END AS verdict, CASE WHEN transaction_id % 3 = 0 THEN 'again' ELSE '' END AS note, decision AS platform_decision FROM attempts",
    "version_days": f"WITH {_FACTS} SELECT decision_date, count(*) AS labelled_payments, count(*) FILTER (is_confirmed_fraud) AS fraud_count FROM facts WHERE label_is_known AND model_version = '1-URGENT' GROUP BY decision_date",
    "rule_operators": f"""WITH {_PAYMENTS}, r AS (SELECT *, card_key IN ('3', '5', '8') AS listed, amount <= 20 AND device_info <> 'click' AS small_other, coalesce(r_emaildomain = '7', false) AND amount > 10 AS nowhere, amount > 180 OR device_info = 'refund' AS either FROM payments)
        SELECT transaction_id, CASE WHEN listed OR either THEN 'block' WHEN small_other OR nowhere THEN 'review' END AS rule_action, CASE WHEN listed THEN 'listed' WHEN either THEN 'either' WHEN small_other THEN 'small_other' WHEN nowhere THEN 'nowhere' END AS rule_name,
               concat_ws(',', CASE WHEN listed THEN 'listed' END, CASE WHEN small_other THEN 'small_other' END, CASE WHEN nowhere THEN 'nowhere' END, CASE WHEN either THEN 'either' END) AS matched FROM r""",
    "early_labels_found": f"WITH {_FACTS} SELECT transaction_id, label_available_at, decision = 'block' AS is_confirmed_fraud FROM facts WHERE label_available_at > {_NOW}",
    "tuned_costs": ORACLE["tuned_thresholds"].partition("SELECT round(r.t, 6)")[0] + """SELECT round(r.t, 6) AS review_threshold, round(b.t, 6) AS block_threshold, round((b.nb - r.nb) / n::DOUBLE, 6) AS review_rate, round((n - b.nb) / n::DOUBLE, 6) AS block_rate,
        round(1 - (r.fb + (b.nb - r.nb) * 5 + (la - b.lb) * 25) / fa, 6) AS cost_reduction, round(r.fb, 3) AS missed_fraud_cost, round((b.nb - r.nb) * 5.0::DOUBLE, 3) AS review_cost, round((la - b.lb) * 25.0::DOUBLE, 3) AS false_block_cost,
        round(r.fb + (b.nb - r.nb) * 5 + (la - b.lb) * 25, 3) AS expected_cost, round(fa, 3) AS baseline_cost FROM g r JOIN g b ON b.t >= r.t, w, (SELECT count(*) AS n FROM scored) ORDER BY round(r.fb + (b.nb - r.nb) * 5 + (la - b.lb) * 25, 6), r.t, b.t LIMIT 1""",
    "labels_known": f"WITH {_LABELS} SELECT transaction_id, is_fraud, label_available_at FROM labels WHERE label_available_at <= {_NOW}",
    "event_times": "SELECT o_orderkey AS transaction_id, TIMESTAMP '2020-02-29 10:00:00' + to_microseconds(o_orderkey * 500000) AS event_time, round(o_orderkey * 0.5::DOUBLE / 86400, 9) AS days FROM orders",
}
SQL["suite_totals"] = f"""SELECT bool_and(success) AS success, count(*) AS evaluated, count(*) FILTER (success) AS successful, coalesce(string_agg(expectation, ',' ORDER BY expectation) FILTER (NOT success), '') AS failures FROM ({SQL['quality_report']})"""
