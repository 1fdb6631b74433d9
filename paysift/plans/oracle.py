"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

import hashlib

from paysift.operators.features import FEATURES
from paysift.operators.layers import PASSTHROUGH
from paysift.plans.inputs import AS_OF, FRAUD_SEED, SALT


def _pad(pad: int) -> str:
    secret = SALT.encode()
    secret = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    return bytes(b ^ pad for b in secret.ljust(64, b"\0")).hex()


def _fraction(identifier: str, seed: int) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || CAST({identifier} AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


_NOW = f"TIMESTAMP '{AS_OF}'"
_TOKEN = f"substr(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(card_key)))), 1, 32)"

_PAYMENTS = """payments AS (
  SELECT event_id AS transaction_id, ts AS event_time, CAST(user_id AS VARCHAR) AS card_key, value AS amount, event_type AS product_cd, json_extract_string(props, '$.k') AS r_emaildomain, event_type AS device_info,
         CAST(round((epoch_us(ts) - epoch_us(TIMESTAMP '2023-01-01')) / 1000000.0) AS BIGINT) AS transaction_dt FROM events)"""


def _features(source: str) -> str:
    """CTEs named s, h and f over a payments table; f has all features."""
    return f"""s AS (SELECT *, CAST(floor(epoch_us(event_time) / 1000000) AS BIGINT) AS sec FROM {source}),
m AS (SELECT *, device_info IS NOT NULL AND row_number() OVER (PARTITION BY card_key, device_info ORDER BY sec, transaction_id) = 1 AS fd,
             r_emaildomain IS NOT NULL AND row_number() OVER (PARTITION BY card_key, r_emaildomain ORDER BY sec, transaction_id) = 1 AS fe FROM s),
h AS (SELECT *, count(*) OVER w10 AS n10, count(*) OVER w60 AS n60, count(*) OVER w24 AS n24, sum(amount) OVER w24 AS s24, count(*) OVER hist AS n, avg(amount) OVER hist AS mean,
             sum(fd::INT) OVER hist AS nd, lag(sec) OVER (PARTITION BY card_key ORDER BY sec, transaction_id) AS last
      FROM m WINDOW w10 AS (PARTITION BY card_key ORDER BY sec RANGE BETWEEN 600 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY card_key ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
                    w24 AS (PARTITION BY card_key ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), hist AS (PARTITION BY card_key ORDER BY sec, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT * EXCLUDE (amount), amount AS amount_, round(amount, 6) AS amount, round(ln(1 + greatest(amount, 0)), 6) AS amount_log, hour(event_time)::DOUBLE AS hour_of_day, (isodow(event_time) - 1)::DOUBLE AS day_of_week,
             (hour(event_time) < 6)::INT::DOUBLE AS is_night, (device_info IS NOT NULL)::INT::DOUBLE AS has_identity, n10::DOUBLE AS card_txn_count_10m, n60::DOUBLE AS card_txn_count_1h, n24::DOUBLE AS card_txn_count_24h,
             round(s24, 6) AS card_amount_sum_24h, coalesce(sec - last, -1)::DOUBLE AS seconds_since_card_last_txn, round(coalesce(mean, 0) + 1e-8, 6) AS card_amount_avg_lifetime,
             round(CASE WHEN mean > 0 THEN amount / mean ELSE 1 END, 6) AS amount_to_card_avg_ratio, n::DOUBLE AS card_txn_count_lifetime, (n = 0)::INT::DOUBLE AS card_is_new,
             (n > 0 AND fd)::INT::DOUBLE AS card_new_device, (n > 0 AND fe)::INT::DOUBLE AS card_new_email_domain, coalesce(nd, 0)::DOUBLE AS card_distinct_devices FROM h)"""


_FEATURES = f"WITH {_PAYMENTS}, {_features('payments')} SELECT transaction_id, {', '.join(FEATURES)} FROM f"
#: Messages are made in pairs; the first of each pair arrives first and has no amount where the id divides by 7.
_SILVER = f"""{_PAYMENTS}, silver AS (SELECT *, CAST(event_time AS DATE) AS event_date, {_TOKEN} AS card_token FROM payments WHERE transaction_id % 7 <> 0)"""

_LABELS = """labels AS (SELECT l_orderkey AS transaction_id, max((l_returnflag = 'R')::INT) AS is_fraud, max(l_shipdate) AS label_available_at FROM lineitem GROUP BY l_orderkey)"""
_DECISIONS = f"""attempts AS (
  SELECT o_orderkey AS transaction_id, md5(CAST(o_custkey AS VARCHAR)) AS card_token, o_orderdate AS decided_at, CASE o_orderstatus WHEN 'F' THEN 'block' WHEN 'P' THEN 'review' ELSE 'allow' END AS decision,
         CASE WHEN o_orderkey % 11 <> 0 THEN {_fraction('o_orderkey', FRAUD_SEED)} END AS score, CASE WHEN o_totalprice >= 400000 THEN 'very_large' WHEN o_totalprice >= 300000 THEN 'large' END AS rule_name,
         o_totalprice AS amount, o_orderpriority AS model_version, o_orderkey % 1000 / 7.0::DOUBLE AS latency_ms, o_orderkey % 13 = 0 AS degraded FROM orders)"""
_FACTS = f"""{_LABELS}, {_DECISIONS}, facts AS (
  SELECT a.*, CAST(decided_at AS DATE) AS decision_date, CASE WHEN rule_name IS NOT NULL THEN 'rule' ELSE 'model' END AS triggered_by, label_available_at, label_available_at <= {_NOW} AS label_is_known,
         CASE WHEN label_available_at <= {_NOW} THEN is_fraud = 1 END AS is_confirmed_fraud, decision IN ('block', 'review') AS was_flagged,
         CASE WHEN label_available_at > {_NOW} THEN 'pending' WHEN is_fraud = 1 AND decision = 'block' THEN 'fraud_blocked' WHEN is_fraud = 1 AND decision = 'review' THEN 'fraud_to_review'
              WHEN is_fraud = 1 AND decision = 'allow' THEN 'fraud_missed' WHEN is_fraud = 0 AND decision = 'block' THEN 'false_block' WHEN is_fraud = 0 AND decision = 'review' THEN 'false_review' ELSE 'correctly_allowed' END AS outcome
  FROM attempts a LEFT JOIN labels USING (transaction_id))"""
_TRAIN = f"""{_LABELS}, train AS (SELECT o_orderkey AS transaction_id, o_totalprice AS amount, label_available_at, label_available_at > {_NOW} AS label_is_assumed,
  CASE WHEN label_available_at <= {_NOW} THEN is_fraud ELSE 0 END AS is_fraud, o_orderdate AS event_time FROM orders JOIN labels ON o_orderkey = transaction_id WHERE o_orderdate <= {_NOW})"""
_SCORED = f"""{_LABELS}, scored AS (SELECT transaction_id, o_totalprice AS amount, is_fraud, (floor({_fraction('o_orderkey', FRAUD_SEED)} * 7000) + 3000 * is_fraud) / 10000.0::DOUBLE AS score FROM orders JOIN labels ON o_orderkey = transaction_id)"""
_CURVE = """c AS (SELECT score, sum(is_fraud) AS p, sum(1 - is_fraud) AS n FROM scored GROUP BY score), k AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp FROM c WINDOW o AS (ORDER BY score DESC)),
a AS (SELECT round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS pr_auc, round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS roc_auc FROM k)"""
_MADE = "d AS (SELECT *, CASE WHEN score >= 0.8::DOUBLE THEN 'block' WHEN score >= 0.5::DOUBLE THEN 'review' ELSE 'allow' END AS made FROM scored)"
_RULES = f"""{_PAYMENTS}, {_features('payments')}, r AS (SELECT *, card_txn_count_24h >= 8 AS velocity, card_is_new = 1 AND amount_ > 50 AS new_card, amount_ >= 200 AS large,
  device_info IN ('purchase', 'refund') AND coalesce(r_emaildomain NOT IN ('1', '2', '3'), true) AND amount_ < 5 AS kinds FROM f),
x AS (SELECT *, CASE WHEN large THEN 'block' WHEN velocity OR new_card OR kinds THEN 'review' END AS rule_action, CASE WHEN large THEN 'large' WHEN velocity THEN 'velocity' WHEN new_card THEN 'new_card' WHEN kinds THEN 'kinds' END AS rule_name,
             concat_ws(',', CASE WHEN velocity THEN 'velocity' END, CASE WHEN new_card THEN 'new_card' END, CASE WHEN large THEN 'large' END, CASE WHEN kinds THEN 'kinds' END) AS matched FROM r)"""
_PLACED = f"{_PAYMENTS}, p AS (SELECT *, row_number() OVER (ORDER BY event_time, transaction_id) - 1 AS place, count(*) OVER () AS total FROM payments)"
_SPLIT = f"{_PLACED}, split AS (SELECT *, CASE WHEN place < floor(total * 0.7) THEN 'train' WHEN place < floor(total * 0.85) THEN 'validation' ELSE 'test' END AS part FROM p)"
_WINDOWS = f"{_PLACED}, win AS (SELECT *, CASE WHEN place < floor(total * 0.7) THEN 'reference' ELSE 'current' END AS part, isodow(event_time) - 1 AS day_of_week FROM p)"
_COSINE = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS transaction_id, q.label AS ql, c.label AS cl, round(list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 9) AS similarity
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, transaction_id) AS rank FROM s) WHERE rank <= 5)"""
_REVIEWS = f"{_DECISIONS}, reviews AS (SELECT *, CASE WHEN transaction_id % 8 = 0 THEN 'fraud' ELSE 'legitimate' END AS verdict FROM attempts)"


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN count(*) FILTER ({whole}) > 0 THEN round(count(*) FILTER ({part})::DOUBLE / count(*) FILTER ({whole}), 6) END"


def _of(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


_MATCH = r"regexp_extract_all(coalesce(text, ''), '-?\d[\d,]*\.?\d*')"
_NUMBERS = f"n AS (SELECT conv_id, turn, [TRY_CAST(replace(x, ',', '') AS DOUBLE) for x in {_MATCH}] AS xs FROM conversations), k AS (SELECT conv_id, turn, [x for x in xs if x IS NOT NULL] AS xs FROM n)"

ORACLE: dict[str, str] = {
    "card_features": _FEATURES,
    "card_features_by_day": _FEATURES,
    "stream_card_features": _FEATURES,
    "stream_bronze": f"""WITH {_PAYMENTS} SELECT transaction_id, CAST(transaction_id % 3 AS INTEGER) AS kafka_partition, transaction_id * 2 + c AS kafka_offset, CAST(event_time AS DATE) AS event_date, card_key,
        round(CASE WHEN c = 1 THEN amount * 2 WHEN transaction_id % 7 = 0 THEN 0 ELSE amount END, 6) AS amount FROM payments, range(0, 2) AS t(c)""",
    "stream_decisions": f"""WITH {_RULES}, y AS (SELECT *, CASE WHEN large THEN 'large' WHEN velocity THEN 'velocity' WHEN new_card THEN 'new_card' END AS rn FROM x)
        SELECT transaction_id, CASE WHEN large THEN 'block' WHEN rn IS NOT NULL THEN 'review' ELSE 'allow' END AS decision, CASE WHEN rn IS NOT NULL THEN 'rule' ELSE 'default' END AS triggered_by, rn AS rule_name, true AS degraded FROM y""",
    "stream_kpis": f"""WITH {_DECISIONS} SELECT CAST(decided_at AS DATE) AS decision_date, count(*) AS payments_scored, {_of("decision = 'allow'")} AS allowed, {_of("decision = 'review'")} AS sent_to_review, {_of("decision = 'block'")} AS blocked
        FROM attempts GROUP BY 1 HAVING CAST(decided_at AS DATE) + 1 <= (SELECT max(decided_at) - INTERVAL 1 DAY FROM attempts)""",
    "parsed_decisions": f"""WITH {_DECISIONS}, b AS (SELECT * FROM attempts UNION ALL SELECT * REPLACE (decided_at - INTERVAL 1 HOUR AS decided_at, 'allow' AS decision) FROM attempts WHERE transaction_id % 5 = 0)
        SELECT transaction_id, decided_at, CAST(decided_at AS DATE) AS decision_date, decision, round(score, 9) AS score, (rule_name IS NOT NULL)::INT AS n_rules, amount FROM b""",
    "card_day_states": f"""WITH {_PAYMENTS}, s AS (SELECT *, CAST(floor(epoch_us(event_time) / 1000000) AS BIGINT) AS sec FROM payments), l AS (SELECT *, max(sec) OVER (PARTITION BY card_key) AS last FROM s)
        SELECT card_key, count(*) AS n, round(sum(amount), 2) AS total, CAST(count(DISTINCT sec) FILTER (WHERE sec >= last - 86400) AS INTEGER) AS n_recent, string_agg(DISTINCT device_info, ',' ORDER BY device_info) AS devices FROM l GROUP BY card_key""",
    "silver_first_arrivals": f"WITH {_SILVER} SELECT transaction_id, event_time, event_date, transaction_dt, card_token, round(amount, 6) AS amount, product_cd, r_emaildomain, device_info FROM silver",
    "gold": f"WITH {_SILVER}, {_features('silver')} SELECT transaction_id, event_time, event_date, transaction_dt, card_token, {', '.join(FEATURES)}, "
    + ", ".join(c if c in ("product_cd", "r_emaildomain") else f"CAST(NULL AS {'VARCHAR' if c in ('card4', 'card6', 'p_emaildomain', 'device_type') else 'DOUBLE'}) AS {c}" for c in PASSTHROUGH) + " FROM f",
    "bronze_summary": f"WITH {_PAYMENTS} SELECT count(*) AS rows, count(DISTINCT transaction_id) AS transactions, count(DISTINCT card_key) AS cards, min(event_time) AS first_event, max(event_time) AS last_event, count(*) > count(DISTINCT transaction_id) AS has_duplicates FROM payments",
    "rows_per_day": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows FROM events GROUP BY 1",
    "most_recent": f"WITH {_PAYMENTS} SELECT transaction_id, event_time, card_key, amount FROM payments ORDER BY event_time DESC, transaction_id LIMIT 20",
    "payments_from_flat": """SELECT o_orderkey AS transaction_id, TIMESTAMP '2023-01-01' + to_seconds(o_orderkey * 60) AS event_time, o_orderkey * 60 AS transaction_dt,
        CAST(o_custkey AS VARCHAR) || '|' || CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 100 AS VARCHAR) ELSE 'unknown' END || '|' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'unknown' END AS card_key,
        o_totalprice AS amount, o_orderstatus AS product_cd, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS p_emaildomain, CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END AS device_type,
        CASE WHEN o_orderkey % 3 = 0 THEN c_name END AS device_info, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END::INTEGER AS n_counts, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS c1, (o_orderkey % 7)::DOUBLE AS c2
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "messages": f"WITH {_PAYMENTS} SELECT card_key AS key, transaction_id, amount, device_info FROM payments",
    "label_table": f"""WITH {_LABELS}, d AS (SELECT *, CASE WHEN is_fraud = 1 THEN 7 + {_fraction('transaction_id', 42)} * 53 ELSE 60.0::DOUBLE END AS days FROM labels)
        SELECT transaction_id, is_fraud, round(days, 9) AS delay_days, date_trunc('second', label_available_at + to_microseconds(CAST(round(days * 86400000000.0::DOUBLE) AS BIGINT))) AS known_second,
               CASE WHEN is_fraud = 1 THEN 'chargeback' ELSE 'matured' END AS label_source FROM d""",
    "label_summary": f"""WITH {_LABELS} SELECT count(*) AS transactions, {_of(f'label_available_at <= {_NOW}')} AS labels_known, {_of(f'label_available_at > {_NOW}')} AS labels_pending,
        {_of(f'label_available_at <= {_NOW}')} / count(*)::DOUBLE AS known_share, {_of(f'label_available_at <= {_NOW} AND is_fraud = 1')} / {_of(f'label_available_at <= {_NOW}')}::DOUBLE AS fraud_rate_known,
        {_of('is_fraud = 1')} / count(*)::DOUBLE AS fraud_rate_overall FROM labels""",
    "training_set": f"WITH {_TRAIN} SELECT transaction_id, amount, is_fraud, label_available_at, label_is_assumed FROM train WHERE NOT label_is_assumed",
    "training_set_assumed": f"WITH {_TRAIN} SELECT transaction_id, amount, is_fraud, label_available_at, label_is_assumed FROM train",
    "training_summary": f"WITH {_TRAIN} SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud, round(avg(is_fraud), 9) AS fraud_rate, {_of('label_is_assumed')} AS assumed, min(event_time) AS first_event, max(event_time) AS last_event FROM train",
    "fact_decisions": f"WITH {_FACTS} SELECT transaction_id, decided_at, decision, rule_name, amount, label_available_at, is_confirmed_fraud, label_is_known, was_flagged, outcome FROM facts",
    "daily_kpis": f"""WITH {_FACTS} SELECT decision_date, count(*) AS payments_scored, {_of("decision = 'allow'")} AS allowed, {_of("decision = 'review'")} AS sent_to_review, {_of("decision = 'block'")} AS blocked,
        {_of("decision = 'review'")} AS review_queue_size, {_of("triggered_by = 'rule'")} AS decided_by_rule, {_of("triggered_by = 'model'")} AS decided_by_model, {_of('degraded')} AS decided_without_a_model,
        {_of('label_is_known')} AS labels_known, {_of('NOT label_is_known')} AS labels_pending, {_of("outcome = 'fraud_blocked'")} AS fraud_blocked, {_of("outcome = 'fraud_to_review'")} AS fraud_to_review,
        {_of("outcome = 'fraud_missed'")} AS fraud_missed, {_of("outcome = 'false_block'")} AS false_blocks, round({_of("decision = 'review'")}::DOUBLE / count(*), 6) AS review_rate, round({_of("decision = 'block'")}::DOUBLE / count(*), 6) AS block_rate,
        round(sum(amount), 2) AS payment_value, round(sum(amount) FILTER (WHERE decision = 'block'), 2) AS blocked_value, round(median(latency_ms), 2) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 2) AS latency_p95_ms,
        round(quantile_cont(latency_ms, 0.99), 2) AS latency_p99_ms, round(coalesce(sum(amount) FILTER (WHERE outcome IN ('fraud_blocked', 'fraud_to_review')), 0), 2) AS fraud_value_caught,
        round(coalesce(sum(amount) FILTER (WHERE outcome = 'fraud_missed'), 0), 2) AS fraud_value_missed, {_rate("WHERE outcome = 'false_block'", 'WHERE label_is_known AND NOT is_confirmed_fraud')} AS false_positive_rate
        FROM facts GROUP BY decision_date""",
    "model_performance": f"""WITH {_FACTS} SELECT model_version, decision_date, count(*) AS labelled_payments, {_of('is_confirmed_fraud')} AS fraud_count, {_rate("WHERE outcome = 'fraud_blocked'", "WHERE decision = 'block'")} AS precision_at_block,
        {_rate("WHERE outcome = 'fraud_blocked'", 'WHERE is_confirmed_fraud')} AS recall_at_block, {_rate("WHERE outcome IN ('fraud_blocked', 'fraud_to_review')", 'WHERE is_confirmed_fraud')} AS recall_including_review,
        round(coalesce(sum(amount) FILTER (WHERE outcome = 'fraud_missed'), 0), 2) AS fraud_value_missed FROM facts WHERE label_is_known GROUP BY model_version, decision_date""",
    "rule_effectiveness": f"""WITH {_FACTS} SELECT rule_name, count(*) AS times_fired, {_of("decision = 'block'")} AS blocked, {_of("decision = 'review'")} AS sent_to_review, {_of('label_is_known')} AS labels_known, {_of('is_confirmed_fraud')} AS caught_fraud,
        {_rate('WHERE is_confirmed_fraud', 'WHERE label_is_known')} AS hit_rate, round(avg(amount), 2) AS average_amount, round(coalesce(sum(amount) FILTER (WHERE is_confirmed_fraud), 0), 2) AS fraud_value_flagged FROM facts WHERE rule_name IS NOT NULL GROUP BY rule_name""",
    "latest_day": f"WITH {_FACTS} SELECT decision_date, count(*) AS payments_scored, {_of(chr(39).join(['decision = ', 'block', '']))} AS blocked FROM facts GROUP BY decision_date ORDER BY decision_date DESC LIMIT 1",
    "review_queue": f"WITH {_DECISIONS} SELECT transaction_id, decided_at, decision FROM attempts WHERE decision IN ('review', 'block') AND transaction_id % 4 <> 0 ORDER BY decided_at DESC, transaction_id LIMIT 100",
    "flagged_known": f"WITH {_LABELS}, {_DECISIONS} SELECT transaction_id, decision, is_fraud FROM attempts JOIN labels USING (transaction_id) WHERE decision IN ('review', 'block') AND label_available_at <= {_NOW}",
    "confirmed_cases": f"WITH {_LABELS}, {_DECISIONS} SELECT transaction_id, decided_at, decision, is_fraud, model_version AS product_cd FROM attempts JOIN labels USING (transaction_id) WHERE label_available_at <= {_NOW}",
    "case_texts": f"""WITH {_LABELS}, {_DECISIONS} SELECT transaction_id, CASE WHEN amount < 50 THEN 'small' WHEN amount < 250 THEN 'moderate' WHEN amount < 1000 THEN 'large' WHEN amount < 5000 THEN 'very large' ELSE 'exceptional' END
        || ' payment, decision ' || decision || '; product ' || model_version AS description, is_fraud = 1 AS is_fraud FROM attempts JOIN labels USING (transaction_id) WHERE label_available_at <= {_NOW}""",
    "latest_features": "SELECT o_orderkey AS transaction_id, o_totalprice AS amount FROM orders",
    "decision_detail": f"WITH {_FACTS} SELECT f.transaction_id, decision, outcome, is_fraud AS label FROM facts f LEFT JOIN labels USING (transaction_id) WHERE f.transaction_id = 7",
    "latency_report": f"""WITH {_DECISIONS}, b AS (SELECT latency_ms, decision FROM attempts UNION ALL SELECT latency_ms, 'allow' FROM attempts WHERE transaction_id % 5 = 0)
        SELECT count(*) AS requests, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(avg(latency_ms), 6) AS mean, round(max(latency_ms), 6) AS max,
        {_of("decision = 'allow'")} AS allow, {_of("decision = 'review'")} AS review, {_of("decision = 'block'")} AS block FROM b""",
    "early_labels": f"WITH {_FACTS} SELECT transaction_id, label_available_at, is_confirmed_fraud FROM facts WHERE is_confirmed_fraud IS NOT NULL AND label_available_at > {_NOW}",
    "unexplained_decisions": f"WITH {_FACTS} SELECT transaction_id, decision, triggered_by FROM facts WHERE was_flagged AND rule_name IS NULL AND (model_version = 'none' OR score IS NULL)",
    "rules": f"WITH {_RULES} SELECT transaction_id, rule_action, rule_name, matched FROM x",
    "blocklisted": "SELECT event_id AS transaction_id, user_id IN (SELECT user_id FROM events WHERE value > 250) AS on_blocklist FROM events",
    "combined_decisions": f"""WITH {_RULES}, y AS (SELECT *, CASE WHEN rule_action = 'block' THEN NULL ELSE {_fraction('transaction_id', FRAUD_SEED)} END AS s FROM x),
        z AS (SELECT *, CASE WHEN rule_action = 'block' THEN 'block' WHEN s >= 0.95::DOUBLE THEN 'block' WHEN s >= 0.6::DOUBLE THEN 'review' ELSE 'allow' END AS m FROM y)
        SELECT transaction_id, CASE WHEN m = 'allow' AND rule_action = 'review' THEN 'review' ELSE m END AS decision, round(s, 12) AS score, CASE WHEN rule_action = 'block' OR (m = 'allow' AND rule_action = 'review') THEN 'rule' ELSE 'model' END AS triggered_by,
               rule_name, CAST({len(FEATURES)} AS INTEGER) AS n_features, false AS degraded FROM z""",
    "ranking_metrics": f"WITH {_SCORED}, {_CURVE} SELECT pr_auc, roc_auc FROM a",
    "evaluate_model": f"""WITH {_SCORED}, {_CURVE}, {_MADE}, b AS (SELECT count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, {_of("is_fraud = 1 AND made = 'block'")} AS tp, {_of("is_fraud = 0 AND made = 'block'")} AS fp, {_of("is_fraud = 1 AND made = 'review'")} AS rf,
          {_of("made = 'allow'")} AS al, {_of("made = 'review'")} AS re, {_of("made = 'block'")} AS bl, sum(amount) FILTER (WHERE is_fraud = 1) AS v, sum(amount) FILTER (WHERE is_fraud = 1 AND made = 'block') AS vb,
          sum(amount) FILTER (WHERE is_fraud = 1 AND made = 'review') AS vr, sum(amount) FILTER (WHERE is_fraud = 1 AND made = 'allow') AS vm, sum(amount) FILTER (WHERE is_fraud = 0 AND made = 'block') AS lb FROM d)
        SELECT rows, fraud_count, round(fraud_count / rows::DOUBLE, 6) AS fraud_rate, round(tp / (tp + fp)::DOUBLE, 6) AS precision_at_block, round(tp / fraud_count::DOUBLE, 6) AS recall_at_block, round(fp / (rows - fraud_count)::DOUBLE, 6) AS false_positive_rate,
          round((tp + rf) / fraud_count::DOUBLE, 6) AS recall_including_review, round(al / rows::DOUBLE, 6) AS allow_rate, round(re / rows::DOUBLE, 6) AS review_rate, round(bl / rows::DOUBLE, 6) AS block_rate, round((coalesce(vb, 0) + coalesce(vr, 0)) / v, 6) AS fraud_value_caught_share,
          pr_auc, roc_auc, round(v, 1) AS fraud_value_total, round(coalesce(vb, 0), 1) AS fraud_value_blocked, round(coalesce(vm, 0), 1) AS fraud_value_missed, round(coalesce(lb, 0), 1) AS legitimate_value_blocked, round(coalesce(vm, 0) + re * 5 + fp * 25, 1) AS expected_cost FROM b, a""",
    "expected_cost": f"""WITH {_SCORED}, {_MADE} SELECT round(coalesce(sum(amount) FILTER (WHERE is_fraud = 1 AND made = 'allow'), 0), 1) AS missed_fraud_cost, round({_of("made = 'review'")} * 5.0::DOUBLE, 1) AS review_cost,
        round({_of("is_fraud = 0 AND made = 'block'")} * 25.0::DOUBLE, 1) AS false_block_cost, round(coalesce(sum(amount) FILTER (WHERE is_fraud = 1 AND made = 'allow'), 0) + {_of("made = 'review'")} * 5 + {_of("is_fraud = 0 AND made = 'block'")} * 25, 1) AS expected_cost FROM d""",
    "tuned_thresholds": f"""WITH {_SCORED}, t AS (SELECT DISTINCT unnest(quantile_cont(score, [i / 100.0::DOUBLE for i in range(0, 101)])) AS t FROM scored),
        g AS (SELECT t, coalesce(sum(amount / 10000) FILTER (WHERE is_fraud = 1 AND score < t), 0) AS fb, count(*) FILTER (WHERE is_fraud = 0 AND score < t) AS lb, count(*) FILTER (WHERE score < t) AS nb FROM scored, t GROUP BY t),
        w AS (SELECT sum(amount / 10000) FILTER (WHERE is_fraud = 1) AS fa, count(*) FILTER (WHERE is_fraud = 0) AS la FROM scored)
        SELECT round(r.t, 6) AS review_threshold, round(b.t, 6) AS block_threshold, round(r.fb + (b.nb - r.nb) * 5 + (la - b.lb) * 25, 3) AS expected_cost, round(fa, 3) AS baseline_cost FROM g r JOIN g b ON b.t >= r.t, w
        ORDER BY round(r.fb + (b.nb - r.nb) * 5 + (la - b.lb) * 25, 6), r.t, b.t LIMIT 1""",
    "class_weight": f"WITH {_LABELS} SELECT round({_of('is_fraud = 0')} / greatest({_of('is_fraud = 1')}, 1)::DOUBLE, 9) AS positive_weight FROM labels",
    "time_split": f"WITH {_SPLIT} SELECT transaction_id, part FROM split",
    "split_boundaries": f"WITH {_SPLIT} SELECT part, count(*) AS rows, min(event_time) AS first, max(event_time) AS last FROM split GROUP BY part",
    "promotions": """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS version, round(avg(o_totalprice), 2) AS pr_auc FROM orders GROUP BY 1),
        b AS (SELECT *, max(pr_auc) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_before FROM r) SELECT version, pr_auc, champion_before, champion_before IS NULL OR pr_auc > champion_before AS promoted FROM b""",
    "drift_distances": f"""WITH {_WINDOWS}, e AS (SELECT part, 'amount' AS "column", amount AS v FROM win UNION ALL SELECT part, 'transaction_dt', transaction_dt::DOUBLE FROM win),
        c AS (SELECT "column", v, count(*) FILTER (WHERE part = 'reference') AS a, count(*) FILTER (WHERE part = 'current') AS b FROM e GROUP BY ALL),
        k AS (SELECT *, sum(a) OVER o AS sa, sum(b) OVER o AS sb, sum(a) OVER p AS na, sum(b) OVER p AS nb, lead(v) OVER o AS nx FROM c WINDOW o AS (PARTITION BY "column" ORDER BY v), p AS (PARTITION BY "column")),
        d AS (SELECT "column", stddev_samp(v) AS dev FROM e WHERE part = 'reference' GROUP BY 1)
        SELECT "column", CAST(max(na) AS BIGINT) AS n_reference, CAST(max(nb) AS BIGINT) AS n_current, count(*) AS "distinct", round(max(abs(sa / na::DOUBLE - sb / nb::DOUBLE)), 6) AS ks,
               round(sum(coalesce(nx - v, 0) * abs(sa / na::DOUBLE - sb / nb::DOUBLE)) / max(dev), 6) AS scaled_distance FROM k JOIN d USING ("column") GROUP BY "column\"""",
    "drift_categories": f"""WITH {_WINDOWS}, e AS (SELECT part, 'device_info' AS "column", device_info AS v FROM win UNION ALL SELECT part, 'day_of_week', CAST(day_of_week AS VARCHAR) FROM win),
        c AS (SELECT "column", v, count(*) FILTER (WHERE part = 'reference')::DOUBLE AS a, count(*) FILTER (WHERE part = 'current')::DOUBLE AS b FROM e GROUP BY ALL),
        k AS (SELECT *, sum(a) OVER p AS na, sum(b) OVER p AS nb, a / sum(a) OVER p AS x, b / sum(b) OVER p AS y FROM c WINDOW p AS (PARTITION BY "column"))
        SELECT "column", CAST(max(na) AS BIGINT) AS n_reference, CAST(max(nb) AS BIGINT) AS n_current, count(*) AS "distinct",
               round(sqrt(greatest(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 0)), 6) AS js,
               round(sum(CASE WHEN a > 0 THEN (b - nb * x) ** 2 / (nb * x) ELSE b END), 4) AS chi2 FROM k GROUP BY "column\"""",
    "nearest_cases": f"WITH {_COSINE} SELECT query_id, CAST(rank AS INTEGER) AS rank, transaction_id, round(similarity, 6) AS similarity FROM t",
    "retrieval_precision": f"WITH {_COSINE} SELECT query_id, count(*) AS retrieved, count(*) FILTER (WHERE ql = cl) AS matching, round(count(*) FILTER (WHERE ql = cl) / count(*)::DOUBLE, 6) AS precision FROM t GROUP BY query_id",
    "stored_embedders": "SELECT DISTINCT 'given-' || CAST(label % 3 AS VARCHAR) AS embedder FROM embeddings",
    "case_upsert": f"""WITH {_DECISIONS} SELECT transaction_id, amount, CASE WHEN transaction_id % 3 = 0 THEN 'block' ELSE decision END AS decision, CASE WHEN transaction_id % 3 = 0 THEN 'new' ELSE 'old' END AS resolution FROM attempts
        UNION ALL SELECT -transaction_id - 1, amount * 2, 'block', 'new' FROM attempts WHERE transaction_id % 6 = 0""",
    "agreement_rate": f"WITH {_REVIEWS}, r AS (SELECT * FROM reviews ORDER BY decided_at DESC, transaction_id LIMIT 1000) SELECT round(avg(((decision = 'block') = (verdict = 'fraud'))::INT), 9) AS agreement_rate FROM r",
    "review_feedback": f"""WITH {_REVIEWS} SELECT transaction_id, verdict = 'fraud' AS is_fraud, decision, 'analyst_review' AS resolution,
        CASE WHEN amount < 50 THEN 'small' WHEN amount < 250 THEN 'moderate' WHEN amount < 1000 THEN 'large' WHEN amount < 5000 THEN 'very large' ELSE 'exceptional' END || ' payment, decision ' || decision AS description FROM reviews""",
    "recent_reviews": f"WITH {_REVIEWS} SELECT transaction_id, decided_at AS reviewed_at, verdict FROM reviews ORDER BY decided_at DESC, transaction_id LIMIT 50",
    "numbers_in_texts": f"WITH {_NUMBERS} SELECT conv_id, turn, CAST(len(xs) AS INTEGER) AS n, round(coalesce(list_sum(xs), 0), 2) AS total FROM k",
    "ungrounded_numbers": f"""WITH {_NUMBERS} SELECT conv_id, turn, CAST(len([x for x in xs if NOT (x = floor(x) AND abs(x) <= 10) AND NOT (abs(x - conv_id) <= 0.01 OR abs(x - turn) <= 0.01 OR abs(x - 100) <= 0.01
        OR round_even(x, 2) IN (conv_id, turn, 100) OR round_even(x, 0) IN (conv_id, turn, 100))]) AS INTEGER) AS n_unsupported FROM k""",
    "model_matrix": f"""WITH {_PAYMENTS}, {_features('payments')} SELECT transaction_id, amount, card_is_new, CAST(NULL AS DOUBLE) AS "C1", CASE WHEN product_cd = 'click' THEN 'mobile' WHEN product_cd = 'view' THEN 'missing' ELSE 'other' END AS device_type,
        CASE WHEN r_emaildomain IS NULL THEN 'missing' ELSE 'other' END AS r_emaildomain, 'missing' AS p_emaildomain FROM f""",
}

#: The same SQL with every case as a query.
for _name in ("nearest_cases", "retrieval_precision"):
    ORACLE[f"{_name}_all"] = ORACLE[_name].replace(_COSINE, _COSINE.replace(" WHERE q.vec_id % 20 = 0", ""))

from paysift.plans import chains_sql, streams_sql  # noqa: E402

ORACLE |= chains_sql.SQL | streams_sql.SQL
