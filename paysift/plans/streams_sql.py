"""SQL of the queries over streams, for DuckDB over the same tables."""

from __future__ import annotations

from paysift.operators.features import FEATURES
from paysift.plans.oracle import _FEATURES, _PAYMENTS, _features

#: Devices and domains that a card still knows, walked payment by payment: a value that is new goes to the end, the first of 21 goes.
_KNOWN = """o AS (SELECT *, row_number() OVER (PARTITION BY card_key ORDER BY epoch_us(event_time) // 1000000, transaction_id) AS place FROM payments),
walk AS (SELECT card_key, place, transaction_id, 0 AS new_device, 0 AS new_domain, 0 AS n_devices, CASE WHEN device_info IS NULL THEN [] ELSE [device_info] END AS devices, CASE WHEN r_emaildomain IS NULL THEN [] ELSE [r_emaildomain] END AS domains FROM o WHERE place = 1
  UNION ALL
  SELECT o.card_key, o.place, o.transaction_id, (o.device_info IS NOT NULL AND NOT list_contains(devices, o.device_info))::INT, (o.r_emaildomain IS NOT NULL AND NOT list_contains(domains, o.r_emaildomain))::INT, CAST(len(devices) AS INTEGER),
         CASE WHEN o.device_info IS NULL OR list_contains(devices, o.device_info) THEN devices ELSE list_append(devices, o.device_info)[-20:] END,
         CASE WHEN o.r_emaildomain IS NULL OR list_contains(domains, o.r_emaildomain) THEN domains ELSE list_append(domains, o.r_emaildomain)[-20:] END
  FROM walk JOIN o ON o.card_key = walk.card_key AND o.place = walk.place + 1)"""
_TOLD = {"card_new_device": "new_device::DOUBLE AS card_new_device", "card_new_email_domain": "new_domain::DOUBLE AS card_new_email_domain", "card_distinct_devices": "n_devices::DOUBLE AS card_distinct_devices"}

_LANDED = f"""{_PAYMENTS.replace('value AS amount', 'CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS amount')}, {_features('payments')}"""

_TERMS = "[('amount', 0.012::DOUBLE * (amount_ - 60)), ('card_txn_count_24h', 0.35::DOUBLE * (n24 - 3)), ('card_new_device', 0.9::DOUBLE * (card_new_device - 0.05::DOUBLE)), ('is_night', 0.6::DOUBLE * (is_night - 0.25::DOUBLE)), ('r_emaildomain', 0.25::DOUBLE * (other - 0.8::DOUBLE)), ('card_amount_avg_lifetime', -0.01::DOUBLE * (coalesce(mean, 0) - 50))]"
_DECIDED = f"""{_PAYMENTS}, {_features('payments')}, x AS (SELECT *, (r_emaildomain IS NOT NULL)::INT::DOUBLE AS other FROM f),
t AS (SELECT *, [e for e in {_TERMS} if e[2] > 0] AS up, 1 / (1 + exp(-(-3.0::DOUBLE + 0.012::DOUBLE * amount_ + 0.35::DOUBLE * n24 + 0.9::DOUBLE * card_new_device + 0.6::DOUBLE * is_night + 0.25::DOUBLE * other - 0.01::DOUBLE * coalesce(mean, 0)))) AS p,
      amount_ >= 200 AS large, n24 >= 8 AS velocity FROM x),
d AS (SELECT *, CASE WHEN NOT large THEN p END AS score, CASE WHEN p >= 0.8::DOUBLE THEN 'block' WHEN p >= 0.35::DOUBLE THEN 'review' ELSE 'allow' END AS by_model FROM t),
e AS (SELECT *, CASE WHEN large THEN 'block' WHEN by_model = 'allow' AND velocity THEN 'review' ELSE by_model END AS decision FROM d)"""

SQL = {
    "stream_ordered_features": _FEATURES,
    "stream_tracked_features": f"""WITH RECURSIVE {_PAYMENTS}, {_features('payments')}, {_KNOWN}
        SELECT transaction_id, {', '.join(_TOLD.get(c, c) for c in FEATURES)} FROM f JOIN walk USING (transaction_id)""",
    "stream_bronze_and_features": f"""WITH {_LANDED} SELECT transaction_id, card_key, CAST(transaction_id % 3 AS INTEGER) AS kafka_partition, transaction_id * 2 AS kafka_offset, event_time, CAST(event_time AS DATE) AS event_date,
        amount, card_txn_count_24h, card_txn_count_lifetime, card_amount_sum_24h FROM f""",
    "stream_audited_decisions": f"""WITH {_DECIDED} SELECT transaction_id, card_key AS card_token, event_time AS decided_at, decision, round(score, 6) AS score,
        CASE WHEN large OR by_model = 'allow' AND velocity THEN 'rule' ELSE 'model' END AS triggered_by, CASE WHEN large THEN 'large' WHEN velocity THEN 'velocity' END AS rule_name,
        concat_ws(',', CASE WHEN velocity THEN 'velocity' END, CASE WHEN large THEN 'large' END) AS matched, 'fixed-1' AS model_version,
        CASE WHEN decision <> 'allow' THEN list_sort([(-e[2], e[1]) for e in up])[1][2] END AS top_reason, CASE WHEN decision <> 'allow' THEN CAST(least(3, len(up)) AS INTEGER) ELSE 0 END AS n_reasons,
        18 AS n_features, amount, false AS degraded FROM e""",
    "stream_clock_expiry": f"""WITH {_PAYMENTS.replace('payments AS', 'given AS')}, b AS (SELECT min(epoch_us(event_time) // 1000000) AS low, max(epoch_us(event_time) // 1000000) AS high FROM given),
        payments AS (SELECT * REPLACE (card_key || CASE WHEN epoch_us(event_time) // 1000000 > (low + high) // 2 THEN ' later' ELSE '' END AS card_key) FROM given, b), {_features('payments')}
        SELECT transaction_id, {', '.join(FEATURES)} FROM f""",
}
