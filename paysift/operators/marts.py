"""Daily figures, queues and look-ups over decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.operators.ranking import group_quantiles

FLAGGED = ("review", "block")
LATENCY_SHARES = (0.5, 0.95, 0.99)


def _count(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


def _total(value: str, test: str) -> Column:
    return F.coalesce(F.sum(F.when(F.expr(test), F.col(value))), F.lit(0.0))


def _rate(part: Column, whole: Column) -> Column:
    """Null without a whole."""
    return F.when(whole > 0, F.round(part.cast("double") / whole, 6))


def daily_kpis(facts: DataFrame) -> DataFrame:
    """Volumes, latencies and, where labels are known, outcomes of each day."""
    everything, legit = F.count("*"), _count("label_is_known AND NOT is_confirmed_fraud")
    counts = {
        "allowed": "decision = 'allow'", "sent_to_review": "decision = 'review'", "blocked": "decision = 'block'", "review_queue_size": "decision = 'review'", "decided_by_rule": "triggered_by = 'rule'",
        "decided_by_model": "triggered_by = 'model'", "decided_without_a_model": "degraded", "labels_known": "label_is_known", "labels_pending": "NOT label_is_known", "fraud_blocked": "outcome = 'fraud_blocked'",
        "fraud_to_review": "outcome = 'fraud_to_review'", "fraud_missed": "outcome = 'fraud_missed'", "false_blocks": "outcome = 'false_block'",
    }
    latencies = group_quantiles(facts, ["decision_date"], "latency_ms", LATENCY_SHARES).withColumnRenamed("decision_date", "_day")
    latency = [F.round(F.get("quantiles", F.lit(i)), 2).alias(name) for i, name in enumerate(("latency_p50_ms", "latency_p95_ms", "latency_p99_ms"))]
    days = facts.groupBy("decision_date").agg(
        everything.alias("payments_scored"), *[_count(test).alias(name) for name, test in counts.items()],
        _rate(_count("decision = 'review'"), everything).alias("review_rate"), _rate(_count("decision = 'block'"), everything).alias("block_rate"),
        F.sum("amount").alias("payment_value"), F.sum(F.when(F.col("decision") == "block", F.col("amount"))).alias("blocked_value"),
        _total("amount", "outcome IN ('fraud_blocked', 'fraud_to_review')").alias("fraud_value_caught"), _total("amount", "outcome = 'fraud_missed'").alias("fraud_value_missed"),
        _rate(_count("outcome = 'false_block'"), legit).alias("false_positive_rate"),
    )
    at = days.columns.index("fraud_value_caught")
    return days.join(latencies, days.decision_date.eqNullSafe(latencies._day), "left").select(*days.columns[:at], *latency, *days.columns[at:]).orderBy("decision_date")


def model_performance(facts: DataFrame) -> DataFrame:
    """Precision and recall of each model version and day, over known labels only."""
    fraud = _count("is_confirmed_fraud")
    return facts.where("label_is_known").groupBy("model_version", "decision_date").agg(
        F.count("*").alias("labelled_payments"), fraud.alias("fraud_count"), _rate(_count("outcome = 'fraud_blocked'"), _count("decision = 'block'")).alias("precision_at_block"),
        _rate(_count("outcome = 'fraud_blocked'"), fraud).alias("recall_at_block"), _rate(_count("outcome IN ('fraud_blocked', 'fraud_to_review')"), fraud).alias("recall_including_review"),
        _total("amount", "outcome = 'fraud_missed'").alias("fraud_value_missed"),
    ).orderBy("model_version", "decision_date")


def rule_effectiveness(facts: DataFrame) -> DataFrame:
    known = _count("label_is_known")
    return facts.where("rule_name IS NOT NULL").groupBy("rule_name").agg(
        F.count("*").alias("times_fired"), _count("decision = 'block'").alias("blocked"), _count("decision = 'review'").alias("sent_to_review"), known.alias("labels_known"),
        _count("is_confirmed_fraud").alias("caught_fraud"), _rate(_count("is_confirmed_fraud"), known).alias("hit_rate"), F.round(F.avg("amount"), 2).alias("average_amount"),
        _total("amount", "is_confirmed_fraud").alias("fraud_value_flagged"),
    ).orderBy(F.desc("times_fired"), "rule_name")


def latest_day(kpis: DataFrame) -> DataFrame:
    """The newest day's row."""
    return kpis.orderBy(F.desc("decision_date")).limit(1)


def of_version(performance: DataFrame, version: str) -> DataFrame:
    return performance.where(F.col("model_version") == version)


def review_queue(facts: DataFrame, reviewed: DataFrame, limit: int = 100, limit_first: bool = False) -> DataFrame:
    """The newest flagged payments that no analyst has reviewed; limit_first drops reviewed ones after the limit."""
    flagged = facts.where(F.col("decision").isin(*FLAGGED))
    newest = [F.desc("decided_at"), F.asc("transaction_id")]
    done = reviewed.select("transaction_id").distinct()
    if limit_first:
        return flagged.orderBy(*newest).limit(limit).join(done, "transaction_id", "left_anti").orderBy(*newest)
    return flagged.join(done, "transaction_id", "left_anti").orderBy(*newest).limit(limit)


def decision_detail(facts: DataFrame, chargebacks: DataFrame, transaction_id: int) -> DataFrame:
    labels = chargebacks.select("transaction_id", F.col("is_fraud").alias("label"), F.col("label_available_at").alias("label_from"))
    return facts.where(F.col("transaction_id") == transaction_id).join(labels, "transaction_id", "left")


def latest_features(decisions: DataFrame, transaction_id: int | None = None) -> DataFrame:
    """Features and reasons of the newest attempt of a payment, or of each."""
    rows = decisions if transaction_id is None else decisions.where(F.col("transaction_id") == transaction_id)
    return rows.groupBy("transaction_id").agg(F.max_by(F.struct("features", "top_reasons"), F.struct("decided_at", *[c for c in ("kafka_timestamp", "decision", "score") if c in rows.columns])).alias("s")).select("transaction_id", "s.*")


def flagged_known(latest: DataFrame, chargebacks: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """Flagged decisions whose label is known at as_of, by id."""
    labels = chargebacks.where(F.col("label_available_at") <= F.lit(as_of).cast("timestamp")).select("transaction_id", "is_fraud")
    rows = latest.where(F.col("decision").isin(*FLAGGED)).join(labels, "transaction_id").orderBy("transaction_id")
    return rows.limit(limit) if limit else rows


def confirmed_cases(latest: DataFrame, chargebacks: DataFrame, silver: DataFrame, as_of: str, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Decisions with known labels and what silver has of them, in no order without a limit; the limit takes the oldest unless newest_first."""
    labels = chargebacks.where(F.col("label_available_at") <= F.lit(as_of).cast("timestamp")).select("transaction_id", "is_fraud", "label_available_at")
    extra = silver.select("transaction_id", *[c for c in ("product_cd", "device_type") if c in silver.columns and c not in latest.columns])
    rows = latest.join(labels, "transaction_id").join(extra, "transaction_id", "left")
    order = [F.desc("decided_at") if newest_first else F.asc("decided_at"), F.asc("transaction_id")]
    return rows.orderBy(*order).limit(limit) if limit else rows


def bronze_summary(bronze: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    out = bronze.agg(F.count("*").alias("rows"), distinct("transaction_id").alias("transactions"), distinct("card_key").alias("cards"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))
    return out.withColumn("has_duplicates", F.col("rows") > F.col("transactions"))


def daily_sketches(bronze: DataFrame, bits: int = 12) -> DataFrame:
    """A row a day to keep: rows, and mergeable sketches of its transactions and cards (relative error about 1.04 / 2**(bits / 2))."""
    sketch = lambda c: F.hll_sketch_agg(F.col(c).cast("string"), bits)
    return bronze.groupBy(F.to_date("event_time").alias("event_date")).agg(
        F.count("*").alias("rows"), sketch("transaction_id").alias("transactions"), sketch("card_key").alias("cards"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")
    )


def summary_of_days(sketches: DataFrame, unit: Column | None = None) -> DataFrame:
    """Totals over any days of daily_sketches, without reading their rows again: one row, or one a unit such as the month."""
    about = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    groups = sketches.groupBy(*([] if unit is None else [unit.alias("unit")]))
    return groups.agg(F.sum("rows").alias("rows"), about("transactions"), about("cards"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))


def rows_per_day(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy(F.to_date("event_time").alias("event_date")).agg(F.count("*").alias("rows")).orderBy("event_date")


def most_recent(rows: DataFrame, n: int, time: str = "event_time", key: str = "transaction_id") -> DataFrame:
    return rows.orderBy(F.desc(time), key).limit(n)


def latency_report(decisions: DataFrame) -> DataFrame:
    """One row: latency percentiles and how many of each decision."""
    latencies = group_quantiles(decisions, [], "latency_ms", LATENCY_SHARES)
    counts = decisions.agg(
        F.count("*").alias("requests"), F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("max"), *[_count(F.col("decision") == d).alias(d) for d in ("allow", "review", "block")]
    )
    at = [F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(("p50", "p95", "p99"))]
    return counts.join(F.broadcast(latencies), F.lit(True), "left").select("requests", *at, "mean", "max", "allow", "review", "block")  # one row each
