"""Decisions: rules and model combined, audit rows, and what became of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.payments import decide

NO_MODEL = "none"


def combine(rows: DataFrame, review: float, block: float, model_version: str = NO_MODEL, score: str = "model_score") -> DataFrame:
    """rows with rule results and a model score (column `score`, if there is a model) become decisions.

    A block rule decides alone and leaves the score null. A review rule lifts an allow and lowers nothing. Without a
    model the row is degraded and the default is to allow.
    """
    loaded = score in rows.columns
    blocked = F.coalesce(F.col("rule_action") == "block", F.lit(False))
    value = F.when(~blocked, F.col(score)) if loaded else F.lit(None).cast("double")
    by_model = F.coalesce(decide(value, review, block), F.lit("allow"))
    lifted = ~blocked & (by_model == "allow") & F.coalesce(F.col("rule_action") == "review", F.lit(False))
    by_rule = blocked | lifted
    text = F.when(F.length("rule_description") > 0, F.col("rule_description")).otherwise(F.concat(F.lit("rule "), F.col("rule_name")))
    at_or = lambda name, limit: F.format_string(f"model score %.3f at or above the {name} threshold %.3f", value, F.lit(limit))
    scored = F.when(value >= block, at_or("block", block)).when(value >= review, at_or("review", review)).otherwise(F.format_string("model score %.3f below the review threshold %.3f", value, F.lit(review)))
    default = F.lit("no rule matched and the score was below the review threshold")
    return rows.withColumns({
        "score": value, "decision": F.when(blocked, "block").when(lifted, "review").otherwise(by_model),
        "triggered_by": F.when(by_rule, "rule").when(value.isNotNull(), "model").otherwise("default"),
        "reason": F.when(by_rule, text).when(value.isNotNull(), scored).otherwise(default),
        "model_version": F.lit(model_version), "review_threshold": F.lit(float(review)), "block_threshold": F.lit(float(block)), "degraded": F.lit(not loaded),
    })


def audit(decided: DataFrame, features: Sequence[str], decided_at: Column | None = None, latency_ms: Column | None = None) -> DataFrame:
    """The decision record: features as a map, reasons where the row has them, thresholds, version, degraded."""
    reasons = F.col("top_reasons") if "top_reasons" in decided.columns else F.array().cast("array<struct<feature:string,value:string,contribution:double,direction:string>>")
    have = [f for f in features if f in decided.columns]
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in have]), F.array(*[F.col(f).cast("double") for f in have])) if have else F.create_map().cast("map<string,double>")
    return decided.select(
        "transaction_id", "card_token", (decided_at if decided_at is not None else F.current_timestamp()).alias("decided_at"), "decision", "score", "triggered_by", "reason", "rule_name", "matched_rules",
        "model_version", "review_threshold", "block_threshold", F.when(F.col("decision") != "allow", reasons).otherwise(F.slice(reasons, 1, 0)).alias("top_reasons"), values.alias("features"),
        (latency_ms if latency_ms is not None else F.lit(None).cast("double")).alias("latency_ms"), "degraded",
    )


#: What settles equal times if nothing else is said: arrival, then what was decided, so that reruns agree.
TIES = ("kafka_timestamp", "decision", "score", "model_version", "rule_name")


def latest_attempts(decisions: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """The newest decision of each transaction; `ties` are columns, later first, that settle equal times before TIES do."""
    settle = [*ties, *[c for c in TIES if c in decisions.columns and c not in ties]]
    order = [F.desc_nulls_last("decided_at"), *[F.desc_nulls_last(c) for c in settle]]
    return decisions.withColumn("_attempt", F.row_number().over(Window.partitionBy("transaction_id").orderBy(*order))).where("_attempt = 1").drop("_attempt")


def staged_decisions(decisions: DataFrame, ties: Sequence[str] = ("kafka_timestamp",)) -> DataFrame:
    rows = latest_attempts(decisions, [c for c in ties if c in decisions.columns])
    reasons = F.col("top_reasons") if "top_reasons" in rows.columns else F.array().cast("array<struct<feature:string>>")
    return rows.withColumns({"decision_date": F.to_date("decided_at"), "reason_count": F.coalesce(F.size(reasons), F.lit(0)), "top_reason_feature": F.get(reasons, F.lit(0))["feature"]})


def fact_decisions(decisions: DataFrame, payments: DataFrame, chargebacks: DataFrame, as_of: datetime | str, unlabelled: str = "correctly_allowed") -> DataFrame:
    """One row a payment: what was decided and, once its label is known at as_of, what came of it.

    decisions: one row a transaction, with decision_date; payments: staged payments; chargebacks: staged ones. A decision
    without a label row has label_is_known null and the outcome `unlabelled`.
    """
    now = F.lit(as_of).cast("timestamp")
    payments = payments.select("transaction_id", *[c for c in ("amount", "product_cd", "card_brand", "card_type", "payer_email_domain", "device_type") if c in payments.columns and c not in decisions.columns])
    labels = chargebacks.select("transaction_id", F.col("is_fraud").alias("_fraud"), F.col("is_confirmed_fraud").alias("_confirmed"), "label_available_at", "label_source")
    known = F.col("label_available_at") <= now
    fraud, decision = F.col("_fraud"), F.col("decision")
    outcome = F.when(F.col("label_available_at") > now, "pending")
    for label, names in ((1, {"block": "fraud_blocked", "review": "fraud_to_review", "allow": "fraud_missed"}), (0, {"block": "false_block", "review": "false_review"})):
        for made, name in names.items():
            outcome = outcome.when((fraud == label) & (decision == made), name)
    outcome = outcome.when(fraud.isNull(), F.lit(unlabelled)).otherwise("correctly_allowed")
    return (
        decisions.join(payments, "transaction_id", "left").join(labels, "transaction_id", "left")
        .withColumns({"is_confirmed_fraud": F.when(known, F.col("_confirmed")), "label_is_known": known, "was_flagged": decision.isin("block", "review"), "outcome": outcome})
        .drop("_fraud", "_confirmed")
    )


def early_labels(facts: DataFrame, as_of: datetime | str) -> DataFrame:
    """Must be empty: labels shown before they were known."""
    return facts.where(F.col("is_confirmed_fraud").isNotNull() & (F.col("label_available_at") > F.lit(as_of).cast("timestamp"))).select("transaction_id", "label_available_at", "is_confirmed_fraud")


def unexplained(facts: DataFrame) -> DataFrame:
    """Must be empty: flagged decisions with neither a rule nor a scored model behind them."""
    columns = ["transaction_id", "decision", "triggered_by", "rule_name", "model_version", "score"]
    no_model = (F.col("model_version") == NO_MODEL) | F.col("score").isNull()
    return facts.where(F.col("decision").isin("block", "review") & F.col("rule_name").isNull() & no_model).select(*columns)
