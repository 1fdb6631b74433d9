"""Silver and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.payments import card_token
from paysift.operators.features import FEATURES, add_card_features, add_card_features_by_day

#: The columns of silver, and of gold besides its features.
SILVER = [
    "transaction_id", "event_time", "event_date", "transaction_dt", "card_token", "amount",
    "product_cd", "card3", "card4", "card5", "card6", "dist1",
    "dist2", "p_emaildomain", "r_emaildomain", "counts", "deltas", "match_flags",
    "vesta", "identity_numeric", "identity_categorical", "device_type", "device_info", "ingested_at",
]
PASSTHROUGH = [
    "product_cd", "card3", "card4", "card5", "card6", "dist1",
    "dist2", "p_emaildomain", "r_emaildomain", "device_type",
]
KEYS = [
    "transaction_id", "event_time", "event_date", "transaction_dt", "card_token",
]


def first_arrivals(bronze: DataFrame) -> DataFrame:
    """The row of each transaction that arrived first, by partition and offset."""
    arrival = Window.partitionBy("transaction_id").orderBy("kafka_partition", "kafka_offset")
    return bronze.withColumn("_arrival", F.row_number().over(arrival)).where("_arrival = 1").drop("_arrival")


def to_silver(bronze: DataFrame, salt: str) -> DataFrame:
    """First arrivals with positive amounts, cards as tokens, raw card columns gone. A first arrival without a
    positive amount removes its payment, whatever arrives later."""
    return first_arrivals(bronze).where("amount > 0").withColumn("card_token", card_token(F.col("card_key"), salt)).select(*SILVER)


def to_gold(silver: DataFrame, by_day: bool = True) -> DataFrame:
    """Keys, features, passed-through columns and maps of each payment.

    by_day splits each card by day, so that a card with very many payments is not one task; without it there is one shuffle less.
    """
    return (add_card_features_by_day if by_day else add_card_features)(silver).select(*KEYS, *FEATURES, *PASSTHROUGH, "counts", "deltas", "match_flags")


def staged_payments(silver: DataFrame) -> DataFrame:
    return silver.select(
        "transaction_id", "card_token", "event_time", F.to_date("event_time").alias("payment_date"), "amount", "product_cd", F.col("card4").alias("card_brand"), F.col("card6").alias("card_type"),
        F.col("p_emaildomain").alias("payer_email_domain"), F.col("r_emaildomain").alias("recipient_email_domain"), "device_type",
    )


def staged_chargebacks(chargebacks: DataFrame) -> DataFrame:
    return chargebacks.select(
        "transaction_id", "is_fraud", F.col("is_fraud").cast("boolean").alias("is_confirmed_fraud"), "event_time", "label_available_at",
        F.to_date("label_available_at").alias("label_available_date"), "label_source", "delay_days",
    )
