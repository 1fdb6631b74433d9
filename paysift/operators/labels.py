"""Labels that arrive late, and training sets as of a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions import payments as P

EXCLUDE, ASSUME_LEGITIMATE = "exclude", "assume_legitimate"


def label_table(transactions: DataFrame, seed: int = 42, shortest: int = 7, longest: int = 60, maturity: int = 60) -> DataFrame:
    """When each payment's label becomes known. transactions: transaction_id, is_fraud, event_time."""
    fraud = F.col("is_fraud") == 1
    delay = P.label_delay_days(F.col("transaction_id"), fraud, seed, shortest, longest, maturity)
    return transactions.select("transaction_id", F.col("is_fraud").cast("int").alias("is_fraud"), "event_time", delay.alias("delay_days")).select(
        "transaction_id", "is_fraud", "event_time", P.plus_days(F.col("event_time"), F.col("delay_days")).alias("label_available_at"),
        F.when(fraud, "chargeback").otherwise("matured").alias("label_source"), "delay_days",
    )


def by_availability(labels: DataFrame) -> DataFrame:
    return labels.orderBy("label_available_at", "transaction_id")


def _at(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def available_as_of(labels: DataFrame, as_of: datetime | str) -> DataFrame:
    return labels.where(F.col("label_available_at") <= _at(as_of))


def label_summary(labels: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: how much of the labels is usable at that time. Rates without rows are 0."""
    known = F.col("label_available_at") <= _at(as_of)
    out = labels.agg(F.count("*").alias("transactions"), F.count_if(known).alias("labels_known"), F.count_if(known & (F.col("is_fraud") == 1)).alias("_f"), F.count_if(F.col("is_fraud") == 1).alias("_all"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return out.select("transactions", "labels_known", (F.col("transactions") - F.col("labels_known")).alias("labels_pending"), share("labels_known", "transactions").alias("known_share"), share("_f", "labels_known").alias("fraud_rate_known"), share("_all", "transactions").alias("fraud_rate_overall"))


def training_set(gold: DataFrame, labels: DataFrame, as_of: datetime | str, immature: str = EXCLUDE) -> DataFrame:
    """Payments up to as_of with the labels known then.

    Payments whose label is not known yet are left out, or taken as legitimate with label_is_assumed set. A table with
    event_date is pruned by it.
    """
    if immature not in (EXCLUDE, ASSUME_LEGITIMATE):
        raise ValueError(f"immature must be {EXCLUDE!r} or {ASSUME_LEGITIMATE!r}")
    past = gold.where(F.col("event_time") <= _at(as_of))
    if "event_date" in gold.columns:
        past = past.where(F.col("event_date") <= F.to_date(_at(as_of)))
    known = labels.select("transaction_id", "is_fraud", "label_available_at", "label_source")
    joined = past.join(known, "transaction_id")
    ready = F.col("label_available_at") <= _at(as_of)
    joined = joined.where(ready) if immature == EXCLUDE else joined
    return joined.withColumn("label_is_assumed", ~ready).withColumn("is_fraud", F.when(ready, F.col("is_fraud")).otherwise(0)).withColumn("as_of", _at(as_of))


def training_summary(training: DataFrame) -> DataFrame:
    return training.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("is_fraud"), F.lit(0)).cast("long").alias("fraud"), F.coalesce(F.avg("is_fraud"), F.lit(0.0)).alias("fraud_rate"),
        F.count_if("label_is_assumed").alias("assumed"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
    )
