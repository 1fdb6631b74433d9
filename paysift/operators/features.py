"""Behaviour of a card up to each of its payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The features in their order.
FEATURES = [
    "amount", "amount_log", "hour_of_day", "day_of_week",
    "is_night", "has_identity", "card_txn_count_10m", "card_txn_count_1h",
    "card_txn_count_24h", "card_amount_sum_24h", "seconds_since_card_last_txn", "card_amount_avg_lifetime",
    "amount_to_card_avg_ratio", "card_txn_count_lifetime", "card_is_new", "card_new_device",
    "card_new_email_domain", "card_distinct_devices",
]
NO_HISTORY = -1.0
DAY = 86_400


def stateless(payments: DataFrame) -> dict[str, Column]:
    """Features of a payment alone."""
    identity = F.col("device_info").isNotNull()
    if "identity_numeric" in payments.columns:
        identity = identity | (F.size(F.coalesce(F.map_keys("identity_numeric"), F.array().cast("array<string>"))) > 0)
    hour = F.hour("event_time")
    return {
        "amount_log": F.log1p(F.greatest(F.col("amount"), F.lit(0.0))), "hour_of_day": hour.cast("double"), "day_of_week": F.weekday("event_time").cast("double"),
        "is_night": (hour < 6).cast("double"), "has_identity": identity.cast("double"),
    }


def _finish(rows: DataFrame, prior: Column, prior_sum: Column, prior_devices: Column, last: Column) -> dict[str, Column]:
    mean = F.when(prior > 0, prior_sum / prior).otherwise(0.0)
    novel = lambda value, first: (F.col(value).isNotNull() & (prior > 0) & F.col(first)).cast("double")
    return {
        "seconds_since_card_last_txn": F.coalesce((F.col("_second") - last).cast("double"), F.lit(NO_HISTORY)),
        "card_txn_count_lifetime": prior.cast("double"), "card_amount_avg_lifetime": mean,
        "amount_to_card_avg_ratio": F.when(mean > 0, F.col("amount") / mean).otherwise(1.0), "card_is_new": (prior == 0).cast("double"),
        "card_new_device": novel("device_info", "_first_device"), "card_new_email_domain": novel("r_emaildomain", "_first_domain"),
        "card_distinct_devices": prior_devices.cast("double"),
    }


def add_card_features(payments: DataFrame, card: str = "card_token") -> DataFrame:
    """All FEATURES by windows over the card, after one shuffle by card.

    Trailing windows are whole seconds, inclusive at both ends, and hold all payments of the same second; lifetime
    features see the payments before this one in the order of second and transaction id. A device or domain is new where its first
    row is, so no set is kept.
    """
    rows = payments.withColumn("_second", F.col("event_time").cast("timestamp").cast("long"))
    trailing = lambda seconds: Window.partitionBy(card).orderBy("_second").rangeBetween(-seconds, 0)
    order = Window.partitionBy(card).orderBy("_second", "transaction_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda value: F.col(value).isNotNull() & (F.row_number().over(Window.partitionBy(card, value).orderBy("_second", "transaction_id")) == 1)
    rows = rows.withColumns({"_first_device": first("device_info"), "_first_domain": first("r_emaildomain")})
    rows = rows.withColumns({
        "card_txn_count_10m": F.count("*").over(trailing(600)).cast("double"), "card_txn_count_1h": F.count("*").over(trailing(3600)).cast("double"),
        "card_txn_count_24h": F.count("*").over(trailing(DAY)).cast("double"), "card_amount_sum_24h": F.sum("amount").over(trailing(DAY)),
    })
    rows = rows.withColumns({
        "_prior": F.count("*").over(before), "_sum": F.coalesce(F.sum("amount").over(before), F.lit(0.0)),
        "_devices": F.coalesce(F.sum(F.col("_first_device").cast("long")).over(before), F.lit(0)), "_last": F.lag("_second").over(order),
    })
    rows = rows.withColumns(stateless(payments) | _finish(rows, F.col("_prior"), F.col("_sum"), F.col("_devices"), F.col("_last")))
    return rows.select(*payments.columns, *[f for f in FEATURES if f not in payments.columns])


def add_card_features_by_day(payments: DataFrame, card: str = "card_token") -> DataFrame:
    """The same features with a card's history split by day, so that no task holds a whole heavy card.

    A row goes to its own day and, as context of the trailing windows, to the next one. What was before the day comes in as one
    row for each card and day, which also has the devices and domains that the card had not seen before it; so rows are
    joined once, by card and day, and shuffled once more for the windows.
    """
    rows = payments.withColumn("_second", F.col("event_time").cast("timestamp").cast("long")).withColumn("_day", F.floor(F.col("_second") / DAY))
    days = rows.groupBy(card, "_day").agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.max("_second").alias("last"))
    for value, new in (("device_info", "_devices"), ("r_emaildomain", "_domains")):
        first = rows.where(F.col(value).isNotNull()).groupBy(card, value).agg(F.min("_day").alias("_day"))
        days = days.join(first.groupBy(card, "_day").agg(F.collect_list(value).alias(new)), [card, "_day"], "left")
    past = Window.partitionBy(card).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        card, "_day", "_devices", "_domains", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n0"), F.coalesce(F.sum("s").over(past), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum(F.when(F.col("_devices").isNotNull(), F.size("_devices")).otherwise(0)).over(past), F.lit(0)).alias("_d0"), F.max("last").over(past).alias("_l0"),
    )
    both = rows.join(days, [card, "_day"]).withColumn("_at", F.explode(F.array(F.col("_day"), F.col("_day") + 1)))
    trailing = lambda seconds: Window.partitionBy(card, "_at").orderBy("_second").rangeBetween(-seconds, 0)
    order = Window.partitionBy(card, "_at").orderBy("_second", "transaction_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    today = lambda x: F.when(F.col("_day") == F.col("_at"), x)
    first = lambda value, new: F.coalesce(F.array_contains(new, F.col(value)), F.lit(False)) & (F.row_number().over(Window.partitionBy(card, "_at", "_day", value).orderBy("_second", "transaction_id")) == 1)
    both = both.withColumns({"_first_device": first("device_info", "_devices"), "_first_domain": first("r_emaildomain", "_domains")}).withColumns({
        "card_txn_count_10m": F.count("*").over(trailing(600)).cast("double"), "card_txn_count_1h": F.count("*").over(trailing(3600)).cast("double"),
        "card_txn_count_24h": F.count("*").over(trailing(DAY)).cast("double"), "card_amount_sum_24h": F.sum("amount").over(trailing(DAY)),
        "_n1": F.count(today(F.lit(1))).over(before), "_s1": F.coalesce(F.sum(today(F.col("amount"))).over(before), F.lit(0.0)),
        "_d1": F.coalesce(F.sum(today(F.col("_first_device").cast("long"))).over(before), F.lit(0)), "_l1": F.max(today(F.col("_second"))).over(before),
    })
    rows = both.where("_day = _at")
    rows = rows.withColumns(stateless(payments) | _finish(rows, F.col("_n0") + F.col("_n1"), F.col("_s0") + F.col("_s1"), F.col("_d0") + F.col("_d1"), F.coalesce("_l1", "_l0")))
    return rows.select(*payments.columns, *[f for f in FEATURES if f not in payments.columns])
