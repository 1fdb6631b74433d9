"""The given tables in the shapes of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift import schemas
from paysift.functions import payments as P

AS_OF = "1999-01-01 00:00:00"
SALT = "a salt for tests"
FRAUD_SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_payments(events: DataFrame) -> DataFrame:
    """Events as payments: users are cards, event types devices, the number in props a recipient domain."""
    time = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("transaction_id"), time.alias("event_time"), P.transaction_dt(time).alias("transaction_dt"), F.col("user_id").cast("string").alias("card_key"), F.col("value").alias("amount"),
        F.col("event_type").alias("product_cd"), F.get_json_object("props", "$.k").alias("r_emaildomain"), F.col("event_type").alias("device_info"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_payments(table(spark, sf_dir, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    """Two messages for each event: the second has twice the amount, and the first none where the id divides by 7."""
    rows = as_payments(events).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.when(F.col("transaction_id") % 7 == 0, 0.0).otherwise(F.col("amount"))
    amount = F.when(F.col("copy") == 0, first).otherwise(F.col("amount") * 2)
    rows = rows.withColumn("amount", amount).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    body = F.to_json(F.struct("transaction_id", "event_time", "transaction_dt", "card_key", "amount", "product_cd", "r_emaildomain", "device_info"))
    return rows.select(
        F.col("card_key").cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit("payments").alias("topic"), (F.col("transaction_id") % 3).cast("int").alias("partition"),
        (F.col("transaction_id") * 2 + F.col("copy")).alias("offset"), F.lit("2023-06-01 12:00:00").cast("timestamp").alias("timestamp"),
    )


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each order: fraud if an item was returned, known when the last one was shipped."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("is_fraud"), F.max(F.col("l_shipdate").cast("timestamp")).alias("label_available_at")
    )
    return items.select("transaction_id", "is_fraud", F.col("label_available_at").alias("event_time"), "label_available_at", F.when(F.col("is_fraud") == 1, "chargeback").otherwise("matured").alias("label_source"), F.lit(0.0).alias("delay_days"))


def silver_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as silver rows."""
    orders = table(spark, sf_dir, "orders")
    none: Column = F.lit(None).cast("string")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"), F.md5(F.col("o_custkey").cast("string")).alias("card_token"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.to_date("o_orderdate").alias("event_date"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("product_cd"), none.alias("card4"), none.alias("card6"), none.alias("p_emaildomain"), none.alias("r_emaildomain"), none.alias("device_type"),
    )


def as_decisions(orders: DataFrame) -> DataFrame:
    """Orders as decisions: open ones allowed, pending ones reviewed, finished ones blocked."""
    score = P.fraction(F.col("o_orderkey"), FRAUD_SEED)
    rule = F.when(F.col("o_totalprice") >= 400_000, "very_large").when(F.col("o_totalprice") >= 300_000, "large")
    made = F.when(F.col("o_orderstatus") == "F", "block").when(F.col("o_orderstatus") == "P", "review").otherwise("allow")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"), F.md5(F.col("o_custkey").cast("string")).alias("card_token"), F.col("o_orderdate").cast("timestamp").alias("decided_at"), made.alias("decision"),
        F.when(F.col("o_orderkey") % 11 != 0, score).alias("score"), F.when(rule.isNotNull(), "rule").otherwise("model").alias("triggered_by"), F.lit("").alias("reason"), rule.alias("rule_name"),
        F.when(rule.isNotNull(), F.array(rule)).otherwise(F.array().cast("array<string>")).alias("matched_rules"), F.col("o_orderpriority").alias("model_version"), F.lit(0.5).alias("review_threshold"), F.lit(0.9).alias("block_threshold"),
        F.array().cast(schemas.DECISION["top_reasons"].dataType).alias("top_reasons"), F.create_map(F.lit("amount"), F.col("o_totalprice")).alias("features"),
        (F.col("o_orderkey") % 1000 / 7).alias("latency_ms"), (F.col("o_orderkey") % 13 == 0).alias("degraded"), F.col("o_orderdate").cast("timestamp").alias("kafka_timestamp"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions; every fifth payment was tried an hour before, and allowed."""
    rows = as_decisions(table(spark, sf_dir, "orders"))
    older = rows.where("transaction_id % 5 = 0").withColumns({"decided_at": F.col("decided_at") - F.expr("INTERVAL 1 HOUR"), "decision": F.lit("allow")})
    return rows.unionByName(older)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("transaction_id"), "embedding", F.col("label").alias("is_fraud"), F.concat(F.lit("given-"), (F.col("label") % 3).cast("string")).alias("embedder"))
