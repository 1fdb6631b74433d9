"""Queries over streams: event-time order, bounded memory of values, two outputs of a batch, models, expiry by the clock."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.operators import model as MO
from paysift.operators.features import FEATURES
from paysift.plans import inputs as I
from paysift.plans import queries as B
from paysift.sources import ingest as S
from paysift.storage import new_path
from paysift.streaming import cards

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A scoring model by its terms, and rules, for the streams of these queries.
MODEL = MO.LinearModel(
    {"amount": 0.012, "card_txn_count_24h": 0.35, "card_new_device": 0.9, "is_night": 0.6, "r_emaildomain=other": 0.25, "card_amount_avg_lifetime": -0.01}, -3.0,
    {"amount": 60.0, "card_txn_count_24h": 3.0, "card_new_device": 0.05, "is_night": 0.25, "r_emaildomain=other": 0.8, "card_amount_avg_lifetime": 50.0}, "fixed-1",
)
RULES = {"rules": [
    {"name": "velocity", "action": "review", "when": {"all": [{"field": "card_txn_count_24h", "op": ">=", "value": 8}]}},
    {"name": "large", "action": "block", "when": {"all": [{"field": "amount", "op": ">=", "value": 200}]}},
]}


class _Rocks:
    """The state store that the card streams need, while a query runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.conf, self.key = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.conf.get(self.key, None)
        self.conf.set(self.key, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.conf.set(self.key, self.before) if self.before else self.conf.unset(self.key)


def _run(rows: DataFrame, out: str, checkpoint: str) -> None:
    with _Rocks(rows.sparkSession):
        rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ordered_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features in the order of event time, of payments that come in three files, each up to 36 hours late and so in another file's time.

    The stream is started anew for every file and goes on from its checkpoint. A last row of a far later time lets the watermark
    pass every payment.
    """
    events = I.table(spark, sf, "events")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(second), F.max(second)).first()
    arrives = second + F.pmod(F.xxhash64("event_id"), F.lit(36 * 3600)) - low
    dealt = events.withColumn("arrival", F.least(F.lit(2), F.floor(3 * arrives / (high - low + 1))))
    closing = spark.createDataFrame([(-1, -1)], "event_id long, user_id long").withColumn("ts", F.timestamp_seconds(F.lit(high + 30 * 86_400)))
    source, out, state = new_path(spark, "arrivals"), new_path(spark, "ordered"), new_path(spark, "ordered-state")
    for arrival in range(3):
        rows = dealt.where(F.col("arrival") == arrival).drop("arrival")
        if arrival == 2:
            rows = rows.unionByName(closing.withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType)), allowMissingColumns=True)
        rows.write.parquet(f"{source}/{arrival}")
        stream = spark.readStream.schema(events.schema).parquet(f"{source}/*")
        found = cards.stream_features(I.as_payments(stream), ttl_hours=None, tracked=1000, lateness="48 hours")
        _run(found, out, state)
    return spark.read.schema(found.schema).parquet(out).where("transaction_id >= 0").select("transaction_id", *B._rounded())


def stream_tracked_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a stream with the memory that ships: the last 20 devices and domains of a card."""
    stream = cards.stream_features(I.as_payments(B._event_stream(spark, sf)), ttl_hours=None)
    return B._finish(stream, "tracked", store=True).select("transaction_id", *B._rounded())


def stream_bronze_and_features(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze rows and features of the messages of a stream, landed together batch by batch and read back.

    The messages lie in files, of which a trigger takes two; those of a card are in one file.
    """
    source, bronze, features = (new_path(spark, n) for n in ("messages", "landed-bronze", "landed-features"))
    I.as_messages(I.table(spark, sf, "events")).where("offset % 2 = 0").repartition(6, "key").write.parquet(source)
    stream = S.parse_payment_events(S.read_message_stream(spark, source, "parquet", per_trigger=2))
    with _Rocks(spark):
        cards.land_and_fold(stream, bronze, features, new_path(spark, "landed-state")).awaitTermination()
    scored = cards.stream_features(stream, ttl_hours=None)
    landed = cards.read_batches(bronze, stream, done=features).select("transaction_id", "card_key", "kafka_partition", "kafka_offset", "event_time", "event_date", "amount")
    found = cards.read_batches(features, scored).select("transaction_id", "card_txn_count_24h", "card_txn_count_lifetime", F.round("card_amount_sum_24h", 6).alias("card_amount_sum_24h"))
    return landed.join(found, "transaction_id").withColumn("amount", F.round("amount", 6))


def stream_audited_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision records of a stream: model, rules, thresholds, reasons and features in one plan."""
    payments = I.as_payments(B._event_stream(spark, sf))
    carried = F.to_json(F.struct("card_key", "r_emaildomain"))
    features = cards.stream_features(payments, ttl_hours=None, tracked=1000, payload=carried)
    known = F.from_json("payload", "card_key string, r_emaildomain string")
    features = features.select("transaction_id", "event_time", *FEATURES, known["card_key"].alias("card_token"), known["r_emaildomain"].alias("r_emaildomain"))
    records = B._finish(cards.audit_stream(features, RULES, 0.35, 0.8, MODEL), "records", store=True)
    first = F.get("top_reasons", F.lit(0))
    return records.select(
        "transaction_id", "card_token", "decided_at", "decision", F.round("score", 6).alias("score"), "triggered_by", "rule_name", F.concat_ws(",", "matched_rules").alias("matched"), "model_version",
        first["feature"].alias("top_reason"), F.size("top_reasons").alias("n_reasons"), F.size("features").alias("n_features"), F.round(F.col("features")["amount"], 6).alias("amount"), "degraded",
    )


def stream_clock_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Cards that the clock has expired start again: the state lives a millisecond, and the later half of the payments comes in a later run.

    A state that expires by the clock keeps a stream going, so each run is stopped once it has taken its rows.
    """
    events = I.table(spark, sf, "events")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(second), F.max(second)).first()
    source, out, state = new_path(spark, "halves"), new_path(spark, "clock"), new_path(spark, "clock-state")
    for half in range(2):
        rows = events.where((second > (low + high) // 2) == bool(half))
        rows.write.parquet(f"{source}/{half}")
        stream = spark.readStream.schema(events.schema).parquet(f"{source}/*")
        found = cards.stream_features(I.as_payments(stream), ttl_hours=1 / 3_600_000, tracked=1000)
        with _Rocks(spark):
            query = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(processingTime="1 second").start()
            try:
                take_all(query, rows.count())
            finally:
                query.stop()
    return spark.read.schema(found.schema).parquet(out).select("transaction_id", *B._rounded())


def take_all(query, rows: int, seconds: float = 1800) -> None:
    """Waits until a query has taken so many rows and written what came of them."""
    until, taken = time.monotonic() + seconds, {}
    while sum(taken.values()) < rows:
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > until:
            raise TimeoutError(f"{sum(taken.values())} of {rows} rows after {seconds} seconds")
        taken |= {p.batchId: p.numInputRows for p in query.recentProgress}
        time.sleep(0.2)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", None) == __name__ and f.__name__.startswith("stream_")}
