"""Sources and sinks: payment and decision messages, layer tables, snapshots, flat files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from paysift import schemas
from paysift.functions import payments as P
from paysift.sources.versions import publish, read_version, versions


def read_message_stream(spark: SparkSession, source: str, format: str = "kafka", servers: str | None = None, starting: str = "earliest", per_trigger: int | None = 20_000) -> DataFrame:
    """Messages (key, value, topic, partition, offset, timestamp) of a Kafka topic, or of files of that schema."""
    reader = spark.readStream.format(format)
    if format == "kafka":
        reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", source).option("startingOffsets", starting).option("failOnDataLoss", "false")
        return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()
    reader = reader.schema(schemas.MESSAGE)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(source)


def parse_payment_events(messages: DataFrame) -> DataFrame:
    """Typed bronze rows of messages, batch or stream; rows without a transaction id go, raw payloads stay."""
    value = F.col("value").cast("string")
    return (
        messages.withColumn("event", F.from_json(value, schemas.PAYMENT_EVENT))
        .where("event.transaction_id IS NOT NULL")
        .select(
            "event.*", F.col("key").cast("string").alias("kafka_key"), value.alias("raw_value"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"),
            F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), F.current_timestamp().alias("ingested_at"), F.to_date("event.event_time").alias("event_date"),
        )
    )


def parse_decisions(messages: DataFrame) -> DataFrame:
    """Typed decisions of messages, with their day."""
    return (
        messages.withColumn("d", F.from_json(F.col("value").cast("string"), schemas.DECISION))
        .where("d.transaction_id IS NOT NULL")
        .select("d.*", F.col("timestamp").alias("kafka_timestamp"), F.to_date("d.decided_at").alias("decision_date"))
    )


def append_batch(rows: DataFrame, path: str, day: str, format: str = "parquet") -> None:
    rows.write.format(format).partitionBy(day).mode("append").save(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, day: str, once: bool = False, interval: str = "10 seconds", format: str = "parquet") -> StreamingQuery:
    """An exactly-once file sink by day; a restart from the checkpoint repeats no row."""
    writer: DataStreamWriter = rows.writeStream.format(format).partitionBy(day).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def rebuild(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Replaces the whole table, its schema too; readers have the old one until the new one stands, so rows may come from it."""
    publish(rows, path, partition_by=day)


def read_layer(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A layer's table: its current version if it was rebuilt, else the rows that were appended."""
    return read_version(spark, path) if versions(spark, path) else spark.read.format(format).load(path)


def export_snapshots(spark: SparkSession, tables: Mapping[str, str], out: str, files: int | None = None, format: str = "parquet") -> list[str]:
    """Writes each table that exists to out/name and returns the names; `files` fixes the file count."""
    conf, jvm, done = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm, []
    for name, path in tables.items():
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            rows = read_layer(spark, path, format)
            (rows.coalesce(files) if files else rows).write.mode("overwrite").parquet(f"{out}/{name}")
            done.append(name)
    return done


def publish_marts(marts: Mapping[str, DataFrame], out: str) -> list[str]:
    for name, rows in marts.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
    return list(marts)


def payments_from_flat(transactions: DataFrame, identity: DataFrame | None = None, epoch: str | None = None) -> DataFrame:
    """Payment events of the flat files: identity joined by TransactionID, column blocks folded into maps."""
    if identity is not None:
        transactions = transactions.join(identity, "TransactionID", "left")
    have = set(transactions.columns)
    for c in ["DeviceType", "DeviceInfo", "card2", "card3", "card5", "addr2", "dist1", "dist2", "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain"]:
        if c not in have:
            transactions = transactions.withColumn(c, F.lit(None).cast("string"))
    block = lambda names, kind: P.map_block([c for c in names if c in have], kind) if have & set(names) else F.create_map().cast(f"map<string,{kind}>")
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    text = lambda c, name: F.when(F.trim(F.col(c)) != "", F.col(c)).alias(name)
    return transactions.select(
        F.col("TransactionID").cast("long").alias("transaction_id"), P.event_time(F.col("TransactionDT"), epoch or P.EPOCH).alias("event_time"), F.col("TransactionDT").cast("long").alias("transaction_dt"),
        P.card_key(F.col("card1"), F.col("addr1"), F.col("P_emaildomain")).alias("card_key"), F.col("TransactionAmt").cast("double").alias("amount"), text("ProductCD", "product_cd"),
        F.col("card1").cast("long").alias("card1"), number("card2"), number("card3"), text("card4", "card4"), number("card5"), text("card6", "card6"), number("addr1"), number("addr2"), number("dist1"), number("dist2"),
        text("P_emaildomain", "p_emaildomain"), text("R_emaildomain", "r_emaildomain"), block(schemas.COUNTS, "double").alias("counts"), block(schemas.DELTAS, "double").alias("deltas"),
        block(schemas.VESTA, "double").alias("vesta"), block(schemas.IDENTITY_NUMBERS, "double").alias("identity_numeric"), block(schemas.MATCHES, "string").alias("match_flags"),
        block(schemas.IDENTITY_TEXTS, "string").alias("identity_categorical"), text("DeviceType", "device_type"), text("DeviceInfo", "device_info"),
    )


def to_messages(rows: DataFrame, key: str = "card_key", fields: Iterable[str] | None = None) -> DataFrame:
    """(key, value) of rows, value as JSON; rows of one card share the key and so a partition and an order."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(fields or rows.columns))).alias("value"))
