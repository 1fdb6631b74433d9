"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "paysift", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf entries have _ for the dots of Spark's names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
