"""Tables that are replaced as a whole, behind a gate, and tables in buckets of which an upsert rewrites the touched ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from paysift.operators import quality as Q
from paysift.operators.cases import CASE_UPDATES, upsert
from paysift.storage import write_table

MANIFEST, LAYOUT = "_versions", "_layout.json"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _read(spark: SparkSession, path: str) -> dict[str, Any]:
    system, place = _fs(spark, path)
    stream = system.open(place)
    try:
        return json.loads(bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, body: dict[str, Any]) -> None:
    """Writes a file that must not be there yet, whole or not at all: it gets its name once it is written."""
    system, place = _fs(spark, path)
    _, draft = _fs(spark, f"{place.getParent()}/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(body).encode()))
    stream.close()
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(f"{path} was written by another run")


def versions(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """The published versions of a table, oldest first: number, folder, rows, failures."""
    system, place = _fs(spark, f"{path}/{MANIFEST}")
    if not system.exists(place):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(place))
    return [_read(spark, f"{path}/{MANIFEST}/{n}") for n in names if n.endswith(".json") and not n.startswith(".")]


def publish(rows: DataFrame, path: str, suite: Sequence[Q.Expect] = (), partition_by: str | None = None, skip: bool = False) -> dict[str, Any]:
    """Replaces a table by rows, if they meet the suite, and returns the new version.

    The rows are computed once, as they are written to a folder of their own; the suite is counted over what was written, of which only
    its columns are read. Then one small file makes the folder the current version. Until then, and if the suite is not
    met (an error names what is not), readers have the version before, so rows may come from the table itself and have other
    columns. Of two runs at once the later one to end is refused. With skip the suite is counted and noted, and nothing is refused.
    """
    spark = rows.sparkSession
    before = versions(spark, path)
    number, folder = (before[-1]["number"] + 1 if before else 1), f"v-{uuid.uuid4().hex}"
    writer = rows.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    totals, repeated = written.agg(*Q.measures(suite, rows.columns)), Q.repeats(written, suite)
    totals = write_table(totals if repeated is None else totals.crossJoin(F.broadcast(repeated)), "gate")  # one row each
    failures = list(Q.suite_result(Q.report(totals, suite, rows.columns)).first()["failures"]) if suite else []
    if failures and not skip:
        _remove(spark, f"{path}/{folder}")
        raise ValueError(f"the table does not meet {', '.join(failures)}")
    version = {"number": number, "folder": folder, "rows": totals.first()["n"], "failures": failures, "schema": rows.schema.jsonValue()}
    _create(spark, f"{path}/{MANIFEST}/{number:08d}.json", version)
    return version


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current version of a table, or an older one that is still there."""
    found = [v for v in versions(spark, path) if number in (None, v["number"])]
    if not found:
        raise FileNotFoundError(f"{path} has no version {number or ''}".rstrip())
    return spark.read.schema(StructType.fromJson(found[-1]["schema"])).parquet(f"{path}/{found[-1]['folder']}")


def _remove(spark: SparkSession, path: str) -> None:
    system, place = _fs(spark, path)
    system.delete(place, True)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes all but the newest versions, with the folders of runs that were refused or died, and returns their numbers."""
    found = versions(spark, path)
    gone, kept = found[:-keep], {v["folder"] for v in found[-keep:]}
    for v in gone:
        _remove(spark, f"{path}/{MANIFEST}/{v['number']:08d}.json")
    system, place = _fs(spark, path)
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            _remove(spark, f"{path}/{name}")
    return [v["number"] for v in gone]


def create_buckets(rows: DataFrame, path: str, key: str = "transaction_id", buckets: int = 64) -> None:
    """A table in folders by the hash of its key. Keys are unique and not null."""
    _bucketed(rows, key, buckets).write.partitionBy("bucket").parquet(path)
    _create(rows.sparkSession, f"{path}/{LAYOUT}", {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue()})


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with their bucket, dealt by it; a large bucket is split over tasks."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(_read(spark, f"{path}/{LAYOUT}")["schema"])
    return spark.read.schema(schema.add("bucket", IntegerType())).parquet(path)


def upsert_buckets(new: DataFrame, path: str, updates: Sequence[str] = CASE_UPDATES) -> list[int]:
    """Takes new rows into a table of create_buckets, as cases.upsert does, and returns the buckets that it rewrote.

    Only buckets that new rows fall into are read, joined and written; the others' files stay as they are. A bucket is replaced once its
    rows are written. The same upsert can be repeated after a failure. Of new rows that share a key one of the greatest is taken.
    """
    spark = new.sparkSession
    layout = _read(spark, f"{path}/{LAYOUT}")
    key, buckets = layout["key"], layout["buckets"]
    rest = [c for c in new.columns if c != key]
    new = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else new.distinct()
    placed = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())  # at most `buckets` numbers
    if touched:
        stored = read_buckets(spark, path).where(F.col("bucket").isin(touched)).drop("bucket")
        merged = _bucketed(upsert(stored, new, key, updates), key, buckets)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched
