"""Helpers that the training-data operators share: tables, shared folder, text streaming."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.storage import new_path, shared_dir, write_table

__all__ = ["LAST_ID", "crc_mod", "drop_table", "new_path", "ordered_id", "pieces", "raw_texts", "record_batch", "shared_dir", "table", "write_table"]

#: The id that stands for a null one; it sorts after every other.
LAST_ID = 2**63 - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table of write_table() that nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ordered_id(id_col: str) -> Column:
    """The id as a long; null comes last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n, null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def raw_texts(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 of a string column, few rows at a time."""
    binary = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    for at in range(0, len(binary), step):
        yield from binary.slice(at, step).to_pylist()


def pieces(raw: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """raw in order, cut at white space into pieces of about limit bytes; a longer word stays whole."""
    at = 0
    while len(raw) - at > limit:
        cut = _SPACE.search(raw, at + limit)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def record_batch(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
