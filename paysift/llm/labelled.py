"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.llm.common import crc_mod, write_table


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label): at most `bound` labelled rows outside the held-out fold, the same texts once.

    The labels with the least hashes are drawn first, so the side that is broadcast has at most `bound` rows and
    documents are read once without a shuffle. Rows with null ids or labels are left out; an id that is labelled
    twice has the greater label, and so has a text that comes under several ids, with the smallest of them.
    """
    hashed = F.xxhash64("id")
    drawn = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where(crc_mod("id", fold) != held).where("label IS NOT NULL")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(hashed, "id").limit(bound)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = write_table(texts.join(F.broadcast(drawn), "id"), "labelled")
    return found.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")).select("id", "text", "label")
