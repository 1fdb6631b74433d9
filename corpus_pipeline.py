"""A training corpus in five stages: toxicity, near duplicates, repeated passages, benchmark leaks, source mixture.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paysift.llm import toxicity
from paysift.llm.common import table, write_table
from paysift.llm.decontaminate import matches
from paysift.llm.mixing import mix
from paysift.llm.simhash import near_duplicates
from paysift.llm.substring import dedup_substrings


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The labels outside the held-out fold are learned from.

    Null and empty texts are scored as any other, by what the model makes of no words. Rows are judged one by one, so repeated rows,
    or rows without an id, go or stay each by its text; columns beyond those of documents stay, whatever their names.
    Without labels nothing is rejected; no rows give no rows.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=docs.columns).where("predicted = 0")
    return scored.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays; of repeated rows of an id, one.

    Rows without an id can't be told apart and stay; null and empty texts have one fingerprint and are one group. Of repeated rows of an
    id that with the smallest text stays, null last. Other columns stay, whatever their names; no rows give no rows.
    """
    found = write_table(near_duplicates(docs).select("doc_id", "component_id"), "components")
    kept = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        row = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text")))
        place = "_" * (1 + max(map(len, kept.columns)))  # no column has this name
        kept = kept.withColumn(place, row).where((F.col(place) == 1) | F.col("doc_id").isNull()).drop(place)
    return kept.select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows are cut; a text that loses words becomes its kept words. No document goes.

    Null texts stay null and short ones as they are. A null id counts as the largest; rows that share an id don't cut each other, so
    repeated rows stay equal. Other columns stay, whatever their names; no rows give no rows.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the operator's own
    cut = dedup_substrings(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), id_col=names["doc_id"], text_col=names["text"], carry=list(names.values()))
    loses = F.col("n_removed") > 0
    new = {"text": F.when(loses, F.col("kept_text")), "n_chars": F.when(loses, F.char_length("kept_text").cast("long"))}
    return cut.select(*[(F.coalesce(new[c], F.col(n)) if c in new else F.col(n)).alias(c) for c, n in names.items()])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows equal in id and text go together. Without items nothing goes. Other columns stay,
    whatever their names; no rows give no rows.
    """
    hit = matches(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("id", "key").distinct()
    key = F.xxhash64(F.coalesce(docs.text, F.lit("")))
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.id) & (key == hit.key), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: the documents that the mixture takes words of, their texts, and how many words of each it takes, which are
    its first ones, all over again where there are more than it has. Documents without words have none to take. Repeated
    rows, equal in id and text, are one row with what all of them give."""
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    parts = mix(docs).where("taken > 0").groupBy("id", "text_key").agg(
        F.sum("taken").alias("taken"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.count("*").alias("rows")
    )
    parts = write_table(parts, "mixture")
    texts = docs.select("doc_id", text_key.alias("_key"), "text", "lang", "source")
    if not parts.where("rows > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "_key"])
    joined = texts.join(parts, texts.doc_id.eqNullSafe(parts.id) & (texts._key == parts.text_key))
    return joined.select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixture", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
