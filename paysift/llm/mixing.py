"""Mixing sources to target weights: hash order, distributed prefix sums, exact cuts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.llm.common import write_table

#: Hexadecimal digits of a key that name its range, so 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table of (source, source_size), one row a source.

    Sources in code point order, null last, get weights in turn and share `share` of all sizes. No target is over
    `most` times its source's size; the excess goes to the others by weight. So target = min(most * size, level *
    weight) for one level: sources are full in the order of size / weight, and level is what is left over the rest.
    Empty sources have target 0.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("full_size", F.coalesce(F.sum("source_size").over(fill), F.lit(0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    )
    level = (share * F.col("all") - most * F.col("full_size")) / (F.col("weights") - F.col("full_weight"))
    # the first source in fill order that its level does not fill, and all after it, stay at that level
    rows = rows.withColumn("level", level).withColumn("open", F.min(F.when(F.col("level") <= most * F.col("ratio"), F.col("ratio"))).over(everything))
    final = F.max(F.when(F.col("ratio") == F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(
        F.col("open").isNull() | (F.col("ratio") < F.col("open")), most * F.col("source_size").cast("double")
    ).otherwise(F.least(most * F.col("source_size"), F.col("final") * F.col("weight")))
    return rows.withColumn("final", final).select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken; also _source, the hash key and text_key, a hash of the text.

    A source gives floor(target) words: as many whole epochs as fit, then the rows first in hash order, the last
    of them in part. Hash keys of the ids put the rows of a source in order; the leading digits of a key are its
    range, so a source of any size is dealt into ranges, whose sums give every range its offset, and no task
    sorts a whole source. Null texts have size 0; a null source is a source, the last; rows with equal ids are
    ordered by size. Reruns agree. Other columns are ignored; no rows give no rows.
    """
    text = F.col(text_col).cast("string")
    # rows without an id are told apart by their texts, so that they are spread over the ranges as well
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    rows = write_table(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
        ),
        "sizes",
    )
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    part = F.substring("key", 1, RANGE_DIGITS)
    ranges = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    plan = offsets.join(goal, offsets.source.eqNullSafe(goal.source)).select(
        offsets.source.alias("_source"), F.col("part").alias("_part"), "offset", "source_size", "target"
    )
    order = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = placed.join(plan, placed.source.eqNullSafe(plan._source) & (placed.part == plan._part))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select("id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("source").alias("_source"), "key", "text_key")
