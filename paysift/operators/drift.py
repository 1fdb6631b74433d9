"""Drift between two windows of a table, column by column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.operators.ranking import running_sums
from paysift.storage import write_table

SMALL, FEW_VALUES = 1000, 5
#: Neighbouring values that one task compares.
BUCKET = 1 << 16


def _ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of a Kolmogorov-Smirnov distance."""
    x = d * math.sqrt(n * m / (n + m))
    return 1.0 if x < 1e-9 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def _chi2_p(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom, by the series of the lower incomplete gamma function."""
    if x <= 0 or k < 1:
        return 1.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= y / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a))))


def numeric_distances(rows: DataFrame, columns: Sequence[str], part: str = "part") -> DataFrame:
    """(column, n_reference, n_current, distinct, ks, wasserstein, deviation) of all columns by one distributed sort."""
    old = F.col(part) == "reference"
    each = rows.select(old.alias("old"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("old", "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    counts = each.groupBy("column", "v").agg(F.count_if("old").alias("a"), F.count_if(~F.col("old")).alias("b"))
    sums = running_sums(counts, [F.col("column"), F.col("v")], {"sa": F.col("a"), "sb": F.col("b"), "r": F.lit(1).cast("long")})
    base = sums.groupBy("column").agg(F.min(F.col("sa") - F.col("a")).alias("a0"), F.min(F.col("sb") - F.col("b")).alias("b0"), F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("distinct"))
    gap = F.abs((F.col("sa") - F.col("a0")) / F.col("na") - (F.col("sb") - F.col("b0")) / F.col("nb"))
    gaps = sums.join(F.broadcast(base), "column").withColumn("gap", F.when((F.col("na") > 0) & (F.col("nb") > 0), gap))
    moved = _with_next(gaps).groupBy("column").agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * (F.col("next") - F.col("v"))), F.lit(0.0)).alias("wasserstein"))
    spread = each.where("old").groupBy("column").agg(F.stddev_samp("v").alias("deviation"))
    return base.select("column", F.col("na").alias("n_reference"), F.col("nb").alias("n_current"), "distinct").join(moved, "column").join(spread, "column", "left")


def _with_next(gaps: DataFrame) -> DataFrame:
    """gaps with next, the column's value after v. Ranks r are dealt into buckets of neighbours; the first value of a bucket,
    one row a bucket, is what follows the last of the bucket before, so no task holds a column and nothing is joined by rank."""
    bucket = F.floor(F.col("r") / BUCKET).alias("bucket")
    inside = Window.partitionBy("bucket").orderBy("r")
    held = gaps.withColumn("bucket", bucket)
    firsts = held.groupBy("bucket").agg(F.min_by(F.struct("column", "v"), "r").alias("first")).select((F.col("bucket") - 1).alias("bucket"), "first")
    after = F.coalesce(F.lead(F.struct("column", "v")).over(inside), F.col("first"))
    return held.join(firsts, "bucket", "left").withColumn("after", after).withColumn("next", F.when(F.col("after.column") == F.col("column"), F.col("after.v"))).drop("after", "first", "bucket")


def category_distances(rows: DataFrame, columns: Sequence[str], part: str = "part") -> DataFrame:
    """(column, n_reference, n_current, distinct, js, chi2): Jensen-Shannon distance and chi-square of value shares."""
    old = F.col(part) == "reference"
    each = rows.select(old.alias("old"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("old", "x.*").where("v IS NOT NULL")
    counts = each.groupBy("column", "v").agg(F.count_if("old").alias("a"), F.count_if(~F.col("old")).alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("distinct"))
    p, q = F.col("a") / F.col("na"), F.col("b") / F.col("nb")
    part_of = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    want = F.col("nb") * (F.col("a") / F.col("na"))
    rows = counts.join(F.broadcast(totals), "column").where("na > 0 AND nb > 0")
    return rows.groupBy("column", F.col("na").alias("n_reference"), F.col("nb").alias("n_current"), "distinct").agg(
        F.sqrt(F.greatest(F.sum(part_of(p) + part_of(q)) / 2, F.lit(0.0))).alias("js"), F.sum(F.when(want > 0, (F.col("b") - want) ** 2 / want).otherwise(F.col("b"))).alias("chi2"),
    )


def drift(rows: DataFrame, columns: Sequence[str], part: str = "part", share: float = 0.3, alpha: float = 0.05, distance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(columns, summary) of rows whose column `part` says reference or current.

    Numeric columns of over FEW_VALUES values: Kolmogorov-Smirnov p under alpha with at most SMALL reference rows, else Wasserstein distance in
    reference deviations of at least `distance`. Others: chi-square p, or Jensen-Shannon distance. The table drifts if at least
    `share` of its columns do. One short row a column comes to the driver.
    """
    columns = [c for c in columns if c in rows.columns]
    if not columns:
        raise ValueError("the windows share no columns")
    rows = write_table(rows.select(part, *columns), "windows")
    numeric = [c for c in columns if isinstance(rows.schema[c].dataType, T.NumericType)]
    found = {r["column"]: r for r in numeric_distances(rows, numeric, part).collect()} if numeric else {}
    few = [c for c in columns if c not in found or found[c]["distinct"] <= FEW_VALUES]
    shares = {r["column"]: r for r in category_distances(rows, few, part).collect()} if few else {}
    table = []
    for c in columns:
        if c not in few:
            r = found[c]
            if r["n_reference"] <= SMALL:
                value = _ks_p(r["ks"] or 0.0, r["n_reference"], r["n_current"])
                table.append((c, "ks", value, value < alpha))
            else:
                value = (r["wasserstein"] or 0.0) / max(r["deviation"] or 0.0, 0.001)
                table.append((c, "wasserstein", value, value >= distance))
        elif c in shares:
            r = shares[c]
            if r["n_reference"] <= SMALL:
                value = _chi2_p(r["chi2"], r["distinct"] - 1)
                table.append((c, "chi2", value, value < alpha))
            else:
                table.append((c, "jensen_shannon", r["js"], r["js"] >= distance))
        else:
            table.append((c, "empty", 0.0, False))
    result = rows.sparkSession.createDataFrame([(a, b, float(v), bool(d)) for a, b, v, d in table], "column string, test string, value double, drifted boolean")
    drifted = F.count_if("drifted")
    summary = result.agg(F.count("*").alias("columns_checked"), drifted.alias("columns_drifted"), (drifted / F.count("*")).alias("drift_share"), (drifted / F.count("*") >= share).alias("dataset_drift"), F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("drifted_columns"))
    return result, summary


def prediction_drift(scores: DataFrame, score: str = "score", least_rows: int = 20) -> DataFrame | None:
    """The summary over the score alone; none with at most least_rows scored rows."""
    scored = scores.where(F.col(score).isNotNull())
    return drift(scored, [score])[1] if scored.count() > least_rows else None
