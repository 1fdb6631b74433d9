"""Global ranks, running sums, chronological splits and ranking metrics, without a task that sorts everything."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.storage import write_table

_LOW = (1 << 33) - 1


def running_sums(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """rows with running sums (this row included) in a total order.

    Rows are dealt into ranges of the order and written with their range and place; each range's sums give the
    next one its offset. The offsets are one row a range.
    """
    names = list(sums)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()], F.monotonically_increasing_id().alias("_id"))
    placed = write_table(placed, "ranges").withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit(_LOW))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names]).select("_range", *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in names}).join(offsets, "_range")
    return out.select(*rows.columns, *[(F.col(f"_o_{n}") + F.col(f"_s_{n}")).alias(n) for n in names])


def global_rank(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """rows with their place, from 0, in a total order."""
    ranked = running_sums(rows, order, {name: F.lit(1).cast("long")})
    return ranked.withColumn(name, F.col(name) - 1)


def time_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15, time: str = "event_time", key: str = "transaction_id", total: int | None = None) -> DataFrame:
    """rows with column part: train, validation or test by place in time, so parts have predictable sizes."""
    if not 0 < train < 1:
        raise ValueError("train must be between 0 and 1")
    if not 0 < validation < 1 - train:
        raise ValueError("validation must leave room for a test part")
    if time not in rows.columns:
        raise ValueError(f"{time!r} is needed for a split by time")
    n = rows.count() if total is None else total
    first, second = int(n * train), int(n * (train + validation))
    place = F.col("_place")
    ranked = global_rank(rows, F.col(time), F.col(key), name="_place")
    return ranked.withColumn("part", F.when(place < first, "train").when(place < second, "validation").otherwise("test")).drop("_place")


def split_boundaries(split: DataFrame, time: str = "event_time") -> DataFrame:
    return split.groupBy("part").agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")).orderBy("first")


def window_split(rows: DataFrame, reference: float = 0.7, time: str = "event_time", key: str = "transaction_id") -> DataFrame:
    """rows with column part: reference for the older share, current for the rest."""
    cut = int(rows.count() * reference)
    ranked = global_rank(rows, F.col(time), F.col(key), name="_place")
    return ranked.withColumn("part", F.when(F.col("_place") < cut, "reference").otherwise("current")).drop("_place")


def ranking_curve(scored: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """(score, positives, negatives, tp, fp): one row a distinct score, counts at it and from the top down to it."""
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")
    )
    return running_sums(counts, [F.desc("score")], {"tp": F.col("positives"), "fp": F.col("negatives")})


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """One row: pr_auc (average precision) and roc_auc, both 0 unless both classes are there. Null scores are left out.

    Precisions are added as decimals, so the figure does not depend on the order in which tasks end.
    """
    curve = ranking_curve(scored, score, label)
    p, n = F.sum("positives"), F.sum("negatives")
    both = (p > 0) & (n > 0)
    precise = F.sum((F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).cast("decimal(38,20)")).cast("double")
    area = F.sum(F.col("negatives") * (F.col("tp") - F.col("positives") / 2))
    return curve.agg(F.when(both, precise / p).otherwise(0.0).alias("pr_auc"), F.when(both, area / (p * n)).otherwise(0.0).alias("roc_auc"))


def exact_quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Interpolated quantiles by global rank; only the rows at the ranks asked for come to the driver."""
    ranked = global_rank(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), F.col("v"), name="r")
    n = ranked.count()
    if not n:
        return []
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    at = {r.r: r.v for r in ranked.where(F.col("r").isin(wanted)).collect()}
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def group_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float | Column], bins: int = 1024, small: int = 10_000) -> DataFrame:
    """(by..., n, quantiles): the interpolated quantiles of a finite value in each group, at shares that may be columns over n.

    No group is sorted and no buffer holds its values. Every rank that a quantile needs has a stretch of values to lie in,
    at first the whole group. Passes count each stretch in `bins` equal parts and go on with the part that has the rank,
    until a stretch has one value or at most `small` rows, which are then ranked. A pass shuffles counts only. Null and NaN are
    left out; groups without a value have no row. A null group is a group.
    """
    g = [f"_g{i}" for i in range(len(by))]
    given = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, g)], F.col(value).cast("double").alias("_v"))
    base = write_table(given.where(~F.isnan("_v")), "values")
    counts = base.groupBy(*g).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    places = [F.greatest(F.lit(0.0), (s if isinstance(s, Column) else F.lit(float(s))) * (F.col("n") - 1)) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places]))).cast("array<long>")
    counts = write_table(counts.where("n > 0").withColumn("ranks", ranks), "groups")
    wanted = counts.select(*g, F.explode("ranks").alias("r"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"))
    found = None
    of = [*g, "low", "high"]

    def met(left: DataFrame, right: DataFrame, names: Sequence[str], more: Column | None = None) -> DataFrame:
        """left joined with right on names, nulls too, and on a further test; right's names are dropped."""
        right = right.select(*[F.col(c).alias(f"{c}_") if c in names else F.col(c) for c in right.columns])
        test = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names], F.lit(True) if more is None else more)
        return left.join(right, test).drop(*[f"{c}_" for c in names])

    def stretches(of_ranks: DataFrame, *more: str) -> DataFrame:
        """The values in each stretch that a rank still lies in."""
        return met(base, of_ranks.select(*of, *more).distinct(), g, F.col("_v").between(F.col("low"), F.col("high")))

    while True:
        narrow = (F.col("size") <= small) | (F.col("low") == F.col("high"))
        closed, wanted = wanted.where(narrow), wanted.where(~narrow)
        found = closed if found is None else found.unionByName(closed)
        if wanted.isEmpty():
            break
        part = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        cells = stretches(wanted).groupBy(*of, part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("from"), F.max("_v").alias("to"))
        before = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
        start = F.col("below") + F.coalesce("before", F.lit(0))
        hit = met(wanted, cells.withColumn("before", F.sum("c").over(before)), of, (F.col("r") >= start) & (F.col("r") < start + F.col("c")))
        wanted = write_table(hit.select(*g, "r", F.col("from").alias("low"), F.col("to").alias("high"), start.alias("below"), F.col("c").alias("size")), "stretches")
    several = found.where("low < high")
    place = F.col("below") + F.row_number().over(Window.partitionBy(*of).orderBy("_v")) - 1  # at most `small` rows
    ranked = stretches(several, "below").withColumn("place", place).select(*of, "place", F.col("_v").alias("x"))
    ranked = met(several.select(*of, "r"), ranked, of, F.col("r") == F.col("place")).select(*g, "r", "x")
    every = found.where("low = high").select(*g, "r", F.col("low").alias("x")).unionByName(ranked)
    values = every.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("at"))
    at = lambda p: F.col("at")[F.floor(p)] + (F.col("at")[F.ceil(p)] - F.col("at")[F.floor(p)]) * (p - F.floor(p))
    joined = met(counts, values, g)
    return joined.select(*[F.col(n).alias(c) for n, c in zip(g, by)], "n", F.array(*[at(p) for p in places]).alias("quantiles"))
