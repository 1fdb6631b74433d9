"""Models at an operating point, and the cheapest operating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.payments import decide
from paysift.operators.ranking import exact_quantiles, ranking_metrics
from paysift.storage import write_table

REVIEW_COST, FALSE_BLOCK_COST = 5.0, 25.0


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0).cast("double")


def _outcomes(scored: DataFrame, review: float, block: float, score: str, label: str, amount: str) -> dict[str, Column]:
    d, fraud, money = decide(F.col(score), review, block), F.col(label) == 1, F.col(amount)
    total = lambda test: F.coalesce(F.sum(F.when(test, money)), F.lit(0.0))
    return {
        "rows": F.count("*"), "fraud_count": F.count_if(fraud), "tp": F.count_if(fraud & (d == "block")), "fp": F.count_if(~fraud & (d == "block")), "reviewed_fraud": F.count_if(fraud & (d == "review")),
        "allowed": F.count_if(d == "allow"), "reviewed": F.count_if(d == "review"), "blocked": F.count_if(d == "block"), "fraud_value_total": total(fraud), "fraud_value_blocked": total(fraud & (d == "block")),
        "fraud_value_reviewed": total(fraud & (d == "review")), "fraud_value_missed": total(fraud & (d == "allow")), "legitimate_value_blocked": total(~fraud & (d == "block")),
    }


def expected_cost(scored: DataFrame, review: float, block: float, review_cost: float = REVIEW_COST, false_block_cost: float = FALSE_BLOCK_COST, score: str = "score", label: str = "is_fraud", amount: str = "amount") -> DataFrame:
    """One row: what is missed, what review costs, what false blocks cost. Fraud that is reviewed costs the review only."""
    o = _outcomes(scored, review, block, score, label, amount)
    out = scored.agg(o["fraud_value_missed"].alias("missed_fraud_cost"), (o["reviewed"] * review_cost).alias("review_cost"), (o["fp"] * false_block_cost).alias("false_block_cost"))
    return out.withColumn("expected_cost", F.col("missed_fraud_cost") + F.col("review_cost") + F.col("false_block_cost"))


def evaluate_model(
    scored: DataFrame, review: float, block: float, review_cost: float = REVIEW_COST, false_block_cost: float = FALSE_BLOCK_COST, dataset: str = "unknown",
    score: str = "score", label: str = "is_fraud", amount: str = "amount",
) -> DataFrame:
    """One row of ranking, decision and money figures at one operating point; ratios without a base are 0."""
    scored = scored.where(F.col(score).isNotNull())
    base = scored.agg(*[c.alias(n) for n, c in _outcomes(scored, review, block, score, label, amount).items()])
    c = F.col
    fraud, legit = c("fraud_count"), c("rows") - c("fraud_count")
    figures = base.select(
        "rows", "fraud_count", _ratio(fraud, c("rows")).alias("fraud_rate"), F.lit(float(review)).alias("review_threshold"), F.lit(float(block)).alias("block_threshold"),
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision_at_block"), _ratio(c("tp"), fraud).alias("recall_at_block"), _ratio(c("fp"), legit).alias("false_positive_rate"),
        _ratio(c("tp") + c("reviewed_fraud"), fraud).alias("recall_including_review"), _ratio(c("allowed"), c("rows")).alias("allow_rate"), _ratio(c("reviewed"), c("rows")).alias("review_rate"),
        _ratio(c("blocked"), c("rows")).alias("block_rate"), "fraud_value_total", "fraud_value_blocked", "fraud_value_reviewed", "fraud_value_missed",
        _ratio(c("fraud_value_blocked") + c("fraud_value_reviewed"), c("fraud_value_total")).alias("fraud_value_caught_share"), "legitimate_value_blocked",
        (c("fraud_value_missed") + c("reviewed") * review_cost + c("fp") * false_block_cost).alias("expected_cost"), c("fraud_value_total").alias("baseline_cost"),
        F.lit(review_cost).alias("cost_review"), F.lit(false_block_cost).alias("cost_false_block"), F.lit(dataset).alias("dataset"),
    )
    return figures.crossJoin(F.broadcast(ranking_metrics(scored, score, label)))  # one row each


def tune_thresholds(
    scored: DataFrame, review_cost: float = REVIEW_COST, false_block_cost: float = FALSE_BLOCK_COST, grid: int = 101, score: str = "score", label: str = "is_fraud", amount: str = "amount"
) -> DataFrame:
    """One row: the cheapest (review, block) pair of score quantiles; of equal costs the lowest review, then block.

    Rows are counted in the at most grid + 1 steps between candidates; the search runs over those few rows.
    """
    scored = write_table(scored.where(F.col(score).isNotNull()).select(score, label, amount), "scored")  # read three times
    shares = [i / (grid - 1) for i in range(grid)] if grid > 1 else [0.0]
    cuts = sorted(set(exact_quantiles(scored, score, shares)))
    if not cuts:
        raise ValueError("no scored rows to tune on")
    spark = scored.sparkSession
    fraud = F.col(label) == 1
    step = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(score)))
    steps = scored.groupBy(step.alias("step")).agg(F.coalesce(F.sum(F.when(fraud, F.col(amount))), F.lit(0.0)).alias("fraud"), F.count_if(~fraud).alias("legit"), F.count("*").alias("n"))
    candidates = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "step int, threshold double")
    sums = candidates.join(F.broadcast(steps.withColumnRenamed("step", "s")), F.col("s") < F.col("step"), "left").groupBy("step", "threshold").agg(
        F.coalesce(F.sum("fraud"), F.lit(0.0)).alias("fraud_below"), F.coalesce(F.sum("legit"), F.lit(0)).alias("legit_below"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_below")
    )
    whole = steps.agg(F.sum("fraud").alias("fraud_all"), F.sum("legit").alias("legit_all"), F.sum("n").alias("n_all"))
    r, b = sums.alias("r"), sums.alias("b")
    pairs = r.join(F.broadcast(b), F.col("b.threshold") >= F.col("r.threshold")).crossJoin(F.broadcast(whole)).select(  # at most grid * grid rows, and one
        F.col("r.threshold").alias("review_threshold"), F.col("b.threshold").alias("block_threshold"), F.col("r.fraud_below").alias("missed_fraud_cost"),
        ((F.col("legit_all") - F.col("b.legit_below")) * false_block_cost).alias("false_block_cost"), ((F.col("b.n_below") - F.col("r.n_below")) * review_cost).alias("review_cost"),
        ((F.col("b.n_below") - F.col("r.n_below")) / F.col("n_all")).alias("review_rate"), ((F.col("n_all") - F.col("b.n_below")) / F.col("n_all")).alias("block_rate"), F.col("fraud_all").alias("baseline_cost"),
    )
    priced = pairs.withColumn("expected_cost", F.col("missed_fraud_cost") + F.col("review_cost") + F.col("false_block_cost"))
    best = priced.orderBy(F.round("expected_cost", 6), "review_threshold", "block_threshold").limit(1)
    return best.withColumn("cost_reduction", F.when(F.col("baseline_cost") > 0, 1 - F.col("expected_cost") / F.col("baseline_cost")).otherwise(0.0))


def class_weight(rows: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: negatives for each positive, of which there is one at least."""
    return rows.agg((F.count_if(F.col(label) != 1) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).cast("double").alias("positive_weight"))


def mean_contributions(contributions: DataFrame, top: int = 20) -> DataFrame:
    """Features by mean absolute contribution; contributions is a table with a map column `contributions`."""
    each = contributions.select(F.explode("contributions").alias("feature", "x"))
    return each.groupBy("feature").agg(F.avg(F.abs("x")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def promotions(runs: DataFrame) -> DataFrame:
    """runs (version, pr_auc) with champion_before and promoted: a run wins if none was before or it is strictly better."""
    best = F.max("pr_auc").over(Window.orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("champion_before", best).withColumn("promoted", F.col("champion_before").isNull() | (F.col("pr_auc") > F.col("champion_before")))
