"""Quantiles of groups by histogram passes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.operators.ranking import group_quantiles

SHARES = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


def want(values, shares=SHARES):
    return np.quantile(np.array(values, float), shares)


@pytest.mark.parametrize("small, bins", [(10_000, 1024), (2, 64)])
def test_groups_equal_plain_quantiles(spark, small, bins):
    rng = random.Random(small)
    kinds = {"even": lambda: float(rng.randrange(10)), "wide": lambda: 10.0 ** rng.uniform(-8, 8), "same": lambda: 4.25, "signed": lambda: rng.gauss(0, 1e-3), None: lambda: float(rng.randrange(-3, 4))}
    rows = [(k, kinds[k]()) for k in kinds for _ in range(rng.randrange(1, 200))] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("nan", float("nan")), ("even", None)]
    frame = spark.createDataFrame(rows, "kind string, v double").withColumn("n", F.lit("a clashing name"))
    got = {r.kind: r for r in group_quantiles(frame, ["kind"], "v", SHARES, bins, small).collect()}
    assert got.keys() == {*kinds, "one", "two"}
    for kind, r in got.items():
        values = [v for k, v in rows if k == kind and v is not None]
        assert r.n == len(values) and np.allclose(r.quantiles, want(values), rtol=1e-9, atol=0)


def test_a_million_distinct_values_in_a_group(spark):
    frame = spark.range(1_000_000).select(F.lit("all").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 7).alias("v")).union(spark.createDataFrame([("few", 1.0)], "g string, v double"))
    got = {r.g: r.quantiles for r in group_quantiles(frame, ["g"], "v", [0.5, 0.95], small=100).collect()}
    assert np.allclose(got["all"], [999_999 * 0.5 / 7, 999_999 * 0.95 / 7], rtol=1e-12) and got["few"] == [1.0, 1.0]


def test_no_group_and_shares_over_n(spark):
    frame = spark.range(101).select(F.col("id").cast("double").alias("v"))
    (row,) = group_quantiles(frame, [], "v", [0.5, 1 / F.col("n")]).collect()
    assert row.n == 101 and np.allclose(row.quantiles, [50.0, 100 / 101])
    assert group_quantiles(frame.limit(0), [], "v", [0.5]).collect() == []
    assert group_quantiles(frame.withColumn("k", F.lit(1)).limit(0), ["k"], "v", [0.5]).collect() == []


def test_reports_hold_no_values(spark):
    """No plan of the three reports has an aggregate that keeps every value."""
    from paysift.plans import queries
    from tests.conftest import SF

    for query in (queries.daily_kpis, queries.latency_report, queries.QUERIES["response_report"]):
        plan = query(spark, SF)._jdf.queryExecution().toString().lower()
        assert "percentile" not in plan
