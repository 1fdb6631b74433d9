"""Queries that leave no row out."""

from pyspark.sql import functions as F

from paysift.operators import decisions as D
from paysift.operators import model as MO
from paysift.plans import inputs as I
from paysift.plans.queries import QUERIES
from tests.conftest import SF


def test_every_case_is_searched(spark):
    stored = {r.transaction_id for r in I.cases(spark, SF).select("transaction_id").collect()}
    found = {r.query_id: r.n for r in QUERIES["nearest_cases_all"](spark, SF).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert found.keys() == stored and set(found.values()) == {5}
    assert {r.query_id for r in QUERIES["retrieval_precision_all"](spark, SF).collect()} == stored


def test_every_payment_is_reviewed(spark):
    paid = {r.transaction_id for r in D.latest_attempts(I.decisions(spark, SF)).select("transaction_id").collect()}
    assert {r.transaction_id for r in QUERIES["review_feedback"](spark, SF).collect()} == paid


def test_day_state_leaves_older_payments_out(spark, tmp_path):
    from datetime import datetime, timedelta

    last = datetime(2023, 6, 3)
    times = [last - timedelta(days=2), last - timedelta(seconds=86_401), last - timedelta(seconds=86_400), last, last, last]
    rows = [(i, t, 7, "view", 1.5, '{"k": 1}') for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    (got,) = QUERIES["card_day_states"](spark, str(tmp_path)).collect()
    assert (got.n, got.total, got.n_recent) == (6, 9.0, 2)


def test_reasons_come_from_a_whole_fit(spark, monkeypatch):
    given, fit = [], MO.fit
    monkeypatch.setattr(MO, "fit", lambda *a, **k: given.append(k) or fit(*a, **k))
    assert QUERIES["explained_decisions"](spark, SF).count() > 0 and given == [{}]
