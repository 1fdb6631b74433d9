from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.operators import cases as C
from paysift.operators import decisions as D
from paysift.operators import drift as DR
from paysift.operators import evaluate as E
from paysift.operators import labels as L
from paysift.operators import layers as LA
from paysift.operators import marts as M
from paysift.operators import model as MO
from paysift.operators import ranking as R
from paysift.operators import responses as RE
from paysift.operators import rules as RU

NOON = datetime(2023, 6, 1, 12, tzinfo=timezone.utc)
AS_OF = "2024-01-01 00:00:00"
SEVEN = [(1000, "block", 1, 500.0), (1001, "review", 1, 300.0), (1002, "allow", 1, 900.0), (1003, "block", 0, 50.0), (1004, "review", 0, 40.0), (1005, "allow", 0, 30.0), (1006, "block", 1, 700.0), (1007, "block", None, 10.0)]
OUTCOMES = ["fraud_blocked", "fraud_to_review", "fraud_missed", "false_block", "false_review", "correctly_allowed", "pending", "correctly_allowed"]


@pytest.fixture(scope="module")
def facts(spark):
    decisions = spark.createDataFrame([(i, NOON, d, "amount_over_hard_limit" if i == 1000 else None, "v1", float(10 + i - 1000), False, "rule" if i == 1000 else "model", a, 0.5) for i, d, _, a in SEVEN], "transaction_id long, decided_at timestamp, decision string, rule_name string, model_version string, latency_ms double, degraded boolean, triggered_by string, amount double, score double")
    labels = spark.createDataFrame([(i, f, NOON, "2033-01-01" if i == 1006 else "2023-07-01") for i, _, f, _ in SEVEN if f is not None], "transaction_id long, is_fraud int, event_time timestamp, day string").select("transaction_id", "is_fraud", "event_time", F.to_timestamp("day").alias("label_available_at"), F.lit("chargeback").alias("label_source"), F.lit(1.0).alias("delay_days"))
    payments = decisions.select("transaction_id")
    return D.fact_decisions(D.staged_decisions(decisions), payments, LA.staged_chargebacks(labels), AS_OF)


def test_outcomes(facts):
    got = {r.transaction_id: r for r in facts.collect()}
    assert [got[i].outcome for i, *_ in SEVEN] == OUTCOMES
    assert got[1006].is_confirmed_fraud is None and got[1006].label_is_known is False and got[1007].label_is_known is None
    assert D.early_labels(facts, AS_OF).count() == 0 and D.unexplained(facts).count() == 0


def test_marts(facts):
    facts = facts.where("transaction_id <> 1007")
    k = M.daily_kpis(facts).first()
    assert (k.payments_scored, k.sent_to_review, k.blocked, k.labels_known, k.labels_pending, k.fraud_value_caught, k.fraud_value_missed) == (7, 2, 3, 6, 1, 800, 900)
    assert k.false_positive_rate == 0.333333 and k.latency_p50_ms == 13
    p = M.model_performance(facts).first()
    assert (p.precision_at_block, p.recall_at_block, p.recall_including_review) == (0.5, 0.333333, 0.666667)
    assert M.rule_effectiveness(facts).first().hit_rate == 1.0
    assert M.daily_kpis(facts.where("transaction_id = 1006")).first().false_positive_rate is None


def test_queue(spark, facts):
    done = spark.createDataFrame([(1000,)], "transaction_id long")
    assert [r.transaction_id for r in M.review_queue(facts, done, 2).collect()] == [1001, 1003]
    assert [r.transaction_id for r in M.review_queue(facts, done, 2, limit_first=True).collect()] == [1001]


@pytest.mark.parametrize("op, value, on_null, on_five", [(">", 4, 0, 1), (">=", 5, 0, 1), ("<", 6, 0, 1), ("<=", 4, 0, 0), ("==", 5, 0, 1), ("!=", 5, 1, 0), ("==", None, 1, 0), ("in", [5, 6], 0, 1), ("in", [None], 1, 0), ("not_in", [5], 1, 0), ("not_in", [None, 1], 0, 1), ("is_null", None, 1, 0), ("not_null", None, 0, 1)])
def test_conditions(spark, op, value, on_null, on_five):
    rows = spark.createDataFrame([(None,), (5,)], "x int")
    got = [r.r for r in rows.select(RU.condition({"x"}, "x", op, value).cast("int").alias("r")).collect()]
    assert got == [on_null, on_five]
    assert rows.select(RU.condition(set(), "gone", op, value).cast("int").alias("r")).first().r == on_null


def test_rules(spark):
    rows = spark.createDataFrame([("bad", 6000.0, 12.0, 0.0, None), ("ok", 6000.0, 1.0, 1.0, "anonymous.com"), ("ok", 1.0, 1.0, 0.0, None), (None, 800.0, 1.0, 0.0, "anonymous.com")], "card_token string, amount double, card_txn_count_10m double, card_is_new double, r_emaildomain string")
    config = RU.DEFAULT_RULES | {"blocklist": {"card_tokens": ["bad"]}}
    got = RU.apply_rules(rows, config).collect()
    assert [(r.rule_action, r.rule_name) for r in got] == [("block", "card_on_blocklist"), ("review", "amount_over_hard_limit"), (None, None), ("review", "anonymous_recipient_high_value")]
    assert got[0].matched_rules == ["card_on_blocklist", "amount_over_hard_limit", "extreme_velocity"] and got[1].matched_rules == ["amount_over_hard_limit", "new_card_large_amount", "anonymous_recipient_high_value"]
    assert RU.apply_rules(rows, {}).first().matched_rules == []


@pytest.mark.parametrize("rule", [{"action": "drop", "when": {"all": [{"field": "a", "op": ">"}]}}, {"action": "block"}, {"action": "block", "when": {"all": []}}, {"action": "block", "when": {"any": [{"field": "a", "op": "~"}]}}])
def test_bad_rules(spark, rule):
    with pytest.raises(ValueError, match="rule"):
        RU.apply_rules(spark.range(1), {"rules": [rule]})


def test_all_faults_are_told_at_once():
    config = {"rules": [{"name": "a", "action": "drop", "when": {"all": [{"field": "x", "op": "~"}, {"op": ">"}]}}, {"action": "block"}, {"action": "block", "when": {"any": [{"field": "x", "op": "is_null"}]}}]}
    told = RU.faults(config)
    assert len(told) == 4 and [t.startswith("rule a:") for t in told] == [True, True, True, False] and told[3].startswith("rule rule_1:")
    assert RU.faults({}) == []


@pytest.mark.parametrize("action, score, want", [("block", 0.1, ("block", "rule", None)), ("review", 0.1, ("review", "rule", 0.1)), ("review", 0.95, ("block", "model", 0.95)), (None, 0.6, ("review", "model", 0.6)), (None, 0.1, ("allow", "model", 0.1))])
def test_combine(spark, action, score, want):
    rows = spark.createDataFrame([(action, "r", "", score)], "rule_action string, rule_name string, rule_description string, model_score double")
    r = D.combine(rows, 0.5, 0.9, "v").first()
    assert (r.decision, r.triggered_by, r.score) == want and not r.degraded
    d = D.combine(rows.drop("model_score"), 0.5, 0.9).first()
    assert d.degraded and d.score is None and d.decision == {"block": "block", "review": "review", None: "allow"}[action]


def test_latest_attempt(spark):
    rows = spark.createDataFrame([(1, NOON, "allow", 1), (1, NOON, "block", 2), (2, NOON, "review", 1)], "transaction_id long, decided_at timestamp, decision string, t int")
    assert {r.transaction_id: r.decision for r in D.latest_attempts(rows, ["t"]).collect()} == {1: "block", 2: "review"}


def test_training_set_never_sees_the_future(spark):
    gold = spark.createDataFrame([(i, datetime(2023, 1, 1 + i, tzinfo=timezone.utc)) for i in range(20)], "transaction_id long, event_time timestamp").withColumn("event_date", F.to_date("event_time"))
    labels = L.label_table(gold.withColumn("is_fraud", (F.col("transaction_id") % 2).cast("int")))
    for day in (10, 40, 90):
        as_of = f"2023-{1 + day // 28:02d}-15 00:00:00"
        for policy in (L.EXCLUDE, L.ASSUME_LEGITIMATE):
            rows = L.training_set(gold, labels, as_of, policy).collect()
            at = datetime.fromisoformat(as_of).replace(tzinfo=None)
            assert all(r.event_time <= at for r in rows)
            assert all(r.label_available_at <= at or r.label_is_assumed and r.is_fraud == 0 for r in rows)
            assert policy != L.EXCLUDE or not any(r.label_is_assumed for r in rows)
    with pytest.raises(ValueError, match="immature"):
        L.training_set(gold, labels, AS_OF, "guess")
    empty = L.label_summary(labels.where("false"), AS_OF).first()
    assert empty.transactions == 0 and empty.known_share == 0


def _scored(spark, rows):
    return spark.createDataFrame(rows, "is_fraud int, score double, amount double")


def test_ranking_metrics(spark):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    order = np.argsort(-s, kind="stable")
    ap = tp = seen = 0
    for v in sorted(set(s), reverse=True):
        at = s == v
        seen, tp = seen + at.sum(), tp + y[at].sum()
        ap += y[at].sum() / y.sum() * tp / seen
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    got = R.ranking_metrics(_scored(spark, [(int(a), float(b), 1.0) for a, b in zip(y[order], s[order])])).first()
    assert got.pr_auc == pytest.approx(ap) and got.roc_auc == pytest.approx(np.mean(pairs))
    assert tuple(R.ranking_metrics(_scored(spark, [(1, 0.5, 1.0)])).first()) == (0.0, 0.0)


def test_thresholds(spark):
    rows = [(1, 0.8, 20.0), (1, 0.4, 5000.0)] + [(0, float(x), 50.0) for x in np.linspace(0, 0.39, 98)]
    best = E.tune_thresholds(_scored(spark, rows)).first()
    assert best.review_threshold <= 0.4
    y, s, a = (np.array(x) for x in zip(*rows))
    cuts, costs = np.unique(np.quantile(s, np.linspace(0, 1, 101))), {}
    for r in cuts:
        for b in cuts[cuts >= r]:
            costs[r, b] = a[(y == 1) & (s < r)].sum() + 5 * ((s >= r) & (s < b)).sum() + 25 * ((y == 0) & (s >= b)).sum()
    assert best.expected_cost == pytest.approx(min(costs.values())) and best.baseline_cost == 5020
    with pytest.raises(ValueError, match="no scored rows"):
        E.tune_thresholds(_scored(spark, []))
    assert E.expected_cost(_scored(spark, rows), 1.1, 1.1).first().expected_cost == 5020
    assert E.expected_cost(_scored(spark, rows), -1, -1).first().expected_cost == 98 * 25
    m = E.evaluate_model(_scored(spark, rows), 0.4, 0.5, dataset="test").first()
    assert m.fraud_value_caught_share == 1 and m.precision_at_block == 1 and m.recall_at_block == 0.5 and m.recall_including_review == 1


def test_split(spark):
    rows = spark.range(100).select(F.col("id").alias("transaction_id"), F.timestamp_seconds(F.col("id") % 10).alias("event_time"))
    parts = {r.part: r.rows for r in R.split_boundaries(R.time_split(rows)).collect()}
    assert parts == {"train": 70, "validation": 15, "test": 15}
    for bad in ((0, 0.1), (0.9, 0.2)):
        with pytest.raises(ValueError):
            R.time_split(rows, *bad)
    assert sorted(r.position for r in R.global_rank(rows, F.col("event_time"), F.col("transaction_id")).collect()) == list(range(100))


def test_promotions(spark):
    runs = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6), (5, 0.8)], "version int, pr_auc double")
    assert [r.promoted for r in E.promotions(runs).orderBy("version").collect()] == [True, False, True, False, True]


@pytest.mark.parametrize("n", [500, 2000])
def test_drift(spark, n):
    rng = np.random.default_rng(9)
    base = [(float(rng.normal(100, 20)), float(rng.poisson(2)), "ab"[i % 2]) for i in range(n)]
    same = [("reference", *r) for r in base] + [("current", *r) for r in base]
    moved = [("reference", *r) for r in base] + [("current", a * 2 + 500, c, "a") for a, c, _ in base]
    schema = "part string, amount double, count double, kind string"
    columns, summary = DR.drift(spark.createDataFrame(same, schema), ["amount", "count", "kind"])
    assert summary.first().columns_drifted == 0
    columns, summary = DR.drift(spark.createDataFrame(moved, schema), ["amount", "count", "kind", "absent"])
    assert summary.first().drifted_columns == ["amount", "kind"] and summary.first().dataset_drift
    with pytest.raises(ValueError, match="share no columns"):
        DR.drift(spark.createDataFrame(same, schema), ["none"])


def test_statistics():
    assert DR._chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and DR._chi2_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert DR._ks_p(1.3580986 / np.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=1e-4)


FEATURES = [(1, 2400.0, {"card_is_new": 1.0, "card_new_device": 1.0}, 1), (2, 2600.0, {"card_is_new": 1.0, "card_new_device": 1.0}, 1), (3, 25.0, {"card_txn_count_24h": 3.0}, 0), (4, 30.0, {"card_txn_count_24h": 2.0}, 0)]


def test_similar_cases(spark):
    rows = spark.createDataFrame(FEATURES, "transaction_id long, amount double, features map<string,double>, is_fraud int")
    rows = rows.withColumn("description", C.describe(F.col("features"), F.col("amount"), F.lit("block"))).withColumn("embedding", C.embed(F.col("description")))
    texts = {r.transaction_id: r for r in rows.collect()}
    assert texts[1].description == "very large payment, decision block; first payment seen on this card; device not seen on this card before"
    assert texts[3].description == "small payment, decision block; 3 payments in 24 hours"
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and len(r.embedding) == 384 for r in texts.values())
    near = {r.query_id: r.transaction_id for r in C.nearest(rows, rows, 1).collect()}
    assert near == {1: 2, 2: 1, 3: 4, 4: 3}
    assert {r.precision for r in C.retrieval_precision(C.nearest(rows, rows, 1), rows).collect()} == {1.0}
    assert C.check_embedder(rows.withColumn("embedder", F.lit("unknown")), "mine") is None
    with pytest.raises(ValueError, match="another|other|stored"):
        C.check_embedder(rows.withColumn("embedder", F.lit("theirs")), "mine")
    empty = spark.createDataFrame([("",), (None,), ("ab",)], "t string").select(C.embed(F.col("t")).alias("e")).collect()
    assert [sum(x != 0 for x in r.e) for r in empty] == [0, 0, 1]


def test_upserts(spark):
    schema = "transaction_id long, card_token string, decision string, resolution string"
    stored, new = spark.createDataFrame([(1, "a", "allow", "x"), (2, "b", "allow", "x")], schema), spark.createDataFrame([(2, "z", "block", None), (3, "c", "block", "y")], schema)
    assert sorted(tuple(r) for r in C.upsert(stored, new).collect()) == [(1, "a", "allow", "x"), (2, "b", "block", None), (3, "c", "block", "y")]
    reviews = spark.createDataFrame([(1, NOON, "ann", "fraud", "n", "block", "v1"), (2, NOON, "bob", "fraud", "n", "review", "v1")], "transaction_id long, reviewed_at timestamp, analyst string, verdict string, note string, platform_decision string, model_version string")
    assert C.agreement_rate(reviews).first().agreement_rate == 0.5 and C.agreement_rate(reviews.where("false")).first().agreement_rate is None
    again = C.upsert_reviews(reviews, reviews.where("transaction_id = 1").withColumns({"verdict": F.lit("legitimate"), "platform_decision": F.lit("allow")}))
    row = again.where("transaction_id = 1").first()
    assert (row.verdict, row.platform_decision) == ("legitimate", "block")


def test_numbers(spark):
    rows = spark.createDataFrame([("paid 1,234.50, 3 times; -3.2 at 0.87 and 847 or 999",)], "t string")
    assert rows.select(RE.numbers_in(F.col("t")).alias("n")).first().n == [1234.5, 3.0, -3.2, 0.87, 847.0, 999.0]
    known = F.array(*[F.lit(x) for x in (1234.5, 847.2, 0.871, -3.2)])
    assert rows.select(RE.unsupported_numbers(F.col("t"), known).alias("n")).first().n == [999.0]


GOOD = '{"summary": "Payment of 500.00 was blocked by the model.", "key_risk_signals": ["new card", " "], "similar_cases": ["42", "43"], "recommended_action": "Investigate further", "confidence": 0.8}'


@pytest.mark.parametrize("text, valid, error", [(GOOD, True, None), ("```json\n" + GOOD + "\n```", True, None), ("no json", False, "no JSON object"), (None, False, "no JSON object"), (GOOD.replace("0.8", "1.8"), False, "confidence"), (GOOD.replace("Investigate further", "pay"), False, "recommended_action"), (GOOD.replace("Payment of 500.00 was blocked by the model.", "short"), False, "summary"), (GOOD.replace('"new card"', '"a","b","c","d","e"'), False, "key_risk_signals")])
def test_responses(spark, text, valid, error):
    r = RE.parse_responses(spark.createDataFrame([(text,)], "response string")).first()
    assert (r.valid, r.error) == (valid, error)
    if valid:
        assert r.parsed.key_risk_signals == ["new card"] and r.parsed.recommended_action == "investigate_further"


def test_grounding_and_report(spark):
    decision = spark.createDataFrame([(7, "card", NOON, "block", 0.95, "model", "", None, 0.5, 0.9, [("amount", "500.0", 1.25, "increases risk")], {"amount": 500.0, "is_night": 1.0})], "transaction_id long, card_token string, decided_at timestamp, decision string, score double, triggered_by string, reason string, rule_name string, review_threshold double, block_threshold double, top_reasons array<struct<feature:string,value:string,contribution:double,direction:string>>, features map<string,double>")
    similar = spark.createDataFrame([(7, 1, 42, 0.9, 480.0, "block", True, NOON, "chargeback")], "query_id long, rank int, transaction_id long, similarity double, amount double, decision string, is_fraud boolean, occurred_at timestamp, resolution string")
    facts = RE.assemble_facts(decision, similar)
    text = facts.select(RE.facts_text(facts).alias("t")).first().t
    assert "- amount: 500.00" in text and "- model score: 0.9500 (review at 0.5000, block at 0.9000)" in text and "- id 42: 2023-06-01: 480.00 block -> confirmed fraud (chargeback), similarity 0.90" in text and "(contribution +1.250)" in text
    assert "SIMILAR PAST CASES: none found." in (f := RE.assemble_facts(decision)).select(RE.facts_text(f).alias("t")).first().t
    rows = RE.parse_responses(facts.withColumn("response", F.explode(F.array(F.lit(GOOD), F.lit(GOOD.replace("500.00", "612.34")), F.lit("x")))).withColumn("latency_ms", F.lit(10.0)))
    checked = RE.grounding(rows)
    got = checked.collect()
    assert [r.unsupported for r in got] == [[], [612.34], None] and [r.invented for r in got] == [["43"], ["43"], None]
    report = RE.response_report(checked).first()
    assert report.responses == 3 and report.schema_validity == pytest.approx(2 / 3) and report.usable == 0 and report.latency_p95_ms == 10


def test_model(spark):
    rng = np.random.default_rng(10)
    rows = [(i, datetime(2023, 1, 1 + i // 30, tzinfo=timezone.utc), float(a := rng.gamma(2, 50)), "W" if i % 3 else None, int(a + rng.normal(0, 10) > 160), {"C1": float(i % 5)}) for i in range(600)]
    frame = spark.createDataFrame(rows, "transaction_id long, event_time timestamp, amount double, product_cd string, is_fraud int, counts map<string,double>")
    matrix = MO.model_matrix(frame)
    assert matrix.columns == ["transaction_id", *MO.COLUMNS] and len(MO.COLUMNS) == 57
    first = matrix.where("transaction_id = 0").first()
    assert first.product_cd == "missing" and first.C1 == 0.0 and first.D1 is None and first.device_type == "missing"
    model, chosen, tested = MO.train_and_test(frame)
    assert tested.first().pr_auc > 0.9 and chosen.first().expected_cost <= chosen.first().baseline_cost
    scored = model.contributions(model.score(MO.model_matrix(frame.limit(20))))
    logits = [(sum(r.contributions.values()), r.model_score) for r in scored.collect()]
    order = np.argsort([a for a, _ in logits])
    assert (np.diff(np.array([s for _, s in logits])[order]) >= -1e-9).all()  # terms add up to the logit, but for a constant
    reasons = MO.top_reasons(scored, flagged=F.col("model_score") > 0.5).collect()
    assert all(len(r.top_reasons) <= 3 and all(x.contribution > 0 for x in r.top_reasons) for r in reasons)
    assert all(not r.top_reasons for r in reasons if r.model_score <= 0.5)
    encoded = spark.createDataFrame([("VISA",), ("Amex",), (None,)], "v string").select(MO.encode(F.col("v"), ["visa", "discover"]).alias("e"), MO.category_index(F.col("v"), ["visa", "discover"]).alias("i")).collect()
    assert [tuple(r) for r in encoded] == [("visa", 0.0), ("other", 2.0), ("missing", 3.0)]
